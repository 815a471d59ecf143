"""BPE encoding and decoding by forced boundaries, for vocabularies with an end-of-word sign.

A pair of neighbouring symbols that stands inside no vocabulary token can never be merged, nor anything across it: it
is a certain cut. The different words of a batch are laid end to end and cut at all such pairs at once; each different
fragment is encoded independently, and fragments' ids are joined again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks
from tidemark.llm.kernels import distinct_spans, spread, words
from tidemark.llm.tokens import byte_letters

#: White_Space characters beyond ASCII; splitting by ASCII white space comes first.
_WIDE = regex.compile(r"[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Kinds of bytes of plain words: 0 letters, 1 digits, 2 other signs; 3 marks words that need the full pattern.
_KIND = np.full(256, 3, np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = 1
_KIND[65:91] = _KIND[97:123] = 0
_KIND[[39, 60]] = 3  # contractions and special tokens begin with these
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that UTF-8 never has, to tell kinds of fragments apart.
_FINAL, _SPECIAL = b"\xff", b"\xfe"


class ForcedBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.vocab, **self.specials}.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        #: joined[0 or 1, x, y]: bytes x and y stand side by side inside some token (1: y ends the word); all others are forced boundaries
        self.joined = np.zeros((2, 256, 256), bool)
        byte = {c: b for b, c in self.letters.items()}
        for token in self.vocab:
            s = self.symbols(token)
            for x, y in zip(s, s[1:], strict=False):
                last = len(y) > 1
                if x in byte and y[:1] in byte:
                    self.joined[int(last), byte[x], byte[y[:1]]] = True
        #: ids of single bytes, inside a word and at its end; merges as sorted pairs of ids
        self.single = [np.array([self.vocab.get(self.letters[b] + end, -1) for b in range(256)], np.int64) for end in ("", self.end)]
        key = np.array([(self.vocab[a] << 32) | self.vocab[b] for a, b in self.rank], np.int64)
        self.pair_rank = np.argsort(key)
        self.pairs = key[self.pair_rank]
        self.into = np.array([self.vocab[a + b] for a, b in self.rank], np.int64)
        self.cache: dict[bytes, list[int]] = {}

    def symbols(self, token: str) -> list[str]:
        """A token's symbols: its letters, the last one together with the end-of-word sign if it has that."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            s = list(token[: -len(self.end)])
            return [*s[:-1], s[-1] + self.end]
        return list(token)

    def merge_long(self, s: list[str]) -> list[int]:
        """BPE of one fragment by a heap over linked symbols: the lowest-ranked pair first, the leftmost of equals."""
        n, s = len(s), list(s)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, s[k], s[k + 1]) for k in range(n - 1) if (r := self.rank.get((s[k], s[k + 1]))) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = nxt[k] if live[k] else -1
            if j < 0 or s[k] != a or s[j] != b:
                continue
            s[k], live[j], nxt[k] = a + b, False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = k
            for x, y in ((prv[k], k), (k, nxt[k])):
                if x >= 0 and y >= 0 and (r := self.rank.get((s[x], s[y]))) is not None:
                    heapq.heappush(heap, (r, x, s[x], s[y]))
        return [self.vocab[s[k]] for k in range(n) if live[k]]

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the number of merges where there is none."""
        key = (x << 32) | y
        spot = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        return np.where(self.pairs[spot] == key, self.pair_rank[spot], len(self.into)) if len(self.pairs) else np.zeros(len(key), np.int64)

    def merge_many(self, s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many fragments end to end (ids of single symbols, sizes): each round merges one pair in each of them."""
        none, f = len(self.into), np.repeat(np.arange(len(size)), size)
        r = np.full(len(s), none, np.int64)
        inner = np.flatnonzero(f[1:] == f[:-1])
        r[inner] = self.ranks(s[inner], s[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(s):
            new = np.ones(len(f), bool)
            new[1:] = f[1:] != f[:-1]
            low = np.minimum.reduceat(r, np.flatnonzero(new))[np.cumsum(new) - 1]
            over = low == none
            if over.any():
                done.append((f[over], s[over]))
                s, f, r, low = s[~over], f[~over], r[~over], low[~over]
            k = np.flatnonzero(r == low)
            if not len(k):
                continue
            k = k[np.append(True, f[k[1:]] != f[k[:-1]])]
            s[k] = self.into[r[k]]
            keep = np.ones(len(s), bool)
            keep[k + 1] = False
            s, f, r = s[keep], f[keep], r[keep]
            k -= np.arange(len(k))
            r[k] = none
            left, right = k[(k > 0) & (f[k - 1] == f[k])] - 1, k[np.append(f[1:], -1)[k] == f[k]]
            for at in (left, right):
                r[at] = self.ranks(s[at], s[at + 1])
        if not done:
            return s, np.zeros(0, np.int64)
        f, s = (np.concatenate(x) for x in zip(*done, strict=True))
        return s[np.argsort(f, kind="stable")], np.bincount(f, minlength=len(size))

    def fragments(self, keys: list[bytes]) -> list[list[int]]:
        """ids of fragments: each key is its bytes, then its sign if it ends a word or is a special token."""
        new = [x for x in dict.fromkeys(keys) if x not in self.cache]
        if len(self.cache) + len(new) > 300_000:
            self.cache, new = {}, list(dict.fromkeys(keys))
        short = []
        for x in new:
            if x[-1:] == _SPECIAL:
                self.cache[x] = [self.specials[x[:-1].decode()]]
            elif len(x) > 64:
                s = [self.letters[b] for b in x.removesuffix(_FINAL)]
                if x[-1:] == _FINAL:
                    s[-1] += self.end
                self.cache[x] = self.merge_long(s)
            else:
                short.append(x)
        if short:
            raw = np.frombuffer(b"".join(short), np.uint8)
            size = np.array([len(x) for x in short], np.int64)
            ends = np.cumsum(size) - 1
            final = raw[ends] == _FINAL[0]
            symbol = self.single[0][raw]
            symbol[ends[final] - 1] = self.single[1][raw[ends[final] - 1]]
            keep = np.ones(len(raw), bool)
            keep[ends[final]] = False
            ids, count = self.merge_many(symbol[keep], size - final)
            ids, upto = ids.tolist(), np.cumsum(count).tolist()
            for x, a, b in zip(short, [0, *upto], upto, strict=False):
                self.cache[x] = ids[a:b]
        return [self.cache[x] for x in keys]

    def pretokens(self, text: str) -> Iterator[tuple[bytes, bool]]:
        """(bytes, whether a special token) of the parts of one word by the file's full rules."""
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.specials:
                yield part.encode(), True
            elif part:
                part = _WIDE.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
                for w in self.words.findall(part):
                    yield w.encode(), False

    def encode_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, how many each has). Words hold no ASCII white space and are not empty."""
        size = np.array([len(x) for x in raw], np.int64)
        buf = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(size) - size
        kind = _KIND[buf]
        odd = np.add.reduceat(kind == 3, first) > 0 if len(raw) else np.zeros(0, bool)
        # plain words: a part is a run of letters or of other signs, or one digit
        own = np.flatnonzero(~odd)
        place = spread(first[own], size[own])
        text, kind = _LOWER[buf[place]], kind[place]
        begin = kind == 1
        begin[1:] |= kind[1:] != kind[:-1]
        begin[np.cumsum(size[own]) - size[own]] = True
        start = np.flatnonzero(begin)
        who = np.repeat(own, size[own])[start]
        parts, owner, special = [], [], []
        for i in np.flatnonzero(odd).tolist():
            for part, is_special in self.pretokens(raw[i].decode("utf-8", "replace")):
                parts.append(part)
                owner.append(i)
                special.append(is_special)
        more = np.array([len(x) for x in parts], np.int64)
        start = np.concatenate([start, len(text) + np.cumsum(more) - more])
        who = np.concatenate([who, np.array(owner, np.int64)])
        whole = np.concatenate([np.zeros(len(who) - len(parts), bool), np.array(special, bool)])
        text = np.concatenate([text, np.frombuffer(b"".join(parts), np.uint8)])
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        # forced boundaries, of all parts at once
        last = np.zeros(len(text), np.int64)
        last[np.append(start[1:], len(text)) - 1] = 1
        cut = np.ones(len(text), bool)
        cut[1:] = ~self.joined[last[1:], text[:-1], text[1:]]
        if whole.any():
            cut[spread(start[whole], np.append(start[1:], len(text))[whole] - start[whole])] = False
        cut[start] = True
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(text))
        part = np.searchsorted(start, a, "right") - 1
        sign = np.where(whole[part], 2, last[b - 1])
        data, ids, number = text.tobytes(), [], np.empty(len(a), np.int64)
        for s, mark in enumerate((b"", _FINAL, _SPECIAL)):
            mine = np.flatnonzero(sign == s)
            pick, back = distinct_spans(text, a[mine], b[mine])
            number[mine] = len(ids) + back
            ids += self.fragments([data[x:y] + mark for x, y in zip(a[mine[pick]].tolist(), b[mine[pick]].tolist(), strict=True)])
        width = np.array([len(x) for x in ids], np.int64)
        flat = np.array([y for x in ids for y in x], np.int64)
        order = np.argsort(who[part], kind="stable")
        number = number[order]
        out = flat[spread((np.cumsum(width) - width)[number], width[number])]
        return out, np.bincount(who[part], weights=width_of(width, number, order), minlength=len(raw)).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        """ids of a whole text."""
        raw = [w for w in regex.split(rb"[\x20\x09-\x0d]+", text.encode()) if w]
        return self.encode_words(raw)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's token strings joined by blanks: the file names no decoder."""
        return " ".join([self.names[i] for i in ids])


def width_of(width: np.ndarray, number: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ids of each fragment, in the order of the text."""
    out = np.empty(len(order), np.int64)
    out[order] = width[number]
    return out


_models: dict[str, ForcedBpe] = {}


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256; with ids=True also ids array<int> and decoded.

    Special tokens written in a text count as such. A null text is an empty one: no ids, hashes of no bytes. Long texts
    and long words are encoded whole. Repeated rows are encoded alike; an empty table gives no rows. Extra
    columns are ignored. Nothing is shuffled. Words and fragments are told apart by their bytes; each different word of a
    task is encoded once, as long as no more than 300,000 are held. A null key stays null.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _models:
            _models[tokenizer] = ForcedBpe(tokenizer)
        m = _models[tokenizer]
        known: dict[bytes, int] = {}
        id_text: list[str] = []
        names: list[str] = []
        count: list[int] = []
        for batch in batches:
            n_tokens, sha_ids, sha_text, all_ids, all_text = [], [], [], [], []
            for a, b, buf, offs in chunks(batch.column(1)):
                if len(known) > 300_000:
                    known, id_text, names, count = {}, [], [], []
                starts, ends, at = words(buf, offs)
                pick, back = distinct_spans(buf, starts, ends)
                data = buf.tobytes()
                raw = [data[x:y] for x, y in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
                new = [x for x in raw if x not in known]
                found, sizes = m.encode_words(new)
                found, upto = found.tolist(), np.cumsum(sizes).tolist()
                for x, s, e in zip(new, [0, *upto], upto, strict=False):
                    known[x] = len(id_text)
                    id_text.append(" ".join(map(str, found[s:e])))
                    names.append(m.decode(found[s:e]))
                    count.append(e - s)
                number = np.array([known[x] for x in raw], np.int64)
                where = number[back] if len(back) else np.zeros(0, np.int64)
                sizes = np.array(count, np.int64)[where] if count else np.zeros(0, np.int64)
                where = where[sizes > 0]  # a word of ignorable characters has no ids
                keep = np.zeros(len(sizes) + 1, np.int64)
                np.cumsum(sizes > 0, out=keep[1:])
                total = np.zeros(len(sizes) + 1, np.int64)
                np.cumsum(sizes, out=total[1:])
                n_tokens += (total[at[1:]] - total[at[:-1]]).tolist()
                spot = keep[at].tolist()
                where = where.tolist()
                for i in range(b - a):
                    own = where[spot[i] : spot[i + 1]]
                    line, decoded = " ".join([id_text[w] for w in own]), " ".join([names[w] for w in own])
                    sha_ids.append(hashlib.sha256(line.encode()).hexdigest())
                    sha_text.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        all_ids.append([int(x) for x in line.split()])
                        all_text.append(decoded)
            cols = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())]
            if ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    schema = f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
