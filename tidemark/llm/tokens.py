"""Token ids of whole texts, with every distinct word of a batch tokenised once."""

from __future__ import annotations

import json

import numpy as np

from tidemark.llm.kernels import SPACE, distinct_spans, spread

#: Splits a text before its merges; a fixed value of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    """ids of texts under a byte-level BPE vocabulary file, special tokens included, as the tokenizers library gives them.

    A text is cut before each blank that stands between two non-blank characters: no pre-token spans such a place, so
    pieces tokenise alike wherever they stand. Each distinct piece of a batch is tokenised once, all of them laid end to
    end in one call, and ids are gathered back by number.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s in special:
            ranks.pop(s.encode(), None)
        self.special = set(special)
        self.mark = [s.encode() for s in special]
        self.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        top = max([*ranks.values(), *special.values()]) + 1
        self.width = np.zeros(top, np.int64)
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.width[i] = len(token)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all texts end to end, offsets of each text's ids)."""
        n = len(offs) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        # wider white space starts with C2, E1, E2 or E3; near such bytes nothing is cut
        odd = np.isin(buf, (0xC2, 0xE1, 0xE2, 0xE3))
        cut = buf == 32
        cut[1:] &= ~(SPACE[buf[:-1]] | ((buf[:-1] >= 0x1C) & (buf[:-1] <= 0x1F)))
        cut[2:] &= ~odd[:-2]
        cut[3:] &= ~odd[:-3]
        cut[:-1] &= ~(SPACE[buf[1:]] | odd[1:] | ((buf[1:] >= 0x1C) & (buf[1:] <= 0x1F)))
        cut[-1] = False
        full = np.flatnonzero(np.diff(offs) > 0)
        # a text's last byte is no cut, as what follows it is another text
        cut[offs[1:][full] - 1] = False
        cut[offs[:-1][full]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(buf))
        pick, back = distinct_spans(buf, begin, end)
        b, e = begin[pick], end[pick]
        size = e - b
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        # pieces with a blank ahead may follow anything; those without start a text and are kept apart
        lead = buf[b] == 32
        data = buf[spread(b, size)]
        ids, count = [], np.zeros(len(size), np.int64)
        for run in np.split(np.arange(len(size)), np.flatnonzero(~lead | np.append(True, ~lead[:-1]))) if len(size) else []:
            if len(run):
                raw = data[at[run[0]] : at[run[-1] + 1]].tobytes()
                got = self.enc.encode(raw.decode("utf-8", "replace"), allowed_special=self.special) if any(m in raw for m in self.mark) else self.enc.encode_ordinary(raw.decode("utf-8", "replace"))
                got = np.array(got, np.uint32)
                ids.append(got)
                if len(run) == 1:
                    count[run[0]] = len(got)
                else:
                    where = np.searchsorted(np.cumsum(self.width[got]), at[run + 1] - at[run[0]], "left") + 1
                    count[run] = np.diff(where, prepend=0)
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        first = np.cumsum(count) - count
        reps = count[back]
        out_at = np.zeros(len(reps) + 1, np.int64)
        np.cumsum(reps, out=out_at[1:])
        out = ids[spread(first[back], reps)]
        return out, out_at[np.searchsorted(begin, offs)]
