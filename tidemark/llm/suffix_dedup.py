"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of `length` bytes that covers it also starts earlier. Three steps find the starts:

1. Every window of `length` bytes has an anchor: its k-byte string of least hash. Equal windows have equal anchors at equal
   distances, so only windows whose anchor stands in two places or more can repeat. Anchors are sorted by hash
   and read as a stream; those of one place are dropped.
2. The text around each shared anchor (its windows end to end) goes to the anchor's bucket: suffixes that begin with one
   string, and as much ahead of it as its windows reach. Texts that are equal are told apart by their first place
   alone, within a task before they are sent. A bucket too large for a block is dealt on by longer strings: its windows
   are halved by the place of the anchor in them, and each half goes to the bucket of all that its windows share.
   A text gives two rows a halving at most, and seven halvings reach single windows.
3. A bucket's different texts are laid out in blocks, and their suffixes sorted one block at a time: by their first V bytes
   and their end, and ties by the ranks of the difference cover's samples, which are ranked first by doubling. Any two
   suffixes have a sample at one common distance below V, so ranks decide between all of them. Neighbours equal
   over `length` bytes are one string; all but its first place repeat.
Blocks bound memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, chunks, id_filter, lets_go, with_maybe
from tidemark.llm.kernels import Prefix, mix, sliding_min, spread

_U = np.uint64
GRAM = 24
#: A difference cover: every difference modulo V is one of two members.
V = 32
COVER = np.array([1, 2, 3, 4, 8, 12, 20])
#: SHIFT[r, q]: the least distance that takes residues r and q to members of the cover both.
SHIFT = np.array([[next(d for d in range(V) if (r + d) % V in COVER and (q + d) % V in COVER) for q in range(V)] for r in range(V)])
#: Bytes of text that a task looks at at once; the kernels take some 60 times as much.
BLOCK_BYTES = 1 << 19
#: Texts that a task remembers to tell their copies; beyond that it starts anew, and copies meet in their bucket.
REMEMBERED = 1 << 19
#: Numbers of large buckets that may come to the driver.
MOST_OFTEN = 1 << 14


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: text number, first and last start, anchor place (all in buf), anchor hash."""
    out = []
    most = max(2 * BLOCK_BYTES, 4 * length)
    for s in range(0, max(1, len(buf)), most):  # only a single long text is longer than one block
        part = buf[s : s + most + length - 1]
        if len(part) < length:
            continue
        p = Prefix(part)
        n = len(part) - GRAM + 1
        h = mix((p.sums[GRAM:] - p.sums[:-GRAM]) * p.inv[:n])
        low = _U(0xFFFFFFFF)
        least = sliding_min((h & ~low) | np.arange(n, dtype=_U), length - GRAM + 1)
        place = (least & low).astype(np.int64)
        starts = np.arange(len(place)) + s
        text = np.searchsorted(offs, starts, "right") - 1
        ok = starts + length <= offs[text + 1]
        starts, place, text = starts[ok], place[ok], text[ok]
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        out.append((text[first], starts[first], starts[last], place[first] + s, h[place[first]]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(_U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _name(raw: bytes) -> int:
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "big", signed=True)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def describe(rows: DataFrame) -> DataFrame:
    """(id, n_bytes, sha): native functions only."""
    return rows.select("id", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2(F.encode("t", "UTF-8"), 256).alias("sha"))


def anchor_places(rows: DataFrame, length: int, bits: int = 20) -> DataFrame:
    """(a, m, h, p): anchor hash, kind, text name, place in the text; equal texts of a task count once. Of an anchor's places in
    a task one is its witness (m 0, or 1 if there are more, at once or by a second row); the others are known to be shared: they
    travel under a key of their own (m 2). A table of 2**bits anchors keeps a task's witnesses, so that a frequent
    anchor has two rows a task in one place, and more only where another anchor took its slot."""

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, told = np.zeros(1 << bits, _U), np.zeros(1 << bits, np.int8)  # told: 0 empty, 1 a witness, 2 known to have more
        for batch in batches:
            for a, b, buf, offs in chunks(batch.column(1), BLOCK_BYTES):
                names, fresh = np.zeros(b - a, np.int64), np.zeros(b - a, bool)
                for i in range(b - a):
                    if offs[i + 1] - offs[i] >= length:
                        sha = hashlib.sha256(buf[offs[i] : offs[i + 1]].tobytes()).digest()
                        names[i] = int.from_bytes(sha[:8], "big", signed=True)
                        fresh[i] = sha not in seen
                        seen.add(sha)
                text, _, _, place, h = anchors(buf, offs, length)
                own = fresh[text]
                h, who, place = h[own], names[text[own]], place[own] - offs[text[own]]
                order = np.argsort(h, kind="stable")
                h, who, place = h[order], who[order], place[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(h))) > 1
                slot = (h[first] & _U((1 << bits) - 1)).astype(np.int64)
                state = np.where(held[slot] == h[first], told[slot], 0)
                kind = np.full(len(h), 2, np.int32)
                kind[first] = np.where(state == 2, 2, np.where((state == 1) | many, 1, 0))
                slot, mine = np.unique(slot, return_index=True)
                held[slot] = h[first[mine]]
                told[slot] = np.where((state[mine] > 0) | many[mine], 2, 1)
                key = np.where(kind < 2, h, mix(who.view(_U) ^ (place.astype(_U) << _U(32))))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), pa.array(who), pa.array(place)], names=["a", "m", "h", "p"])

    return rows.mapInArrow(run, "a long, m int, h long, p long")


def shared_places(places: DataFrame) -> DataFrame:
    """(h, p) of the anchors that stand in two places or more: a stream over sorted partitions that holds one row of the
    anchor it is at."""

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held: the last anchor's first row, and whether all its rows have been given out
        held, given = np.zeros((4, 0), np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            a, m, h, p = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)[group]
            other = (m == 1) | ((m == 0) & (m[first] < 2) & ((h != h[first]) | (p != p[first])))
            shared = np.bincount(group, other) > 0
            if given:
                shared[0] = True
            take = (m == 2) | shared[group]
            if given:
                take[0] = False
            if take.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(p[take])], names=["h", "p"])
            k = first[-1]
            given = bool(take[k] or shared[-1])
            held = np.array([[a[k]], [m[k]], [h[k]], [p[k]]])

    return places.repartition("a").sortWithinPartitions("a", "m", "h", "p").mapInArrow(run, "h long, p long")


CONTEXT = "a long, id long, h long, start long, span int, rel int, ctx binary"


def _packed(buf: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> pa.Array:
    """A binary array of buf[start:end], null where not kept."""
    size = np.where(keep, end - start, 0)
    data = buf[spread(start, size)]
    bits = np.packbits(keep, bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(keep), [pa.py_buffer(bits), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


class Met:
    """The earliest place of each text that a task has met, by 128-bit digests."""

    def __init__(self) -> None:
        self.at: dict[bytes, tuple[int, int, int]] = {}

    def earliest(self, data: bytes, lo: list[int], hi: list[int], rel: list[int], places: list[tuple[int, int, int]]) -> np.ndarray:
        """Which texts data[lo:hi] (with their anchors at rel) have no equal one so far at an earlier place, and none among them."""
        names = [hashlib.blake2b(data[x:y], digest_size=16, salt=r.to_bytes(4, "little")).digest() for x, y, r in zip(lo, hi, rel, strict=True)]
        best: dict[bytes, int] = {}
        for i, n in enumerate(names):
            k = best.get(n)
            if k is None or places[i] < places[k]:
                best[n] = i
        if len(self.at) > REMEMBERED:
            self.at.clear()
        out, at = np.zeros(len(names), bool), self.at
        for n, i in best.items():
            if n not in at or places[i] < at[n]:
                at[n] = places[i]
                out[i] = True
        return out


def contexts(rows: DataFrame, length: int) -> DataFrame:
    """rows (id, t, h, places) -> one row per run of windows around a shared anchor; ctx is null where the task has met an
    equal one that starts earlier: that run repeats."""

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for batch in batches:
            ids, names = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b, buf, offs in chunks(batch.column(1), BLOCK_BYTES):
                text, lo, hi, place, h = anchors(buf, offs, length)
                take = np.zeros(len(text), bool)
                at = np.searchsorted(text, np.arange(b - a + 1))
                for i in range(b - a):
                    if _name(buf[offs[i] : offs[i + 1]].tobytes()) != names[a + i]:
                        continue
                    own = slice(at[i], at[i + 1])
                    spots = np.sort(batch.column(3)[a + i].values.to_numpy(zero_copy_only=False))
                    k = np.minimum(np.searchsorted(spots, place[own] - offs[i]), len(spots) - 1)
                    take[own] = spots[k] == place[own] - offs[i]
                text, lo, hi, place, h = (x[take] for x in (text, lo, hi, place, h))
                if not len(text):
                    continue
                who, name, start, rel = ids[a + text], names[a + text], lo - offs[text], place - lo
                first = met.earliest(buf.tobytes(), lo.tolist(), (hi + length).tolist(), rel.tolist(), list(zip(who.tolist(), name.tolist(), start.tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(who), pa.array(name), pa.array(start), pa.array((hi - lo + 1).astype(np.int32)), pa.array(rel.astype(np.int32)), _packed(buf, lo, hi + length, first)],
                    names=["a", "id", "h", "start", "span", "rel", "ctx"],
                )

    return rows.mapInArrow(run, CONTEXT)


def narrower(ctx: DataFrame, length: int, width: int) -> DataFrame:
    """Contexts dealt on to buckets of longer strings: windows whose anchor stands at one of `width` neighbouring distances go
    together, under the name of the bytes that all such windows of a text have. ctx is null where the task has met an
    equal one that starts earlier."""
    top = length - GRAM

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for batch in batches:
            ids, names, start, span, rel = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3, 4, 5))
            for a, b, buf, offs in chunks(batch.column(6), BLOCK_BYTES):
                far, near = rel[a:b], rel[a:b] - span[a:b] + 1
                n = far // width - near // width + 1
                who = np.repeat(np.arange(b - a), n)
                piece = (near // width)[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                low, high = np.maximum(near[who], piece * width), np.minimum(far[who], piece * width + width - 1)
                anchor = offs[who] + far[who]
                lo, hi = anchor - high, anchor - low + length
                data, data_lo, data_hi = buf.tobytes(), (anchor - piece * width).tolist(), (anchor - np.minimum(piece * width + width - 1, top) + length).tolist()
                key = [int.from_bytes(hashlib.blake2b(data[x:y], digest_size=8, salt=k.to_bytes(4, "little")).digest(), "little", signed=True) for x, y, k in zip(data_lo, data_hi, piece.tolist(), strict=True)]
                own, name, at = ids[a + who], names[a + who], start[a + who] + far[who] - high
                first = met.earliest(data, lo.tolist(), hi.tolist(), high.tolist(), list(zip(own.tolist(), name.tolist(), at.tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(own), pa.array(name), pa.array(at), pa.array((high - low + 1).astype(np.int32)), pa.array(high.astype(np.int32)), _packed(buf, lo, hi, first)],
                    names=["a", "id", "h", "start", "span", "rel", "ctx"],
                )

    return ctx.mapInArrow(run, CONTEXT)


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(_U)
    out = np.zeros(len(text), _U)
    for k in range(8):
        out = (out << _U(8)) | padded[k : k + len(text)]
    return out


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by keys, the first key most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A class number for each start: equal where text[start : start + length] is."""
    word = np.concatenate([_words(text), np.zeros(2 * V + length + 8, _U)])
    ends = [*range(0, min(V, length - 7), 8), *([] if length >= 3 * V else range(V, length - 7, 8)), length - 8]
    if length < 3 * V:  # no room for a sample of V bytes at every distance
        return _ranks(*(word[starts + k] for k in ends))
    sample = np.flatnonzero(np.isin(np.arange(len(text) + V) % V, COVER))
    rank = _ranks(*(word[sample + 8 * k] for k in range(V // 8)))
    reach = V
    at = np.full(len(text) + 4 * V + length, -1, np.int64)
    while 2 * reach + V <= length:  # ranks over twice as many bytes, as long as they end inside a window from every distance
        at[sample] = rank
        rank = _ranks(rank, at[sample + reach])
        reach *= 2
    at[sample] = rank
    # the first V bytes and those that ranks do not reach, then the samples between for what is still tied
    tied = _ranks(*(word[starts + k] for k in [*range(0, V, 8), *range(reach, length - 7, 8), length - 8]))
    residue = starts % V
    own = _ranks(tied, residue, at[starts + SHIFT[residue, residue]])
    _, pick, back = np.unique(own, return_index=True, return_inverse=True)
    tied, residue, place = tied[pick], residue[pick], starts[pick]
    label = np.arange(len(pick))
    mixed = np.bincount(tied)[tied] > 1
    by = {r: np.flatnonzero(mixed & (residue == r)) for r in np.unique(residue[mixed]).tolist()}
    for q, mine in by.items():
        free = np.ones(len(mine), bool)
        for r, theirs in by.items():
            if r >= q or not free.any():
                break
            shift = SHIFT[r, q]
            pair = _ranks(np.concatenate([tied[theirs], tied[mine]]), np.concatenate([at[place[theirs] + shift], at[place[mine] + shift]]))
            order = np.argsort(pair[: len(theirs)])
            found = pair[: len(theirs)][order]
            spot = np.minimum(np.searchsorted(found, pair[len(theirs) :]), len(found) - 1)
            hit = free & (found[spot] == pair[len(theirs) :])
            label[mine[hit]] = label[theirs[order[spot[hit]]]]
            free &= ~hit
    return label[back]


def repeated_starts(ctx: DataFrame, length: int, block_bytes: int = 1 << 20) -> DataFrame:
    """(id, h, lo, hi): runs of window starts that also start earlier."""
    runs = ["id", "h", "lo", "hi"]

    def firsts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(the earliest row of each different text of a bucket, the other rows)."""
        a, ids, names, start, rel = (t.column(c).to_numpy().tolist() for c in ("a", "id", "h", "start", "rel"))
        raw = t.column("ctx").to_pylist()
        best: dict[tuple[int, int, bytes], int] = {}
        for i in sorted(range(len(a)), key=lambda i: (ids[i], names[i], start[i])):
            best.setdefault((a[i], rel[i], raw[i]), i)
        keep = np.zeros(len(a), bool)
        keep[list(best.values())] = True
        return np.flatnonzero(keep), np.flatnonzero(~keep)

    def whole(t: pa.Table, rows: np.ndarray) -> pa.RecordBatch:
        """Rows of which every window repeats."""
        lo, span = (t.column(c).to_numpy()[rows].astype(np.int64) for c in ("start", "span"))
        return pa.RecordBatch.from_arrays([pa.array(t.column("id").to_numpy()[rows]), pa.array(t.column("h").to_numpy()[rows]), pa.array(lo), pa.array(lo + span - 1)], names=runs)

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        keep, other = firsts(t)
        yield whole(t, other)
        a = t.column("a").to_numpy()[keep]
        many = keep[(np.append(a[1:] == a[:-1], False) if len(a) else np.zeros(0, bool)) | (np.append(False, a[1:] == a[:-1]) if len(a) else np.zeros(0, bool))]
        if not len(many):
            return
        ids, names, start, span = (t.column(c).to_numpy()[many].astype(np.int64) for c in ("id", "h", "start", "span"))
        ctx = t.column("ctx").take(pa.array(many)).combine_chunks()
        ctx = ctx.chunk(0) if isinstance(ctx, pa.ChunkedArray) else ctx
        offs = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
        text = np.frombuffer(ctx.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        who = np.repeat(np.arange(len(many)), span)
        step = spread(np.zeros(len(many), np.int64), span)
        cls = equal_windows(text, offs[who] - offs[0] + step, length)
        where = start[who] + step
        order = np.lexsort([where, names[who], ids[who], cls])
        rep = np.zeros(len(order), bool)
        rep[order[1:]] = cls[order][1:] == cls[order][:-1]
        k = np.flatnonzero(rep)
        if len(k):
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1] + 1) | (who[k[1:]] != who[k[:-1]])
            f = np.flatnonzero(new)
            e = np.append(f[1:], len(k)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[who[k[f]]], names[who[k[f]]], where[k[f]], where[k[e]])], names=runs)

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, block_bytes
        for big in batches:
            for s in range(0, big.num_rows, 2000):
                batch = big.slice(s, 2000)
                held.append(batch)
                size += batch.get_total_buffer_size() // max(1, -(-big.num_rows // 2000))
                if size < most:
                    continue
                t = pa.Table.from_batches(held)
                a = t.column("a").to_numpy()
                cut = int(np.searchsorted(a, a[-1], "left"))  # rows are sorted by bucket: the last one may go on
                if cut:
                    yield from solve(t.slice(0, cut))
                    held, size, most = t.slice(cut).to_batches(), 0, block_bytes
                else:  # one bucket fills the block: its equal texts are told apart at once
                    keep, other = firsts(t)
                    yield whole(t, other)
                    t = t.take(pa.array(keep)).combine_chunks()
                    held, size = t.to_batches(), t.nbytes
                    most = max(block_bytes, 2 * size)
        if held:
            yield from solve(pa.Table.from_batches(held))

    return ctx.repartition("a").sortWithinPartitions("a").mapInArrow(run, "id long, h long, lo long, hi long")


def parted(sent: DataFrame, often: DataFrame, n_often: int, most: int = MOST_OFTEN) -> tuple[DataFrame, DataFrame]:
    """(rows of the buckets in often, the others). Up to `most` such buckets are told by their numbers alone; beyond, by a
    joined bitmap: a mark goes by bucket, so a bucket that is marked by chance is dealt on as a whole."""
    if n_often <= most:
        hit = F.col("a").isin([r[0] for r in often.collect()])
        return sent.where(hit), sent.where(~hit)
    marked = with_maybe(sent, "a", often)
    return marked.where("maybe").select("row.*"), marked.where("not maybe").select("row.*")


def repeat_spans(docs: DataFrame, scratch: Scratch, key: str, text: str, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(about, spans): about has id, n_bytes, sha, copy (an equal text has a smaller id); spans has id, h and starts
    array<struct<lo, hi>> for the first of equal texts that has repeated windows."""
    rows = _rows(docs, key, text).where("id is not null")
    about = scratch.table(describe(rows), "about")
    classes = about.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("id").alias("rep"))
    classes = scratch.table(classes.withColumn("h", F.expr("cast(conv(substr(sha, 1, 16), 16, -10) as long)")), "classes")
    shared = scratch.table(shared_places(anchor_places(rows, length)), "shared")
    listed = shared.groupBy("h").agg(F.collect_list("p").alias("places"))
    listed = scratch.table(listed.join(classes, "h").select(F.col("rep").alias("id"), "h", "places"), "listed")
    texts = id_filter(rows, "id", listed.select("id")).join(listed, "id").select("id", "t", "h", "places")
    # rows that repeat a key: each of its texts once
    twice = scratch.table(about.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "twice")
    texts = with_maybe(texts, "id", twice)
    texts = texts.where("not maybe").select("row.*").unionByName(texts.where("maybe").select("row.*").dropDuplicates(["id", "h", "t"]))
    found = [scratch.table(contexts(texts, length), "contexts")]
    sent, cold, width = found[0].where("ctx is not null"), [], length - GRAM + 1
    while width > 1:
        often = scratch.table(sent.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("a"), f"often{width}")
        if not (n_often := often.count()):
            break
        large, small = parted(sent, often, n_often)
        cold.append(small)
        width = -(-width // 2)
        found.append(scratch.table(narrower(large, length, width), f"width{width}"))
        sent = found[-1].where("ctx is not null")
    every, sent = reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, cold, sent)
    local = every.where("ctx is null").select("id", "h", F.col("start").alias("lo"), (F.col("start") + F.col("span") - 1).alias("hi"))
    runs = local.unionByName(repeated_starts(sent, length)).groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    spans = scratch.table(runs, "spans")
    scratch.drop("shared", "contexts", *(f"width{x}" for x in (39, 20, 10, 5, 3, 2, 1)))
    return about.join(classes, "sha", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("rep"), F.lit(False))).select("id", "n_bytes", "sha", "copy"), spans


def _removed(size: int, starts: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the given runs."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in starts):
        a, b = lo, min(size, hi + length)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    keep, at = [], 0
    for a, b in gone:
        keep.append(raw[at:a])
        at = b
    return b"".join([*keep, raw[at:]])


def repeat_digest(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", length: int = 100, hot: int = 4096) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256.

    Documents are ordered by key; a byte goes if a string of `length` bytes covering it also starts at a smaller key, or earlier
    in the same document. Strings are those of the input, never across documents. A null text is empty. Texts
    shorter than `length` lose nothing. Rows that repeat a key with the same text count as one document and get
    the same result; of different texts of one key, the one with the smaller hash counts as the earlier. Rows
    with a null key take part in nothing and keep all. Keys are integers. An empty table gives no rows. Extra columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    about, spans = repeat_spans(docs, scratch, key, text, length, hot)

    @lets_go
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, h, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = t.encode()
                if _name(raw) == h:
                    gone = _removed(len(raw), starts, length)
                    out.append((i, hashlib.sha256(raw).hexdigest(), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(raw, gone)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind_) for k, kind_ in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["id", "sha", "n_removed", "n_spans", "kept"])

    rows = _rows(docs, key, text).where("id is not null")
    done = id_filter(rows, "id", spans.select("id")).join(spans, "id").select("id", "t", "h", "starts").mapInArrow(cut, "id long, sha string, n_removed long, n_spans long, kept string")
    done = scratch.table(done.distinct(), "done")
    nothing = hashlib.sha256(b"").hexdigest()
    out = about.join(done, ["id", "sha"], "left").select(
        F.col("id").cast(kind).alias(key), "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
    alone = describe(docs.where(F.col(key).isNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")))
    return out.unionByName(alone.select(F.col("id").cast(kind).alias(key), "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256")))


def remove_repeats(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", length: int = 100, hot: int = 4096) -> DataFrame:
    """docs with each text cut as repeat_digest counts it; rows and columns stay. A character that loses a byte goes whole.
    A copy of an earlier text becomes empty. Null texts stay null."""
    about, spans = repeat_spans(docs, scratch, key, text, length, hot)
    marks = about.where("copy").select("id", "sha").distinct().groupBy("id").agg(F.collect_set("sha").alias("gone"))
    cuts = spans.groupBy("id").agg(F.collect_list(F.struct("h", "starts")).alias("cuts"))  # a key can have several texts
    plan = scratch.table(cuts.join(marks, "id", "full").select(F.col("id").alias("key"), "cuts", "gone"), "plan")
    marked = with_maybe(docs.withColumn(key, F.col(key).cast("long")), key, plan.select(F.col("key").alias(key)))

    @F.pandas_udf("string")
    def cut(t, cuts, gone):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for x, c, g in zip(t, cuts, gone, strict=True):
            raw = x.encode()
            sha = hashlib.sha256(raw)
            name = int.from_bytes(sha.digest()[:8], "big", signed=True)
            own = next((list(y["starts"]) for y in c if y["h"] == name), None) if c is not None else None
            if g is not None and sha.hexdigest() in set(g):
                out.append("")
            elif own is not None:
                out.append(_kept(raw, _removed(len(raw), own, length)).decode("utf-8", "ignore"))
            else:
                out.append(x)
        return pd.Series(out, dtype=object)

    doubtful = marked.where("maybe").join(plan, "key", "left")
    old = F.col(f"row.{text}").cast("string")
    new = F.when(old.isNotNull() & (F.col("cuts").isNotNull() | F.col("gone").isNotNull()), cut(F.coalesce(old, F.lit("")), "cuts", "gone")).otherwise(old)
    changed = doubtful.select(*(new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
    return marked.where("not maybe").select("row.*").unionByName(changed).withColumn(key, F.col(key).cast(docs.schema[key].dataType))
