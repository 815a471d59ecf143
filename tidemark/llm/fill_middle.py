"""Fill-in-the-middle rows through an index of distinct texts with Elias-Fano lists of their code point boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import CHUNK_BYTES, Scratch, with_bytes, with_maybe

#: Bits of an Elias-Fano upper part between two counts of its set bits.
STRIDE = 512


class Boundaries:
    """The byte places of n + 1 rising boundaries (each code point's start, and the text's end) in about two bits each: upper
    parts in unary, lower parts plain, and a count of the upper bits set before each stride for selection."""

    __slots__ = ("n", "shift", "upper", "lower", "ranks")

    def __init__(self, n: int, shift: int, upper: np.ndarray, lower: np.ndarray, ranks: np.ndarray):
        self.n, self.shift, self.upper, self.lower, self.ranks = n, shift, upper, lower, ranks

    @classmethod
    def of(cls, buf: np.ndarray) -> Boundaries:
        """From a text's UTF-8 bytes."""
        at = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        shift = max(0, int(np.log2((len(buf) + 1) / len(at))))
        bit = (at >> shift) + np.arange(len(at))
        upper = np.zeros(int(bit[-1]) + 1, np.uint8)
        upper[bit] = 1
        lower = np.packbits(at[:, None] >> np.arange(shift) & 1, bitorder="little") if shift else np.zeros(0, np.uint8)
        return cls(len(at) - 1, shift, np.packbits(upper, bitorder="little"), lower.astype(np.uint8), np.searchsorted(bit, np.arange(0, len(upper), STRIDE)))

    def __getitem__(self, k: int) -> int:
        """The byte place ahead of code point k; of n: the text's length in bytes."""
        b = int(np.searchsorted(self.ranks, k, "right")) - 1
        own = np.unpackbits(self.upper[b * STRIDE // 8 : (b + 1) * STRIDE // 8], bitorder="little")
        high = b * STRIDE + int(np.flatnonzero(own)[k - int(self.ranks[b])]) - k
        low = 0
        for j in range(self.shift):
            spot = k * self.shift + j
            low |= (int(self.lower[spot >> 3]) >> (spot & 7) & 1) << j
        return high << self.shift | low


LIST = "n long, shift int, upper binary, lower binary, ranks binary"


def boundary_lists(texts: DataFrame) -> DataFrame:
    """rows (d, t, c) with each text's boundary list beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = with_bytes(batch.column("t"))
            found = [Boundaries.of(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            cols = [pa.array([x.n for x in found], pa.int64()), pa.array([x.shift for x in found], pa.int32())]
            cols += [pa.array([getattr(x, f).tobytes() for x in found], pa.binary()) for f in ("upper", "lower")] + [pa.array([x.ranks.astype("<i8").tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "n", "shift", "upper", "lower", "ranks"])

    return texts.mapInArrow(run, f"d binary, t string, c long, {LIST}")


def seeds(name: str) -> tuple[int, int, int, int]:
    hexed = hashlib.sha256(name.encode()).hexdigest()
    return tuple(int(hexed[8 * i : 8 * i + 8], 16) for i in range(4))


MARKS = (b"<P>", b"<S>", b"<M>")


def arranged(body: bytes, places: Boundaries, seed: tuple[int, int, int, int], plain_from: int, spm_below: int) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points of the prefix, of the middle, output)."""
    if not body or seed[2] % 100 >= plain_from or any(m in body for m in MARKS):
        return "plain", None, None, body
    x, y = sorted((seed[0] % (places.n + 1), seed[1] % (places.n + 1)))
    a, b = places[x], places[y]
    p, s, m = MARKS
    if seed[3] % 100 < spm_below:
        return "spm", x, y - x, s + body[b:] + p + body[:a] + m + body[a:b]
    return "psm", x, y - x, p + body[:a] + s + body[b:] + m + body[a:b]


def fill_in_middle(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20, share: int = 1024) -> DataFrame:
    """One row per document: key, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Two cuts are drawn from the sha256 of `seed:key`; the output is plain if the text is empty, holds a mark itself, or the
    seed says so. Identical texts are one entry of the index: they are grouped by their digest and their whole content, so two
    texts under one digest would be two entries, and that raises. An entry's boundary list is made once; documents meet it by
    their text's digest, those of a text with more than `share` copies in salted parts of about that many. A text of a single
    document is an entry that nothing else asks for: its list is made and used where the text was read, without a shuffle.
    A null text counts as empty, a null key as an empty one; repeated rows give equal rows; a table without rows gives
    none; extra columns are ignored. Long texts are handled whole, one at a time.
    """
    kind = docs.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), whole.alias("t"), F.monotonically_increasing_id().alias("u")).withColumn("d", F.unhex(F.sha2("t", 256)))
    repeated = scratch.table(rows.groupBy("d").agg(F.count("*").alias("c")).where("c > 1"), "repeated")
    marked = with_maybe(rows, "d", repeated.select("d"))
    several = marked.where("maybe").select("row.*")
    index = scratch.table(boundary_lists(several.groupBy("d", "t").agg(F.count("*").alias("c"))), "index")
    if index.groupBy("d").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        raise ValueError("two texts have one digest")
    parts = F.greatest(F.ceil(F.col("c") / share), F.lit(1)).cast("long")
    hot = repeated.where(F.col("c") > share).select("d", parts.alias("parts"))
    ids = several.select("k", "d", "u").join(hot, "d", "left").select("k", "d", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).alias("salt"))
    entries = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("c")
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def put(batch: pa.RecordBatch, listed: bool) -> Iterator[pa.RecordBatch]:
        raw, offs = with_bytes(batch.column("t"))
        keys = batch.column("k").to_pylist()
        upper, lower, ranks = (batch.column(c) for c in ("upper", "lower", "ranks")) if listed else (None,) * 3
        made, first, size = [], 0, 0
        for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            buf = raw[a:b]
            if listed:
                bits = [np.frombuffer(x[i].as_buffer() or b"", d) for x, d in ((upper, np.uint8), (lower, np.uint8), (ranks, "<i8"))]
                places = Boundaries(batch.column("n")[i].as_py(), batch.column("shift")[i].as_py(), *bits)
            else:
                places = Boundaries.of(buf)
            form, x, y, out = arranged(buf.tobytes(), places, seeds(f"{seed}:{'' if keys[i] is None else keys[i]}"), plain_from, spm_below)
            made.append((places.n, form, x, y, out))
            size += len(out)
            if size >= CHUNK_BYTES or i + 2 == len(offs):
                n, f, x, y, o = zip(*made, strict=True)
                cols = [pa.array(n, pa.int64()), pa.array(f), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(o, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(first, len(made)), *cols], names=["k", *names])
                made, first, size = [], i + 1, 0

    schema = f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    alone = marked.where("not maybe").select("row.k", "row.t").mapInArrow(lambda it: (x for b in it for x in put(b, False)), schema)
    shared = ids.join(entries, ["d", "salt"]).select("k", "t", "n", "shift", "upper", "lower", "ranks").mapInArrow(lambda it: (x for b in it for x in put(b, True)), schema)
    return alone.unionByName(shared).select(F.col("k").alias(key), *names)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone."""
    out, marks = F.col(output), {"psm": "SM", "spm": "PM"}

    def parts(kind: str) -> tuple[Column, Column, Column]:
        a, b = (f"<{x}>" for x in marks[kind])
        body = F.substr(out, F.lit(4))
        one = F.substring_index(body, a, 1)
        rest = F.substr(body, F.length(one) + 4)
        two = F.substring_index(rest, b, 1)
        return one, two, F.substr(rest, F.length(two) + 4)

    p, s, m = parts("psm")
    s2, p2, m2 = parts("spm")
    return F.when(F.col(form) == "psm", F.concat(p, m, s)).when(F.col(form) == "spm", F.concat(p2, m2, s2)).otherwise(out)
