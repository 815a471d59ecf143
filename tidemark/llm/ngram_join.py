"""Jaccard self-join of documents on word n-grams, by a token-group matrix.

1. Documents with equal shingle sets form a class; only class representatives go on.
2. Similar representatives are put into groups: those that share one of their smallest shingles are compared with the first
   of them, and verified links make the groups. Parity sketches of the sets, whose differing bits bound from below how many
   shingles two sets differ in, spare the verification of most pairs that don't link.
3. The matrix holds, per shingle, the blocks of groups whose token union has it. It needs only prefix shingles: in one total
   order of shingles (frequent ones last), sets that link share one of the first n - ceil(t n) + 1 of each. Shingles of
   one class alone are dropped as soon as they are sorted.
4. A document that shares such shingles with a block of another group is a candidate for it if their number and the sizes of
   the block's members allow a link at all. Its overlap with the block's token union then bounds its overlap with every
   member; only blocks that qualify are opened, and their members verified exactly. Of each two groups the most promising
   candidate is tried first; the others only if that leaves the groups apart.
Links inside a group need no further check, as only connectivity is asked for; so a group of n near copies costs
about n comparisons, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, chunks, components, id_filter, lets_go
from tidemark.llm.kernels import Prefix, grams, mix, sequences, words

_U = np.uint64
#: Smallest shingles kept of a set, and the bytes of text that a task looks at at once.
MINS, BLOCK_BYTES = 4, 1 << 19


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text, its different `size`-word shingles as sorted hashes; a shorter text is one shingle, none is empty."""
    starts, ends, at = words(buf, offs)
    h = Prefix(buf, lower=True).spans(starts, ends)
    g, first = grams(h, at, size)
    out, at, first = [], at.tolist(), first.tolist()
    for i in range(len(at) - 1):
        n = at[i + 1] - at[i]
        if n >= size:
            s = np.sort(g[first[i] : first[i + 1]])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(np.array([sequences(h, at[i], at[i + 1])] if n else [], _U))
    return out


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    return int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0, int(np.add.reduce(mix(s ^ _U(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0


def parity_sketch(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the set's shingles fall on i; about as many bits as shingles. Every bit in which two
    such sketches differ takes at least one shingle that only one of the sets has."""
    bits = 1 << max(6, min(17, int(max(len(s), 1) - 1).bit_length()))
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))


def describe(rows: DataFrame, size: int) -> DataFrame:
    """(id, n, h1, h2, mins, sketch): set size, set names, smallest shingles and parity sketch of every document."""

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, _, buf, offs in chunks(batch.column(1), BLOCK_BYTES) for s in shingle_sets(buf, offs, size)]
            names = [_names(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
                    pa.array([s[:MINS].view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parity_sketch(s) for s in sets], pa.binary()),
                ],
                names=["id", "n", "h1", "h2", "mins", "sketch"],
            )

    return rows.mapInArrow(run, "id long, n long, h1 long, h2 long, mins array<long>, sketch binary")


def common_shingles(rows: DataFrame, size: int, n_docs: int, sample: int = 4096, least: int = 3) -> np.ndarray:
    """Sorted shingles that stand in `least` or more of about `sample` documents. They only set the order of shingles, so
    that prefixes avoid them; every result is the same for any such list."""
    if n_docs > sample:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 24)) < int((1 << 24) * sample / n_docs))

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(1), BLOCK_BYTES):
                t, c = np.unique(np.concatenate([np.zeros(0, _U), *shingle_sets(buf, offs, size)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], names=["t", "c"])

    got = rows.mapInArrow(run, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("t").toArrow()
    return np.sort(np.asarray(got.column("t").to_numpy()).view(_U)) if got.num_rows else np.zeros(0, _U)


def _is_in(s: np.ndarray, pool: np.ndarray) -> np.ndarray:
    if not len(pool):
        return np.zeros(len(s), bool)
    spot = np.minimum(np.searchsorted(pool, s), len(pool) - 1)
    return pool[spot] == s


def prefix_tokens(rows: DataFrame, size: int, percent: int, common: np.ndarray, level: np.ndarray) -> DataFrame:
    """(t, h): prefix shingles of every document, h its set's name; equal sets of a task count once. The order of shingles: those
    not in `common` first, then by level, then by hash."""
    sent = rows.sparkSession.sparkContext.broadcast((common, level))

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(1), BLOCK_BYTES):
                tokens, names, lengths = [], [], []
                for s in shingle_sets(buf, offs, size):
                    if not len(s) or (h := _names(s)[0]) in seen:
                        continue
                    seen.add(h)
                    p = prefix_length(len(s), percent)
                    pool, ranks = sent.value
                    often = _is_in(s, pool)
                    rare = s[~often]
                    if len(rare) < p:
                        late = s[often]
                        late = late[np.argsort(ranks[np.searchsorted(pool, late)], kind="stable")]
                        rare = np.concatenate([rare, late[: p - len(rare)]])
                    tokens.append(rare[:p])
                    names.append(h)
                    lengths.append(p)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), lengths))], names=["t", "h"])

    return rows.mapInArrow(run, "t long, h long")


def frequent_tokens(shared: DataFrame, most: int = 1 << 20, least_level: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, levels): the tokens with the most sets, level = log2 of their number: all from 2**least_level sets on, or from the
    lowest level that leaves no more than `most` of them."""
    counted = shared.groupBy("t").agg(F.count("*").alias("c")).withColumn("l", F.floor(F.log2("c")).cast("int"))
    by_level = {r["l"]: r["count"] for r in counted.groupBy("l").count().collect()}
    level = least_level
    while sum(n for k, n in by_level.items() if k >= level) > most:
        level += 1
    got = counted.where(F.col("l") >= level).select("t", "l").toArrow()
    t, ranks = np.asarray(got.column("t").to_numpy()).view(_U), np.asarray(got.column("l").to_numpy())
    order = np.argsort(t)
    return t[order], ranks[order]


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """(t, h) for the tokens that stand in two or more sets: each partition is sorted by token and read as a stream."""

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # held: the last token's last row, and whether it has been given out
        given = False
        for batch in batches:
            t, h = np.concatenate([held[0], batch.column(0).to_numpy()]), np.concatenate([held[1], batch.column(1).to_numpy()])
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
            if not new.all():
                t, h = t[new], h[new]
            same = t[1:] == t[:-1]
            shared = np.zeros(len(t), bool)
            shared[1:] |= same
            shared[:-1] |= same
            last = bool(shared[-1]) or (given and len(t) == 1)
            give = shared.copy()
            if given:
                give[0] = False
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(t[give]), pa.array(h[give])], names=["t", "h"])
            held, given = (t[-1:], h[-1:]), last
    return tokens.repartition("t").sortWithinPartitions("t", "h").mapInArrow(run, "t long, h long")


def load_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, s): sorted shingles, 8 bytes each, of at least the documents in ids."""

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in chunks(batch.column(1), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([s.tobytes() for s in shingle_sets(buf, offs, size)], pa.binary())], names=["id", "s"])

    return id_filter(_rows(docs, key, text), "id", ids).mapInArrow(run, "id long, s binary")


def _overlap(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    if len(x) > len(y):
        x, y = y, x
    return int(_is_in(x, y).sum())


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link: 100 * intersection >= percent * union."""

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [100 * (c := _overlap(x, y)) >= percent * ((len(x) + len(y)) // 8 - c) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    right = id_filter(sets, "id", pairs.select(F.col("b").alias("id")).distinct())  # far fewer: the leads of groups
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(right.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _least_shared(percent: int, lo: str, hi: str) -> tuple[Column, Column]:
    """(some size fits, least c): how many prefix shingles a set of n shingles must share with a block whose members have lo..hi
    shingles to link with one of them. In the common order, after the earlier end of two prefixes at most ceil(t max(n, m)) - 1 shingles
    are left to share, and a link needs t (n + m) / (1 + t). So c >= t (n + m) / (1 + t) - ceil(t max(n, m)) + 1: for m above n this
    falls with m, below n it rises with it, and its least value is at an end of the sizes that can link. One less
    is asked for, so that rounding loses nothing."""
    t = percent / 100
    n = F.col("n")
    low, high = F.greatest(F.col(lo).cast("double"), n * t), F.least(F.col(hi).cast("double"), n / t)
    need = lambda m: (t / (1 + t)) * (n + m) - F.ceil(t * F.greatest(n.cast("double"), m)) + 1
    return low <= high + 1e-9, F.least(need(low), need(high)) - 1


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b and other columns) that can link: those whose sketches differ in no more bits than the sets of linked
    documents can differ in shingles, (100 - percent) / (100 + percent) of their sizes' sum."""
    names = pairs.columns
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(*names, "n_a", "n_b", "sketch_a", "sketch_b")

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, x, y = (batch.column(k).to_pylist() for k in range(len(names), len(names) + 4))
            ok = [(100 + percent) * _differ(p, q) <= (100 - percent) * (m + n) for m, n, p, q in zip(n_a, n_b, x, y, strict=True)]
            yield batch.select(names).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, pairs.schema)


def _alike(m: str, n: str, percent: int) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def open_blocks(asks: DataFrame, members: DataFrame, sets: DataFrame, percent: int, most_askers: int = 256) -> DataFrame:
    """(a, b): for each ask (id, g, k) a link between the set id and a member of the block (g, k), if there is one.

    Members and askers of a block meet once. The overlap with the members' token union bounds that with each of them; where it
    allows a link, members of fitting size are verified until one links: all of a group are connected. A block with many
    askers is given out several times, each time to most_askers of them or so."""
    parts = asks.groupBy("g", "k").agg(F.ceil(F.count("*") / most_askers).cast("int").alias("parts"))
    askers = asks.join(parts, ["g", "k"]).select("id", "g", "k", F.pmod(F.xxhash64("id", F.lit(5)), "parts").cast("int").alias("part"), F.lit(True).alias("asker"))
    inside = members.join(parts, ["g", "k"]).select("id", "g", "k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asker"))

    def meet(table: pa.Table) -> pa.Table:
        asker = table.column("asker").to_numpy(zero_copy_only=False)
        ids, raw = table.column("id").to_pylist(), table.column("s").to_pylist()
        own = [(ids[i], raw[i]) for i in np.flatnonzero(~asker).tolist()]
        union = np.unique(np.concatenate([np.zeros(0, _U), *(np.frombuffer(x, _U) for _, x in own)])).tobytes()
        out = []
        for i in np.flatnonzero(asker).tolist():
            x = raw[i]
            if 100 * _overlap(x, union) < percent * (len(x) // 8):
                continue
            for b, y in own:
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * (c := _overlap(x, y)) >= percent * ((len(x) + len(y)) // 8 - c):
                    out.append((ids[i], b))
                    break
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    both = askers.unionByName(inside).join(sets, "id")
    return both.groupBy("g", "k", "part").applyInArrow(meet, "a long, b long")


def jaccard_components(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, block: int = 64) -> DataFrame:
    """One row per document: key, n_shingles, component_id.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set is its different `size`-word
    shingles, or its whole word sequence if shorter. Two documents link when 100 * |A and B| >= percent * |A or B|;
    component_id is the smallest key reachable by links. Documents without words (null or empty text) have n_shingles 0 and
    link with nothing. Repeated rows and equal texts form one class. Rows of one key count as one document with
    several texts. A null key has component_id null. Long texts are taken whole. An empty table gives no
    rows. Extra columns are ignored. Keys are integers. Shingles are told apart by 64-bit hashes.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = _rows(docs, key, text)
    about = scratch.table(describe(rows, size), "about")
    n_docs = about.count()
    full = about.where("n > 0 and id is not null")
    classes = scratch.table(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch")), "classes")

    # postings of shared prefix tokens, by class: a first round finds the frequent ones, which the second puts last
    keyed_rows = rows.where("id is not null")
    early = common_shingles(rows, size, n_docs)
    first = scratch.table(shared_tokens(prefix_tokens(keyed_rows, size, percent, early, np.zeros(len(early), np.int32))), "first")
    often, level = frequent_tokens(first)
    pool = np.union1d(often, early)
    ranks = np.full(len(pool), 64, np.int32)
    ranks[np.searchsorted(pool, often)] = level
    shared = scratch.table(shared_tokens(prefix_tokens(keyed_rows, size, percent, pool, ranks)), "shared") if len(often) else first

    # groups: representatives that share a smallest shingle, against the first of them
    keyed = classes.select("id", "n", F.explode("mins").alias("m"))
    lead = keyed.groupBy("m").agg(F.min(F.struct("id", "n")).alias("f"), F.count("*").alias("c")).where("c > 1").select("m", F.col("f.id").alias("b"), F.col("f.n").alias("bn"))
    stars = keyed.join(lead, "m").where("id <> b").where(_alike("n", "bn", percent)).select(F.col("id").alias("a"), "b").distinct()
    stars = scratch.table(likely(stars, classes, percent), "stars")
    wanted = stars.select(F.col("a").alias("id")).unionAll(stars.select(F.col("b").alias("id"))).distinct()
    sets = scratch.table(load_sets(docs, wanted, key, text, size), "sets")
    links = scratch.table(verify(stars, sets, percent), "links")
    joined = components(links, scratch, "groups").withColumnRenamed("component", "g")
    grouped = scratch.table(joined.join(joined.groupBy("g").agg(F.count("*").alias("members")), "g"), "grouped")

    # the matrix, a row for each set: its tokens that lie in two groups or more. The filter lets some others pass, which meet nothing
    posted = shared.groupBy("h").agg(F.collect_list("t").alias("ts")).join(classes.select(F.col("h1").alias("h"), "id", "n"), "h").join(grouped, "id", "left")
    posted = scratch.table(posted.select("id", "n", F.coalesce("g", "id").alias("g"), F.coalesce("members", F.lit(1)).alias("members"), "ts"), "posted")
    cells = posted.select("id", "n", "g", "members", F.explode("ts").alias("t"))
    crossing = cells.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("t")
    kept = id_filter(cells, "t", scratch.table(crossing, "crossing")).groupBy("id", "n", "g", "members").agg(F.collect_list("t").alias("ts"))
    # `own`: how many shingles a set has in the matrix, which bounds how many it can share
    matrix = kept.select("*", F.size("ts").alias("own"), F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / block)).alias("k"))
    matrix = scratch.table(matrix, "matrix")
    cells = matrix.select("id", "n", "g", "members", "own", "k", F.explode("ts").alias("t"))
    # a document asks the blocks of larger groups (of equal ones, those with the larger name)
    asked = cells.groupBy("t", F.col("g").alias("g2"), F.col("k").alias("k2"), F.col("members").alias("m2")).agg(F.min("n").alias("tlo"), F.max("n").alias("thi"), F.max("own").alias("own2"))
    fits, least = _least_shared(percent, "tlo", "thi")
    fits = fits & (F.least("own", "own2") >= least) & F.expr("members < m2 or (members = m2 and g < g2)")
    sizes = matrix.groupBy(F.col("g").alias("g2"), F.col("k").alias("k2")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    met = cells.select("t", "id", "n", "g", "members", "own").join(asked, "t").where(fits).groupBy("id", "n", "g", "g2", "k2", "m2").agg(F.count("*").alias("c"))
    some, least = _least_shared(percent, "lo", "hi")
    asks = met.join(sizes, ["g2", "k2"]).where(some & (F.col("c") >= least))
    asks = asks.select(F.col("id").alias("a"), F.col("g2").alias("b"), F.col("g").alias("g1"), F.col("k2").alias("k"), "m2", (F.col("c") / F.col("n")).alias("share"))
    asks = scratch.table(asks, "asked")
    # a group of one is its member's set: sketches tell at once whether it can link
    asks = asks.where("m2 > 1").unionByName(likely(asks.where("m2 = 1"), classes, percent))
    asks = scratch.table(asks.withColumnsRenamed({"a": "id", "b": "g"}), "asks")

    # the members of the blocks that are asked, and the sets of those that were not needed before
    single = asks.where("m2 = 1").select(F.col("g").alias("id"), "g", "k").distinct()
    member = grouped.select("id", "g", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / block)).alias("k")).join(asks.where("m2 > 1").select("g", "k").distinct(), ["g", "k"], "left_semi")
    member = scratch.table(member.select("id", "g", "k").unionByName(single), "members")
    late = asks.select("id").unionAll(member.select("id")).distinct().join(wanted, "id", "left_anti")
    sets = sets.unionByName(scratch.table(load_sets(docs, late, key, text, size), "sets2"))  # a set that the filters let pass twice links twice

    # first the most promising ask of each two groups; then those between groups that are still apart
    best = scratch.table(asks.groupBy("g1", "g").agg(F.max(F.struct("share", "id", "k")).alias("b")).select(F.col("b.id").alias("id"), "g", F.col("b.k").alias("k")), "best")
    # each step goes on from the stars of the one before, in place of its links
    stars_of = lambda cc, c: cc.select(F.col("id").alias("a"), F.col(c).alias("b"))
    now = components(stars_of(joined, "g").unionByName(scratch.table(open_blocks(best, member, sets, percent), "more")), scratch, "halfway")
    name = lambda c: now.select(F.col("id").alias(c), F.col("component").alias(f"{c}c"))
    apart = asks.join(name("g1"), "g1", "left").join(name("g"), "g", "left").where(F.coalesce("g1c", "g1") != F.coalesce("gc", "g"))
    rest = scratch.table(apart.select("id", "g", "k").join(best, ["id", "g", "k"], "left_anti"), "rest")
    final = components(stars_of(now, "component").unionByName(scratch.table(open_blocks(rest, member, sets, percent), "most")), scratch, "final")
    named = classes.join(final, "id", "left").select("h1", "h2", "n", F.coalesce("component", "id").alias("c"))
    linked = full.select("id", "h1", "h2", "n").join(named, ["h1", "h2", "n"]).select("id", "n", "c")
    alone = about.where("n = 0 or id is null").select("id", "n", F.col("id").alias("c"))
    return linked.unionAll(alone).select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("c").cast(kind).alias("component_id"))
