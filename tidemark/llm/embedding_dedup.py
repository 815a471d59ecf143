"""Near-duplicate vectors through an inverted multi-index.

Each half of a unit vector has its own codebook; the product of the two is a grid of cells, and every vector is listed
in one. A vector visits cells in the order of the sum of its halves' squared distances to the codewords (multi-sequence
order). How many cells are visited is set by measurement: so many, all of them if need be, that a vector at exactly the wanted
cosine is met with at least the target recall from one side alone; a pair counts when either side meets the other. All candidates are
verified in double precision, block by block, and blocks give counts and spanning edges, never lists of pairs.

Near groups of any size: members within half the wanted angle of their cell's centre are its core. By the triangle inequality a
visitor that lies close enough to the centre links to the whole core, one far enough away to none of it; both are settled by
one row, without a vector sent or compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, components


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means codewords (at most k, fewer if x has fewer different rows)."""
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:k]]
    for _ in range(rounds):
        near = _distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((len(c), 0))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None, :]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    visits: int = 1
    recall: float = 1.0

    def home(self, x: np.ndarray) -> np.ndarray:
        h = x.shape[1] // 2
        return _distances(x[:, :h], self.first).argmin(axis=1) * len(self.second) + _distances(x[:, h:], self.second).argmin(axis=1)

    def angles(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Angle of each row of x to the centres of its row of cells; infinite where a centre is zero."""
        h, (a, b) = x.shape[1] // 2, np.divmod(cells, len(self.second))
        dots = np.take_along_axis(x[:, :h] @ self.first.T, a, 1) + np.take_along_axis(x[:, h:] @ self.second.T, b, 1)
        norms = np.sqrt((self.first**2).sum(axis=1)[a] + (self.second**2).sum(axis=1)[b])
        return np.where(norms > 0, np.arccos(np.clip(dots / np.where(norms > 0, norms, 1.0), -1.0, 1.0)), np.inf)

    def traverse(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first `most` cells of each vector in multi-sequence order. The cell of ranks (a, b) comes after at least
        (a + 1)(b + 1) - 1 others, so only those with (a + 1)(b + 1) <= most can be among them."""
        h = x.shape[1] // 2
        d1, d2 = _distances(x[:, :h], self.first), _distances(x[:, h:], self.second)
        o1, o2 = d1.argsort(axis=1, kind="stable"), d2.argsort(axis=1, kind="stable")
        d1, d2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        ranks = [(a, b) for a in range(min(most, d1.shape[1])) for b in range(min(most // (a + 1), d2.shape[1]))]
        ra, rb = np.array([r[0] for r in ranks]), np.array([r[1] for r in ranks])
        order = (d1[:, ra] + d2[:, rb]).argsort(axis=1, kind="stable")[:, : min(most, len(ranks))]
        return np.take_along_axis(o1[:, ra], order, 1) * len(self.second) + np.take_along_axis(o2[:, rb], order, 1)


def fit_index(x: np.ndarray, k: int, cosine: float, target: float, seed: int = 5) -> MultiIndex:
    """Codebooks from sample x (unit rows), and the number of visits that meets the target recall on made-up partners:
    for each sample row, a vector at exactly the wanted cosine in a random direction."""
    rng = np.random.default_rng(seed)
    h = x.shape[1] // 2
    index = MultiIndex(_codebook(x[:, :h], k, rng), _codebook(x[:, h:], k, rng))
    probe = x[rng.permutation(len(x))[:2000]]
    side = rng.normal(size=probe.shape)
    side -= (side * probe).sum(axis=1)[:, None] * probe
    side /= np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
    home = index.home(cosine * probe + np.sqrt(1 - cosine**2) * side)
    cells, most = len(index.first) * len(index.second), 32
    while True:
        met = np.concatenate([index.traverse(probe[s : s + 100], most) == home[s : s + 100, None] for s in range(0, len(probe), 100)]).cumsum(axis=1).mean(axis=0)
        good = np.flatnonzero(met >= target)
        if len(good):
            index.visits, index.recall = int(good[0]) + 1, float(met[good[0]])
            return index
        if most >= cells:
            index.visits, index.recall = cells, 1.0  # every cell: nothing can be missed
            return index
        most *= 4


def one_cell(d: int) -> MultiIndex:
    """An index without a grid, for lengths with few vectors."""
    return MultiIndex(np.zeros((1, d // 2)), np.zeros((1, d - d // 2)))


def _compare(q: dict, m: dict, cosine: float) -> tuple[dict[str, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Visitors q against members m of one block: links to add for each, and edges (id, root id)."""
    add_q, add_m = np.zeros(len(q["id"]), np.int64), np.zeros(len(m["id"]), np.int64)
    edges = []
    for a in range(0, len(q["id"]), 1024):
        part = slice(a, a + 1024)
        hits = (q["x"][part] @ m["x"].T >= cosine) & (q["id"][part][:, None] != m["id"][None, :])
        if not hits.any():
            continue
        add_q[part] += hits @ m["n"]
        # a member that visits the visitor's cell counts this link there itself
        for cell in np.unique(q["home"][part]):
            blind = ~(m["visits"] == cell).any(axis=1)
            if blind.any():
                own = q["home"][part] == cell
                add_m[blind] += q["n"][part][own] @ hits[own][:, blind]
        big = np.iinfo(np.int64).max
        lq, lm = q["id"][part].copy(), m["id"].copy()
        while True:  # labels fall to the smallest id of each connected part of the block
            nm = np.minimum(lm, np.where(hits, lq[:, None], big).min(axis=0))
            nq = np.minimum(lq, np.where(hits, nm[None, :], big).min(axis=1))
            if (nm == lm).all() and (nq == lq).all():
                break
            lq, lm = nq, nm
        for ids, root in ((q["id"][part], lq), (m["id"], lm)):
            edges.append((ids[ids != root], root[ids != root]))
    return {"q": add_q, "m": add_m}, edges


#: Radians by which angles may be off; within it, vectors are compared.
SLACK = 1e-6


def cell_table(placed: DataFrame, block_rows: int) -> DataFrame:
    """A row a cell: blocks of its other members (rest) and of its core, the core's radius, number of vectors and smallest id."""
    core = F.col("r").isNotNull()
    blocks = lambda which: F.ceil(F.count_if(which) / block_rows).cast("long")
    return placed.groupBy(F.col("home").alias("cell")).agg(
        blocks(~core).alias("rest"), blocks(core).alias("core"), F.max("r").alias("radius"), F.sum(F.when(core, F.col("n"))).alias("core_n"), F.min(F.when(core, F.col("id"))).alias("core_id")
    )


def routes(placed: DataFrame, cells: DataFrame, cosine: float) -> DataFrame:
    """A row for each vector and cell it visits, with what is known of the cell; sure: it links to the whole core; blocks: so many of
    the cell's blocks are to be compared, the core's coming last."""
    angle = float(np.arccos(cosine))
    at = placed.withColumn("v", F.explode(F.arrays_zip("visits", "angles"))).withColumns({"cell": F.col("v.visits"), "angle": F.col("v.angles")}).join(cells, "cell")
    at = at.withColumn("sure", F.coalesce(F.col("angle") + F.col("radius") <= angle - SLACK, F.lit(False)))
    none = F.coalesce(F.col("angle") - F.col("radius") > angle + SLACK, F.lit(False))
    return at.withColumn("blocks", F.col("rest") + F.when(F.col("sure") | none, F.lit(0)).otherwise(F.col("core")))


def core_links(placed: DataFrame, cells: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """(id, add, root) of links to whole cores: a visitor adds the core's vectors, itself left out, and hangs on its smallest id; a
    core member that does not visit the visitor's cell is given the visitor's vectors, summed up by pairs of cells."""
    bare = placed.select("id", "n", "home", "r", "visits", "angles")
    sure = scratch.table(routes(bare, cells, cosine).where("sure").select("id", "n", "home", "r", "cell", "core_n", "core_id"), "sure")
    own = (F.col("cell") == F.col("home")) & F.col("r").isNotNull()
    adds = sure.select("id", (F.col("core_n") - F.when(own, F.col("n")).otherwise(0)).alias("add"), F.lit(None).cast("long").alias("root"))
    roots = sure.where("id <> core_id").select("id", F.lit(0).cast("long").alias("add"), F.col("core_id").alias("root"))
    sent = scratch.table(sure.groupBy(F.col("home").alias("from_cell"), "cell").agg(F.sum("n").alias("s")), "sent")
    members = bare.where("r is not null").withColumnRenamed("home", "cell")
    met = members.select("id", "cell", F.explode("visits").alias("from_cell")).join(sent, ["from_cell", "cell"]).groupBy("id").agg(F.sum("s").alias("met"))
    total = sent.groupBy("cell").agg(F.sum("s").alias("s"))
    given = members.select("id", "cell").join(total, "cell").join(met, "id", "left").select("id", (F.col("s") - F.coalesce("met", F.lit(0))).alias("add"), F.lit(None).cast("long").alias("root")).where("add > 0")
    return adds.where("add > 0").unionByName(roots).unionByName(given)


def near_vectors(
    vectors: DataFrame, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, target_recall: float = 0.97,
    sample: int = 20_000, cell_rows: int = 256, most_codewords: int = 4096, block_rows: int = 2048,
) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    n_links counts the other rows found with cosine >= `cosine`, equal vectors included; component_id is the smallest key
    reachable by links; kept: the key is that smallest one. Vectors that are null, empty, zero, or hold a null, NaN or
    infinite component link with nothing and are kept. Vectors of different lengths never link. Repeated rows are
    rows of their own. A null key links nothing. An empty table gives no rows. Extra columns are ignored.
    Codebooks are fitted on about `sample` different vectors, or 8 a codeword if that is more; every vector is indexed. There
    are as many codewords a half as make cells of about cell_rows vectors, at most most_codewords: what lies beyond stays in
    larger cells, which are dealt out in blocks of about block_rows members; links to a whole core need no comparing. A length with few vectors has one cell.
    Equal vectors are gathered first. Ties at the wanted cosine link.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    good = F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vector, lambda v: v != 0)
    # vectors travel in their own type and are scaled where they are compared
    own = "float" if "float" in vectors.schema[vector].dataType.simpleString() else "double"
    e = F.transform(vector, lambda v: v.cast(own) + F.lit(0.0).cast(own))
    rows = vectors.select(F.col(key).alias("k"), F.when(F.coalesce(good, F.lit(False)) & F.col(key).isNotNull(), e).alias("e"))
    rows = rows.withColumns({"h1": F.xxhash64("e"), "h2": F.xxhash64("e", F.lit(1))})
    classes = scratch.table(rows.where("e is not null").groupBy("h1", "h2").agg(F.min("k").cast("long").alias("id"), F.count("*").alias("n"), F.first("e").alias("e")), "classes")
    sizes = {r["d"]: r["count"] for r in classes.groupBy(F.size("e").alias("d")).count().collect()}
    indexes, nth = {}, 0
    for d, n in sorted(sizes.items()):
        k = int(min(most_codewords, max(1, 2 ** round(np.log2(max(1.0, (n / cell_rows) ** 0.5))))))
        if k == 1 or d == 1:
            indexes[d] = (nth, one_cell(d))
        else:
            few, take = classes.where(F.size("e") == d), max(sample, 8 * k)
            if n > take:
                few = few.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * take / n))
            x = np.array(few.select("e").toArrow().column("e").to_pylist(), float).reshape(-1, d)[: 2 * take]
            indexes[d] = (nth, fit_index(unit(x), k, cosine, target_recall) if len(x) else one_cell(d))
        nth += len(indexes[d][1].first) * len(indexes[d][1].second)
    sent = spark.sparkContext.broadcast(indexes)

    flat_type = pa.float32() if own == "float" else pa.float64()
    inner = float(np.arccos(cosine)) / 2 - SLACK  # members so near their centre are its core

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths, flat, at = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for d in np.unique(lengths):
                base, index = sent.value[int(d)]
                own = np.flatnonzero(lengths == d)
                for s in range(0, len(own), 1024):
                    part = own[s : s + 1024]
                    raw = flat[at[part][:, None] + np.arange(d)]
                    x = unit(raw)
                    cells, home = index.traverse(x, index.visits), index.home(x)
                    r = index.angles(x, home[:, None])[:, 0]
                    angles, cells, home = index.angles(x, cells), cells + base, home + base
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(part)), batch.column(1).take(pa.array(part)), pa.array(home.astype(np.int64)),
                            pa.array(r, pa.float64(), mask=~(r <= inner)), pa.array(list(cells.astype(np.int64)), pa.list_(pa.int64())), pa.array(list(angles), pa.list_(pa.float64())),
                            pa.array(list(raw), pa.list_(flat_type)),
                        ],
                        names=["id", "n", "home", "r", "visits", "angles", "x"],
                    )

    shape = f"id long, n long, home long, r double, visits array<long>, angles array<double>, x array<{own}>"
    placed = scratch.table(classes.select("id", "n", "e").mapInArrow(place, shape), "placed")
    cells = scratch.table(cell_table(placed, block_rows), "cells")
    spot = F.when(F.col("r").isNull(), F.pmod(F.xxhash64("id"), F.greatest("rest", F.lit(1)))).otherwise(F.col("rest") + F.pmod(F.xxhash64("id"), F.greatest("core", F.lit(1))))
    members = placed.withColumn("cell", F.col("home")).join(cells, "cell").select("cell", spot.alias("block"), F.lit(0).alias("visitor"), "id", "n", "home", "visits", "x")
    visitors = routes(placed, cells, cosine).where("blocks > 0").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("visitor"), "id", "n", "home", F.array().cast("array<long>").alias("visits"), "x"
    )

    def block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        role = table.column("visitor").to_numpy() == 1
        out_id, out_n, out_root = [], [], []
        if not role.all():
            def side(own: np.ndarray) -> dict:
                t = table.take(pa.array(np.flatnonzero(own)))
                x = unit(np.array(t.column("x").combine_chunks().flatten().to_numpy()).reshape(t.num_rows, -1)) if t.num_rows else np.zeros((0, 1))
                return {"id": t.column("id").to_numpy(), "n": t.column("n").to_numpy(), "home": t.column("home").to_numpy(), "x": x, "visits": t.column("visits").to_pylist()}

            q, m = side(role), side(~role)
            m["visits"] = np.array(m["visits"], np.int64)
            if len(q["id"]):
                add, edges = _compare(q, m, cosine)
                for who, name in ((q, "q"), (m, "m")):
                    some = add[name] > 0
                    out_id += who["id"][some].tolist()
                    out_n += add[name][some].tolist()
                    out_root += [None] * int(some.sum())
                for ids, root in edges:
                    out_id += ids.tolist()
                    out_n += [0] * len(ids)
                    out_root += root.tolist()
        return pa.table({"id": pa.array(out_id, pa.int64()), "add": pa.array(out_n, pa.int64()), "root": pa.array(out_root, pa.int64())})

    compared = members.unionByName(visitors).groupBy("cell", "block").applyInArrow(block, "id long, add long, root long")
    found = scratch.table(compared.unionByName(core_links(placed, cells, cosine, scratch)), "found")
    linked = found.where("root is null").groupBy("id").agg(F.sum("add").alias("others"))
    joined = components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    per_class = (
        classes.select("h1", "h2", "id", "n").join(linked, "id", "left").join(joined, "id", "left")
        .select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    valid = rows.where("e is not null").select("k", "h1", "h2").join(per_class, ["h1", "h2"]).select("k", "n_links", F.col("component").cast(kind).alias("c"))
    rest = rows.where("e is null").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("c"))
    return valid.unionByName(rest).select(F.col("k").alias(key), "n_links", F.col("c").alias("component_id"), F.coalesce(F.col("k") == F.col("c"), F.lit(True)).alias("kept"))
