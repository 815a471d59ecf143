"""Centroid clustering by ball k-means over integer vectors, equal to plain Lloyd rounds in every assignment.

Rows lie in blocks of vectors. Within a block a cluster's members are a ball around their centroid. The neighbours of a ball are
the centroids nearer to its own than twice its radius; a member whose distance is below half the way to the nearest
neighbour is in the stable core and is compared with none, and one further out only with those of its annulus.
All of it is decided in whole numbers: |x - c_i| <= |x - c_j| needs |c_i - c_j|^2 <= 4 |x - c_j|^2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Vectors of a block, and the largest component that keeps a squared distance in a long.
BLOCK, MOST = 2048, 1 << 27


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, centroids) of int64 vectors: by matrix products while those hold whole numbers exactly."""
    if not x.size or not c.size:
        return np.zeros((len(x), len(c)), np.int64)
    if x.shape[1] * (int(np.abs(x).max()) + int(np.abs(c).max())) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


def nearest(x: np.ndarray, c: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, number of other centroids compared) of each row; ties go to the smaller number. own: the
    cluster of the round before."""
    if own is None:
        d = squared(x, c)
        label = d.argmin(1)
        return label, d[np.arange(len(x)), label], np.full(len(x), len(c) - 1)
    label, met = own.copy(), np.zeros(len(x), np.int64)
    dist = np.empty(len(x), np.int64)
    apart = squared(c, c)
    for j in np.unique(own).tolist():
        ball = np.flatnonzero(own == j)
        dist[ball] = d = squared(x[ball], c[j : j + 1])[:, 0]
        near = np.flatnonzero(apart[j] <= 4 * d.max())
        near = near[near != j]
        near = near[np.argsort(apart[j][near], kind="stable")]
        ring = np.searchsorted(apart[j][near], 4 * d, "right")  # 0: the stable core
        for r in np.unique(ring[ring > 0]).tolist():
            rows = ball[ring == r]
            rivals = np.sort(np.append(near[:r], j))
            got = squared(x[rows], c[rivals])
            best = got.argmin(1)
            label[rows], dist[rows], met[rows] = rivals[best], got[np.arange(len(rows)), best], r
    return label, dist, met


def _seeded(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit("")))
    got = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).toArrow()
    return np.array(got.column("v").to_pylist(), np.int64).reshape(got.num_rows, -1 if got.num_rows else 0)


def ball_kmeans(
    vectors: DataFrame, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", dims: int = 64, clusters: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2",
) -> DataFrame:
    """One row per kept vector: key, cluster, distance (squared), compared (other centroids that it met in the last assignment),
    cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `dims` components, none null or non-finite; each becomes floor(scale * x). The first centroids are the
    vectors with the smallest sha256 of `seed:key` (equal keys: by their components), fewer than `clusters` if there are
    fewer. A round assigns all vectors and moves each non-empty centroid to the exact floor(sum / count) of its members; a last
    assignment follows. Ties go to the smaller number, so repeated rows share a cluster; a null key is seeded as an
    empty one. A component beyond 2^27 after scaling raises, as its distances might not fit a long. No kept vector: no rows.
    Extra columns are ignored. Blocks never move: a round writes them with their new clusters and drops the table before, its
    sums are added up by task, then by Spark, and the driver holds clusters x dims numbers.
    """
    kind = vectors.schema[key].dataType.simpleString()
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double") * scale) > MOST, F.raise_error(F.lit("a component is too large")).cast("long")).otherwise(F.floor(x.cast("double") * scale)))
    rows = vectors.where(fine).select(F.col(key).alias("k"), whole.alias("v"))
    c = _seeded(rows, clusters, seed)
    if not len(c):
        return rows.where("false").select(F.col("k").alias(key), *(F.lit(0).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("compared", "int"), ("cluster_inertia", "long"), ("inertia", "long"))), F.lit("").alias("centroid_sha256"))
    schema = f"ids array<{kind}>, m binary, label binary, dist binary, met binary, sums binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4")
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.column(0).slice(a, BLOCK)
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                none = pa.array([None], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array([flat[a * dims : (a + len(part)) * dims].tobytes()], pa.binary()), none, none, none, none], names=["ids", "m", "label", "dist", "met", "sums"])

    def assign(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    m, label = (batch.column(x)[i].as_py() for x in ("m", "label"))
                    x = np.frombuffer(m, "<i4").reshape(-1, dims).astype(np.int64)
                    label, dist, met = nearest(x, c, None if label is None else np.frombuffer(label, "<i4").astype(np.int64))
                    sums = np.zeros((len(c), dims + 2), np.int64)
                    np.add.at(sums[:, :dims], label, x)
                    sums[:, dims], sums[:, dims + 1] = np.bincount(label, minlength=len(c)), [int(dist[label == j].sum()) for j in range(len(c))]
                    made = [pa.array([z.astype(t).tobytes()], pa.binary()) for z, t in ((label, "<i4"), (dist, "<i8"), (met, "<i4"), (sums, "<i8"))]
                    yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1), batch.column("m").slice(i, 1), *made], names=["ids", "m", "label", "dist", "met", "sums"])

        return run

    def totals(table: DataFrame) -> list[list[int]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(c), dims + 2), np.int64)
            for batch in batches:
                for s in batch.column(0):
                    total += np.frombuffer(s.as_buffer(), "<i8").reshape(total.shape)
            at = np.arange(total.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1))], names=["at", "s"])

        got = dict(table.select("sums").mapInArrow(run, "at int, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())
        return [[int(got[j * (dims + 2) + i]) for i in range(dims + 2)] for j in range(len(c))]

    table = scratch.table(rows.mapInArrow(blocks, schema), "blocks")
    for r in range(rounds + 1):
        table = scratch.table(table.mapInArrow(assign(c), schema), f"round{r}")
        scratch.drop("blocks" if r == 0 else f"round{r - 1}")
        sums = totals(table)
        if r < rounds:
            c = np.array([[s // t[dims] for s in t[:dims]] if t[dims] else old for t, old in zip(sums, c.tolist(), strict=True)], np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label, dist, met = (np.frombuffer(batch.column(x)[i].as_buffer(), t) for x, t in (("label", "<i4"), ("dist", "<i8"), ("met", "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(label), pa.array(dist), pa.array(met)], names=["k", "cluster", "distance", "compared"])

    named = [(j, t[dims + 1], sum(x[dims + 1] for x in sums), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, t in enumerate(sums)]
    each = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = table.select("ids", "label", "dist", "met").mapInArrow(spread, f"k {kind}, cluster int, distance long, compared int")
    return out.join(F.broadcast(each), "cluster").select(F.col("k").alias(key), "cluster", "distance", "compared", "cluster_inertia", "inertia", "centroid_sha256")
