"""Spark helpers shared by the corpus operators: scratch tables, Arrow text chunks, id filters, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised kernel handles at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local folder serves a local master; on a cluster
    that would be another folder on each machine, so the setting is asked for."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Jobs inside hand rows to Python in batches of at most `most` bytes (None: as the session says)."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    if most is not None:
        spark.conf.set(setting, str(most))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def give_back() -> None:
    """Free memory that this process's allocators keep goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lets_go(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker gives free memory back: workers outlive their tasks, and what their allocators keep would
    add to the needs of every later stage."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


#: Share of the driver's largest heap from which its garbage is collected between tables.
HEAP_SHARE = 0.5


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver collect its garbage if its heap has grown beyond HEAP_SHARE. Spark drops the broadcasts and shuffle files of
    earlier steps only once the driver has collected what refers to them; a heap with room to grow puts that off."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        jvm.java.lang.System.gc()


class Scratch:
    """Intermediate Parquet tables in the shared folder; they cut lineage and survive lost executors. batch_bytes: see arrow_batches."""

    def __init__(self, spark: SparkSession, name: str, batch_bytes: int | None = None):
        self.spark, self.batch_bytes = spark, batch_bytes
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with arrow_batches(self.spark, self.batch_bytes):
            df.write.mode("overwrite").parquet(path)
        collect_garbage(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data uint8, offsets int64 of len+1) of a string array; a null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else pa.large_string()
    text = pc.fill_null(text.cast(wide), b"" if wide == pa.large_binary() else "")
    _, offs, data = text.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[text.offset : text.offset + len(text) + 1] if offs is not None and len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(text: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets from 0) over whole texts, at most `most` bytes unless one text is longer."""
    raw, offs = with_bytes(text)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def with_maybe(df: DataFrame, col: str, ids: DataFrame, max_bits: int = 1 << 24) -> DataFrame:
    """(row, key, maybe): df's rows as a struct, so that no name of theirs clashes, and whether `col` may be in ids (ids has
    `col`). A one-hash bitmap of at most max_bits bits is joined as a broadcast of at most max_bits/64 rows. It marks
    every true id, and some others; beyond about max_bits ids nearly all. An exact join follows: the mark only spares
    shuffled bytes. A null is never marked. Where ids is empty nothing is marked, and nothing broadcast."""
    n = ids.count()
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(col).alias("key"))
    if not n:
        return packed.withColumn("maybe", F.lit(False))
    bits = 1 << 12
    while bits < min(max_bits, 16 * n):
        bits <<= 1
    spot = F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(bits)).cast("long"))
    words = (
        ids.select(F.col(col).alias("key")).where("key is not null").select(spot.alias("s"))
        .select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("v"))
        .groupBy("w")
        .agg(F.bit_or("v").alias("v"))
    )
    out = packed.withColumn("s", spot).withColumn("w", F.shiftright("s", 6)).join(F.broadcast(words), "w", "left")
    return out.select("row", "key", F.coalesce(F.expr("(shiftright(v, cast(s % 64 as int)) & 1L) = 1L"), F.lit(False)).alias("maybe"))


def id_filter(df: DataFrame, col: str, ids: DataFrame, max_bits: int = 1 << 24) -> DataFrame:
    """The rows of df whose `col` may be in ids."""
    return with_maybe(df, col, ids, max_bits).where("maybe").select("row.*")


def without(docs: DataFrame, key: str, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose key is in gone (has `key`); of the rows of each key in `once` one stays. Rows that the
    bitmap clears are passed on without a shuffle; only the others are joined."""
    marked = with_maybe(docs, key, gone if once is None else gone.unionByName(once))
    doubtful = marked.where("maybe").join(gone.select(F.col(key).alias("key")).distinct(), "key", "left_anti")
    if once is not None:
        doubtful = doubtful.dropDuplicates(["key"])
    return marked.where("not maybe").select("row.*").unionByName(doubtful.select("row.*"))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component), component = smallest id reachable.

    Alternating large-star and small-star until a round changes nothing; stars stay as they are, so edges that are stars take one
    round. Each round is a written table, so lineage stays short and a lost executor costs a round at most. Hub nodes are aggregated map-side before the shuffle: min is the only
    aggregate, and each star emits one row per incoming edge. Ids without an edge are absent.
    """
    def written(df: DataFrame, k: int) -> tuple[DataFrame, dict]:
        """The table of a round, with its rows counted and hashed as they are written."""
        seen = Observation()
        out = scratch.table(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), f"{name}{k}")
        return out, seen.get

    cur, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    for k in range(1, 100):
        if not before["n"]:
            break
        # large-star: every neighbour larger than u links to the smallest of u and its neighbours
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: u and its smaller neighbours link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        cur, now = written(small.where("a <> b").distinct(), k)
        scratch.drop(f"{name}{k - 1}")
        if now == before:
            break
        before = now
    return cur.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        cur.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    )
