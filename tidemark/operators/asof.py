"""Ordered merging of feeds and as-of look-ups that never sort a symbol's whole history in one task.

Histories are cut in blocks of time. Inside a block a window finds the neighbour; between blocks a table of one row per block
carries the last (or first) row onwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def merged_stream(books: DataFrame, trades: DataFrame) -> DataFrame:
    """Both feeds as one: kind 'trade' or 'book', phase 0 or 1. The order is (ts, phase, sequence): a trade goes first in its
    millisecond. Ids of different feeds are never compared across phases."""
    b = books.withColumns({"kind": F.lit("book"), "phase": F.lit(1)})
    t = trades.withColumns({"kind": F.lit("trade"), "phase": F.lit(0)})
    return t.unionByName(b, allowMissingColumns=True)


def within_ms(stream: DataFrame) -> DataFrame:
    """A synthetic sequence from 0 within each millisecond."""
    return stream.withColumn("ms_seq", (F.row_number().over(Window.partitionBy("symbol", "ts_ms").orderBy("phase", "sequence")) - 1).cast("long"))


def _with_blocks(left: DataFrame, right: DataFrame, at: str, cols: list[str], block_ms: int, forward: bool) -> DataFrame:
    payload = F.struct("ts_ms", *(["sequence"] if "sequence" in right.columns else []), *cols)
    rows = right.select("symbol", F.col("ts_ms").alias("__t"), payload.alias("__p"), F.lit(1 if forward else 0).alias("__side"))
    asks = left.withColumn("__t", F.col(at)).withColumn("__side", F.lit(0 if forward else 1))
    both = asks.unionByName(rows, allowMissingColumns=True).withColumn("__b", F.floor(F.col("__t") / block_ms))
    # right rows ahead of asks on a tie, in either direction: both include the tied row. Forward reads the block backwards,
    # so that each row's frame is a running one
    keys = [F.col("__t"), F.col("__side"), F.col("__p")]
    w = Window.partitionBy("symbol", "__b").orderBy(*(k.desc() if forward else k for k in keys)).rowsBetween(Window.unboundedPreceding, 0)
    near = F.last("__p", ignorenulls=True).over(w)
    edge = F.min("__p") if forward else F.max("__p")
    block = F.col("__b").desc() if forward else F.col("__b")
    carry = F.last("e", ignorenulls=True).over(Window.partitionBy("symbol").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    # one row per block: the history's length in blocks, not in rows
    edges = both.groupBy("symbol", "__b").agg(edge.alias("e")).withColumn("c", carry).select("symbol", "__b", "c")
    found = both.withColumn("__n", near).where(F.col("__side") == (0 if forward else 1)).drop("__p")
    return found.join(edges, ["symbol", "__b"]).withColumn("__n", F.coalesce("__n", "c")).drop("__b", "__t", "__side", "c")


def asof_backward(left: DataFrame, right: DataFrame, cols: list[str], at: str = "ts_ms", prefix: str = "", block_ms: int = DAY_MS) -> DataFrame:
    """left with the columns of the last right row (by ts, sequence) at or before left.`at`; null where there is none."""
    out = _with_blocks(left, right, at, cols, block_ms, False)
    return out.select(*left.columns, *(F.col(f"__n.{c}").alias(prefix + c) for c in cols))


def asof_forward(left: DataFrame, right: DataFrame, cols: list[str], at: str = "ts_ms", prefix: str = "", block_ms: int = DAY_MS) -> DataFrame:
    """left with the columns of the first right row (smallest sequence of a tie) at or after left.`at`; null where there is none."""
    out = _with_blocks(left, right, at, cols, block_ms, True)
    return out.select(*left.columns, *(F.col(f"__n.{c}").alias(prefix + c) for c in cols))


def interval_join(spans: DataFrame, points: DataFrame, lo: str, hi: str, bucket_ms: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs with lo < point.ts_ms <= hi, as an equi-join on (symbol, keys, time bucket). With buckets as long as the spans
    each span meets two or three of them; a plain between would be a nested loop."""
    on = ["symbol", *(keys or []), "__b"]
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / bucket_ms), F.floor(F.col(hi) / bucket_ms))))
    p = points.withColumn("__b", F.floor(F.col("ts_ms") / bucket_ms))
    return s.join(p, on).where((F.col("ts_ms") > F.col(lo)) & (F.col("ts_ms") <= F.col(hi))).drop("__b")
