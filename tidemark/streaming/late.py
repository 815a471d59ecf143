"""Late rows of a stream, kept and counted: rows in time go to one table, late ones to another, and none is lost.

A row is late if its time lies more than the allowed lateness before the latest time of its symbol in earlier batches. Batches are
routed as whole tables; only the latest time a symbol is carried on, in a small table a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a router's folder.
ON_TIME, LATE, CLOCKS = "on_time", "late", "clocks"


#: Largest table of one row a symbol that is broadcast.
MOST = 1 << 14


def beside(small: DataFrame) -> DataFrame:
    """small, a row a symbol, to be joined with rows: broadcast up to MOST symbols, as a join that deals out by symbol would send a
    symbol's rows to one task. Spark can't tell by itself: it takes a table that is joined, or empty yet, for larger than it is."""
    return F.broadcast(small) if small.count() <= MOST else small


def route(rows: DataFrame, clocks: DataFrame, lateness_ms: int) -> DataFrame:
    """rows with `late` and `behind_ms`, the time by which a row lies behind its symbol's clock (clocks: symbol, clock_ms; null if it
    has none). A row without a time is late; a null symbol is a symbol like any other."""
    c = clocks.select(F.col("symbol").alias("__symbol"), "clock_ms")
    met = rows.join(c, F.col("symbol").eqNullSafe(F.col("__symbol")), "left")
    behind = F.col("clock_ms") - F.col("ts_ms")
    late = F.col("ts_ms").isNull() | F.coalesce(behind > lateness_ms, F.lit(False))
    return met.select(*rows.columns, late.alias("late"), behind.alias("behind_ms"))


def router(folder: str, lateness_ms: int) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: each batch goes to folder/on_time and folder/late under its number, and the clocks it leaves to
    folder/clocks. A batch that is run again after a failure finds the clocks of the one before and replaces its own files, so
    every row stands in one table once."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = lambda table, n: f"{folder}/{table}/batch={n}"
        before = spark.read.parquet(at(CLOCKS, number - 1)) if number else spark.createDataFrame([], "symbol string, clock_ms long")
        routed = route(batch, beside(before), lateness_ms)
        routed.where("not late").drop("late", "behind_ms").write.mode("overwrite").parquet(at(ON_TIME, number))
        routed.where("late").drop("late").write.mode("overwrite").parquet(at(LATE, number))
        seen = batch.groupBy("symbol").agg(F.max("ts_ms").alias("clock_ms"))
        clocks = before.unionByName(seen).groupBy("symbol").agg(F.max("clock_ms").alias("clock_ms"))
        clocks.coalesce(1).write.mode("overwrite").parquet(at(CLOCKS, number))  # a row a symbol

    return step


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, on_time, late, most_behind_ms): what a router has passed on and held back so far."""
    kept = spark.read.parquet(f"{folder}/{ON_TIME}").groupBy("symbol").agg(F.count("*").alias("on_time"), F.lit(0).cast("long").alias("late"), F.lit(None).cast("long").alias("most_behind_ms"))
    late = spark.read.parquet(f"{folder}/{LATE}").groupBy("symbol").agg(F.lit(0).cast("long").alias("on_time"), F.count("*").alias("late"), F.max("behind_ms").alias("most_behind_ms"))
    return kept.unionByName(late).groupBy("symbol").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"), F.max("most_behind_ms").alias("most_behind_ms"))
