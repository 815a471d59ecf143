"""Positions, lags and running extremes of long ordered histories, without one key's history in one task.

A history is cut in blocks of its first order column. Windows run inside a block, and a table of one row per block
carries counts, totals and peaks on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import DAY_MS


def block_of(at: str, block: int) -> Column:
    """Rows without a place in time come first, in a block of their own."""
    return F.coalesce(F.floor(F.col(at) / block).cast("long"), F.lit(-(2**63)))


def numbered(rows: DataFrame, order: list[str], key: list[str], block: int = DAY_MS, tasks: int | None = None) -> DataFrame:
    """rows with __k, their place from 1 within key in that order; ties of the order go in any order. tasks: over how many the
    blocks are dealt, where Spark's own number is too small for the rows."""
    b = rows.withColumn("__b", block_of(order[0], block))
    own = (b.repartition(tasks, *key, "__b") if tasks else b).withColumn("__k", F.row_number().over(Window.partitionBy(*key, "__b").orderBy(*order)).cast("long"))
    earlier = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = b.groupBy(*key, "__b").agg(F.count("*").alias("__c")).withColumn("__at", F.coalesce(F.sum("__c").over(earlier), F.lit(0))).drop("__c")
    return own.join(starts, [*key, "__b"]).withColumn("__k", F.col("__k") + F.col("__at")).drop("__b", "__at")


def with_lags(rows: DataFrame, value: str, lags: int, key: list[str], chunk: int = 1 << 17, tasks: int | None = None) -> DataFrame:
    """Numbered rows with l1 to l`lags`, the value so many places before (null where there is none). Chunks of equal size, each with
    the last rows of the one before, are a task's share."""
    size = max(chunk, lags)
    at = F.col("__k") - 1
    home = F.struct(F.floor(at / size).alias("c"), F.lit(False).alias("copy"))
    next_ = F.struct((F.floor(at / size) + 1).alias("c"), F.lit(True).alias("copy"))
    out = rows.withColumn("__in", F.explode(F.when(at % size >= size - lags, F.array(home, next_)).otherwise(F.array(home))))
    out = out.repartition(tasks, *key, "__in.c") if tasks else out
    w = Window.partitionBy(*key, "__in.c").orderBy("__k")
    return out.withColumns({f"l{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)}).where("not __in.copy").drop("__in")


def largest_fall(rows: DataFrame, value: str, order: list[str], key: list[str], levels: bool, block: int = DAY_MS) -> DataFrame:
    """(key, fall): the largest fall below the peak so far, of the running total of value (its peak is 0 at least) or, with levels,
    of value itself. Ties of the order go by value. A block needs only its total, peak, lowest point and own fall."""
    b = rows.withColumn("__b", block_of(order[0], block))
    w = Window.partitionBy(*key, "__b").orderBy(*order, value).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("__level", F.col(value) if levels else F.sum(value).over(w))
    b = b.withColumn("__fall", F.max("__level").over(w) - F.col("__level"))
    total = F.lit(0.0) if levels else F.sum(value)
    blocks = b.groupBy(*key, "__b").agg(total.alias("t"), F.max("__level").alias("peak"), F.min("__level").alias("low"), F.max("__fall").alias("own"))
    earlier = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("t").over(earlier), F.lit(0.0)))
    highest = F.max(F.col("before") + F.col("peak")).over(earlier)
    blocks = blocks.withColumn("high", highest if levels else F.greatest(highest, F.lit(0.0)))
    return blocks.groupBy(*key).agg(F.max(F.greatest("own", F.col("high") - F.col("before") - F.col("low"))).alias("fall"))
