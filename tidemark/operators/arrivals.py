"""Arrival diagnostics of a trade feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import DAY_MS
from tidemark.operators.quantiles import exact_quantiles, with_quantiles


def gaps(trades: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """trades with `delta`, the milliseconds since the trade before (null on the first)."""
    t = trades.withColumn("__b", F.floor(F.col("ts_ms") / block_ms))
    own = t.withColumn("__p", F.lag("ts_ms").over(Window.partitionBy("symbol", "__b").orderBy("ts_ms", "sequence")))
    ends = t.groupBy("symbol", "__b").agg(F.max("ts_ms").alias("e")).withColumn("c", F.lag("e").over(Window.partitionBy("symbol").orderBy("__b"))).select("symbol", "__b", "c")
    return own.join(ends, ["symbol", "__b"]).withColumn("delta", F.col("ts_ms") - F.coalesce("__p", "c")).select(*trades.columns, "delta")


def interarrival(trades: DataFrame) -> DataFrame:
    """delta_count, mean, exact median and population coefficient of variation of the gaps."""
    g = gaps(trades).where("delta is not null")
    t = g.groupBy("symbol").agg(F.count("*").alias("delta_count"), F.avg("delta").alias("mean_ms"), F.stddev_pop("delta").alias("s"))
    return with_quantiles(t, exact_quantiles(g, ["symbol"], ["delta"], [0.5]), ["symbol"]).select(
        "symbol", "delta_count", "mean_ms", F.col("q_delta")[0].alias("median_ms"), F.when(F.col("mean_ms") > 0, F.col("s") / F.col("mean_ms")).alias("cv")
    )


def fano(total: Column, squares: Column, bins: Column) -> Column:
    """Population variance over mean of counts in `bins` bins, empty ones included; null without events."""
    mean = total / bins
    return F.when((bins >= 1) & (total > 0), (squares / bins - mean * mean) / mean)


def bin_counts(trades: DataFrame, bin_ms: int = 100) -> DataFrame:
    return trades.groupBy("symbol", F.floor(F.col("ts_ms") / bin_ms).alias("bin")).agg(F.count("*").alias("c"))


def _bounds(counts: DataFrame, start_ms: int | None, end_ms: int | None, bin_ms: int) -> DataFrame:
    first = F.min("bin") if start_ms is None else F.lit(start_ms // bin_ms)
    last = F.max("bin") if end_ms is None else F.lit((end_ms - 1) // bin_ms)
    return counts.groupBy("symbol").agg(F.sum("c").alias("events"), F.sum(F.col("c") * F.col("c")).alias("squares"), first.alias("first_bin"), last.alias("last_bin"))


def count_fano(trades: DataFrame, start_ms: int | None = None, end_ms: int | None = None, bin_ms: int = 100) -> DataFrame:
    """Epoch-aligned tumbling counts: the bins that were empty count in the denominator."""
    b = _bounds(bin_counts(trades, bin_ms), start_ms, end_ms, bin_ms).withColumn("bins", F.col("last_bin") - F.col("first_bin") + 1)
    return b.select("symbol", "events", "bins", fano(F.col("events"), F.col("squares"), F.col("bins")).alias("fano"))


def minute_fano(trades: DataFrame, start_ms: int | None = None, end_ms: int | None = None, bin_ms: int = 100, per_minute: int = 600) -> DataFrame:
    """Fano factor of each minute with events; the first and last minute are cut to the observed bins."""
    counts = bin_counts(trades, bin_ms)
    edge = _bounds(counts, start_ms, end_ms, bin_ms).select("symbol", "first_bin", "last_bin")
    m = counts.groupBy("symbol", F.floor(F.col("bin") / per_minute).alias("minute")).agg(F.sum("c").alias("events"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    bins = F.least(F.col("last_bin"), (F.col("minute") + 1) * per_minute - 1) - F.greatest(F.col("first_bin"), F.col("minute") * per_minute) + 1
    return m.join(F.broadcast(edge), "symbol").select("symbol", "minute", "events", bins.alias("bins"), fano(F.col("events"), F.col("squares"), bins).alias("fano"))


def median_minute_fano(minutes: DataFrame) -> DataFrame:
    """The exact median over the minutes of minute_fano."""
    t = minutes.groupBy("symbol").agg(F.count("fano").alias("minutes"))
    return with_quantiles(t, exact_quantiles(minutes, ["symbol"], ["fano"], [0.5]), ["symbol"]).select("symbol", "minutes", F.col("q_fano")[0].alias("median_fano"))
