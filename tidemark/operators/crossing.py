"""First crossings of levels inside spans of time, without pairs of spans and points.

The extremes of a series by block of time form a tree of a few levels. A span asks for its blocks at the coarsest level and
goes down only into those that may hold its first crossing: the first full block that crosses, and a partial one ahead of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a level in one block of the level above.
FAN = 64
#: Values and levels are compared in decimals, so that long running totals stay exact.
VALUE = "decimal(38,12)"


def crosses(value: Column) -> Column:
    """Of a span's row: value lies at or beyond thr in the span's direction; strictly beyond if strict."""
    return F.when(F.col("up"), F.when(F.col("strict"), value > F.col("thr")).otherwise(value >= F.col("thr"))).otherwise(F.when(F.col("strict"), value < F.col("thr")).otherwise(value <= F.col("thr")))


def first_crossing(spans: DataFrame, points: DataFrame, longest_ms: int, fan: int = FAN) -> DataFrame:
    """(id, hit): for each span (k, id, lo, hi, thr, up, strict) that is crossed the first point (t, s, v, p) of its series k, by (t, s),
    with lo < t <= hi. No span is longer than longest_ms. A span meets at most `fan` + 1 blocks of a level for each of the few
    ranges that it keeps, and points only in the last ranges; busy times are many small blocks."""
    widths, w = [], -(-longest_ms // fan)
    while w > fan:
        widths.append(w)
        w = -(-w // fan)
    span = ["k", "id", "thr", "up", "strict"]
    ranges = spans.where("hi > lo and thr is not null").select(*span, "lo", "hi")
    for w in widths:
        blocks = points.groupBy("k", F.floor(F.col("t") / w).alias("b")).agg(F.max("v").alias("most"), F.min("v").alias("least"))
        asked = ranges.withColumn("b", F.explode(F.sequence(F.floor((F.col("lo") + 1) / w), F.floor(F.col("hi") / w))))
        met = asked.join(blocks, ["k", "b"]).where(crosses(F.when(F.col("up"), F.col("most")).otherwise(F.col("least"))))
        whole = (F.col("b") * w > F.col("lo")) & ((F.col("b") + 1) * w - 1 <= F.col("hi"))
        kept = met.groupBy(*span, "lo", "hi").agg(F.min(F.when(whole, F.col("b"))).alias("sure"), F.min(F.when(~whole, F.col("b"))).alias("x"), F.max(F.when(~whole, F.col("b"))).alias("y"))
        down = F.filter(F.array_distinct(F.array_compact(F.array("x", "y", "sure"))), lambda b: F.col("sure").isNull() | (b <= F.col("sure")))
        cut = kept.withColumn("b", F.explode(down))
        ranges = cut.select(*span, F.greatest("lo", F.col("b") * w - 1).alias("lo"), F.least("hi", (F.col("b") + 1) * w - 1).alias("hi"))
    w = widths[-1] if widths else longest_ms
    asked = ranges.withColumn("b", F.explode(F.sequence(F.floor((F.col("lo") + 1) / w), F.floor(F.col("hi") / w))))
    near = asked.join(points.withColumn("b", F.floor(F.col("t") / w)), ["k", "b"]).where((F.col("t") > F.col("lo")) & (F.col("t") <= F.col("hi")) & crosses(F.col("v")))
    return near.groupBy("id").agg(F.min(F.struct("t", "s", "v", "p")).alias("hit"))
