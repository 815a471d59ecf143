"""Exact quantiles of large groups: wanted ranks are closed in on by counts, so no task holds a group's values.

Splitters from a sketch cut a group's values into cells, one aggregate counts the cells, and only the cells that hold a
wanted rank go on, equal values as one row with their number. Splitters decide how fast this is, counts alone what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.folders import new_folder

#: Different values of a group that a task may order, splitter rows that may be broadcast, and a sketch's relative rank error.
MOST_VALUES, MOST_BROADCAST, ERROR = 1 << 18, 1 << 14, 1e-4


def beside(rows: DataFrame, small: DataFrame, on: list[str], n_small: int, most: int = MOST_BROADCAST) -> DataFrame:
    """rows joined with a table of n_small rows: a broadcast up to `most` rows, a shuffled join beyond."""
    return rows.join(F.broadcast(small) if n_small <= most else small, on)


def _cell(value: Column, splitters: Column, n: int) -> Column:
    """How many of n splitters lie at or below a value."""
    return sum(((value >= splitters[i]).cast("int") for i in range(n)), F.lit(0))


def _picked(rows: DataFrame, key: list[str], ranks: list[Column]) -> DataFrame:
    """(key, r0, r1, ...): of rows (key, v, c) the value at each rank, from 1; equal values are one row with their number c."""
    w = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumns({"__upto": F.sum("c").over(w), "__n": F.sum("c").over(Window.partitionBy(*key))})
    here = lambda r: (r > F.col("__upto") - F.col("c")) & (r <= F.col("__upto"))
    return upto.groupBy(*key).agg(*(F.max(F.when(here(r), F.col("v"))).alias(f"r{i}") for i, r in enumerate(ranks)))


def exact_quantiles(rows: DataFrame, by: list[str], values: list[str], probabilities: list[float], most_values: int = MOST_VALUES, splits: int = 64, weight: str | None = None) -> DataFrame:
    """One row per group: by, and for each value column q_<name>, the array of its quantiles (linear between the two nearest
    ranks), all columns, groups and quantiles together. Nulls do not count, NaN is above all numbers; a column without values
    in a group has null. A task orders at most about most_values different values of a group and column; larger groups are
    narrowed down first, by tables in the shared folder. weight: a column of whole numbers, how often a row counts."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "quantiles")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    group = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("j"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values))))
    once = (F.col(weight) if weight else F.lit(1)).cast("long")
    flat = rows.select(group.alias("g"), cells.alias("x"), once.alias("c")).select("g", "x.j", "x.v", "c").where("v is not null")
    sizes = kept(flat.groupBy("g", "j").agg(F.sum("c").alias("n")), "sizes")
    spot = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = lambda p: (F.floor(spot(p)) + 1, F.ceil(spot(p)) + 1)
    pairs = [r for p in probabilities for r in ranks(p)]
    n_groups, largest = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    if largest <= most_values:
        counted = flat.groupBy("g", "j", "v").agg(F.sum("c").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("g", "j")))
        found = _picked(counted, ["g", "j"], pairs)
    else:
        key, work = ["g", "j"], flat
        targets = kept(sizes.select("g", "j", F.posexplode(F.array(*pairs)).alias("t", "r")), "targets0")
        # the first splitters bracket the wanted ranks as closely as the sketch can; later ones cut evenly
        fractions = sorted({min(1.0, max(0.0, p + s)) for p in probabilities for s in (-2 * ERROR, 2 * ERROR)})
        turn = 0
        while True:
            turn += 1
            cuts = kept(work.groupBy(*key).agg(F.percentile_approx("v", fractions, int(1 / ERROR)).alias("s")), f"cuts{turn}")
            celled = beside(work, cuts, key, n_groups).withColumn("cell", _cell(F.col("v"), F.col("s"), len(fractions))).drop("s")
            total = celled.groupBy(*key, "cell").agg(F.sum("c").alias("m"))
            order = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
            upto = total.withColumn("upto", F.sum("m").over(order)).withColumn("before", F.col("upto") - F.col("m"))
            aims = targets.join(upto, key).where("r > before and r <= upto").select("g", "j", "t", "cell", (F.col("r") - F.col("before")).alias("r"))
            aims = kept(aims, f"aims{turn}")
            chosen = beside(celled, aims.select(*dict.fromkeys([*key, "t", "cell"])), [*key, "cell"], aims.count())
            key = ["g", "j", "t"]
            work = kept(chosen.groupBy(*key, "v").agg(F.sum("c").alias("c")), f"work{turn}")
            targets, n_groups = aims.drop("cell"), n_groups * len(pairs)
            if work.groupBy(*key).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] <= most_values:
                break
            fractions = [i / splits for i in range(splits + 1)]
        found = _picked(work.join(targets, key).withColumnRenamed("r", "__r"), key, [F.col("__r")])
        found = found.groupBy("g", "j").agg(*(F.max(F.when(F.col("t") == t, F.col("r0"))).alias(f"r{t}") for t in range(len(pairs))))
    out = found.join(sizes, ["g", "j"])
    line = lambda i, p: F.when(F.col(f"r{2 * i}") == F.col(f"r{2 * i + 1}"), F.col(f"r{2 * i}")).otherwise(F.col(f"r{2 * i}") + (spot(p) - F.floor(spot(p))) * (F.col(f"r{2 * i + 1}") - F.col(f"r{2 * i}")))
    out = out.withColumn("q", F.array(*(line(i, p) for i, p in enumerate(probabilities))))
    wide = out.groupBy("g").agg(*(F.first(F.when(F.col("j") == i, F.col("q")), ignorenulls=True).alias(f"q_{v}") for i, v in enumerate(values)))
    return wide.select(*(F.col(f"g.`{c}`").alias(c) for c in by), *(f"q_{v}" for v in values))


def with_quantiles(table: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """A table of one row a group beside the quantiles of exact_quantiles; null is a group like any other."""
    if not by:
        return table.join(quantiles, F.lit(True), "left")  # one row each
    same = F.lit(True)
    for c in by:
        same = same & table[c].eqNullSafe(quantiles[c])
    return table.join(quantiles, same, "left").select(*(table[c] for c in table.columns), *(quantiles[c] for c in quantiles.columns if c not in by))
