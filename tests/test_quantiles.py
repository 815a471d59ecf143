"""Exact quantiles by rank selection against numpy, with ties, nulls, and groups far larger than a task may order."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import diagnostics as dg
from tidemark.operators import hazard as hz
from tidemark.operators import quantiles as qu


def rows(spark, n=30_000):
    """Groups a (nearly all rows), b, null; a third of a's values are one number."""
    r = F.xxhash64("id", F.lit(5))
    v = F.when(r % 3 == 0, F.lit(2.5)).otherwise(F.pmod(r, F.lit(1 << 30)) / 1000.0 - 5e5)
    g = F.when(F.col("id") % 500 == 0, "b").when(F.col("id") % 501 == 0, None).otherwise("a")
    return spark.range(n).select(g.alias("g"), F.when(F.col("id") % 97 != 0, v).alias("v"), (F.col("id") % 11).alias("w"), F.lit("x").alias("c"))


@pytest.mark.parametrize("most", [1 << 18, 500, 3])
def test_quantiles_of_large_groups(spark, monkeypatch, most):
    df, probs = rows(spark), [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    held = []
    plain = qu._picked
    monkeypatch.setattr(qu, "_picked", lambda r, key, ranks: held.append(r.groupBy(*key).count().agg(F.max("count")).first()[0]) or plain(r, key, ranks))
    out = qu.exact_quantiles(df, ["g"], ["v", "w"], probs, most_values=most)
    assert "percentile(" not in out._jdf.queryExecution().toString()
    if most < 1 << 18:
        assert max(held) <= most  # of 30,000 rows in a group
    local = df.toPandas()
    got = {r.g: r for r in out.collect()}
    assert len(got) == 3
    for g in ("a", "b", None):
        part = local[local.g == g] if g else local[local.g.isna()]
        for c in ("v", "w"):
            want = np.quantile(part[c].dropna().astype(float), probs)
            assert np.allclose(got[g][f"q_{c}"], want, rtol=1e-12, atol=1e-9)


def test_quantiles_without_rows_values_or_groups(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 3.0, None)], "g string, v double, w double")
    got = {r.g: r for r in qu.exact_quantiles(df, ["g"], ["v", "w"], [0.5]).collect()}
    assert got["a"].q_v is None and got["a"].q_w == [1.0] and got["b"].q_v == [3.0] and got["b"].q_w is None
    assert qu.exact_quantiles(df, [], ["v"], [0.1, 0.9]).collect()[0].q_v == [3.0, 3.0]
    assert qu.exact_quantiles(df.where("false"), ["g"], ["v"], [0.5]).count() == 0
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (-math.inf,), (math.inf,)], "v double")
    q = qu.exact_quantiles(odd, [], ["v"], [0.0, 0.25, 0.5, 0.75, 1.0]).first().q_v
    assert q[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(q[4])
    lone = dg.markout_stats(df.where("false").withColumnRenamed("v", "markout")).collect()
    assert len(lone) == 1 and lone[0].n == 0 and lone[0].median_markout is None


def test_statistics_keep_groups_without_a_name(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("s", 1.0)], "side string, v double")
    got = {r.side: r for r in dg.markout_stats(df, "v", ["side"]).collect()}
    assert got[None].n == 9 and got[None].median_markout == 4.0 and got["s"].markout_tail == 1.0
    risk = {r.side: r for r in dg.pnl_stats(df, "v", ["side"], 0.25).collect()}
    assert risk[None].value_at_risk == -2.0 and risk[None].expected_shortfall == -1.0


def test_reliability_by_side(spark):
    df = spark.range(400).select(F.when(F.col("id") % 4 == 0, "bid").otherwise("ask").alias("side"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("probability"), (F.col("id") % 2).cast("double").alias("event"))
    both = {(r.side, r.bin): r for r in hz.reliability(df, 5, ["side"]).collect()}
    for side in ("bid", "ask"):
        alone = {r.bin: r for r in hz.reliability(df.where(F.col("side") == side), 5).collect()}
        assert {b: (round(r.predicted, 12), round(r.observed, 12), r["count"]) for b, r in alone.items()} == {b: (round(r.predicted, 12), round(r.observed, 12), r["count"]) for (s, b), r in both.items() if s == side}
