import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import accounting as acc
from tidemark.functions import prices as px
from tidemark.functions import quotes as gq
from tidemark.operators import diagnostics as dg
from tidemark.operators import hazard as hz
from tidemark.operators import walkforward as wf


def test_quotes_symmetry_and_bounds():
    m = gq.QuoteModel(1.0, 1.5, 0.1, 0.3, 0.0, 5)
    for q in range(-5, 6):
        bid, ask = gq.deltas(m, q, 1.0)
        mirror = gq.deltas(m, -q, 1.0)
        assert bid == pytest.approx(mirror[1]) if bid is not None else mirror[1] is None
    assert gq.deltas(m, 5, 1.0)[0] is None and gq.deltas(m, -5, 1.0)[1] is None
    assert np.isfinite(gq.relative_value(m, 2000.0)).all()
    c = m.constants[0]
    assert gq.deltas(m, 0, 0.0) == (c, c)
    with pytest.raises(ValueError):
        gq.deltas(m, 6, 1.0)


def test_time_grid():
    assert len(gq.time_grid(1.0, 0.1)) == 11 and gq.time_grid(1.0, 0.3)[-1] == 1.0 and len(gq.time_grid(1.0, 0.3)) == 5


def test_simulation_is_self_financing_and_seeded():
    m = gq.QuoteModel(1.0, 1.5, 0.1, 0.3, 0.0, 3)
    a, b = gq.simulate(m, 20.0, 0.5, 100.0, 7), gq.simulate(m, 20.0, 0.5, 100.0, 7)
    assert a == b and len(a) == 41 and all(abs(r[3]) <= 3 for r in a)
    for x, y in zip(a, a[1:], strict=False):
        paid = (x[8] or 0) * (x[2] - (x[6] or 0)) - (x[9] or 0) * (x[2] + (x[7] or 0))
        assert y[4] == pytest.approx(x[4] - paid) and y[3] == x[3] + (x[8] or 0) - (x[9] or 0)


def test_tick_rounding(spark):
    df = spark.createDataFrame([(100.09,)], "p double")
    assert df.select(px.tick_round(F.col("p"), "0.1", F.lit("buy")), px.tick_round(F.col("p"), "0.1", F.lit("sell"))).first()[:] == (100.0, 100.1)
    with pytest.raises(Exception, match="zero or less"):
        spark.createDataFrame([(0.01,)], "p double").select(px.tick_round(F.col("p"), "0.1", F.lit("buy"))).collect()


def test_grid_inventory_half_away_from_zero(spark):
    got = spark.createDataFrame([(x,) for x in (0.5, -0.5, 1.49, 9.0, -9.0)], "u double").select(px.grid_inventory(F.col("u"), 1.0, 3)).collect()
    assert [r[0] for r in got] == [1, -1, 1, 3, -3]


FILLS = "k string, n long, side string, price double, quantity double"


def test_linear_rebate(spark):
    f = spark.createDataFrame([("a", 1, "buy", 100.0, 1.0), ("a", 2, "sell", 101.0, 1.0)], FILLS)
    rows = acc.linear(f, ["k"], ["n"], -0.001).orderBy("n").collect()
    assert rows[-1].inventory_after == 0 and rows[-1].cash_after == pytest.approx(1.201)


def test_inverse_harmonic_entry_and_flip(spark):
    f = spark.createDataFrame([("a", 1, "buy", 100.0, 1.0), ("a", 2, "buy", 200.0, 1.0), ("a", 3, "sell", 150.0, 3.0)], FILLS)
    rows = acc.inverse(f, ["k"], ["n"], 100.0).orderBy("n").collect()
    assert rows[1].average_entry == pytest.approx(133.33333333)
    assert rows[2].inventory_after == -1 and rows[2].average_entry == 150.0 and rows[2].realized_pnl == pytest.approx(100 * 2 * (1 / 133.3333333333333 - 1 / 150))


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.3, 1.0), (1.0, 1.0), (0.0, 0.0)], "probability double, event double")
    assert sorted(r.bin for r in hz.calibration(df).collect()) == [0, 2, 9]


def test_likelihood_edge_cases(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0)], "count long, rate double, exposure double")
    assert df.agg(hz.log_likelihood()).first()[0] == -math.inf and df.agg(hz.deviance()).first()[0] == math.inf


def test_competing_risk_ties_raise(spark):
    df = spark.createDataFrame([(1.0, 2.0, None)], "f double, a double, c double")
    label = hz.competing_risk(F.col("f"), F.col("a"), F.col("c"))
    assert df.select(label).first()[0] == "fill"
    with pytest.raises(Exception, match="simultaneous"):
        spark.createDataFrame([(1.0, 1.0, None)], "f double, a double, c double").select(label).collect()


def test_glm_recovers_rates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    e = rng.uniform(0.5, 2, size=4000)
    y = rng.poisson(e * np.exp(-0.5 + 0.4 * x))
    rows = spark.createDataFrame([(float(a), int(b), float(c), "bid" if i % 2 else "ask") for i, (a, b, c) in enumerate(zip(x, y, e, strict=True))], "x1 double, count long, exposure double, side string")
    rows = rows.withColumnRenamed("x1", "distance")
    m = hz.PoissonGlm(("distance",), l2=1e-6).fit(rows)
    slope = {s: b[1] / m.stats.first()["s_distance"] for s, b in m.beta.items()}
    assert set(slope) == {"bid", "ask"} and all(abs(v - 0.4) < 0.08 for v in slope.values()) and all(r["converged"] and r["gradient"] < 1e-5 for r in m.results.values())
    with pytest.raises(Exception, match="not trained"):
        m.predict(rows.withColumn("side", F.lit("other"))).collect()


def test_walk_forward_has_no_leakage(spark):
    rows = spark.createDataFrame([(m, s, c, 1.0) for m in range(1, 5) for s in ("bid", "ask") for c in (m, 0)], "m int, side string, count long, exposure double").withColumn("month", F.make_date(F.lit(2024), F.col("m"), F.lit(1)))
    by = {(r.m, r.side): r.rate for r in wf.constant_rate(rows).collect()}
    assert by[(2, "bid")] == 0.5 and by[(3, "bid")] == 0.75 and (1, "bid") not in by
    with pytest.raises(ValueError):
        wf.monthly_splits(rows, "rolling", 3, 2)


def test_drawdown_definitions(spark):
    df = spark.createDataFrame([("a", 1, -2.0), ("a", 2, 1.0)], "k string, n long, v double")
    assert dg.drawdown(df, "v", ["n"], ["k"]).first().max_drawdown == 2.0
    assert dg.drawdown(df, "v", ["n"], ["k"], from_first=True).first().max_drawdown == 0.0


def test_acf_of_a_constant(spark):
    df = spark.createDataFrame([("bid", i, 1.0) for i in range(3)], "side string, n long, v double")
    assert {r.lag: r.acf for r in dg.acf(df, "v", ["n"], ["side"], 2).collect()} == {0: 1.0, 1: 0.0, 2: 0.0}


def test_gate_needs_out_of_sample():
    assert not dg.gate(1000, {"bid": 0.5}, None, 2.0, False)["warranted"]
    g = dg.gate(1000, {"bid": 0.5}, None, 2.0, True)
    assert g["warranted"] and g["overdispersed"]
    assert not dg.gate(1000, {"bid": 0.01}, 0.02, 9.0, True)["warranted"]


def test_bootstrap_single_cluster(spark):
    df = spark.createDataFrame([("c", 0, 1.0), ("c", 0, 0.0)], "cluster string, bin int, event double")
    r = dg.bootstrap_ci(df, "cluster", "bin", "event", draws=20).first()
    assert (r.lower, r.upper) == (0.5, 0.5)


@pytest.mark.parametrize("count", [0, 1, 2, 20, 21, 30, 1000])
def test_log_likelihood_of_large_counts(spark, count):
    got = spark.createDataFrame([(count, 2.5, 2.0)], "count long, rate double, exposure double").agg(hz.log_likelihood()).first()[0]
    assert got == pytest.approx(count * math.log(5.0) - 5.0 - math.lgamma(count + 1), rel=1e-12)


def test_blocks_do_not_change_order_statistics(spark):
    import numpy as np

    from tidemark.operators import ordering

    rng = np.random.default_rng(5)
    data = [("a" if k % 3 else "b", int(t), float(v)) for k, (t, v) in enumerate(zip(rng.integers(-50, 50, 400), rng.normal(size=400), strict=True))] + [("a", None, 0.25)]
    df = spark.createDataFrame(data, "side string, t long, v double")
    lagged = ordering.with_lags(ordering.numbered(df, ["t", "v"], ["side"], 7), "v", 3, ["side"], 5).collect()
    for side in "ab":
        own = sorted(((-1e9 if t is None else t, v) for s, t, v in data if s == side))
        got = sorted((r for r in lagged if r.side == side), key=lambda r: r["__k"])
        assert [r["__k"] for r in got] == list(range(1, len(own) + 1)) and [r.v for r in got] == [v for _, v in own]
        assert [(r.l1, r.l3) for r in got] == [(own[k - 1][1] if k else None, own[k - 3][1] if k > 2 else None) for k in range(len(own))]
        steps = np.cumsum([v for _, v in own])
        fall = ordering.largest_fall(df.where(f"side = '{side}'"), "v", ["t"], ["side"], False, 7).first().fall
        assert fall == pytest.approx(max(np.maximum(np.maximum.accumulate(steps), 0) - steps))
        level = np.array([v for _, v in own])
        assert ordering.largest_fall(df.where(f"side = '{side}'"), "v", ["t"], ["side"], True, 7).first().fall == pytest.approx(max(np.maximum.accumulate(level) - level))


def test_bootstrap_in_buckets(spark):
    """Many buckets give the interval that one gives, up to the draws' own spread."""
    df = spark.range(6000).selectExpr("cast(id % 600 as string) as cluster", "cast(id % 2 as int) as bin", "cast(hash(id % 600) % 5 = 0 as double) as event")
    one, many = ({r.bin: r for r in dg.bootstrap_ci(df, "cluster", "bin", "event", bucket_clusters=b).collect()} for b in (10_000, 40))
    for k in (0, 1):
        assert one[k].observed == many[k].observed and one[k].lower < one[k].observed < one[k].upper
        width = one[k].upper - one[k].lower
        assert abs(one[k].lower - many[k].lower) < 0.15 * width and abs(one[k].upper - many[k].upper) < 0.15 * width


def test_inverse_fold_is_linear(spark):
    import time

    f = spark.range(200_000).selectExpr("'a' as k", "id as n", "if(id % 2 = 0, 'buy', 'sell') as side", "100.0 + id % 7 as price", "1.0 + id % 3 as quantity")
    began = time.time()
    assert acc.inverse(f, ["k"], ["n"]).count() == 200_000 and time.time() - began < 60


def test_month_pair(spark):
    rows = spark.createDataFrame([("2024-01-01",), ("2024-02-01",), ("2024-03-01",)], "m string").select(F.col("m").cast("date").alias("month"))
    assert sorted((str(r.month), r.part) for r in wf.month_pair(rows, "2024-01", "2024-03").collect()) == [("2024-01-01", "train"), ("2024-03-01", "test")]
    with pytest.raises(ValueError, match="before"):
        wf.month_pair(rows, "2024-02", "2024-02")
    with pytest.raises(ValueError, match="2024-04"):
        wf.month_pair(rows, "2024-01", "2024-04")


def test_month_of_units(spark):
    got = spark.range(1).select(*(wf.month_of(F.lit(-1 * per).cast("long"), u) for u, per in (("s", 1), ("ms", 1000), ("us", 10**6), ("ns", 10**9)))).first()
    assert {str(x) for x in got} == {"1969-12-01"}


def test_value_vector_and_time_grids(spark):
    m = gq.QuoteModel(1.0, 1.5, 0.1, 0.3, 0.02, 3)
    _, eta, alpha, beta = m.constants
    q = np.arange(-3, 4.0)
    step = np.eye(7) - (np.diag(alpha * q**2 - beta * q) - eta * (np.eye(7, k=1) + np.eye(7, k=-1))) * (2.0 / 2**20)
    assert gq.finite_value(m, 2.0) == pytest.approx(np.linalg.matrix_power(step, 2**20) @ np.ones(7), rel=1e-5)
    params = [(1, 1.0, 0.1), (2, 1.0, 0.3), (3, 0.5, 2.0), (4, 0.7, 0.7 / 3)]
    rows = gq.time_grids(spark.createDataFrame(params, "id long, horizon double, dt double")).orderBy("id", "step").collect()
    for k, horizon, dt in params:
        assert [r.time for r in rows if r.id == k] == pytest.approx(list(gq.time_grid(horizon, dt)))


def test_flagged_risk(spark):
    df = spark.createDataFrame([(True, False, None, None, 1.0, 2.0), (True, True, False, 5.0, 2.0, None), (None, False, False, None, None, None)], "f boolean, a boolean, c boolean, t double, u double, v double")
    flags, times = tuple(map(F.col, "fac")), tuple(map(F.col, "tuv"))
    assert [r[0] for r in df.select(hz.flagged_risk(flags, times)).collect()] == ["fill", "adverse_move", "none"]
    for odd, told in ((None, "missing"), (-1.0, "missing"), (float("inf"), "missing"), (float("nan"), "missing"), (2.0, "simultaneous")):
        row = spark.createDataFrame([(True, True, False, odd, 2.0, None)], df.schema)
        with pytest.raises(Exception, match=told):
            row.select(hz.flagged_risk(flags, times)).collect()
    with pytest.raises(Exception, match="need event times"):
        df.select(hz.flagged_risk(flags)).collect()


def test_a_small_file_of_seeds_is_dealt_out(spark):
    """Paths make many rows of few seeds: one input partition must not simulate them all in one task."""
    m, seeds = gq.QuoteModel(1.0, 1.5, 0.1, 0.3, 0.0, 2), spark.range(40).toDF("seed").coalesce(1)
    out = gq.simulate_paths(seeds, m, 3.0, 0.5, 100.0, paths=5)
    assert out.rdd.getNumPartitions() == 8
    rows = sorted(tuple(r)[1:] for r in out.where("seed = 17").collect())
    assert rows == gq.simulate(m, 3.0, 0.5, 100.0, 17) and out.count() == 40 * 7
    assert all(r[6:8] == gq.deltas(m, r[3], 3.0 - r[1]) for r in rows[:-1])


def test_a_key_of_many_rows_is_not_sent_to_one_task(spark):
    """Means and cutoffs of two sides are broadcast beside the rows; no join shuffles the rows by side."""
    rows = spark.range(400).selectExpr("id as ts_ms", "id as k1", "if(id % 2 = 0, 'bid', 'ask') as side", "double(id * 37 % 101) as v")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for out in (dg.acf(rows, "v", ["ts_ms", "k1"], ["side"], 2), dg.pnl_stats(rows, "v", ["side"])):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin [side" in plan or "BroadcastHashJoin [coalesce(side" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_more_rows_of_a_series_go_to_more_tasks(spark):
    rows = spark.range(3000).selectExpr("id * 86400000 as ts_ms", "id as k1", "if(id % 2 = 0, 'bid', 'ask') as side", "double(id * 37 % 101) as v")
    few, many = (dg.acf(rows, "v", ["ts_ms", "k1"], ["side"], 2, most) for most in (1 << 22, 100))
    assert "REPARTITION_BY_NUM" in (plan := many._jdf.queryExecution().executedPlan().toString()) and ", 30)" in plan
    got = lambda x: {(r.side, r.lag): pytest.approx(r.acf, abs=1e-12) for r in x.collect()}
    assert got(few) == {k: v.expected for k, v in got(many).items()}
