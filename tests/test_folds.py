"""Fits of all folds at once against numpy, with nine features, ridge, bounds, and rows of several batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import diagnostics as dg
from tidemark.operators import hazard as hz
from tidemark.operators import walkforward as wf
from tidemark.operators.folds import fit_folds


def scaler(x):
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    iqr, dev = (q[2] - q[0]) / 1.349, x.std(axis=0)
    return q[1], np.where(iqr > 1e-12, iqr, np.where(dev > 1e-12, dev, 1.0))


def newton(x, y, e, l2, centre, scale, clip=12.0, bound=30.0, steps=100):
    """Plain numpy: Newton steps with halving, on all rows at once."""
    d = np.hstack([np.ones((len(x), 1)), np.clip((x - centre) / scale, -clip, clip)])
    ridge = np.append(0.0, np.full(x.shape[1], l2))
    beta = np.zeros(d.shape[1])
    beta[0] = math.log((y.sum() + 0.5) / (e.sum() + 0.5))
    value = lambda b: (e * np.exp(np.clip(d @ b, -bound, bound)) - y * np.clip(d @ b, -bound, bound)).sum() + 0.5 * (ridge * b * b).sum()
    for _ in range(steps):
        mu = e * np.exp(np.clip(d @ beta, -bound, bound))
        step, size = np.linalg.solve((d * mu[:, None]).T @ d + np.diag(ridge), d.T @ (mu - y) + ridge * beta), 1.0
        while value(np.clip(beta - size * step, -bound, bound)) > value(beta) + 1e-12 * abs(value(beta)) and size > 1e-6:
            size /= 2
        new = np.clip(beta - size * step, -bound, bound)
        if np.abs(new - beta).max() < 1e-9:
            break
        beta = new
    mu = e * np.exp(np.clip(d @ beta, -bound, bound))
    return beta, (y * np.log(mu) - mu - np.array([math.lgamma(v + 1) for v in y])).sum()


def sample(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 9))
    x[:, 3] = np.where(rng.random(n) < 0.9, 0.0, x[:, 3])  # no spread between quartiles
    x[:, 4] = 7.0  # constant
    x[5, 0] = 1e6  # clipped
    e = rng.uniform(0.1, 3, n)
    y = rng.poisson(e * np.exp(-0.7 + 0.4 * x[:, 1] - 0.3 * x[:, 2]))
    return x, y, e, rng.choice(["bid", "ask"], n), rng.integers(1, 5, n)


def frame(spark, x, y, e, side, m):
    names = [f"{c} double" for c in hz.FEATURES]
    rows = [(*map(float, a), int(b), float(c), str(s), int(k)) for a, b, c, s, k in zip(x, y, e, side, m, strict=True)]
    return spark.createDataFrame(rows, ", ".join(names) + ", count long, exposure double, side string, m int").withColumn("month", F.make_date(F.lit(2024), F.col("m"), F.lit(1))).repartition(5)


@pytest.mark.parametrize("l2", [1e-3, 25.0])
def test_glm_with_nine_features_against_numpy(spark, l2):
    x, y, e, side, m = sample()
    got = hz.PoissonGlm(l2=l2).fit(frame(spark, x, y, e, side, m))
    for s in ("bid", "ask"):
        own, (centre, scale) = side == s, scaler(x)  # one scaler for both sides
        fit = got.fits[0, s]
        beta, like = newton(x[own], y[own], e[own], l2, centre, scale)
        assert np.allclose(fit.centre, centre) and np.allclose(fit.scale, scale) and np.allclose(fit.beta, beta, atol=1e-6)
        assert fit.converged and fit.n_observations == own.sum() and math.isclose(fit.log_likelihood, like, rel_tol=1e-9)


def test_bounds_hold_where_no_event_was_seen(spark):
    rows = spark.createDataFrame([(float(i % 2), 1 if i % 2 else 0, 1.0, "bid") for i in range(200)], "distance double, count long, exposure double, side string")
    m = hz.PoissonGlm(("distance",), l2=0.0).fit(rows)
    rate = {r.distance: r.rate for r in m.predict(rows).select("distance", "rate").distinct().collect()}
    assert all(abs(b) <= 30 for b in m.beta["bid"]) and rate[0.0] < 1e-6 and abs(rate[1.0] - 1) < 1e-6


def test_walk_forward_of_all_folds_equals_each_fold_alone(spark):
    x, y, e, side, m = sample(900, 3)
    rows = frame(spark, x, y, e, side, m)
    oos, fits = wf.walk_forward_glm(rows, hz.FEATURES, min_train=2)
    told = {(r.fold, r.side): r for r in fits.collect()}
    assert {f for f, _ in told} == {2, 3} and all(r.n_parameters == 10 and r.converged for r in told.values())
    for fold in (2, 3):
        use = m <= fold
        centre = scaler(x[use])[0]
        alone = fit_folds(rows.where(F.col("m") <= fold), hz.FEATURES)
        for s in ("bid", "ask"):
            assert np.allclose(alone[0, s].centre, centre) and np.allclose(told[fold, s].coefficients, alone[0, s].beta, atol=1e-7)
            assert told[fold, s].n_observations == (use & (side == s)).sum() and math.isclose(told[fold, s].event_count, y[use & (side == s)].sum())
    got = oos.collect()
    assert len(got) == (m > 2).sum() and {(r.m, r.fold) for r in got} == {(3, 2), (4, 3)}
    for r in got[:50]:
        centre, scale = scaler(x[m <= r.fold])
        z = np.clip((np.array([r[c] for c in hz.FEATURES]) - centre) / scale, -12, 12)
        assert math.isclose(r.rate, math.exp(np.append(1.0, z) @ told[r.fold, r.side].coefficients), rel_tol=1e-9)
        assert math.isclose(r.probability, -math.expm1(-r.rate * r.exposure), rel_tol=1e-12)
    with pytest.raises(ValueError, match="no eligible"):
        wf.walk_forward_glm(rows.where("m = 1"), hz.FEATURES)


def test_a_side_that_its_fold_never_saw_raises(spark):
    rows = spark.createDataFrame([(1, "bid", 1, 1.0, 0.5), (1, "bid", 0, 1.0, 1.5), (2, "bid", 1, 1.0, 0.5), (2, "ask", 1, 1.0, 0.5)], "m int, side string, count long, exposure double, distance double").withColumn("month", F.make_date(F.lit(2024), F.col("m"), F.lit(1)))
    with pytest.raises(Exception, match="not trained"):
        wf.walk_forward_glm(rows, ("distance",))[0].collect()
    assert wf.walk_forward_glm(rows.where("side = 'bid'"), ("distance",))[0].count() == 1


def test_gate_frame_names_its_reasons(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(size=400).cumsum()
    df = spark.createDataFrame([(i // 2, "bid" if i % 2 else "ask", float(v), 1) for i, v in enumerate(r)], "ts_ms long, side string, residual double, count int")
    out, inside = (dg.gate_frame(df, ["ts_ms"], out_of_sample=o).first() for o in (True, False))
    assert out.warranted and out.decision == "research_hawkes" and out.reasons[0] == "serial" and "in_sample" not in out.reasons
    assert not inside.warranted and inside.reasons[0] == "in_sample" and inside.serial_dependence
    calm = spark.createDataFrame([(i, "bid" if i % 2 else "ask", float(v), 1) for i, v in enumerate(rng.normal(size=20000))], "ts_ms long, side string, residual double, count int")
    got = dg.gate_frame(calm, ["ts_ms"]).first()
    assert not got.warranted and got.reasons == ["nothing_left"] and got.decision == "keep_state_dependent_poisson"


def test_equal_rows_are_gathered_and_weigh_as_often_as_they_occur(spark):
    """A pass reads as many rows as there are different ones; nulls, copies and rows alone give the fit of the rows one by one."""
    from tidemark.operators import folds

    rows = spark.range(6000).selectExpr("double(id % 5) as x", "case when id % 3 = 0 then 'bid' else 'ask' end as side", "int(id % 7 = 0) as count", "1.0 + id % 2 as exposure", "date'2024-01-01' as month")
    rows = rows.unionByName(spark.sql("select cast(null as double) as x, 'bid' as side, 1 as count, 1.0 as exposure, date'2024-01-01' as month")).withColumn("exposure", F.col("exposure").cast("double"))
    got = folds.gathered(rows, ("x",), False)
    assert got.count() <= 5 * 2 * 2 * 2 + 1 and got.agg(F.sum("c")).first()[0] == 6001
    fits = fit_folds(rows, ("x",))
    x, y, e, side = (np.array(c) for c in zip(*[(r.x, r["count"], r.exposure, r.side) for r in rows.where("x is not null").collect()], strict=True))
    for s in ("bid", "ask"):
        f, use = fits[0, s], side == s
        d = np.stack([np.ones(use.sum()), (x[use] - f.centre[0]) / f.scale[0]], axis=1)
        slope = d.T @ (e[use] * np.exp(d @ f.beta) - y[use]) + np.array([0.0, 1e-3]) * f.beta
        assert f.n_observations == use.sum() and f.converged and np.abs(slope).max() < 1e-6
