"""Registered reports over fitted models: walk-forward of all folds at once, evaluation, residuals and the gate in full, features of
episode rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import diagnostics as dg
from tidemark.operators import episodes as ep
from tidemark.operators import hazard as hz
from tidemark.operators import walkforward as wf
from tidemark.plans.catalog import ACF, BINS, MONTHLY, OOS, ORDER, RATE, SPLIT, W, XS, _rated, _residuals, query, rounded
from tidemark.sources import feeds
from tidemark.sources.folders import kept

LATE = "x as (select month, side, k1, k2, (k2 > 3)::double as late, (k1 % 5 = 0 or k2 > 5)::bigint as count, exposure from mo)"
FITTED = f"""{MONTHLY}, {LATE}, {SPLIT}, sums as (select side, month, late, sum(count) as y, sum(exposure) as e from x group by 1, 2, 3),
rt as (select t.k as fold, t.month, s.side, s.late, sum(s.y) / sum(s.e) as rate from um t join um u on u.k < t.k and u.k >= t.k - 24 join sums s on s.month = u.month where t.k >= 12 group by 1, 2, 3, 4),
oo as (select x.*, rt.fold, rt.rate, 1 - exp(-rt.rate * exposure) as probability from x join rt using (month, side, late))"""


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    """With one feature of two values and no ridge, a fold's fitted rate of a side's group is its events over its exposure."""
    x = feeds.monthly_episodes(spark, d)
    x = x.select("month", "side", "k1", "k2", (F.col("k2") > 3).cast("double").alias("late"), ((F.col("k1") % 5 == 0) | (F.col("k2") > 5)).cast("long").alias("count"), "exposure")
    return wf.walk_forward_glm(x, ("late",), "rolling", 12, 24, l2=0.0)[0]


@query(f"with {FITTED} select fold::int as fold, month, side, late, count(*) as n, round(max(rate), 6) as rate from oo group by 1, 2, 3, 4")
def walkforward_fitted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_fitted(spark, d).groupBy("fold", "month", "side", "late").agg(F.count("*").alias("n"), F.max("rate").alias("rate")), 6)


@query(f"""with {FITTED} select side, count(*) as n_observations, sum(count)::double as event_count, round(sum(case when count > 0 then count * ln(rate * exposure) else 0 end - rate * exposure) / count(*), 6) as mean_poisson_log_likelihood,
  round(2 * sum(rate * exposure - count + case when count > 0 then count * ln(count / (rate * exposure)) else 0 end) / count(*), 6) as mean_deviance, round(avg(((count > 0)::int - probability) * ((count > 0)::int - probability)), 6) as brier_score,
  round(avg(probability), 6) as predicted_event_frequency, round(sum(rate * exposure) / sum(exposure), 6) as predicted_rate from oo group by 1""")
def walkforward_fitted_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-sample measures of the fitted folds together."""
    e = hz.evaluation(_fitted(spark, d), ["side"]).withColumn("mean_deviance", F.col("poisson_deviance") / F.col("n_observations"))
    return rounded(e.select("side", "n_observations", "event_count", "mean_poisson_log_likelihood", "mean_deviance", "brier_score", "predicted_event_frequency", "predicted_rate"), 6)


@query(f"""with {RATE}, ev as (select side, count(*) as n_observations, sum(count)::double as event_count, sum(exposure) as total_exposure, sum(count * ln(rate * exposure) - rate * exposure) as poisson_log_likelihood,
  2 * sum(rate * exposure - count + case when count > 0 then count * ln(count / (rate * exposure)) else 0 end) as poisson_deviance, avg((event - p) * (event - p)) as brier_score, avg(event) as observed_event_frequency, avg(p) as predicted_event_frequency,
  sum(count) / sum(exposure) as observed_rate, sum(rate * exposure) / sum(exposure) as predicted_rate from ra group by 1),
cv as (select side, least(floor(p * 10 + 1e-12), 9)::int as bin, avg(p) as predicted, avg(event) as observed, count(*) as count from ra group by 1, 2)
select side, n_observations, event_count, round(total_exposure, 5) as total_exposure, round(poisson_log_likelihood, 4) as poisson_log_likelihood, round(poisson_log_likelihood / n_observations, 8) as mean_poisson_log_likelihood, round(poisson_deviance, 4) as poisson_deviance,
  round(brier_score, 8) as brier_score, round(observed_event_frequency, 8) as observed_event_frequency, round(predicted_event_frequency, 8) as predicted_event_frequency, round(observed_rate, 8) as observed_rate, round(predicted_rate, 8) as predicted_rate,
  bin, round(predicted, 8) as predicted, round(observed, 8) as observed, count from ev join cv using (side)""")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The eleven measures of a side beside each bin of its calibration."""
    e = hz.evaluation_report(_rated(spark, d), ["side"]).withColumn("x", F.explode("curve")).select("*", "x.*").drop("x", "curve")
    few = {"total_exposure": 5, "poisson_log_likelihood": 4, "poisson_deviance": 4}
    return e.select(*(F.round(c, few.get(c, 8)).alias(c) if t == "double" and c != "event_count" else F.col(c) for c, t in e.dtypes))


_LAGS = (1, 2, 3)


def _curve_sql(value: str, name: str, scope: str | None) -> str:
    part = f"where side = '{scope}'" if scope else ""
    tag = f"{name}_{scope or 'all'}"
    lags = ", ".join(f"lag(c, {k}) over (order by ts_ms, k1, k2, c) as l{k}" for k in _LAGS)
    return f"{tag}_c as (select ts_ms, k1, k2, {value} - avg({value}) over () as c from oo {part}), {tag}_l as (select c, {lags} from {tag}_c), {tag} as (select " + ", ".join(f"round(sum(c * l{k}) / sum(c * c), 7) as {tag}_{k}" for k in _LAGS) + f" from {tag}_l)"


_CURVES = [(v, n, s) for v, n in (("count::double", "count"), ("residual", "residual")) for s in (None, "bid", "ask")]
_TAGS = [f"{n}_{s or 'all'}" for _, n, s in _CURVES]
REPORT = f"""with {OOS}, {XS}, {', '.join(_curve_sql(*c) for c in _CURVES)}, nn as (select count(*) as n_observations, round(sum(residual * residual) / greatest(count(*) - 4, 1), 7) as dispersion from oo),
cx as (select round(covar_pop(b, a) / (stddev_pop(b) * stddev_pop(a)), 7) as correlation, count(*) as pair_count from pr)
select true as out_of_sample, n_observations, 4 as n_parameters, dispersion, correlation, pair_count, {', '.join(f'{t}_{k}' for t in _TAGS for k in _LAGS)} from nn, cx, {', '.join(_TAGS)}"""


@query(REPORT)
def residual_report(spark: SparkSession, d: str) -> DataFrame:
    """The residual bundle, its curves spelled out by lag."""
    r = dg.residual_bundle(kept(_residuals(spark, d), "residuals"), ORDER, max(_LAGS), 4, True)
    cells = [F.round(F.col(f"{n}_acf" + (f"_{s}" if s else ""))[k], 7).alias(f"{n}_{s or 'all'}_{k}") for _, n, s in _CURVES for k in _LAGS]
    return r.select("out_of_sample", "n_observations", "n_parameters", F.round("dispersion", 7).alias("dispersion"), F.round("correlation", 7).alias("correlation"), "pair_count", *cells)


GATES = f"""with {OOS}, {ACF}, {XS}, nn as (select count(*) as n, sum(residual * residual) / count(*) as disp from oo),
pk as (select max(greatest(abs(s1/d), abs(s2/d), abs(s3/d))) as peak from ac2), cx as (select covar_pop(b, a) / (stddev_pop(b) * stddev_pop(a)) as corr from pr),
g as (select o.oos, z.least, greatest(z.least, 1.96 / sqrt(n)) as lim, peak, corr, disp from nn, pk, cx, (values (true), (false)) o(oos), (values (0.1), (0.000001)) z(least)),
h as (select *, peak > lim as serial, coalesce(abs(corr) > lim, false) as crossed from g)
select oos as out_of_sample, least::double as least, oos and (serial or crossed) as warranted, case when oos and (serial or crossed) then 'research_hawkes' else 'keep_state_dependent_poisson' end as decision,
  concat_ws(',', case when not oos then 'in_sample' end, case when serial then 'serial' end, case when crossed then 'cross_side' end, case when disp > 1.5 then 'overdispersed' end, case when oos and not (serial or crossed) then 'nothing_left' end) as reasons from h"""


@query(GATES)
def hawkes_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The gate's decision with reasons, for rows in and out of sample and for two thresholds."""
    measures, out = kept(dg.gate_measures(kept(_residuals(spark, d), "residuals"), ORDER, 3), "measures"), None
    for least in (0.1, 0.000001):
        for oos in (True, False):
            g = dg.gate_of(measures, least, out_of_sample=oos).select("out_of_sample", F.lit(least).alias("least"), "warranted", "decision", F.concat_ws(",", "reasons").alias("reasons"))
            out = g if out is None else out.unionByName(g)
    return out


@query(W + f""", {BINS} select episode_id, start_ms as start_timestamp, greatest(case when side = 'bid' then bid_price - quote_price else quote_price - ask_price end / 0.5, 0.0)::double as distance, (ask_price - bid_price) / 0.5 as spread,
  round((bid_qty - ask_qty) / (bid_qty + ask_qty), 8) as imbalance, round(ofi, 7) as ofi, round(volatility, 7) as volatility, greatest(queue0 - taken, 0.0)::double as queue_ahead, (start_ms - activated_ms) / 1000.0::double as order_age,
  round(sin(2 * pi() * (start_ms % 86400000) / 86400000.0::double), 8) as tod_sin, round(cos(2 * pi() * (start_ms % 86400000) / 86400000.0::double), 8) as tod_cos from c4""")
def episode_features(spark: SparkSession, d: str) -> DataFrame:
    """The nine model features of real episode intervals."""
    rows = ep.build_intervals(feeds.books(spark, d), feeds.trades(spark, d), ep.FIXTURE)
    x = hz.features(rows, hz.time_fraction(F.col("start_timestamp"))).select("episode_id", "start_timestamp", *hz.FEATURES)
    return x.withColumns({c: F.round(c, n) for c, n in (("imbalance", 8), ("ofi", 7), ("volatility", 7), ("tod_sin", 8), ("tod_cos", 8))})
