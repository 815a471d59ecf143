"""Risk statistics, residual diagnostics and the gate for self-exciting models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import largest_fall, numbered, with_lags
from tidemark.operators.quantiles import MOST_BROADCAST, beside, exact_quantiles, with_quantiles
from tidemark.sources.folders import kept


def finite(value: str) -> Column:
    """Neither null nor NaN nor infinite."""
    v = F.col(value).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def metric_slice(rows: DataFrame, value: str, event: str | None = None) -> DataFrame:
    """The rows that a metric is taken over: finite values, and with `event` only rows on which one happened."""
    out = rows.where(finite(value))
    return out.where(F.col(event) > 0) if event else out


def rebased(rows: DataFrame, value: str, order: list[str], key: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """rows of the range start <= order[0] < end with `rebased`, the value less that of the range's first row."""
    at = F.col(order[0])
    part = rows.where((at >= start if start is not None else F.lit(True)) & (at < end if end is not None else F.lit(True)))
    first = part.groupBy(*key).agg(F.min_by(value, F.struct(*order, value)).alias("__first"))  # one row a key, no window over its history
    return part.join(F.broadcast(first), key).withColumn("rebased", F.col(value) - F.col("__first")).drop("__first")


def markout_stats(rows: DataFrame, value: str = "markout", by: list[str] | None = None, tail: float = 0.05) -> DataFrame:
    """n, mean, exact median and tail, and the share below 0, of the finite values."""
    by, own = by or [], metric_slice(rows, value)
    q = exact_quantiles(own, by, [value], [0.5, tail])
    t = own.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean_markout"), F.avg((F.col(value) < 0).cast("double")).alias("adverse_fraction"))
    cut = F.col(f"q_{value}")
    return with_quantiles(t, q, by).select(*by, "n", "mean_markout", cut[0].alias("median_markout"), "adverse_fraction", cut[1].alias("markout_tail"))


def drawdown(rows: DataFrame, value: str, order: list[str], key: list[str], from_first: bool = False) -> DataFrame:
    """Largest fall of a running total below its peak. The peak starts at 0 (profit steps), or with from_first at the first
    level (an equity curve; value is then the level itself)."""
    return largest_fall(rows, value, order, key, from_first).select(*key, F.greatest("fall", F.lit(0.0)).alias("max_drawdown"))


def pnl_stats(rows: DataFrame, value: str, key: list[str], tail: float = 0.05) -> DataFrame:
    """net, mean, population deviation, value at risk and expected shortfall (mean of values at or below the cutoff). The cutoffs
    are broadcast, so that a group of many rows is not sent to one task."""
    cut = exact_quantiles(rows, key, [value], [tail]).select(*(F.col(c).alias(f"__{c}") for c in key), F.col(f"q_{value}")[0].alias("__cut"))
    cut = kept(cut, "cutoffs")
    cut = F.broadcast(cut) if cut.count() <= MOST_BROADCAST else cut
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    v = F.col(value)
    return rows.join(cut, same).groupBy(*key).agg(
        F.sum(v).alias("net_pnl"), F.avg(v).alias("mean_pnl"), F.stddev_pop(v).alias("pnl_volatility"), (-F.max("__cut")).alias("value_at_risk"), (-F.avg(F.when(v <= F.col("__cut"), v))).alias("expected_shortfall")
    )


def inventory_stats(rows: DataFrame, value: str, order: list[str], key: list[str]) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*key).agg(
        F.sqrt(F.avg(v * v)).alias("inventory_rms"), F.avg(F.abs(v)).alias("mean_absolute_inventory"), F.max(F.abs(v)).alias("max_absolute_inventory"), F.max_by(value, F.struct(*order, value)).alias("terminal_inventory")
    )


def pearson(rows: DataFrame) -> DataFrame:
    mu = F.col("rate") * F.col("exposure")
    return rows.withColumn("residual", (F.col("count") - mu) / F.sqrt(F.greatest(mu, F.lit(2.2250738585072014e-308))))


def dispersion(rows: DataFrame, n_parameters: int = 0) -> DataFrame:
    r = F.col("residual")
    return rows.agg(F.count("*").alias("n"), (F.sum(r * r) / F.greatest(F.count("*") - n_parameters, F.lit(1))).alias("dispersion"))


def acf(rows: DataFrame, value: str, order: list[str], key: list[str], max_lag: int = 10, most: int = 1 << 22) -> DataFrame:
    """(key, lag, acf): row-lag autocorrelation with the global mean and the full-sample denominator. A constant series has 0
    beyond lag 0; a lag not shorter than the series is null. The means are broadcast, so that a key of many rows is not sent
    to one task; a task has about `most` rows, so more rows go to more tasks."""
    means = kept(rows.groupBy(*key).agg(F.avg(value).alias("__m"), F.count("*").alias("__n")), "means")
    n_keys, n = means.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    tasks = -(-n // most) if n > most * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    c = beside(rows, means.drop("__n"), key, n_keys).withColumn("__c", F.col(value) - F.col("__m")).select(*{*key, *order}, "__c")
    lagged = with_lags(numbered(c, [*order, "__c"], key, tasks=tasks), "__c", max_lag, key, tasks=tasks)  # ties of the order go by value
    sums = lagged.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("__c") * F.col("__c")).alias("d"), *(F.sum(F.col("__c") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)))
    flat = F.col("d") <= 2.220446049250313e-16
    cells = [F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf"))]
    cells += [F.struct(F.lit(k).alias("lag"), F.when(flat, F.lit(0.0)).when(F.col("n") > k, F.col(f"s{k}") / F.col("d")).alias("acf")) for k in range(1, max_lag + 1)]
    return sums.select(*key, F.explode(F.array(*cells)).alias("x")).select(*key, "x.lag", "x.acf")


def acf_bundle(rows: DataFrame, order: list[str], max_lag: int = 10) -> DataFrame:
    """(series, scope, lag, acf) for counts and residuals, over all rows and for each side. rows: count, residual, side."""
    if max_lag < 1:
        raise ValueError("an autocorrelation needs a lag of one or more")
    scopes = F.explode(F.array(F.lit("all"), F.col("side")))
    series = F.explode(F.array(F.struct(F.lit("count").alias("series"), F.col("count").cast("double").alias("v")), F.struct(F.lit("residual").alias("series"), F.col("residual").alias("v"))))
    flat = rows.select(*order, "side", series.alias("x")).select(*order, "side", "x.series", "x.v").withColumn("scope", scopes)
    return acf(flat, "v", order, ["series", "scope"], max_lag)


def cross_side(rows: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """One row: correlation of the sides' mean residuals over common timestamps, and their number."""
    m = rows.groupBy(ts, "side").agg(F.avg("residual").alias("r"))
    pairs = m.where("side = 'bid'").select(ts, F.col("r").alias("b")).join(m.where("side = 'ask'").select(ts, F.col("r").alias("a")), ts)
    s = pairs.agg(F.count("*").alias("pair_count"), F.stddev_pop("b").alias("sb"), F.stddev_pop("a").alias("sa"), F.covar_pop("b", "a").alias("cov"))
    eps = 2.220446049250313e-16
    corr = F.when(F.col("pair_count") < 2, None).when((F.col("sb") <= eps) | (F.col("sa") <= eps), 0.0).otherwise(F.col("cov") / F.nullif(F.col("sb") * F.col("sa"), F.lit(0.0)))
    return s.select(corr.alias("correlation"), "pair_count")


def paired_sides(rows: DataFrame, order: list[str]) -> DataFrame:
    """Without timestamps: the k-th bid with the k-th ask, to the shorter side's length."""
    n = numbered(rows, [*order, "residual"], ["side"]).withColumnRenamed("__k", "k")
    return n.where("side = 'bid'").select("k", F.col("residual").alias("bid_residual")).join(n.where("side = 'ask'").select("k", F.col("residual").alias("ask_residual")), "k")


def gate(n: int, peaks: dict[str, float], correlation: float | None, dispersion_value: float | None, out_of_sample: bool, least: float = 0.10, most_dispersion: float = 1.50, z: float = 1.96) -> dict:
    """Whether remaining dependence warrants research into a self-exciting layer. Only out-of-sample residual correlation
    opens the gate; dispersion is advisory."""
    if min(least, most_dispersion, z) <= 0:
        raise ValueError("thresholds must be positive")
    limit = max(least, z / max(n, 1) ** 0.5)
    serial = any(p > limit for p in peaks.values())
    cross = correlation is not None and np.isfinite(correlation) and abs(correlation) > limit
    return {
        "threshold": limit, "serial_dependence": serial, "cross_side_dependence": bool(cross), "overdispersed": dispersion_value is not None and dispersion_value > most_dispersion,
        "warranted": bool(out_of_sample and (serial or cross)), "decision": "research_hawkes" if out_of_sample and (serial or cross) else "keep_state_dependent_poisson",
    }


def residual_bundle(rows: DataFrame, order: list[str], max_lag: int = 10, n_parameters: int = 0, out_of_sample: bool = False) -> DataFrame:
    """All residual diagnostics as one row: out_of_sample, n_observations, n_parameters, dispersion, correlation and pair_count of the
    sides, and the autocorrelations by lag from 0, of counts and residuals, over all rows and each side (count_acf,
    count_acf_bid, ...; null for a side without rows). rows: count, residual, side, ts_ms and the order."""
    curves = acf_bundle(rows, order, max_lag)
    cells = [F.array_sort(F.collect_list(F.when((F.col("series") == s) & (F.col("scope") == w), F.struct("lag", "acf")))).alias(f"{s}_acf" + ("" if w == "all" else f"_{w}")) for s in ("count", "residual") for w in ("all", "bid", "ask")]
    wide = curves.agg(*cells)  # max_lag + 1 entries of each curve
    wide = wide.select(*(F.when(F.size(c) > 0, F.transform(c, lambda x: x["acf"])).alias(c) for c in wide.columns))
    one = dispersion(rows, n_parameters).withColumnRenamed("n", "n_observations").crossJoin(cross_side(rows)).crossJoin(wide)  # one row each
    return one.withColumns({"out_of_sample": F.lit(out_of_sample), "n_parameters": F.lit(n_parameters)})


def gate_measures(rows: DataFrame, order: list[str], max_lag: int = 10, n_parameters: int = 0) -> DataFrame:
    """What the gate goes by, one row: n, dispersion, bid_peak, ask_peak, correlation, pair_count."""
    peak = acf(rows, "residual", order, ["side"], max_lag).where("lag > 0").agg(F.max(F.when(F.col("side") == "bid", F.abs("acf"))).alias("bid_peak"), F.max(F.when(F.col("side") == "ask", F.abs("acf"))).alias("ask_peak"))
    return dispersion(rows, n_parameters).crossJoin(peak).crossJoin(cross_side(rows))


def gate_of(measures: DataFrame, least: float = 0.10, z: float = 1.96, out_of_sample: bool = True, most_dispersion: float = 1.50) -> DataFrame:
    """The gate over a row of gate_measures. It opens on out-of-sample rows alone; `reasons` lists what speaks for or against:
    in_sample, serial, cross_side, overdispersed, nothing_left."""
    if min(least, most_dispersion, z) <= 0:
        raise ValueError("thresholds must be positive")
    limit = F.greatest(F.lit(least), F.lit(z) / F.sqrt(F.greatest(F.col("n"), F.lit(1))))
    out = measures.withColumn("threshold", limit)
    serial = F.greatest(F.coalesce("bid_peak", F.lit(0.0)), F.coalesce("ask_peak", F.lit(0.0))) > F.col("threshold")
    cross = F.coalesce(F.abs("correlation") > F.col("threshold"), F.lit(False))
    out = out.withColumns({"serial_dependence": serial, "cross_side_dependence": cross, "overdispersed": F.coalesce(F.col("dispersion") > most_dispersion, F.lit(False)), "out_of_sample": F.lit(out_of_sample)})
    left = F.col("serial_dependence") | F.col("cross_side_dependence")
    out = out.withColumn("warranted", F.col("out_of_sample") & left)
    why = ((~F.col("out_of_sample"), "in_sample"), (F.col("serial_dependence"), "serial"), (F.col("cross_side_dependence"), "cross_side"), (F.col("overdispersed"), "overdispersed"), (F.col("out_of_sample") & ~left, "nothing_left"))
    return out.withColumns({"decision": F.when(F.col("warranted"), "research_hawkes").otherwise("keep_state_dependent_poisson"), "reasons": F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in why)))})


def gate_frame(rows: DataFrame, order: list[str], max_lag: int = 10, least: float = 0.10, z: float = 1.96, out_of_sample: bool = True, n_parameters: int = 0, most_dispersion: float = 1.50) -> DataFrame:
    """The gate as a one-row plan over rows with residual and side."""
    return gate_of(gate_measures(rows, order, max_lag, n_parameters), least, z, out_of_sample, most_dispersion)


def bootstrap_ci(
    rows: DataFrame, cluster: str, bin_col: str, event: str, draws: int = 2000, batch: int = 250, seed: int = 0, low: float = 2.5, high: float = 97.5, bucket_clusters: int = 1 << 14,
) -> DataFrame:
    """(bin, observed, lower, upper): interval of each bin's event share under cluster resampling. Clusters' sums are dealt into
    buckets of about bucket_clusters; a draw's number of picks in each bucket is multinomial, and so are the picks of
    the bucket's clusters, which together is a draw over all clusters. Only the buckets' sizes come to the driver. A null
    cluster is one cluster. One cluster: the interval is the share itself."""
    own = rows.select(F.coalesce(F.col(cluster).cast("string"), F.lit("null")).alias("c"), F.col(bin_col).cast("int").alias("j"), F.col(event).cast("double").alias("v"))
    n_buckets = max(1, -(-(own.agg(F.approx_count_distinct("c")).first()[0]) // bucket_clusters))
    sums = own.groupBy("c", "j").agg(F.sum("v").alias("e"), F.count("*").cast("double").alias("n")).withColumn("b", F.pmod(F.xxhash64("c"), F.lit(n_buckets)).cast("int"))
    sizes = dict(sums.groupBy("b").agg(F.count_distinct("c")).collect())
    which = {b: k for k, b in enumerate(sorted(sizes))}
    all_clusters, share = sum(sizes.values()), np.array([sizes[b] for b in sorted(sizes)], float)

    def run(t: pa.Table) -> pa.Table:
        mine = which[t.column("b")[0].as_py()]
        names, who = np.unique(np.asarray(t.column("c").to_pylist(), dtype=object).astype(str), return_inverse=True)
        labels, where = np.unique(t.column("j").to_numpy(), return_inverse=True)
        e, n = np.zeros((len(names), len(labels))), np.zeros((len(names), len(labels)))
        np.add.at(e, (who, where), t.column("e").to_numpy())
        np.add.at(n, (who, where), t.column("n").to_numpy())
        out = []
        for k in range(-(-draws // batch)):
            size = min(batch, draws - k * batch)
            picks = np.random.default_rng([seed, k]).multinomial(all_clusters, share / share.sum(), size)[:, mine]
            w = np.random.default_rng([seed, k, 1 + mine]).multinomial(picks, np.full(len(names), 1 / len(names)))
            at = np.repeat(k * batch + np.arange(size), len(labels))
            out.append(pa.table({"draw": pa.array(at, pa.int32()), "j": pa.array(np.tile(labels, size), pa.int32()), "e": (w @ e).reshape(-1), "n": (w @ n).reshape(-1)}))
        return pa.concat_tables(out)

    drawn = sums.groupBy("b").applyInArrow(run, "draw int, j int, e double, n double").groupBy("draw", "j").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).where("n > 0")
    ci = drawn.groupBy("j").agg(F.percentile(F.col("e") / F.col("n"), F.array(F.lit(low / 100), F.lit(high / 100))).alias("q"))
    base = sums.groupBy("j").agg((F.sum("e") / F.sum("n")).alias("observed"))
    return base.join(ci, "j", "left").select(F.col("j").alias(bin_col), "observed", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
