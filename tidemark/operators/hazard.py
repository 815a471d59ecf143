"""Exposure-aware Poisson fill hazard: features, robust scaling, Newton fits on Spark-aggregated sums, and evaluation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import BOUND, fit_folds, predicted
from tidemark.operators.quantiles import exact_quantiles, with_quantiles

RAW = ("distance", "spread", "imbalance", "ofi", "volatility", "queue_ahead", "order_age")
FEATURES = (*RAW, "tod_sin", "tod_cos")
NOT_NEGATIVE = ("distance", "spread", "volatility", "queue_ahead", "order_age")
CLIP = 12.0


def time_fraction(ts: Column, unit: str = "ms") -> Column:
    """Fraction of the UTC day of an epoch time. The unit is given, never guessed from a batch."""
    per_day = {"s": 86_400, "ms": 86_400_000, "us": 86_400_000_000, "ns": 86_400_000_000_000}[unit]
    return F.pmod(ts, F.lit(per_day)) / per_day


def infer_unit(largest: float) -> str:
    """The unit of epoch times by the size of the largest: from 1e17 ns, 1e14 us, 1e11 ms, else s."""
    return "ns" if largest >= 1e17 else "us" if largest >= 1e14 else "ms" if largest >= 1e11 else "s"


def features(rows: DataFrame, fraction: Column) -> DataFrame:
    """rows with tod_sin and tod_cos; a negative distance, spread, volatility, queue or age, or an odd value, raises."""
    bad = F.lit(False)
    for c in RAW:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    for c in NOT_NEGATIVE:
        bad = bad | (F.col(c) < 0)
    angle = fraction * (2.0 * math.pi)
    checked = F.when(bad, F.raise_error(F.lit("invalid state features")).cast("double")).otherwise(F.sin(angle))
    return rows.withColumns({"tod_sin": checked, "tod_cos": F.cos(angle)})


def scaler_stats(rows: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row: c_<name> exact median, s_<name> = IQR/1.349, else population deviation, else 1."""
    s = with_quantiles(rows.agg(*(F.stddev_pop(n).alias(f"d_{n}") for n in names)), exact_quantiles(rows, [], list(names), [0.25, 0.5, 0.75]), [])
    out = []
    for n in names:
        iqr = (F.col(f"q_{n}")[2] - F.col(f"q_{n}")[0]) / 1.349
        out += [F.col(f"q_{n}")[1].alias(f"c_{n}"), F.when(iqr > 1e-12, iqr).when(F.col(f"d_{n}") > 1e-12, F.col(f"d_{n}")).otherwise(1.0).alias(f"s_{n}")]
    return s.select(*out)


def scaled(rows: DataFrame, stats: DataFrame, names: tuple[str, ...] = FEATURES, clip: float = CLIP) -> DataFrame:
    """rows with x_<name>: scaled and clipped. stats is a single row."""
    z = {f"x_{n}": F.greatest(F.least((F.col(n) - F.col(f"c_{n}")) / F.col(f"s_{n}"), F.lit(clip)), F.lit(-clip)) for n in names}
    return rows.crossJoin(F.broadcast(stats)).withColumns(z).drop(*(f"{k}_{n}" for n in names for k in "cs"))


@dataclass
class PoissonGlm:
    """Log-link Poisson rates per side, exposure as offset, ridge on the summed objective except the intercept."""

    names: tuple[str, ...] = FEATURES
    l2: float = 1e-3
    iterations: int = 50
    stats: DataFrame | None = None
    fits: dict = field(default_factory=dict)

    def fit(self, rows: DataFrame) -> PoissonGlm:
        """Newton steps, all sides in one pass a step. rows: features, side, count, exposure."""
        self.fits = fit_folds(rows, self.names, None, self.l2, self.iterations, CLIP)
        one = next(iter(self.fits.values()))
        cells = {f"{k}_{n}": float(v[i]) for i, n in enumerate(self.names) for k, v in (("c", one.centre), ("s", one.scale))}
        self.stats = rows.sparkSession.createDataFrame([tuple(cells.values())], ", ".join(f"{c} double" for c in cells)) if cells else None
        return self

    @property
    def beta(self) -> dict[str, np.ndarray]:
        return {s: f.beta for (_, s), f in sorted(self.fits.items())}

    @property
    def results(self) -> dict[str, dict]:
        shown = ("n_observations", "event_count", "total_exposure", "log_likelihood", "converged", "iterations", "gradient")
        return {s: {x: getattr(f, x) for x in shown} for (_, s), f in sorted(self.fits.items())}

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with `rate`; a side that was not trained raises."""
        return predicted(rows, self.fits, self.names, None, CLIP)


def fill_probability(rate: Column, exposure: Column) -> Column:
    return -F.expm1(-rate * exposure)


def _mean() -> Column:
    return F.col("rate") * F.col("exposure")


def log_likelihood() -> Column:
    """Aggregate; minus infinity if a count meets a zero mean. The factorial term is exact up to 20; above, log-gamma
    by Stirling's series (error below 1e-12)."""
    mu, y = _mean(), F.col("count")
    x = y.cast("double") + 1
    stirling = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    small = F.log(F.factorial(F.least(y, F.lit(20)).cast("int")).cast("double"))
    term = y * F.log(F.greatest(mu, F.lit(2.2250738585072014e-308))) - mu - F.when(y <= 1, F.lit(0.0)).when(y <= 20, small).otherwise(stirling)
    return F.sum(F.when((mu == 0) & (y > 0), F.lit(float("-inf"))).otherwise(term))


def deviance() -> Column:
    mu, y = _mean(), F.col("count").cast("double")
    term = F.when(y > 0, F.when(mu == 0, F.lit(float("inf"))).otherwise(mu - y + y * F.log(y / F.when(mu > 0, mu)))).otherwise(mu)
    return 2.0 * F.sum(term)


def brier(event: Column, probability: Column) -> Column:
    return F.avg((event - probability) * (event - probability))


def evaluation(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The eleven scalar measures of rows with count, rate and exposure, in one aggregate."""
    event = (F.col("count") > 0).cast("double")
    p = fill_probability(F.col("rate"), F.col("exposure"))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n_observations"), F.sum("count").cast("double").alias("event_count"), F.sum("exposure").alias("total_exposure"), log_likelihood().alias("poisson_log_likelihood"),
        (log_likelihood() / F.count("*")).alias("mean_poisson_log_likelihood"), deviance().alias("poisson_deviance"), brier(event, p).alias("brier_score"), F.avg(event).alias("observed_event_frequency"),
        F.avg(p).alias("predicted_event_frequency"), (F.sum("count") / F.sum("exposure")).alias("observed_rate"), (F.sum(_mean()) / F.sum("exposure")).alias("predicted_rate"),
    )


def evaluation_report(rows: DataFrame, by: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    """The eleven measures of evaluation with `curve`, the calibration in fixed bins as an array of (bin, predicted, observed, count)."""
    by = by or []
    own = rows.withColumns({"probability": fill_probability(F.col("rate"), F.col("exposure")), "event": (F.col("count") > 0).cast("double")})
    curve = calibration(own, n_bins, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "predicted", "observed", "count"))).alias("curve"))  # n_bins entries at most
    return with_quantiles(evaluation(rows, by), curve, by)


def fixed_bin(probability: Column, n_bins: int = 10) -> Column:
    """Number of the calibration bin; edges are those of an even float grid, the last bin is closed."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)]
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (probability >= F.lit(e)).cast("int")
    return out


def calibration(rows: DataFrame, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """rows with event (0/1) and probability -> bin, predicted, observed, count; empty bins are absent."""
    return rows.withColumn("bin", fixed_bin(F.col("probability"), n_bins)).groupBy(*(by or []), "bin").agg(F.avg("probability").alias("predicted"), F.avg("event").alias("observed"), F.count("*").alias("count"))


def reliability(rows: DataFrame, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Equal-frequency bins, of each group apart with `by`: edges are the different exact quantiles; a row's bin counts the inner
    edges at or below it."""
    by = by or []
    q = exact_quantiles(rows, by, ["probability"], [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)])
    edges = q.select(*(F.col(c).alias(f"__{c}") for c in by), F.array_distinct("q_probability").alias("__edges"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inner = F.slice("__edges", 2, F.greatest(F.size("__edges") - 2, F.lit(0)))
    b = rows.join(edges, same).withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("probability"))))
    return b.groupBy(*by, "bin").agg(F.avg("probability").alias("predicted"), F.avg("event").alias("observed"), F.count("*").alias("count"))


def competing_risk(fill: Column, adverse: Column, cancel: Column) -> Column:
    """Label of the earliest of three event times (null: not observed); 'none' without any; a tie for first raises."""
    first = F.least(fill, adverse, cancel)
    ties = sum((F.coalesce(t == first, F.lit(False)).cast("int") for t in (fill, adverse, cancel)), F.lit(0))
    named = F.when(fill == first, "fill").when(adverse == first, "adverse_move").when(cancel == first, "cancel")
    return F.when(first.isNull(), "none").when(ties > 1, F.raise_error(F.lit("simultaneous competing risks")).cast("string")).otherwise(named)


def flagged_risk(flags: tuple[Column, Column, Column], times: tuple[Column, Column, Column] | None = None) -> Column:
    """Label of three event flags (fill, adverse move, cancel; null: not seen). One flag needs no time; where several are set, the
    earliest wins, and a row raises if times are not given, if one of a set flag is missing, odd or negative, or on a tie."""
    on = [F.coalesce(f.cast("boolean"), F.lit(False)) for f in flags]
    several = on[0].cast("int") + on[1].cast("int") + on[2].cast("int") > 1
    alone = F.when(on[0], "fill").when(on[1], "adverse_move").when(on[2], "cancel").otherwise("none")
    if times is None:
        return F.when(several, F.raise_error(F.lit("several risks need event times")).cast("string")).otherwise(alone)
    odd = F.lit(False)
    for f, t in zip(on, times, strict=True):
        good = t.isNotNull() & ~F.isnan(t.cast("double")) & (t >= 0) & (t < float("inf"))
        odd = odd | (f & ~F.coalesce(good, F.lit(False)))
    first = competing_risk(*(F.when(f, t) for f, t in zip(on, times, strict=True)))
    return F.when(several & odd, F.raise_error(F.lit("an event time is missing or not a finite number from 0 on")).cast("string")).when(several, first).otherwise(alone)
