"""Monthly walk-forward evaluation without leakage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.folds import fit_folds, predicted
from tidemark.operators.hazard import evaluation, fill_probability
from tidemark.sources.folders import kept


def monthly_splits(months: DataFrame, mode: str = "expanding", min_train: int = 1, window: int | None = None) -> DataFrame:
    """(fold, test_month, train_month): every test month with its training months. months has `month`."""
    if min_train < 1:
        raise ValueError("min_train must be at least one")
    if mode not in ("expanding", "rolling"):
        raise ValueError(f"no such mode of walking forward: {mode}")
    if mode == "rolling" and (window is None or window < min_train):
        raise ValueError("rolling mode needs window >= min_train")
    if mode == "expanding" and window is not None:
        raise ValueError("window is for rolling mode")
    # one row per calendar month: small at any scale
    ranked = months.select("month").distinct().withColumn("k", F.row_number().over(Window.orderBy("month")) - 1)
    test = ranked.where(F.col("k") >= min_train).select(F.col("k").alias("fold"), F.col("month").alias("test_month"))
    early = F.col("k") < F.col("fold")
    if mode == "rolling":
        early = early & (F.col("k") >= F.col("fold") - window)
    return test.join(F.broadcast(ranked), early).select("fold", "test_month", F.col("month").alias("train_month"))


def month_of(ts: Column, unit: str = "ms") -> Column:
    """First day of an epoch time's UTC month; the unit is given, never guessed."""
    per = {"s": ts, "ms": F.floor(ts / 1000), "us": F.floor(ts / 1_000_000), "ns": F.floor(ts / 1_000_000_000)}[unit]
    return F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(per / 86_400).cast("int")), "month")


def month_pair(rows: DataFrame, train: str, test: str) -> DataFrame:
    """rows of two months (YYYY-MM) with `part`: train or test. The first must lie before the second, and both must have rows."""
    if train >= test:
        raise ValueError("the training month must lie before the test month")
    name = F.date_format("month", "yyyy-MM")
    chosen = rows.where(name.isin(train, test))
    if missing := {train, test} - {r[0] for r in chosen.select(name).distinct().collect()}:
        raise ValueError(f"no rows in {', '.join(sorted(missing))}")
    return chosen.withColumn("part", F.when(name == train, "train").otherwise("test"))


def constant_rate(rows: DataFrame, mode: str = "expanding", min_train: int = 1, window: int | None = None) -> DataFrame:
    """Out-of-sample rows with fold, rate and probability under the model rate = events / exposure of the training months of
    the row's side. Monthly sums are windowed; no row meets a fold but its own."""
    sums = rows.groupBy("side", "month").agg(F.sum("count").alias("y"), F.sum("exposure").alias("e"))
    splits = monthly_splits(rows, mode, min_train, window)
    rates = splits.join(sums.withColumnRenamed("month", "train_month"), "train_month").groupBy("fold", "test_month", "side").agg((F.sum("y") / F.sum("e")).alias("rate"))
    out = rows.join(F.broadcast(rates.withColumnRenamed("test_month", "month")), ["month", "side"])
    return out.withColumn("probability", fill_probability(F.col("rate"), F.col("exposure")))


def walk_forward(rows: DataFrame, factory: Callable[[], object], mode: str = "expanding", min_train: int = 1, window: int | None = None) -> DataFrame:
    """Out-of-sample rows with fold, rate and probability. factory() gives a fresh object with fit(rows) and predict(rows) ->
    rows with rate, so a fold's scaler and coefficients see its training months alone. Invalid rates raise."""
    splits: dict[tuple, list] = {}
    for r in monthly_splits(rows, mode, min_train, window).collect():
        splits.setdefault((r["fold"], r["test_month"]), []).append(r["train_month"])
    if not splits:
        raise ValueError("no eligible test month")
    out = None
    for (fold, month), train in sorted(splits.items()):
        model = factory()
        model.fit(rows.where(F.col("month").isin(train)))
        got = model.predict(rows.where(F.col("month") == F.lit(month))).withColumn("fold", F.lit(fold))
        bad = F.col("rate").isNull() | F.isnan("rate") | (F.col("rate") == float("inf")) | (F.col("rate") < 0)
        got = got.withColumn("rate", F.when(bad, F.raise_error(F.lit("invalid rate")).cast("double")).otherwise(F.col("rate")))
        out = got if out is None else out.unionByName(got)
    return out.withColumn("probability", fill_probability(F.col("rate"), F.col("exposure")))


def walk_forward_glm(
    rows: DataFrame, names: tuple[str, ...], mode: str = "expanding", min_train: int = 1, window: int | None = None, l2: float = 1e-3, iterations: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """(out-of-sample rows with fold, rate, probability; one row per fold and side of how it was fitted). All folds and sides take
    their Newton steps together, each with its own scaler over its own training months. A test row whose side its fold was
    not trained on raises."""
    splits = kept(monthly_splits(rows, mode, min_train, window), "splits")
    fits = fit_folds(rows, names, splits, l2, iterations)
    if not fits:
        raise ValueError("no eligible test month")
    oos = predicted(rows, fits, names, splits)
    kinds = "fold int, side string, n_observations long, event_count double, total_exposure double, log_likelihood double, converged boolean, iterations int, gradient double, n_parameters int, coefficients array<double>"
    told = [(f, s, x.n_observations, x.event_count, x.total_exposure, x.log_likelihood, x.converged, x.iterations, x.gradient, len(x.beta), x.beta.tolist()) for (f, s), x in sorted(fits.items())]
    return oos.withColumn("probability", fill_probability(F.col("rate"), F.col("exposure"))), rows.sparkSession.createDataFrame(told, kinds)


def fold_metrics(oos: DataFrame) -> DataFrame:
    return evaluation(oos, ["fold", "month"])
