"""Poisson fits of many folds and sides at once: every Newton step is one pass over the rows for all of them.

Rows that agree in all that a fit looks at are one row with their number `c`. Scales and coefficients are a small table of
one row a fold and side. A task adds up the gradients and Hessians of all
fits that train on its rows, Spark adds up the tasks' sums, and the driver solves fits x terms systems.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import beside, exact_quantiles
from tidemark.sources.folders import kept

BOUND = 30.0


def gathered(rows: DataFrame, names: tuple[str, ...], by_month: bool) -> DataFrame:
    """(names, count, exposure, side, month if asked for, c): equal rows as one with their number, written once for all passes."""
    used = rows.select(*dict.fromkeys([*names, "count", "exposure", "side", *(["month"] if by_month else [])]))
    return kept(used.groupBy(*used.columns).agg(F.count("*").alias("c")), "gathered")


def scales(rows: DataFrame, names: tuple[str, ...], splits: DataFrame | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """fold -> (centres, scales) of gathered rows: exact median, and IQR / 1.349, else population deviation, else 1, over a fold's training
    months. Months are summed up first, so a row meets its own month and not every fold. Without splits: all rows, as fold 0."""
    by = ["month"] if splits is not None else []
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("j"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names))))
    flat = rows.select(*by, cells.alias("x"), "c").select(*by, "x.j", "x.v", "c")
    counted = kept(flat.groupBy(*by, "j", "v").agg(F.sum("c").alias("c")), "counted")
    sure = counted.where("v is not null")
    means = kept(sure.groupBy(*by, "j").agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("m")), "means")
    away = F.col("v") - F.col("m")
    moments = beside(sure, means, [*by, "j"], means.count()).groupBy(*by, "j").agg(F.first("n").alias("n"), F.first("m").alias("m"), (F.sum(F.col("c") * away * away) / F.first("n")).alias("d"))
    if splits is None:
        counted, moments = (x.withColumn("fold", F.lit(0)) for x in (counted, moments))
    else:
        of = splits.select("fold", F.col("train_month").alias("month"))
        counted, moments = counted.join(of, "month"), moments.join(of, "month")
    centre = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    square = F.sum(F.col("n") * (F.col("d") + F.col("m") * F.col("m"))) / F.sum("n")
    spread = {(r["fold"], r["j"]): math.sqrt(max(r["s"] or 0.0, 0.0)) for r in moments.groupBy("fold", "j").agg((square - centre * centre).alias("s")).collect()}
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in exact_quantiles(counted, ["fold", "j"], ["v"], [0.25, 0.5, 0.75], weight="c").collect():
        c, s = out.setdefault(r["fold"], (np.zeros(len(names)), np.ones(len(names))))
        if r["q_v"] is None:
            continue
        low, c[r["j"]], high = r["q_v"]
        iqr = (high - low) / 1.349
        s[r["j"]] = iqr if iqr > 1e-12 else spread[r["fold"], r["j"]] if spread[r["fold"], r["j"]] > 1e-12 else 1.0
    return out


@dataclass
class Fit:
    """One fold's fit of one side."""

    centre: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    n_observations: int = 0
    event_count: float = 0.0
    total_exposure: float = 0.0
    log_likelihood: float = 0.0
    converged: bool = False
    iterations: int = 0
    gradient: float = math.inf


def design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, clip: float) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), np.clip((x - centre) / scale, -clip, clip)])


def _sums(rows: DataFrame, names: tuple[str, ...], folds_of: dict | None, trials: dict[tuple[int, str], tuple[np.ndarray, np.ndarray, np.ndarray]], clip: float) -> dict[tuple[int, str], np.ndarray]:
    """(fold, side) -> objective, gradient, Hessian (row by row), and n, events, exposure, constant of the log-likelihood, in one pass."""
    k = len(names) + 1
    size, order = 1 + k + k * k + 4, sorted(trials)
    number = {x: i for i, x in enumerate(order)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(order), size))
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1) if names else np.zeros((batch.num_rows, 0))
            y, e, c = (batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in ("count", "exposure", "c"))
            kinds, back = np.unique(batch.column("side").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            months, when = np.unique(batch.column("month").to_numpy(zero_copy_only=False).astype(str), return_inverse=True) if folds_of else (None, None)
            often, place = np.unique(y, return_inverse=True)
            fixed = np.where(y > 0, y * np.log(np.where(y > 0, e, 1.0)), 0.0) - np.array([math.lgamma(v + 1) for v in often.tolist()])[place]
            for s, side in enumerate(kinds.tolist()):
                for fold in {f for f, z in order if z == side}:
                    use = back == s
                    if folds_of:
                        use = use & np.array([fold in folds_of.get(m, ()) for m in months.tolist()])[when]
                    if not use.any():
                        continue
                    beta, centre, scale = trials[fold, side]
                    d, yy, ee, w = design(x[use], centre, scale, clip), y[use], e[use], c[use]
                    raw = d @ beta
                    eta, on = np.clip(raw, -BOUND, BOUND), (np.abs(raw) < BOUND).astype(float)
                    mu = ee * np.exp(eta)
                    own = total[number[fold, side]]
                    own[0] += (w * (mu - yy * eta)).sum()
                    own[1 : 1 + k] += d.T @ (w * (mu - yy) * on)
                    own[1 + k : 1 + k + k * k] += ((d * (w * mu * on)[:, None]).T @ d).reshape(-1)
                    own[-4:] += (w.sum(), (w * yy).sum(), (w * ee).sum(), (w * fixed[use]).sum())
        at = np.flatnonzero(total.any(axis=1))
        spot = (at[:, None] * size + np.arange(size)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(spot.astype(np.int64)), pa.array(total[at].reshape(-1))], names=["at", "s"])

    used = rows.select(*names, "count", "exposure", "side", "c", *(["month"] if folds_of else [])).dropna(subset=[*names, "count", "exposure"])
    if folds_of:
        used = used.withColumn("month", F.col("month").cast("string"))
    got = np.zeros(len(order) * size)
    for r in used.mapInArrow(add, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        got[r["at"]] = r["s"]
    return {x: got[i * size : (i + 1) * size] for x, i in number.items()}


def fit_folds(rows: DataFrame, names: tuple[str, ...], splits: DataFrame | None = None, l2: float = 1e-3, iterations: int = 50, clip: float = 12.0) -> dict[tuple[int, str], Fit]:
    """(fold, side) -> its fit. rows: features, side, count, exposure and, with splits (fold, train_month), month; rows with a null among them are passed over. Fits that have
    converged leave the passes; a step that does not lower its fit's objective is halved in the next pass. Fits are folds x sides,
    as many as there are months, so they and their sums stay small at any number of rows."""
    rows = gathered(rows, names, splits is not None)
    scaled = scales(rows, names, splits)
    folds_of: dict | None = None
    if splits is not None:
        folds_of = {}
        for r in splits.select("fold", F.col("train_month").cast("string").alias("m")).collect():
            folds_of.setdefault(r["m"], set()).add(r["fold"])
    k, ridge = len(names) + 1, np.append(0.0, np.full(len(names), l2))
    sides = [r[0] for r in rows.select("side").where("side is not null").distinct().collect()]
    fits = {(f, s): Fit(c, w, np.zeros(k)) for f, (c, w) in scaled.items() for s in sides}
    first = _sums(rows, names, folds_of, {x: (f.beta, f.centre, f.scale) for x, f in fits.items()}, clip)
    fits = {x: f for x, f in fits.items() if first[x][-4] > 0}
    for x, f in fits.items():
        n, y, e, _ = first[x][-4:]
        f.n_observations, f.event_count, f.total_exposure = int(n), float(y), float(e)
        f.beta[0] = np.clip(math.log((y + 0.5) / (e + 0.5)), -BOUND, BOUND)

    def measured(trials: dict[tuple[int, str], np.ndarray]) -> dict:
        got = _sums(rows, names, folds_of, {x: (b, fits[x].centre, fits[x].scale) for x, b in trials.items()}, clip)
        return {x: (v[0] + 0.5 * float((ridge * trials[x] ** 2).sum()), v[1 : 1 + k] + ridge * trials[x], v[1 + k : 1 + k + k * k].reshape(k, k) + np.diag(ridge), v) for x, v in got.items()}

    state = measured({x: f.beta for x, f in fits.items()})
    size, going = dict.fromkeys(fits, 1.0), {x for x in fits if iterations > 0}
    while going:
        step = {x: np.linalg.solve(state[x][2] + 1e-10 * np.eye(k), state[x][1]) for x in going}
        trials = {x: np.clip(fits[x].beta - size[x] * step[x], -BOUND, BOUND) for x in going}
        for x, got in measured(trials).items():
            f = fits[x]
            if got[0] > state[x][0] + 1e-12 * abs(state[x][0]) and size[x] >= 1e-6:
                size[x] /= 2
                continue
            moved = float(np.abs(trials[x] - f.beta).max())
            f.beta, state[x], size[x], f.iterations = trials[x], got, 1.0, f.iterations + 1
            f.converged = moved < 1e-9
            if f.converged or f.iterations >= iterations:
                going.discard(x)
    for x, f in fits.items():
        f.gradient = float(np.abs(state[x][1]).max())
        f.log_likelihood = float(state[x][3][-1] - state[x][3][0])
    return fits


def predicted(rows: DataFrame, fits: dict[tuple[int, str], Fit], names: tuple[str, ...], tests: DataFrame | None = None, clip: float = 12.0) -> DataFrame:
    """rows with `rate` (and `fold`, with tests (fold, test_month): rows of test months alone). A row whose side was not trained in its
    fold raises."""
    spark = rows.sparkSession
    flat = [(f, s, *map(float, (*x.beta, *x.centre, *x.scale))) for (f, s), x in fits.items()]
    k = len(names)
    cols = ["__b", *(f"__b{i}" for i in range(k)), *(f"__c{i}" for i in range(k)), *(f"__s{i}" for i in range(k))]
    table = spark.createDataFrame(flat, "__fold int, __side string, " + ", ".join(f"{c} double" for c in cols))
    if tests is not None:
        which = tests.select(F.col("fold").cast("int").alias("fold"), F.col("test_month").alias("month")).distinct()
        rows = beside(rows, which, ["month"], which.count())
    else:
        rows = rows.withColumn("fold", F.lit(0))
    on = (F.col("fold") == F.col("__fold")) & (F.col("side") == F.col("__side"))
    got = rows.join(F.broadcast(table) if len(flat) <= 1 << 14 else table, on, "left")
    eta = F.col("__b")
    for i, n in enumerate(names):
        z = (F.col(n) - F.col(f"__c{i}")) / F.col(f"__s{i}")
        eta = eta + F.col(f"__b{i}") * F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))
    rate = F.exp(F.greatest(F.least(eta, F.lit(BOUND)), F.lit(-BOUND)))
    untrained = F.raise_error(F.concat(F.lit("side was not trained: "), F.coalesce("side", F.lit("null")))).cast("double")
    out = got.withColumn("rate", F.when(F.col("__b").isNull(), untrained).otherwise(rate)).drop("__fold", "__side", *cols)
    return out if tests is not None else out.drop("fold")
