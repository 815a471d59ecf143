"""Inventory-aware optimal quotes over a finite horizon, and a seeded benchmark simulation.

With x = 1 + gamma/k: c = ln(x)/gamma, eta = A x^-(1 + k/gamma), alpha = k gamma sigma^2 / 2, beta = k mu. The value vector
over inventories -Q..Q is v = exp(-M tau) 1 for the tridiagonal M with diagonal alpha q^2 - beta q and -eta beside it; quotes
are c plus differences of ln v over k. Only ratios of v matter, so exponents are shifted by the smallest eigenvalue and
nothing overflows at any horizon.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QuoteModel:
    A: float
    k: float
    gamma: float
    sigma: float
    mu: float = 0.0
    max_inventory: int = 5

    def __post_init__(self) -> None:
        if not all(map(math.isfinite, (self.A, self.k, self.gamma, self.sigma, self.mu))) or min(self.A, self.k, self.gamma) <= 0 or self.sigma < 0 or self.max_inventory < 1:
            raise ValueError("A, k and gamma must be positive, sigma not negative, max_inventory at least 1, all finite")

    @property
    def constants(self) -> tuple[float, float, float, float]:
        """(c, eta, alpha, beta)"""
        x = math.log1p(self.gamma / self.k)
        return x / self.gamma, self.A * math.exp(-(1 + self.k / self.gamma) * x), self.k * self.gamma * self.sigma**2 / 2, self.k * self.mu


@lru_cache(maxsize=128)
def _spectrum(m: QuoteModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, eta, alpha, beta = m.constants
    q = np.arange(-m.max_inventory, m.max_inventory + 1, dtype=float)
    values, vectors = np.linalg.eigh(np.diag(alpha * q**2 - beta * q) - eta * (np.eye(len(q), k=1) + np.eye(len(q), k=-1)))
    return values - values[0], vectors, vectors.sum(axis=0)


def relative_value(m: QuoteModel, tau: float) -> np.ndarray:
    """v up to a positive factor, for time tau to the horizon."""
    if not math.isfinite(tau) or tau < 0:
        raise ValueError("time to the horizon must be finite and not negative")
    gaps, vectors, weights = _spectrum(m)
    return vectors @ (np.exp(-gaps * tau) * weights) if tau else np.ones(len(gaps))


def finite_value(m: QuoteModel, tau: float) -> np.ndarray:
    """v itself; for long times it may overflow, where relative_value does not."""
    _, eta, alpha, beta = m.constants
    q0 = -m.max_inventory
    least = float(np.linalg.eigvalsh(np.diag([alpha * q * q - beta * q for q in range(q0, -q0 + 1)]) - eta * (np.eye(1 - 2 * q0, k=1) + np.eye(1 - 2 * q0, k=-1)))[0])
    return relative_value(m, tau) * math.exp(-least * tau)


def deltas(m: QuoteModel, q: int, tau: float) -> tuple[float | None, float | None]:
    """(bid, ask) distances from the mid; no bid at the upper bound, no ask at the lower."""
    if abs(q) > m.max_inventory:
        raise ValueError("inventory outside the grid")
    v, i, c = np.log(relative_value(m, tau)), q + m.max_inventory, m.constants[0]
    return (c + float(v[i] - v[i + 1]) / m.k if q < m.max_inventory else None), (c + float(v[i] - v[i - 1]) / m.k if q > -m.max_inventory else None)


def constants_frame(params: DataFrame) -> DataFrame:
    """params (A, k, gamma, sigma, mu) with c, eta, alpha, beta: expressions only."""
    x = F.log1p(F.col("gamma") / F.col("k"))
    return params.withColumns({"c": x / F.col("gamma"), "eta": F.col("A") * F.exp(-(1 + F.col("k") / F.col("gamma")) * x), "alpha": F.lit(0.5) * F.col("k") * F.col("gamma") * F.col("sigma") * F.col("sigma"), "beta": F.col("k") * F.col("mu")})


def matrix_frame(params: DataFrame) -> DataFrame:
    """(params, q, q2, value): the non-zero cells of M."""
    c = constants_frame(params).withColumn("q", F.explode(F.sequence(-F.col("max_inventory"), F.col("max_inventory"))))
    cells = c.withColumn("q2", F.explode(F.filter(F.array(F.col("q") - 1, F.col("q"), F.col("q") + 1), lambda x: F.abs(x) <= F.col("max_inventory"))))
    return cells.select("id", "q", "q2", F.when(F.col("q") == F.col("q2"), F.col("alpha") * F.col("q") * F.col("q") - F.col("beta") * F.col("q")).otherwise(-F.col("eta")).alias("value"))


def intensity(A: Column, k: Column, delta: Column) -> Column:
    return A * F.exp(-k * delta)


def quote_distances(params: DataFrame, taus: list[float]) -> DataFrame:
    """(id, tau, q, bid, ask) over the whole inventory grid and the given times to the horizon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {x: [] for x in ("id", "tau", "q", "bid", "ask")}
            for r in b.to_pylist():
                m = QuoteModel(r["A"], r["k"], r["gamma"], r["sigma"], r["mu"], r["max_inventory"])
                for q in range(-m.max_inventory, m.max_inventory + 1):
                    bid, ask = deltas(m, q, r["tau"])
                    for name, v in zip(out, (r["id"], r["tau"], q, bid, ask), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["tau"], pa.float64()), pa.array(out["q"], pa.int32()), pa.array(out["bid"], pa.float64()), pa.array(out["ask"], pa.float64())], names=list(out))

    grid = params.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    return grid.select("id", "A", "k", "gamma", "sigma", "mu", "max_inventory", "tau").mapInArrow(run, "id long, tau double, q int, bid double, ask double")


def value_frame(params: DataFrame, taus: list[float]) -> DataFrame:
    """(id, tau, q, value): the value vector of every parameter set over its inventory grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                m = QuoteModel(r["A"], r["k"], r["gamma"], r["sigma"], r["mu"], r["max_inventory"])
                out += [(r["id"], r["tau"], i - m.max_inventory, float(v)) for i, v in enumerate(finite_value(m, r["tau"]))]
            kinds = {"id": pa.int64(), "tau": pa.float64(), "q": pa.int32(), "value": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    grid = params.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    return grid.select("id", "A", "k", "gamma", "sigma", "mu", "max_inventory", "tau").mapInArrow(run, "id long, tau double, q int, value double")


def time_grids(params: DataFrame) -> DataFrame:
    """(id, step, time) of params (id, horizon, dt), as time_grid gives for each."""
    ratio = F.col("horizon") / F.col("dt")
    near = F.abs(ratio - F.rint(ratio)) <= 1e-12 * F.greatest(ratio, F.lit(1.0))
    n = F.greatest(F.when(near, F.rint(ratio)).otherwise(F.ceil(ratio)), F.lit(1)).cast("int")
    steps = params.withColumn("n", n).withColumn("step", F.explode(F.sequence(F.lit(0), "n")))
    return steps.select("id", "step", F.when(F.col("step") == F.col("n"), F.col("horizon")).otherwise(F.least(F.col("step") * F.col("dt"), "horizon")).alias("time"))


def time_grid(horizon: float, dt: float) -> np.ndarray:
    """0, dt, 2 dt, ... ending at the horizon; a ratio within 1e-12 of a whole number counts as that number."""
    ratio = horizon / dt
    n = max(1, round(ratio)) if math.isclose(ratio, round(ratio), rel_tol=1e-12, abs_tol=1e-12) else math.ceil(ratio)
    t = np.minimum(np.arange(n + 1) * dt, horizon)
    t[-1] = horizon
    return t


@lru_cache(maxsize=8)
def quoted_steps(m: QuoteModel, horizon: float, dt: float) -> list[tuple]:
    """(time, step, by inventory from the lowest: (bid, ask, bids expected, asks expected)) of each step; the same for every path."""
    t = time_grid(horizon, dt)
    out = []
    for at, step in zip(t[:-1], np.diff(t), strict=True):
        row = []
        for q in range(-m.max_inventory, m.max_inventory + 1):
            bid, ask = deltas(m, q, horizon - at)
            row.append((bid, ask, None if bid is None else m.A * math.exp(-m.k * bid) * step, None if ask is None else m.A * math.exp(-m.k * ask) * step))
        out.append((float(at), step, row))
    return out


def simulate(m: QuoteModel, horizon: float, dt: float, mid0: float, seed: int, inventory: int = 0, cash: float = 0.0) -> list[tuple]:
    """One path: (step, time, mid, inventory, cash, equity, bid delta, ask delta, bid fills, ask fills), the last row without
    quotes. Draw order per step: bid count, ask count (each only if quoted), then the mid's normal."""
    if abs(inventory) > m.max_inventory:
        raise ValueError("inventory outside the grid")
    rng, most = np.random.default_rng(seed), m.max_inventory
    poisson, normal = rng.poisson, rng.normal
    mid, q, rows = mid0, inventory, []
    for i, (at, step, quotes) in enumerate(quoted_steps(m, horizon, dt)):
        bid, ask, bids, asks = quotes[q + most]
        nb = min(int(poisson(bids)), most - q) if bid is not None else 0
        na = min(int(poisson(asks)), q + most) if ask is not None else 0
        rows.append((i, at, mid, q, cash, cash + q * mid, bid, ask, nb, na))
        cash += (na * (mid + ask) if na else 0.0) - (nb * (mid - bid) if nb else 0.0)
        q += nb - na
        mid += m.mu * step + m.sigma * math.sqrt(step) * normal()
    rows.append((len(rows), float(horizon), mid, q, cash, cash + q * mid, None, None, None, None))
    return rows


SIMULATION = "seed long, step long, time double, mid double, inventory long, cash double, equity double, bid_delta double, ask_delta double, bid_fills long, ask_fills long"


def simulate_paths(seeds: DataFrame, m: QuoteModel, horizon: float, dt: float, mid0: float, paths: int = 1 << 12) -> DataFrame:
    """seeds has `seed`; paths run side by side, each sequential and reproducible from its seed. Seeds are dealt out anew, about `paths`
    a task, since a small file of seeds makes many rows."""
    names = [x.split()[0] for x in SIMULATION.split(", ")]
    kinds = [pa.float64() if x.endswith("double") else pa.int64() for x in SIMULATION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            for k in range(0, len(own), 32):
                rows = [(s, *r) for s in own[k : k + 32] for r in simulate(m, horizon, dt, mid0, s)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    tasks = max(seeds.sparkSession.sparkContext.defaultParallelism, -(-seeds.count() // paths))
    return seeds.select("seed").repartition(tasks).mapInArrow(run, SIMULATION)
