"""Chunked scans against plain loops, with chunks of a few rows, resets, flips, ties and keys without a name."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_queries import norm
from tidemark.functions import accounting as acc
from tidemark.operators import bookstate as bs
from tidemark.operators.scans import affine_scan, composed, in_chunks, running_total
from tidemark.plans import catalog
from tidemark.sources import feeds


def test_composed_maps_equal_a_loop():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 1000):
        a, b = np.where(rng.random(n) < 0.2, 0.0, rng.random(n)), rng.normal(size=n)
        x, y = composed(a, b)
        for seed in (0.0, 3.5):
            s, want = seed, []
            for i in range(n):
                s = a[i] * s + b[i]
                want.append(s)
            assert np.allclose(x * seed + y, want)


@pytest.mark.parametrize("chunk", [3, 7, 1 << 17])
def test_affine_scan_and_totals_over_chunks(spark, chunk):
    rng = random.Random(1)
    data = [(k, i * 1000, rng.choice([0.0, 0.5, 1.0]), rng.uniform(-1, 1)) for k in ("a", "b", None) for i in range(60)]
    rows = in_chunks(spark.createDataFrame(data, "key string, at long, a double, b double").repartition(4), ["key"], ["at"], chunk)
    got = running_total(affine_scan(rows, {"s": (F.col("a"), F.col("b"))}, 2.0), F.col("b"), "total").collect()
    assert len(got) == 180
    for k in ("a", "b", None):
        s, total = 2.0, 0.0
        for r in sorted((r for r in got if r.key == k), key=lambda r: r.at):
            assert math.isclose(r.s_before, s, abs_tol=1e-12)
            s, total = r.a * s + r.b, total + r.b
            assert math.isclose(r.s, s, abs_tol=1e-12) and math.isclose(r.total, total, abs_tol=1e-12)


def fold(fills, multiplier, fee_rate):
    q, entry, cash, out = 0.0, None, 0.0, []
    for p, n, s in fills:
        d, old = s * n, q
        pnl = multiplier * min(abs(old), n) * math.copysign(1.0, old) * (1 / entry - 1 / p) if old * d < 0 else 0.0
        q = 0.0 if abs(old + d) <= 1e-12 else old + d
        if q == 0:
            entry = None
        elif old == 0 or old * q < 0:
            entry = p
        elif old * d > 0:
            entry = (abs(old) + n) / (abs(old) / entry + n / p)
        fee = multiplier * n / p * fee_rate
        cash += pnl - fee
        out.append((q, entry, pnl, fee, cash))
    return out


@pytest.mark.parametrize("chunk", [1, 5, 1 << 17])
def test_inverse_position_against_a_fold(spark, chunk):
    rng = random.Random(3)
    data = [(k, i, rng.choice([100.0, 101.5, 99.25]), rng.choice([0.1, 0.2, 0.3, 1.0, 2.5]), rng.choice(["buy", "sell"])) for k in ("a", None) for i in range(80)]
    df = spark.createDataFrame(data, "acc string, ts_ms long, price double, quantity double, side string").repartition(3)
    got = acc.inverse(df, ["acc"], ["ts_ms"], 10.0, 0.001, chunk).collect()
    for k in ("a", None):
        mine = sorted((r for r in got if r.acc == k), key=lambda r: r.ts_ms)
        want = fold([(p, n, 1.0 if s == "buy" else -1.0) for a, _, p, n, s in data if a == k], 10.0, 0.001)
        for r, (q, entry, pnl, fee, cash) in zip(mine, want, strict=True):
            assert math.isclose(r.inventory_after, q, abs_tol=1e-9) and math.isclose(r.realized_pnl, pnl, abs_tol=1e-10) and math.isclose(r.cash_after, cash, abs_tol=1e-9)
            assert (r.average_entry is None) == (entry is None) and (entry is None or math.isclose(r.average_entry, entry, rel_tol=1e-9))
    assert {abs(r.inventory_after) for r in got} & {0.0}


def test_registered_scans_with_small_chunks(spark, duck):
    """The SQL of both queries against chunks of seven rows: one key's history is many tasks' work."""
    f = feeds.trades(spark, DATA).withColumns({"side": feeds.aggressor_side(F.col("buyer_is_maker")), "day": F.floor(F.col("ts_ms") / 86_400_000)})
    inverse = catalog.rounded(acc.inverse(f, ["day"], ["ts_ms", "sequence"], 100.0, 0.0002, 7), 10)
    ewma = catalog.rounded(bs.ewma_state(feeds.books(spark, DATA), chunk=7).select("sequence", "ofi", "volatility"), 7)
    for name, df in (("inverse_accounting", inverse), ("ewma_state", ewma)):
        cols = sorted(df.columns)
        cur = duck.execute(catalog.ORACLE_SQL[name])
        names = [x[0] for x in cur.description]
        want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want
