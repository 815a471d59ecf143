import math

import pytest

from tidemark.operators import arrivals as arr

S = "symbol string, ts_ms long, sequence long"
T0 = 1_725_148_800_000


def feed(spark, *offsets):
    return spark.createDataFrame([("S", T0 + o, i) for i, o in enumerate(offsets)], S)


def test_gaps_and_fano(spark):
    t = feed(spark, 0, 0, 100, 200)
    r = arr.interarrival(t).first()
    assert (r.delta_count, r.median_ms) == (3, 100) and r.cv == pytest.approx(math.sqrt(2) / 2)
    f = arr.count_fano(t).first()
    assert f.bins == 3 and f.fano == pytest.approx(1 / 6)


def test_explicit_bounds_count_empty_bins(spark):
    f = arr.count_fano(feed(spark, 0, 0, 100, 200), T0, T0 + 1000).first()
    assert f.bins == 10 and f.fano == pytest.approx(1.1)


def test_partial_minute_and_blocks(spark):
    t = feed(spark, 59_900, 60_000, 60_050)
    assert sorted(r.bins for r in arr.minute_fano(t).collect()) == [1, 1]
    assert sorted(r.delta for r in arr.gaps(t, block_ms=100).where("delta is not null").collect()) == [50, 100]


def test_no_events(spark):
    assert arr.interarrival(feed(spark, 0)).collect() == []
