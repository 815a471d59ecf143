import math

import pytest

from tidemark.operators import bookstate as bs
from tidemark.operators.episodes import EpisodeConfig, build_intervals

B = "symbol string, ts_ms long, sequence long, bid_price double, bid_qty double, ask_price double, ask_qty double"
T = "symbol string, ts_ms long, sequence long, price double, quantity double, buyer_is_maker boolean"


def run(spark, books, trades, **kw):
    c = EpisodeConfig(**({"tick_size": 1.0, "distance_ticks": (0,), "decision_interval_ms": 100_000, "placement_latency_ms": 10, "horizon_ms": 1000, "observation_interval_ms": 5000} | kw))
    b = spark.createDataFrame([("S", t, i, *(rest or (99.0, 2.0, 101.0, 3.0))) for i, (t, *rest) in enumerate(books)], B)
    t = spark.createDataFrame([("S", t, i, *rest) for i, (t, *rest) in enumerate(trades)], T)
    return build_intervals(b, t, c).orderBy("episode_id", "start_timestamp").collect()


def risks(rows):
    return {(r.episode_id, r.end_timestamp): r.risk for r in rows}


def test_trade_at_activation_cannot_fill(spark):
    rows = run(spark, [(0,), (2000,)], [(10, 98.0, 9.0, True)])
    assert risks(rows) == {(0, 1010): "cancel", (1, 1010): "cancel"}


def test_trade_at_expiry_fills(spark):
    rows = run(spark, [(0,), (2000,)], [(1010, 98.0, 9.0, True)])
    assert risks(rows)[(0, 1010)] == "fill"


def test_queue_ahead_then_fill(spark):
    rows = run(spark, [(0,), (2000,)], [(20, 99.0, 2.0, True), (30, 99.0, 0.5, True)])
    f = next(r for r in rows if r.risk == "fill")
    assert (f.end_timestamp, f.filled_quantity, f.queue_ahead) == (30, 0.5, 2.0)


def test_through_print_fills_whole_order(spark):
    f = next(r for r in run(spark, [(0,), (2000,)], [(20, 98.0, 0.1, True)]) if r.risk == "fill")
    assert f.filled_quantity == 1.0


def test_fill_beats_adverse_in_one_ms(spark):
    rows = run(spark, [(0,), (50, 95.0, 1.0, 97.0, 1.0), (2000, 95.0, 1.0, 97.0, 1.0)], [(50, 98.0, 1.0, True)])
    assert risks(rows)[(0, 50)] == "fill"


def test_adverse_beats_cancel(spark):
    rows = run(spark, [(0,), (1010, 95.0, 1.0, 97.0, 1.0), (2000, 95.0, 1.0, 97.0, 1.0)], [])
    assert risks(rows)[(0, 1010)] == "adverse_move" and risks(rows)[(1, 1010)] == "cancel"


def test_bins_take_same_ms_trades_and_censor_at_the_end(spark):
    rows = [r for r in run(spark, [(0,), (700,)], [(260, 99.0, 1.0, True)], observation_interval_ms=250) if r.side == "bid"]
    assert [(r.start_timestamp, r.end_timestamp, r.queue_ahead, r.risk) for r in rows] == [(10, 260, 2.0, "none"), (260, 510, 1.0, "none"), (510, 700, 1.0, "none")]


def test_post_only_rejects_but_uses_the_id(spark):
    rows = run(spark, [(0,), (5, 101.0, 1.0, 103.0, 1.0), (3000, 101.0, 1.0, 103.0, 1.0)], [])
    assert {r.episode_id for r in rows} == {0}  # the ask at 101 would cross the new bid


def test_zero_latency(spark):
    rows = run(spark, [(0,), (3000,)], [], placement_latency_ms=0)
    assert {(r.start_timestamp, r.end_timestamp, r.risk) for r in rows} == {(0, 1000, "cancel")}


def test_ewma_across_blocks(spark):
    rows = [("S", t, i, 100.0 + i % 3, 1.0 + i % 4, 102.0 + i % 3 + i % 2, 2.0 + i % 5) for i, t in enumerate(range(0, 5000, 37))]
    df = spark.createDataFrame(rows, B)
    one = {r.sequence: (r.ofi, r.volatility) for r in bs.ewma_state(df, 0.2).collect()}
    many = {r.sequence: (r.ofi, r.volatility) for r in bs.ewma_state(df, 0.2, block_ms=500).collect()}
    assert one.keys() == many.keys() and all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-14) for k in one for a, b in zip(one[k], many[k], strict=True))
    assert one[0] == (0.0, 0.0)


@pytest.mark.parametrize("bad", [{"tick_size": 0.0}, {"distance_ticks": (1, 1)}, {"horizon_ms": 0}, {"placement_latency_ms": -1}, {"state_ewma_alpha": 0.0}, {"order_quantity": 1.5, "quantity_step": 1.0}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        EpisodeConfig(**({"tick_size": 1.0} | bad))
