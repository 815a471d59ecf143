"""First crossings and fills against plain loops: ties in a millisecond, several symbols, a minute that holds nearly all trades."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodes as ep
from tidemark.operators.crossing import first_crossing
from tidemark.sources.folders import kept

SPAN = "k string, id long, lo long, hi long, thr double, up boolean, strict boolean"


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_first_crossing_against_a_scan(spark, fan):
    rng = random.Random(fan)
    points = [(k, rng.randint(0, 900), s, rng.choice([1.0, 2.0, 2.5, 3.0, 9.0])) for k in ("a", "b") for s in range(250)]
    spans = []
    for i in range(150):
        lo = rng.randint(-50, 900)
        spans.append((rng.choice(["a", "b", "c"]), i, lo, lo + rng.randint(0, 300), rng.choice([0.5, 1.0, 2.5, 3.0, 9.5, None]), rng.random() < 0.5, rng.random() < 0.5))
    want = {}
    for k, i, lo, hi, thr, up, strict in spans:
        beyond = lambda v: thr is not None and ((v > thr if strict else v >= thr) if up else (v < thr if strict else v <= thr))  # noqa: B023, E731
        if hits := [(t, s, v) for kk, t, s, v in points if kk == k and lo < t <= hi and beyond(v)]:
            want[i] = min(hits)
    p = spark.createDataFrame(points, "k string, t long, s long, v double").withColumns({"v": F.col("v").cast("decimal(38,12)"), "p": F.lit(0)})
    x = spark.createDataFrame(spans, SPAN).withColumn("thr", F.col("thr").cast("decimal(38,12)"))
    assert {r.id: (r.hit.t, r.hit.s, float(r.hit.v)) for r in first_crossing(x, p, 300, fan).collect()} == want and want


def brute(active, trades, mids, c):
    """(end_ms, risk, filled) of every order, trade by trade."""
    out = {}
    for a in active:
        bid, q, tol, taken, fill = a.side == "bid", a.quote_price, c.tolerance, 0.0, None
        for t in trades.get(a.symbol, []):
            if not (a.activated_ms < t.ts_ms <= a.expires_ms and t.buyer_is_maker == bid and (t.price <= q + tol if bid else t.price >= q - tol)):
                continue
            through = t.price < q - tol if bid else t.price > q + tol
            taken += t.quantity
            if through or taken > a.queue0 + 1e-9:
                fill = (t.ts_ms, c.order_quantity if through else min(c.order_quantity, taken - a.queue0))
                break
        away = c.adverse_move_ticks * c.tick_size
        moves = [t for t, m in mids.get(a.symbol, []) if a.activated_ms < t <= a.expires_ms and (m <= a.mid0 - away if bid else m >= a.mid0 + away)]
        events = [(fill[0], 0, "fill", fill[1])] if fill else []
        events += [(moves[0], 1, "adverse_move", 0.0)] if moves else []
        events += [(a.expires_ms, 2, "cancel", 0.0)] if a.expires_ms <= a.last_ms else []
        end, _, risk, got = min([*events, (a.last_ms, 3, "none", 0.0)])
        out[a.symbol, a.episode_id] = (end, risk, round(got, 9))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_terminals_against_every_trade(spark, seed):
    rng = random.Random(seed)
    c = ep.EpisodeConfig(tick_size=1.0, order_quantity=1.5, distance_ticks=(0, 1, 3), decision_interval_ms=400, placement_latency_ms=3, horizon_ms=900, observation_interval_ms=70)
    books, trades = [], []
    for s in ("S", "R"):
        for i in range(160):
            m = 100 + rng.randint(-2, 2)
            books.append((s, rng.randint(0, 200) * 20, i, m - 1.0, rng.choice([0.0, 0.3, 2.0]), m + 1.0, rng.choice([0.5, 1.1])))
        hot = lambda: rng.randint(600, 630) if rng.random() < 0.9 else rng.randint(0, 4000)
        trades += [(s, hot(), i, 100.0 + rng.randint(-4, 4) + rng.choice([0, 0, 0, 0.5]), rng.choice([0.1, 0.2, 0.7]), rng.random() < 0.5) for i in range(400)]
    b = kept(spark.createDataFrame(books, "symbol string, ts_ms long, sequence long, bid_price double, bid_qty double, ask_price double, ask_qty double"), "b")
    t = kept(spark.createDataFrame(trades, "symbol string, ts_ms long, sequence long, price double, quantity double, buyer_is_maker boolean"), "t")
    state = kept(ep.end_of_ms(b.withColumns({"ofi": F.lit(0.0), "volatility": F.lit(0.0)})), "s")
    active = kept(ep.activations(ep.orders(ep.decision_grid(b, t, c), state, c), state, c), "a")
    volume = kept(ep.level_volume(t, c), "v")
    ended = ep.terminals(active, t, volume, state, c)
    by = lambda rows, key: {s: sorted((r for r in rows if r.symbol == s), key=key) for s in ("S", "R")}
    own = by(t.collect(), lambda r: (r.ts_ms, r.sequence))
    mids = {s: [(r.ts_ms, 0.5 * (r.bid_price + r.ask_price)) for r in v] for s, v in by(state.collect(), lambda r: r.ts_ms).items()}
    want = brute(active.collect(), own, mids, c)
    got = {(r.symbol, r.episode_id): (r.end_ms, r.risk, round(r.filled_quantity, 9)) for r in ended.collect()}
    assert got == want and {"fill", "adverse_move", "cancel"} <= {x[1] for x in got.values()}
    # queue ahead at each bin's start
    orders = {(a.symbol, a.episode_id): a for a in active.collect()}
    for r in ep.bins(kept(ended, "e"), volume, state, c).collect():
        a = orders[r.symbol, r.episode_id]
        taken = sum(x.quantity for x in own[r.symbol] if a.activated_ms < x.ts_ms <= r.start_timestamp and x.buyer_is_maker == (a.side == "bid") and abs(x.price - a.quote_price) < 1e-6)
        assert abs(r.queue_ahead - max(a.queue0 - taken, 0.0)) < 1e-9


def test_a_busy_minute_is_spread(spark):
    """45,000 of 50,000 trades in one minute, at one price: no window or join of the step meets them in one place."""
    c = ep.EpisodeConfig(tick_size=1.0, decision_interval_ms=1000, horizon_ms=5000)
    hot = F.col("id") < 45_000
    t = spark.range(50_000).select(F.lit("S").alias("symbol"), F.when(hot, 600_000 + F.col("id") % 60_000).otherwise(F.col("id") * 20).alias("ts_ms"), F.col("id").alias("sequence"), F.lit(99.0).alias("price"), F.lit(0.5).alias("quantity"), F.lit(True).alias("buyer_is_maker"))
    volume = kept(ep.level_volume(t, c, 1000), "volume")
    assert volume.count() <= 50_000 and float(volume.agg(F.max("v")).first()[0]) == 25_000.0
    assert volume.groupBy("k", F.floor(F.col("ts_ms") / 1000)).count().agg(F.max("count")).first()[0] <= 1000  # of a window
    orders = spark.range(900).select(F.lit("volume:bid:99|S").alias("k"), "id", (F.col("id") * 1000).alias("lo"), (F.col("id") * 1000 + 5000).alias("hi"), F.lit(True).alias("up"), F.lit(True).alias("strict"))
    base = volume.select("ts_ms", "v")
    spans = orders.join(base, base.ts_ms <= orders.lo, "left").groupBy("k", "id", "lo", "hi", "up", "strict").agg((F.coalesce(F.max("v"), F.lit(0)) + 7).alias("thr"))
    points = volume.select(F.concat_ws("|", "k", "symbol").alias("k"), F.col("ts_ms").alias("t"), F.lit(0).cast("long").alias("s"), "v", "p")
    got = {r.id: r.hit.t for r in first_crossing(spans, points, 5000).collect()}
    rows = sorted((r.ts_ms, float(r.v)) for r in volume.collect())
    for s in spans.where("id % 37 = 0").collect():
        after = [x for x, v in rows if s.lo < x <= s.hi and v > float(s.thr)]
        assert got.get(s.id) == (after[0] if after else None)


def test_invalid_rows_raise_ahead_of_episodes(spark):
    b = "symbol string, ts_ms long, sequence long, bid_price double, bid_qty double, ask_price double, ask_qty double"
    t = "symbol string, ts_ms long, sequence long, price double, quantity double, buyer_is_maker boolean"
    good_b, good_t = [("S", 0, 0, 99.0, 1.0, 101.0, 1.0), ("S", 9000, 1, 99.0, 1.0, 101.0, 1.0)], [("S", 50, 0, 99.0, 1.0, True)]
    c = ep.EpisodeConfig(tick_size=1.0, distance_ticks=(0,), quantity_step=0.5, decision_interval_ms=100_000)
    run = lambda bs, ts: ep.build_intervals(spark.createDataFrame(bs, b), spark.createDataFrame(ts, t), c).count()
    assert run(good_b, good_t) > 0
    with pytest.raises(Exception, match="crossed"):
        run([*good_b, ("S", 70, 2, 102.0, 1.0, 101.0, 1.0)], good_t)
    with pytest.raises(Exception, match="off_step"):
        run(good_b, [("S", 60, 1, 99.0, 0.3, True)])
    with pytest.raises(Exception, match="non_positive"):
        run(good_b, [("S", 60, 1, 99.0, -1.0, True)])
