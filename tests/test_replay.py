import pytest

from tidemark.functions.quotes import QuoteModel
from tidemark.operators.replay import QuotePolicy, Replay, ReplayConfig, canonical, checked, event_fault, event_rows, fill_markouts, fixture_run, replay
from tidemark.sources import feeds

DATA = "/root/testdata/sf0.001"


def book(ts, bid=99.0, bq=2.0, ask=101.0, aq=3.0, seq=0):
    return {"ts_ms": ts, "phase": 1, "sequence": seq, "kind": "book", "bid_price": bid, "bid_qty": bq, "ask_price": ask, "ask_qty": aq}


def trade(ts, price, qty, side, seq=0):
    return {"ts_ms": ts, "phase": 0, "sequence": seq, "kind": "trade", "price": price, "quantity": qty, "side": side}


def place(ts, oid, side, price, qty, seq=0):
    return {"ts_ms": ts, "phase": 2, "sequence": seq, "kind": "place", "order_id": oid, "side": side, "price": price, "quantity": qty}


def go(rows, **kw):
    r = Replay(ReplayConfig(**({"tick_size": 1.0, "liquidate_at_end": False} | kw)))
    r.run(sorted(rows, key=lambda x: (x["ts_ms"], x["phase"], x["sequence"])))
    return r


def test_fifo_over_own_orders():
    r = go([book(0), place(1, "a", "buy", 99.0, 1.0, 1), place(2, "b", "buy", 99.0, 1.0, 2), trade(3, 99.0, 2.5, "sell"), trade(4, 99.0, 1.0, "sell"), book(9)])
    assert [(f["order_id"], f["quantity"]) for f in r.fills] == [("a", 0.5), ("a", 0.5), ("b", 0.5)]


def test_size_reduction_does_not_advance():
    r = go([book(0), place(1, "a", "buy", 99.0, 1.0), book(2, bq=0.5), trade(3, 99.0, 1.5, "sell"), book(9)])
    assert r.fills == [] and r.orders["a"].queue == 0.5


def test_own_cancel_advances():
    r = go([book(0), place(1, "a", "buy", 99.0, 1.0, 1), place(2, "b", "buy", 99.0, 1.0, 2), {"ts_ms": 3, "phase": 2, "sequence": 0, "kind": "cancel", "order_id": "a"}, book(9)])
    assert r.orders["b"].queue == 2.0 and r.orders["a"].status == "canceled"


def test_through_print_and_unknown_queue():
    r = go([book(0), place(1, "a", "buy", 97.0, 2.0), trade(2, 97.0, 50.0, "sell"), trade(3, 96.0, 0.1, "sell"), book(9)])
    assert [(f["ts_ms"], f["quantity"], f["price"]) for f in r.fills] == [(3, 2.0, 97.0)]


def test_crossing_is_rejected_and_late_placement_expires():
    r = go([book(0), place(1, "a", "buy", 101.0, 1.0), book(5)])
    assert r.orders["a"].status == "rejected"
    assert go([book(0), place(1, "a", "buy", 99.0, 1.0), book(5)], placement_latency_ms=100).orders["a"].status == "expired"


def test_identical_quote_keeps_its_place():
    q = lambda ts, bid: {"ts_ms": ts, "phase": 2, "sequence": 0, "kind": "quote", "order_id": f"q{ts}", "bid_price": bid, "ask_price": None, "quantity": 1.0}
    r = go([book(0), q(1, 99.0), q(2, 99.0), q(3, 98.0), book(9)], cancel_latency_ms=2)
    assert len(r.orders) == 2
    old, new = r.orders.values()
    assert (old.status, old.closed_ms, new.active_ms) == ("canceled", 5, 5)


def test_liquidation_costs():
    r = go([book(0), place(1, "a", "buy", 100.0, 1.0), trade(2, 99.0, 1.0, "sell"), book(3)], liquidate_at_end=True, taker_fee_rate=0.01)
    assert r.cash == pytest.approx(-100 + 99 - 0.99) and r.inventory == 0.0


def test_inverse_position():
    rows = [book(0, 99, 2, 201, 3), place(1, "a", "buy", 100.0, 1.0), trade(2, 99.0, 1.0, "sell"), place(3, "b", "buy", 200.0, 1.0), trade(4, 199.0, 1.0, "sell"), book(5, 99, 2, 201, 3)]
    r = go(rows, inverse=True, multiplier=100.0)
    assert r.entry == pytest.approx(133.33333333)


def test_policy_respects_inventory_and_horizon():
    c = ReplayConfig(tick_size=1.0)
    p = QuotePolicy(QuoteModel(1.0, 1.5, 0.1, 0.3, 0.0, 2), c, 1.0, 1.0, horizon_ms=1000, interval_ms=500)
    b = (99.0, 1.0, 101.0, 1.0)
    assert p.on_book(0, b, 0.0) is not None and p.on_book(100, b, 0.0) is None and p.on_book(200, b, 2.0)[0] is None
    assert p.on_book(1000, b, 0.0) == (None, None) and p.on_book(1100, b, 0.0) is None


def test_guard_and_frame(spark):
    e = event_rows(feeds.books(spark, DATA), feeds.trades(spark, DATA))
    logs = replay(e, fixture_run()).collect()
    assert {r.log for r in logs} == {"order", "fill", "equity"}
    eq = [r for r in logs if r.log == "equity"]
    assert all(abs(r.equity - (r.cash_after + r.inventory_after * r.mid)) < 1e-9 for r in eq)
    with pytest.raises(Exception, match="max_events"):
        replay(e, fixture_run(), max_events=10).collect()


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.live import stream_replay

    e = event_rows(feeds.books(spark, DATA), feeds.trades(spark, DATA)).where("ts_ms < 1704400000000")
    cut = [r[0] for r in e.selectExpr("percentile_approx(ts_ms, array(0.3, 0.6))").collect()][0]
    src = str(tmp_path / "in")
    for lo, hi in zip([0, *cut], [*cut, 10**15], strict=True):
        e.where((e.ts_ms >= lo) & (e.ts_ms < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_replay(stream, fixture_run()).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    live = {(r.ts_ms, r.order_id, r.quantity, r.price) for r in spark.table("live").where("log = 'fill'").collect()}
    batch = {(r.ts_ms, r.order_id, r.quantity, r.price) for r in replay(e, fixture_run()).where("log = 'fill' and liquidity = 'maker'").collect()}
    assert live == batch


def test_stream_counts(spark, tmp_path):
    from tidemark.streaming.live import stream_counts

    t = feeds.trades(spark, DATA)
    t.coalesce(1).write.parquet(str(tmp_path / "t"))
    q = stream_counts(spark.readStream.schema(t.schema).parquet(str(tmp_path / "t"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.c for r in spark.table("counts").collect()) == t.count()


def test_quotes_are_withdrawn_at_the_horizon_without_a_book():
    config = ReplayConfig(tick_size=1.0, liquidate_at_end=False)
    policy = QuotePolicy(QuoteModel(1.0, 1.5, 0.1, 0.05, 0.0, 5), config, unit=1.0, order_quantity=1.0, horizon_ms=10)
    r = Replay(config, policy)
    r.run([book(0, bq=0.0, aq=0.0), trade(15, 1.0, 50.0, "sell"), trade(16, 1000.0, 50.0, "buy"), book(30)])
    assert r.orders and r.fills == [] and all(o.status == "canceled" and o.closed_ms == 10 for o in r.orders.values())


EVENTS = "symbol string, kind string, ts_ms long, sequence long, order_id string, side string, price double, quantity double, bid_price double, bid_qty double, ask_price double, ask_qty double"
GOOD = {
    "book": ("S", "book", 1, 0, None, None, None, None, 99.0, 0.0, 101.0, 2.0), "trade": ("S", "trade", 1, 0, None, "buy", 99.0, 1.0, None, None, None, None), "cancel": ("S", "cancel", 1, 0, "a", None, None, None, None, None, None, None),
    "place": ("S", "place", 1, 0, "a", "sell", 99.0, 1.0, None, None, None, None), "quote": ("S", "quote", 1, 0, "q", None, None, 1.0, 99.0, None, None, None),
}


def odd(base, **kw):
    names = [x.split()[0] for x in EVENTS.split(", ")]
    return tuple(kw.get(n, v) for n, v in zip(names, GOOD[base], strict=True))


def test_event_faults(spark):
    inf, nan = float("inf"), float("nan")
    cases = [(GOOD[k], None) for k in GOOD] + [
        (odd("book", kind="other"), "kind"), (odd("book", kind=None), "kind"), (odd("book", ts_ms=None), "order"), (odd("book", bid_price=0.0), "price"), (odd("book", ask_price=nan), "price"), (odd("book", bid_qty=-1.0), "quantity"),
        (odd("book", bid_price=101.0), "crossed"), (odd("trade", price=None), "price"), (odd("trade", quantity=0.0), "quantity"), (odd("trade", side="up"), "side"), (odd("trade", side=None), "side"), (odd("place", price=inf), "price"),
        (odd("place", order_id=""), "order_id"), (odd("cancel", order_id=None), "order_id"), (odd("quote", bid_price=-1.0), "price"), (odd("quote", quantity=0.0), "quantity"), (odd("quote", bid_price=None, quantity=None), None), (odd("trade", quantity=1.5), None),
    ]
    for rows, config in (([(r, f) for r, f in cases], ReplayConfig(1.0)), ([(odd("trade", quantity=1.5), "step"), (odd("book", ask_qty=0.5), "step"), (GOOD["trade"], None)], ReplayConfig(1.0, inverse=True, quantity_step=1.0))):
        for row, want in rows:
            e = spark.createDataFrame([row], EVENTS)
            assert e.select(event_fault(e, config)).first()[0] == want, row
    with pytest.raises(Exception, match="bad replay event: crossed at 1 book"):
        checked(spark.createDataFrame([odd("book", bid_price=101.0)], EVENTS), ReplayConfig(1.0)).collect()
    with pytest.raises(Exception, match="bad replay event: side"):
        replay(spark.createDataFrame([GOOD["book"], odd("trade", side="up")], EVENTS), lambda: Replay(ReplayConfig(1.0))).collect()


def test_order_of_rows_does_not_matter(spark):
    rows = [odd("book", bid_qty=2.0), odd("place", ts_ms=2, order_id="b", side="buy"), odd("place", ts_ms=2, order_id="a", side="buy"), odd("cancel", ts_ms=2, order_id="a"), odd("trade", ts_ms=2, quantity=2.5, side="sell"), odd("trade", ts_ms=3, quantity=2.5, side="sell"), odd("book", ts_ms=3, bid_qty=1.0)]
    logs = [sorted(map(str, replay(spark.createDataFrame(x, EVENTS), lambda: Replay(ReplayConfig(1.0))).collect())) for x in (rows, rows[::-1])]
    assert logs[0] == logs[1] and len(logs[0]) > 5
    names = [x.split()[0] for x in EVENTS.split(", ")]
    at_two = sorted((dict(zip(names, r, strict=True)) for r in rows if r[2] == 2), key=canonical)
    assert [(r["kind"], r["order_id"]) for r in at_two] == [("trade", None), ("cancel", "a"), ("place", "a"), ("place", "b")]


def test_policy_results_are_checked():
    class Bad:
        ended, start_ms, horizon_ms = False, None, 10

        def __init__(self, got):
            self.got = got

        def on_book(self, ts, book, inventory):
            return self.got

    for got in ((1.0,), (float("nan"), None), (-1.0, None)):
        with pytest.raises(ValueError, match="a policy gives"):
            Replay(ReplayConfig(1.0), Bad(got)).run([book(0)])


@pytest.mark.parametrize("inverse", [False, True])
def test_fill_markouts_equal_brute_force(spark, inverse):
    config = ReplayConfig(0.5, inverse=inverse, multiplier=10.0)
    books = feeds.books(spark, DATA)
    fills = replay(event_rows(books, feeds.trades(spark, DATA)), fixture_run()).where("log = 'fill'")
    history = sorted((b.ts_ms, b.sequence, 0.5 * (b.bid_price + b.ask_price)) for b in books.collect())
    want = {}
    for f in fills.collect():
        for h in (600_000, 5 * 86_400_000) if f.liquidity == "maker" else ():
            t, _, mid = next((x for x in history if x[0] >= f.ts_ms + h), (None, None, None))
            s = 1 if f.side == "buy" else -1
            pnl = None if mid is None else 10.0 * s * (1 / f.price - 1 / mid) if inverse else s * (mid - f.price)
            want[f.n, h] = (t, mid, pnl, None if mid is None else 10_000 * pnl / ((10.0 / f.price) if inverse else f.price))
    got = {(r.n, r.horizon_ms): (r.observed_ms, r.mid, r.signed_pnl, r.signed_bps) for r in fill_markouts(fills, books, [600_000, 5 * 86_400_000], config).collect()}
    assert got.keys() == want.keys() and len(want) > 3 and any(v[0] is None for v in want.values())
    for k, v in want.items():
        assert got[k] == (None,) * 4 if v[0] is None else got[k] == pytest.approx(v)


def test_stream_end_closes_the_run(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.streaming.live import stream_replay

    e = event_rows(feeds.books(spark, DATA), feeds.trades(spark, DATA)).where("ts_ms < 1704300000000")
    last = e.agg(F.max("ts_ms")).first()[0]
    src = str(tmp_path / "in")
    e.where(F.col("ts_ms") < last).coalesce(1).write.parquet(src)
    end = e.limit(1).withColumns({"kind": F.lit("end"), "ts_ms": F.lit(last)})
    e.where(F.col("ts_ms") == last).unionByName(end).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_replay(stream, fixture_run()).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    cols = ("log", "n", "ts_ms", "order_id", "status", "liquidity", "equity")
    pick = lambda rows: {tuple(r[c] for c in cols) for r in rows if r.log != "order"} | {("order", r.order_id, r.status, r.closed_ms) for r in rows if r.log == "order"}
    live, batch = pick(spark.table("closed").collect()), pick(replay(e, fixture_run()).collect())
    assert live == batch and any(x[0] == "order" and x[2] == "expired" for x in live)


def test_a_long_run_is_a_stream(spark):
    """A run arrives in many small batches, its orders are given out as they close, and the logs are those of one piece."""
    e = event_rows(feeds.books(spark, DATA), feeds.trades(spark, DATA)).where("ts_ms < 1704400000000")
    run = fixture_run()()
    run.run(sorted((r.asDict() for r in e.collect()), key=canonical))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        plan = replay(e, fixture_run())
        rows = plan.collect()
        assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()  # no group of a symbol's whole history
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    by = {k: sorted((r for r in rows if r.log == k), key=lambda r: r.n) for k in ("order", "fill", "equity")}
    assert [(r.n, r.order_id, r.status, r.closed_ms, r.filled, r.queue0) for r in by["order"]] == [(i, o.order_id, o.status, o.closed_ms, o.filled, o.queue0) for i, o in enumerate(run.orders.values())]
    assert [(r.ts_ms, r.order_id, r.quantity, r.cash_after) for r in by["fill"]] == [(f["ts_ms"], f["order_id"], f["quantity"], f["cash_after"]) for f in run.fills]
    assert [(r.n, r.ts_ms, r.equity) for r in by["equity"]] == [(i, x["ts_ms"], x["equity"]) for i, x in enumerate(run.equity)]
    only = replay(e, fixture_run(), logs=("fill",)).collect()
    assert sorted(only, key=lambda r: r.n) == by["fill"]


def test_an_id_is_not_used_twice_even_after_its_order_has_closed(spark):
    rows = [book(0), place(1, "a", "buy", 101.0, 1.0), book(5), *(book(t) for t in range(6, 60)), place(60, "a", "buy", 99.0, 1.0), book(70)]
    e = spark.createDataFrame([{"symbol": "S", **r} for r in rows], "symbol string, ts_ms long, phase int, sequence long, kind string, bid_price double, bid_qty double, ask_price double, ask_qty double, order_id string, side string, price double, quantity double")
    with pytest.raises(Exception, match="placed before"):
        replay(e, lambda: Replay(ReplayConfig(tick_size=1.0, liquidate_at_end=False))).collect()
