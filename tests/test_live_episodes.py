"""Episodes over a stream of shuffled micro-batches are those over the whole feed."""

import random

import pytest

from tidemark.operators.episodes import EpisodeConfig, build_intervals
from tidemark.streaming import late
from tidemark.streaming import live_episodes as live

CONFIG = EpisodeConfig(tick_size=0.5, order_quantity=2.0, distance_ticks=(0, 1), decision_interval_ms=700, placement_latency_ms=60, horizon_ms=900, observation_interval_ms=250)
LATENESS = 400


def _feed(seed, symbol, n, start=0):
    """Rows of SCHEMA, in order of time, several a millisecond among them."""
    rng, out, t, level = random.Random(seed), [], start, 100.0
    for k in range(n):
        t += rng.choice([0, 7, 20, 45])
        level += 0.5 * rng.choice([-1, 0, 0, 0, 1])
        if k == 0 or rng.random() < 0.6:
            out.append((symbol, t, k, "book", level, 1.0 + rng.randrange(4), level + 0.5 * rng.choice([1, 1, 2]), 1.0 + rng.randrange(4), None, None, None))
        else:
            out.append((symbol, t, k, "trade", None, None, None, None, level + 0.5 * rng.choice([-1, 0, 1, 2]), 0.5 + rng.randrange(3), rng.random() < 0.5))
    return out


def _whole(spark, rows):
    df = spark.createDataFrame(rows, live.SCHEMA)
    return build_intervals(df.where("kind = 'book'").select(*live.BOOK), df.where("kind = 'trade'").select(*live.TRADE), CONFIG)


def _told(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect())


def _batches(rows, rng, n):
    """rows dealt out by time and a delay below LATENESS, shuffled within a batch."""
    hi = max(r[1] for r in rows) + LATENESS
    out = [[] for _ in range(n)]
    for r in rows:
        out[min(n - 1, (r[1] + rng.randrange(LATENESS)) * n // hi)].append(r)
    for b in out:
        rng.shuffle(b)
    return out


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """Three batches through a file stream, with late rows in the second and third."""
    root, rng = tmp_path_factory.mktemp("live"), random.Random(5)
    rows = _feed(1, "A", 260) + _feed(2, "B", 60, start=500) + [("T", 50, 0, "trade", None, None, None, None, 9.0, 1.0, True)]
    batches = _batches(rows, rng, 3)
    stale = [("A", 1, 9_000, "trade", None, None, None, None, 90.0, 50.0, True), ("A", 2, 9_001, "book", 1.0, 1.0, 2.0, 1.0, None, None, None)]
    out, source, seen = str(root / "out"), str(root / "in"), []
    for number, b in enumerate(batches):
        spark.createDataFrame(b + (stale if number else []), live.SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(live.SCHEMA).parquet(source)
        stream.writeStream.foreachBatch(live.episode_stream(out, LATENESS, CONFIG)).option("checkpointLocation", str(root / "cp")).trigger(availableNow=True).start().awaitTermination()
        seen.append(live.intervals(spark, out).collect())
    live.finish(spark, out, LATENESS, CONFIG)
    return rows, out, seen


def test_streamed_intervals_equal_those_of_the_whole_feed(spark, streamed):
    rows, out, _ = streamed
    got = live.intervals(spark, out)
    assert {r[0] for r in got.select("risk").collect()} == {"fill", "adverse_move", "cancel", "none"} and {r[0] for r in got.select("symbol").collect()} == {"A", "B"}
    assert _told(got) == _told(_whole(spark, rows))


def test_ended_orders_are_given_out_before_the_end(spark, streamed):
    rows, out, seen = streamed
    final = live.intervals(spark, out).collect()
    assert 0 < len(seen[1]) < len(seen[2]) < len(final)
    assert set(seen[1]) < set(seen[2]) < set(final)  # what was given out stays


def test_late_rows_change_nothing_and_are_counted(spark, streamed):
    rows, out, _ = streamed
    counts = {r.symbol: (r.on_time, r.late) for r in late.late_counts(spark, out).collect()}
    assert counts["A"] == (260, 4) and counts["B"] == (60, 0) and counts["T"] == (1, 0)


def test_what_is_carried_on_is_bounded_by_the_open_orders(spark, streamed):
    rows, out, _ = streamed
    clock = {r.symbol: r.clock_ms for r in spark.read.parquet(f"{out}/clocks/batch=2").collect()}
    oldest = {s: t - LATENESS - CONFIG.placement_latency_ms - CONFIG.horizon_ms for s, t in clock.items()}
    state = spark.read.parquet(f"{out}/{live.STATE}/batch=2").collect()
    for s in ("A", "B"):
        assert sum(r.symbol == s and r.ts_ms < oldest[s] for r in state) <= 1  # the last book ahead of them
    assert all(r.ts_ms >= oldest[r.symbol] for r in spark.read.parquet(f"{out}/{live.TRADES}/batch=2").collect())


def test_a_batch_run_again_and_an_empty_one(spark, tmp_path):
    rows, out = _feed(7, "A", 80), str(tmp_path / "out")
    step = live.episode_stream(out, LATENESS, CONFIG)
    for batch, number in ((rows, 0), (rows, 0), ([], 1)):
        step(spark.createDataFrame(batch, live.SCHEMA), number)
    live.finish(spark, out, LATENESS, CONFIG)
    assert _told(live.intervals(spark, out)) == _told(_whole(spark, rows))


def test_an_invalid_row_raises(spark, tmp_path):
    step = live.episode_stream(str(tmp_path / "out"), 10, CONFIG)
    bad = [("A", 0, 0, "book", 101.0, 1.0, 100.0, 1.0, None, None, None), ("A", 5000, 1, "book", 99.0, 1.0, 100.0, 1.0, None, None, None)]
    with pytest.raises(Exception, match="invalid book row: "):
        step(spark.createDataFrame(bad, live.SCHEMA), 0)


def test_rows_of_a_symbol_are_not_sent_to_one_task(spark, tmp_path, monkeypatch):
    """Clocks and marks, a row a symbol, are broadcast, whatever size Spark takes them for."""
    plans, route, kept = {}, late.route, live.kept
    told = lambda name, df: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and df
    monkeypatch.setattr(late, "route", lambda *x: told("routed", route(*x)))
    monkeypatch.setattr(live, "kept", lambda df, name: kept(told(name, df), name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        live.episode_stream(str(tmp_path / "out"), LATENESS, CONFIG)(spark.createDataFrame(_feed(7, "A", 40), live.SCHEMA), 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in ("routed", "books", "trades"):
        assert "BroadcastHashJoin" in plans[name] and "SortMergeJoin" not in plans[name]
