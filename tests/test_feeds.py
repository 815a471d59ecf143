import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.sources import feeds

T0 = 1_725_148_800_000


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_by_name_and_extras(spark, tmp_path):
    p = write(tmp_path / "b.csv", "extra,update_id,best_bid_price,best_bid_qty,best_ask_price,best_ask_qty,transaction_time,event_time\nx,7,99,2,101,3,1000,\ny,8,99,2,101,3,1001,1002\n")
    rows = feeds.read_book_csv(spark, p, "S").orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.sequence, r.bid_price, r.ask_qty, r.event_time_ms) for r in rows] == [(1000, 7, 99.0, 3.0, None), (1001, 8, 99.0, 3.0, 1002)]


def test_trade_csv_strict_bool(spark, tmp_path):
    head = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n"
    good = feeds.read_trade_csv(spark, write(tmp_path / "t.csv", head + "1,100,2,1,1,1000, TRUE \n2,100,2,,,1000,0\n")).orderBy("sequence").collect()
    assert [r.buyer_is_maker for r in good] == [True, False] and good[1].first_trade_id is None
    with pytest.raises(Exception, match="not a boolean"):
        feeds.read_trade_csv(spark, write(tmp_path / "u.csv", head + "1,100,2,1,1,1000,maybe\n")).collect()


def test_missing_column(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns"):
        feeds.read_trade_csv(spark, write(tmp_path / "t.csv", "price\n1\n"))


def test_merge_tie_trade_first(spark):
    b = spark.createDataFrame([("S", 5, 1)], "symbol string, ts_ms long, sequence long")
    t = spark.createDataFrame([("S", 5, 9)], "symbol string, ts_ms long, sequence long")
    rows = asof.within_ms(asof.merged_stream(b, t)).orderBy("ms_seq").collect()
    assert [(r.kind, r.ms_seq) for r in rows] == [("trade", 0), ("book", 1)]


def test_timestamps():
    assert feeds.parse_timestamp_ms("1725148800000") == T0
    assert feeds.parse_timestamp_ms("2024-09-01T00:00:00") == T0 == feeds.parse_timestamp_ms("2024-09-01T02:00:00+02:00")
    assert feeds.parse_timestamp_ms(None) is None


def test_order_violations(spark):
    df = spark.createDataFrame([("S", 1, 1, 0), ("S", 3, 1, 1), ("S", 2, 5, 2), ("S", 2, 4, 3), ("S", 2, 4, 4)], "symbol string, ts_ms long, sequence long, row long")
    assert [r.row for r in feeds.order_violations(df, "row").orderBy("row").collect()] == [2, 3]


def test_faults(spark):
    rows = [("a", 99.0, 1.0, 101.0, 1.0), ("b", 101.0, 1.0, 101.0, 1.0), ("c", 99.0, -1.0, 101.0, 1.0), ("d", float("nan"), 1.0, 101.0, 1.0), ("e", None, 1.0, 101.0, 1.0)]
    got = {r.k: r.fault for r in feeds.book_faults(spark.createDataFrame(rows, "k string, bid_price double, bid_qty double, ask_price double, ask_qty double")).collect()}
    assert got == {"a": None, "b": "crossed", "c": "negative_qty", "d": "non_finite", "e": "non_finite"}


def test_jsonl_round_trip(spark, tmp_path):
    row = {"timestamp": 1.0, "side": "bid", **{c: 0.5 for c in ("distance", "spread", "imbalance", "ofi", "volatility", "queue_ahead", "order_age")}, "count": 1, "exposure": 2.0}
    for k in (0, 1):
        (tmp_path / f"{k}.jsonl").write_text(json.dumps(row | {"episode_id": "e"}) + "\n")
    ids = [r.episode_id for r in feeds.read_episodes_jsonl(spark, [str(tmp_path / "0.jsonl"), str(tmp_path / "1.jsonl")]).orderBy("episode_id").collect()]
    assert ids == ["0:e", "1:e"]
    (tmp_path / "bad.jsonl").write_text(json.dumps({"side": "bid"}) + "\n")
    with pytest.raises(Exception, match="required field"):
        feeds.read_episodes_jsonl(spark, [str(tmp_path / "bad.jsonl")]).collect()
    feeds.write_jsonl(spark.createDataFrame([(1, float("nan")), (2, 3.0)], "a int, b double"), str(tmp_path / "out"))
    assert {r.a: r.b for r in spark.read.schema("a int, b double").json(str(tmp_path / "out")).collect()} == {1: None, 2: 3.0}


def test_report_sorted_and_null(spark):
    r = feeds.json_report(spark.createDataFrame([(1.0, float("inf"))], "z double, a double")).first().report
    assert r == '{"a":null,"z":1.0}'


def test_asof_carries_over_blocks(spark):
    right = spark.createDataFrame([("S", 10, 1, 1.0), ("S", 10, 2, 2.0), ("S", 500, 3, 3.0)], "symbol string, ts_ms long, sequence long, v double")
    left = spark.createDataFrame([("S", 5), ("S", 10), ("S", 11), ("S", 499), ("S", 500), ("S", 501)], "symbol string, ts_ms long")
    back = {r.ts_ms: r.v for r in asof.asof_backward(left, right, ["v"], block_ms=100).collect()}
    assert back == {5: None, 10: 2.0, 11: 2.0, 499: 2.0, 500: 3.0, 501: 3.0}
    ahead = {r.ts_ms: r.v for r in asof.asof_forward(left, right, ["v"], block_ms=100).collect()}
    assert ahead == {5: 1.0, 10: 1.0, 11: 3.0, 499: 3.0, 500: 3.0, 501: None}


def test_interval_join_is_an_equi_join(spark):
    spans = spark.createDataFrame([("S", 0, 10), ("S", 95, 105)], "symbol string, lo long, hi long")
    points = spark.createDataFrame([("S", 0), ("S", 10), ("S", 95), ("S", 96), ("S", 105), ("S", 106)], "symbol string, ts_ms long")
    j = asof.interval_join(spans, points, "lo", "hi", 10)
    assert sorted((r.lo, r.ts_ms) for r in j.collect()) == [(0, 10), (95, 96), (95, 105)]
    assert "NestedLoop" not in j._jdf.queryExecution().toString()


def test_sides_and_steps(spark):
    df = spark.createDataFrame([(" Buy ",), ("1",), ("A",), ("b",)], "s string")
    assert [r[0] for r in df.select(feeds.normalise_side(F.col("s"))).collect()] == ["bid", "ask", "ask", "bid"]
    assert spark.range(1).select(feeds.step_multiple(F.lit(0.3), 0.1), feeds.step_multiple(F.lit(0.35), 0.1)).first()[:] == (True, False)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    row = {"timestamp": 1.0, "side": "bid", **{c: 0.5 for c in ("distance", "spread", "imbalance", "ofi", "volatility", "queue_ahead", "order_age")}, "count": 1, "exposure": 2.0}
    lines = ["" if k % 7 == 3 else json.dumps(row | {"timestamp": float(k)}) for k in range(400)]
    path = write(tmp_path / "e.jsonl", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = feeds.read_episodes_jsonl(spark, [path])
        assert df.rdd.getNumPartitions() > 4
        assert {(r.episode_id, r.timestamp) for r in df.collect()} == {(str(k + 1), float(k)) for k in range(400) if k % 7 != 3}
        assert [r.episode_id for r in feeds.read_episodes_jsonl(spark, [path, path], 350).collect()][-7:] == [f"1:{k}" for k in (1, 2, 3, 5, 6, 7, 8)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(Exception, match=r"bad.jsonl:2: episode row lacks required field timestamp, distance"):
        feeds.read_episodes_jsonl(spark, [write(tmp_path / "bad.jsonl", json.dumps(row) + "\n" + json.dumps({"side": "bid"}) + "\n")]).collect()


def test_month_files_must_exist(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="bookTicker-2024-09.csv and .*aggTrades-2024-09.csv"):
        feeds.existing_month_paths(spark, str(tmp_path), "X", "2024-09")
    for p in feeds.month_paths(str(tmp_path), "X", "2024-09"):
        open(p, "w").close()
    assert feeds.existing_month_paths(spark, str(tmp_path), "X", "2024-09") == feeds.month_paths(str(tmp_path), "X", "2024-09")


def test_order_violations_over_blocks(spark):
    df = spark.createDataFrame([("S", 1, 1, 0), ("S", 3, 1, 1), ("S", 2, 5, 2), ("S", 2, 4, 9), ("S", 2, 4, 10)], "symbol string, ts_ms long, sequence long, row long")
    assert [r.row for r in feeds.order_violations(df, "row", 2).orderBy("row").collect()] == [2, 9]


def test_an_episode_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}\n")
    plan = feeds.read_episodes_jsonl(spark, [str(tmp_path / "a.jsonl")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
