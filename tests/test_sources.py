"""Source order of files, the first rows without one task for them all, and the feed store."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds

T = "symbol string, ts_ms long, sequence long, price double"


def trade_file(spark, path, rows):
    path.mkdir()
    (path / "t.csv").write_text("\n".join(["agg_trade_id,price,quantity,transact_time,is_buyer_maker", *(f"{s},1.0,1.0,{t},true" for t, s in rows)]) + "\n")
    return f"file://{path}"


def test_reader_finds_and_rejects_unsorted_files(spark, tmp_path):
    good = feeds.read_trade_csv(spark, trade_file(spark, tmp_path / "a", [(1, 1), (1, 2), (2, 1)]), "S", source=True)
    assert feeds.source_violations(good).count() == 0 and feeds.sorted_source(good).count() == 3 and "source_row" not in feeds.sorted_source(good).columns
    rows = [(i // 3, i) for i in range(4000)]
    rows[700], rows[2500], rows[3999] = (0, 0), (833, 2499), (5, 5)
    path = trade_file(spark, tmp_path / "b", rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits of one file
        bad = feeds.read_trade_csv(spark, path, "S", source=True)
        want = [b for a, b in zip(rows, rows[1:], strict=False) if a > b]
        assert sorted((r.ts_ms, r.sequence) for r in feeds.source_violations(bad).collect()) == sorted(want)
        with pytest.raises(ValueError, match=r"t.csv: \(0, 0\) comes after \(233, 699\)"):
            feeds.sorted_source(bad)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("most", [1, 7, 250, 251, 399, 400, 900])
def test_first_rows_equal_a_full_sort(spark, most):
    rows = [("S", (i * 37 % 5) * 86_400_000 + (i % 3) * 60_000 + i % 2, i, 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, T).repartition(4)
    got = feeds.first_rows(df, most)
    assert sorted((r.ts_ms, r.sequence) for r in got.collect()) == sorted((r[1], r[2]) for r in rows)[:most]


def test_first_rows_put_one_millisecond_in_order(spark):
    df = spark.range(10_000).select(F.lit("S").alias("symbol"), F.col("id").alias("ts_ms"), F.col("id").alias("sequence"), F.lit(1.0).alias("price"))
    plan = feeds.first_rows(df, 6000)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 1" in plan and "GlobalLimit 6000" not in plan and feeds.first_rows(df, 6000).count() == 6000
    assert feeds.first_rows(df, 0).count() == 10_000 and feeds.first_rows(df.limit(0), 5).count() == 0


def test_feed_store_reads_what_it_must(spark, tmp_path):
    day, path = 86_400_000, f"file://{tmp_path}/store"
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("symbol"), (F.col("id") * (day // 500)).alias("ts_ms"), F.col("id").alias("sequence"), F.lit(2.0).alias("price"))
    feeds.write_feed_store(df, path, files_per_day=4)
    got = feeds.read_feed_store(spark, path, "A", 2 * day + 5, 4 * day)
    want = df.where((F.col("symbol") == "A") & (F.col("ts_ms") >= 2 * day + 5) & (F.col("ts_ms") < 4 * day))
    assert sorted(r.sequence for r in got.collect()) == sorted(r.sequence for r in want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "GreaterThanOrEqual(ts_ms" in plan and "LessThan(ts_ms" in plan
    read = got.select(F.col("_metadata.file_path")).distinct().count() if "_metadata" in got.columns else got.select(F.input_file_name()).distinct().count()
    assert read <= 8 < len(list((tmp_path / "store").rglob("*.parquet")))
    for f in list((tmp_path / "store").rglob("*.parquet"))[:3]:
        times = [r.ts_ms for r in spark.read.parquet(f"file://{f}").collect()]
        assert times == sorted(times)
    assert feeds.read_feed_store(spark, path).count() == 4000
