"""Book and trade feeds: CSV and JSONL sources and sinks, strict parsing, validation, and the fixture adapters.

Feeds are DataFrames. book: symbol, ts_ms, sequence, bid_price, bid_qty, ask_price, ask_qty, event_time_ms; trade:
symbol, ts_ms, sequence, price, quantity, buyer_is_maker, first_trade_id, last_trade_id. Time is integer milliseconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPISODE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()), T.StructField("side", T.StringType()), *(T.StructField(x, T.DoubleType()) for x in ("distance", "spread", "imbalance", "ofi", "volatility", "queue_ahead", "order_age")),
        T.StructField("count", T.LongType()), T.StructField("exposure", T.DoubleType()), T.StructField("episode_id", T.StringType()), *(T.StructField(x, T.DoubleType()) for x in ("markout", "pnl", "inventory")),
    ]
)
EPISODE_REQUIRED = ("timestamp", "side", "distance", "spread", "imbalance", "ofi", "volatility", "queue_ahead", "order_age", "count", "exposure")


def strict_bool(c: Column) -> Column:
    """true/1 and false/0, trimmed, any case; anything else raises."""
    v = F.lower(F.trim(c))
    return F.when(v.isin("true", "1"), F.lit(True)).when(v.isin("false", "0"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(c, F.lit("null")))).cast("boolean"))


def optional_long(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).cast("long")


def _by_name(df: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    if missing := [x for x in required if x not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*required, *((F.col(x) if x in df.columns else F.lit(None).cast("string")).alias(x) for x in optional))


def read_book_csv(spark: SparkSession, path: str | list[str], symbol: str = "", source: bool = False) -> DataFrame:
    """Top-of-book CSV, columns by name, extras ignored. Bad numbers fail (ANSI casts). source: with the rows' places in their files."""
    scan, more = spark.read.csv(path, header=True), SOURCE if source else ()
    raw = _by_name(with_source(scan) if source else scan, ("transaction_time", "update_id", "best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty", *more), ("event_time",))
    return raw.select(
        F.lit(symbol).alias("symbol"), F.col("transaction_time").cast("long").alias("ts_ms"), F.col("update_id").cast("long").alias("sequence"),
        F.col("best_bid_price").cast("double").alias("bid_price"), F.col("best_bid_qty").cast("double").alias("bid_qty"),
        F.col("best_ask_price").cast("double").alias("ask_price"), F.col("best_ask_qty").cast("double").alias("ask_qty"), optional_long(F.col("event_time")).alias("event_time_ms"), *more,
    )


def read_trade_csv(spark: SparkSession, path: str | list[str], symbol: str = "", source: bool = False) -> DataFrame:
    """Aggregate-trade CSV, columns by name, extras ignored. source: with the rows' places in their files."""
    scan, more = spark.read.csv(path, header=True), SOURCE if source else ()
    raw = _by_name(with_source(scan) if source else scan, ("transact_time", "agg_trade_id", "price", "quantity", "is_buyer_maker", *more), ("first_trade_id", "last_trade_id"))
    return raw.select(
        F.lit(symbol).alias("symbol"), F.col("transact_time").cast("long").alias("ts_ms"), F.col("agg_trade_id").cast("long").alias("sequence"), F.col("price").cast("double").alias("price"),
        F.col("quantity").cast("double").alias("quantity"), strict_bool(F.col("is_buyer_maker")).alias("buyer_is_maker"), optional_long(F.col("first_trade_id")).alias("first_trade_id"), optional_long(F.col("last_trade_id")).alias("last_trade_id"), *more,
    )


def month_paths(directory: str, symbol: str, month: str) -> tuple[str, str]:
    """Where a month's book and trade files lie: directory/SYMBOL-bookTicker-MONTH.csv and SYMBOL-aggTrades-MONTH.csv."""
    return f"{directory}/{symbol}-bookTicker-{month}.csv", f"{directory}/{symbol}-aggTrades-{month}.csv"


def existing_month_paths(spark: SparkSession, directory: str, symbol: str, month: str) -> tuple[str, str]:
    """month_paths, looked up in the directory's file system; missing files raise, all named."""
    paths = month_paths(directory, symbol, month)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    if missing := [p for p, f in zip(paths, files, strict=True) if not f.getFileSystem(conf).isFile(f)]:
        raise FileNotFoundError(f"no market data at {' and '.join(missing)}")
    return paths


def parse_timestamp_ms(value: str | None) -> int | None:
    """Integer milliseconds, or ISO-8601 (without zone: UTC)."""
    if value is None:
        return None
    if value.lstrip("+-").isdigit():
        return int(value)
    at = datetime.fromisoformat(value)
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def in_window(df: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Rows with start <= ts < end; pushed down to columnar scans."""
    for ok in ([F.col("ts_ms") >= start_ms] if start_ms is not None else []) + ([F.col("ts_ms") < end_ms] if end_ms is not None else []):
        df = df.where(ok)
    return df


def first_rows(df: DataFrame, most: int | None) -> DataFrame:
    """The first `most` rows in (ts, sequence) order; None or 0 means all, as on the command line. Rows are counted by day, then by
    minute and millisecond of the part that crosses `most`, so only the rows of one millisecond are put in order."""
    if not most:
        return df
    at, left = None, most
    for width in (86_400_000, 60_000, 1):
        block = F.floor(F.col("ts_ms") / width)
        counts = (df if at is None else df.where((F.col("ts_ms") >= at[0]) & (F.col("ts_ms") < at[1]))).where("ts_ms is not null").groupBy(block.alias("b")).agg(F.count("*").alias("c"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("b")))  # one row a block
        found = upto.where(F.col("upto") >= left).orderBy("b").first()
        if found is None:
            return df.where("ts_ms is not null")
        left -= found["upto"] - found["c"]
        at = (found["b"] * width, (found["b"] + 1) * width)
    return df.where(F.col("ts_ms") < at[0]).unionByName(df.where(F.col("ts_ms") == at[0]).orderBy("sequence").limit(left))


def order_violations(df: DataFrame, row_id: str, block_rows: int = 1 << 20) -> DataFrame:
    """Rows whose (ts, sequence) is below that of the row before in source order. A DataFrame has no order of its own, so the
    source's row number is an explicit column; windows run over block_rows of it, and one row per block carries on."""
    at = F.struct("ts_ms", "sequence")
    b = df.withColumn("__b", F.floor(F.col(row_id) / block_rows))
    own = b.withColumn("__p", F.lag(at).over(Window.partitionBy("symbol", "__b").orderBy(row_id)))
    ends = b.groupBy("symbol", "__b").agg(F.max_by(at, row_id).alias("e")).withColumn("__e", F.lag("e").over(Window.partitionBy("symbol").orderBy("__b"))).drop("e")
    out = own.join(ends, ["symbol", "__b"]).withColumn("__p", F.coalesce("__p", "__e"))
    out = out.select(*df.columns, F.col("__p.ts_ms").alias("p_ts"), F.col("__p.sequence").alias("p_seq"))
    return out.where("p_ts > ts_ms or (p_ts = ts_ms and p_seq > sequence)")


SOURCE = ("source_file", "source_start", "source_row")


def with_source(scan: DataFrame) -> DataFrame:
    """A file scan with the place of each row in its source: file, where the split starts, and a number that rises in the split."""
    return scan.select("*", F.col("_metadata.file_path").alias(SOURCE[0]), F.col("_metadata.file_block_start").alias(SOURCE[1]), F.monotonically_increasing_id().alias(SOURCE[2]))


def source_violations(df: DataFrame) -> DataFrame:
    """Rows of a feed read with its source whose (ts, sequence) is below that of the row before in the same symbol; files follow each
    other by name. Windows run inside a split, and one row a split carries on."""
    at, split = F.struct("ts_ms", "sequence"), list(SOURCE[:2])
    own = df.withColumn("__p", F.lag(at).over(Window.partitionBy("symbol", *split).orderBy(SOURCE[2])))
    last = df.groupBy("symbol", *split).agg(F.max_by(at, SOURCE[2]).alias("e"))
    ends = last.withColumn("__e", F.lag("e").over(Window.partitionBy("symbol").orderBy(*split))).drop("e")  # one row a split
    out = own.join(ends, ["symbol", *split]).withColumn("__p", F.coalesce("__p", "__e"))
    return out.select(*df.columns, F.col("__p.ts_ms").alias("p_ts"), F.col("__p.sequence").alias("p_seq")).where("p_ts > ts_ms or (p_ts = ts_ms and p_seq > sequence)")


def sorted_source(df: DataFrame) -> DataFrame:
    """A feed read with its source, without those columns, if its files are in order; raises at the first row that is not."""
    if bad := source_violations(df).orderBy(*SOURCE).first():
        raise ValueError(f"{bad['source_file']}: ({bad['ts_ms']}, {bad['sequence']}) comes after ({bad['p_ts']}, {bad['p_seq']})")
    return df.drop(*SOURCE)


def write_feed_store(feed: DataFrame, path: str, files_per_day: int = 1) -> None:
    """A feed as Parquet by symbol and UTC day, sorted by time in each file, so that a file's and row group's statistics bound its times.
    A day is cut by time in files_per_day files."""
    part = F.floor((F.pmod("ts_ms", F.lit(86_400_000))) / (86_400_000 / files_per_day))
    dated = feed.withColumns({"day": F.floor(F.col("ts_ms") / 86_400_000).cast("int"), "__part": part})
    dated.repartition("symbol", "day", "__part").drop("__part").sortWithinPartitions("symbol", "day", "ts_ms", "sequence").write.mode("overwrite").partitionBy("symbol", "day").parquet(path)


def read_feed_store(spark: SparkSession, path: str, symbol: str | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Rows of a feed store with start <= ts < end: other symbols and days are not listed to be read, and inside a day the times are
    left to the files' statistics."""
    df = spark.read.parquet(path)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    if start_ms is not None:
        df = df.where(F.col("day") >= start_ms // 86_400_000)
    if end_ms is not None:
        df = df.where(F.col("day") <= (end_ms - 1) // 86_400_000)
    return in_window(df, start_ms, end_ms).drop("day")


def book_faults(books: DataFrame) -> DataFrame:
    """books with `fault`: non_finite, crossed, negative_qty or null, the first that applies."""
    cols = ("bid_price", "bid_qty", "ask_price", "ask_qty")
    odd = F.greatest(*(F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1).otherwise(0) for c in cols)) == 1
    return books.withColumn("fault", F.when(odd, "non_finite").when((F.col("bid_price") <= 0) | (F.col("ask_price") <= F.col("bid_price")), "crossed").when((F.col("bid_qty") < 0) | (F.col("ask_qty") < 0), "negative_qty"))


def trade_faults(trades: DataFrame) -> DataFrame:
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) <= 0) for c in ("price", "quantity")]
    return trades.withColumn("fault", F.when(bad[0] | bad[1], "non_positive"))


def step_multiple(quantity: Column, step: float) -> Column:
    """Whether a quantity is a multiple of step, within max(1e-9, 8 ulp) of the nearest number of steps."""
    units = quantity / step
    return F.abs(units - F.rint(units)) <= F.greatest(F.lit(1e-9), 8 * F.abs(units) * 2.220446049250313e-16)


def aggressor_side(buyer_is_maker: Column) -> Column:
    return F.when(buyer_is_maker, "sell").otherwise("buy")


def normalise_side(c: Column) -> Column:
    """bid/buy/b/0 and ask/sell/a/1, trimmed, any case; anything else raises."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("bid", "buy", "b", "0"), "bid").when(v.isin("ask", "sell", "a", "1"), "ask").otherwise(F.raise_error(F.lit("unknown side")).cast("string"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): a text file's lines that are not blank with their numbers from 1, blank ones counted; of a folder, the files in
    order of their names. A split's lines are counted first, so no task sees more than its split."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("m"))
    splits = raw.groupBy("f", "s").agg(F.count("*").alias("c"), F.min("m").alias("m0"))  # one row a split
    starts = splits.select("f", "s", "m0", (F.sum("c").over(Window.orderBy("f", "s")) - F.col("c")).alias("before"))
    out = raw.join(F.broadcast(starts), ["f", "s"])
    return out.where(F.length(F.trim("value")) > 0).select("value", (F.col("before") + F.col("m") - F.col("m0") + 1).alias("line"))


def read_episodes_jsonl(spark: SparkSession, paths: list[str], most: int | None = None) -> DataFrame:
    """Episode JSONL files; the id gets its file's number as a prefix when there is more than one file, and is the line
    number within the file where absent. Missing required fields raise, with file and line. `most`: the first so
    many rows in the order of files and lines."""
    out = None
    for k, path in enumerate(paths):
        # a generator's columns are not computed anew by the filter below: each line is parsed once
        df = numbered_lines(spark, path).select(F.lit(k).alias("file"), "line", F.inline(F.array(F.from_json("value", EPISODE_SCHEMA))))
        lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in EPISODE_REQUIRED)))
        told = F.concat(F.lit(f"{path}:"), F.col("line").cast("string"), F.lit(": episode row lacks required field "), F.array_join(lacking, ", "))
        df = df.where(F.when(F.size(lacking) == 0, True).otherwise(F.raise_error(told).cast("boolean")))
        own = F.coalesce("episode_id", F.col("line").cast("string"))
        df = df.withColumn("episode_id", F.concat(F.lit(f"{k}:"), own) if len(paths) > 1 else own)
        out = df if out is None else out.unionByName(df)
    return (out.orderBy("file", "line").limit(most) if most else out).drop("file", "line")


def null_odd(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, as JSON output needs."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*(F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if isinstance(k, (T.DoubleType, T.FloatType)) else F.col(c) for c, k in kinds.items()))


def write_jsonl(df: DataFrame, path: str) -> None:
    null_odd(df).write.mode("overwrite").json(path)


def json_report(df: DataFrame) -> DataFrame:
    """One JSON string a row, keys sorted, NaN and infinities null."""
    clean = null_odd(df)
    return clean.select(F.to_json(F.struct(*sorted(clean.columns)), {"ignoreNullFields": "false"}).alias("report"))


# --- fixture adapters over the events table ---------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tick = 1000 + F.expr("(event_id div 20) % 10")
    return e.select(F.lit("S").alias("symbol"), F.expr("unix_millis(cast(ts as timestamp))").alias("ts_ms"), F.col("event_id").alias("sequence"), "user_id", "event_type", "value", tick.alias("n"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _events(spark, sf_dir).where(F.col("event_type").isin("click", "view", "signup")), F.col("sequence")
    return e.select(
        "symbol", "ts_ms", "sequence", ((F.col("n") + i % 3) * 0.5).alias("bid_price"), (1 + F.col("user_id") % 5).cast("double").alias("bid_qty"),
        ((F.col("n") + 1 + i % 3 + i % 2) * 0.5).alias("ask_price"), (1 + i % 4).cast("double").alias("ask_qty"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error")), F.col("sequence")
    return e.select(
        "symbol", "ts_ms", "sequence", ((F.col("n") + i % 5) * 0.5).alias("price"), (1 + F.floor("value").cast("long") % 10).cast("double").alias("quantity"), (F.col("event_type") == "error").alias("buyer_is_maker"),
    )


def monthly_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode-shaped rows over 83 months, from lineitem."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select(
        F.trunc("l_shipdate", "month").alias("month"), F.expr("unix_millis(cast(l_shipdate as timestamp))").alias("ts_ms"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
        F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"), (F.col("l_returnflag") == "R").cast("long").alias("count"), (1 + F.col("l_tax")).alias("exposure"),
        F.col("l_discount").alias("distance"), (1.0 + F.col("l_linenumber") % 3).cast("double").alias("spread"), ((F.col("l_quantity") - 25.5) / 24.5).alias("imbalance"),
        F.col("l_quantity").alias("queue_ahead"), (F.col("l_extendedprice") / 1000).alias("value"),
    )
