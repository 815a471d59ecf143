"""Episodes over a stream: each micro-batch gives out the intervals of all orders whose expiry lies strictly before the watermark.

An order needs the feed from its decision to its horizon, and the recursive book state, of which one row a symbol is carried on. So a
batch runs the plans of operators/episodes.py over the decisions that have just come due, keeps the rows that open ones need,
and leaves the rest. Work is dealt out as in batch: no task folds a symbol's history.

For writeStream.foreachBatch. A batch that is run again finds the tables of the one before and replaces its own. Late rows go to
the table of late.router and change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bookstate import end_of_ms, ewma_state
from tidemark.operators.episodes import EpisodeConfig, activations, bins, checked_rows, level_volume, orders, terminals
from tidemark.sources.folders import kept
from tidemark.streaming.late import CLOCKS, ON_TIME, beside, router

#: Tables of the folder beside the router's: what is given out; rows past the watermark; books with their state; trades; first books.
INTERVALS, OPEN, STATE, TRADES, STARTS = "intervals", "open", "state", "trades", "starts"
BOOK = ("symbol", "ts_ms", "sequence", "bid_price", "bid_qty", "ask_price", "ask_qty")
TRADE = ("symbol", "ts_ms", "sequence", "price", "quantity", "buyer_is_maker")
SCHEMA = (
    "symbol string, ts_ms long, sequence long, kind string, bid_price double, bid_qty double, ask_price double, ask_qty double, "
    "price double, quantity double, buyer_is_maker boolean"
)


def feed_rows(books: DataFrame, trades: DataFrame) -> DataFrame:
    """Both feeds as rows of one stream, kind book or trade; the feeds number their rows apart."""
    rows = books.select(*BOOK, F.lit("book").alias("kind")).unionByName(trades.select(*TRADE, F.lit("trade").alias("kind")), allowMissingColumns=True)
    return rows.select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in SCHEMA.split(", ")))


def due(starts: DataFrame, marks: DataFrame, config: EpisodeConfig) -> DataFrame:
    """The part of decision_grid from from_ms (null: the first book) to to_ms."""
    step = config.decision_interval_ms
    first = F.greatest(F.coalesce("from_ms", "t0"), F.col("t0"))
    at = starts.join(marks, "symbol").withColumn("d0", F.col("t0") + F.ceil((first - F.col("t0")) / step) * step).where("d0 <= to_ms")
    grid = at.withColumn("decision_ms", F.explode(F.sequence("d0", "to_ms", F.lit(step).cast("long"))))
    return grid.select("symbol", F.expr(f"(decision_ms - t0) div {int(step)}").alias("decision"), "decision_ms", "last_ms")


def _advance(spark: SparkSession, folder: str, before: int | None, name: str, fresh: DataFrame, marks: DataFrame, config: EpisodeConfig) -> None:
    """marks: a row a symbol. Rows below closed_ms are complete; decisions from from_ms to to_ms are due; later ones stay open."""
    marks = beside(kept(marks, "marks"))
    at = lambda table, n: f"{folder}/{table}/batch={n}"
    state_schema = "symbol string, ts_ms long, sequence long, bid_price double, bid_qty double, ask_price double, ask_qty double, ofi double, volatility double"
    trade_schema = "symbol string, ts_ms long, sequence long, price double, quantity double, buyer_is_maker boolean"

    def prior(table: str, schema: str) -> DataFrame:
        return spark.createDataFrame([], schema) if before is None else spark.read.schema(schema).parquet(at(table, before))

    rows = prior(OPEN, SCHEMA).unionByName(fresh).join(marks, "symbol")  # marks are broadcast: a symbol's rows stay where they are
    rows.where("ts_ms >= closed_ms").select(*fresh.columns).write.mode("overwrite").parquet(at(OPEN, name))
    closed = rows.where("ts_ms < closed_ms")
    books, trades = checked_rows(closed.where("kind = 'book'").select(*BOOK), closed.where("kind = 'trade'").select(*TRADE), config)

    held = prior(STATE, state_schema)
    names = [c for c in held.columns if c != "symbol"]
    last = held.groupBy("symbol").agg(F.max_by(F.struct(*names), "ts_ms").alias("s")).select("symbol", "s.*")
    none = F.lit(None).cast("double")
    known = last.withColumnsRenamed({"ofi": "__ofi", "volatility": "__volatility"}).unionByName(books.withColumns({"__ofi": none, "__volatility": none}))
    told = ewma_state(kept(known, "books"), config.state_ewma_alpha, known=("__ofi", "__volatility")).where("__ofi is null").drop("__ofi", "__volatility")
    state = kept(held.unionByName(end_of_ms(told).select(*held.columns)), "state")
    traded = kept(prior(TRADES, trade_schema).unionByName(trades), "trades")
    starts = prior(STARTS, "symbol string, t0 long").unionByName(state.select("symbol", F.col("ts_ms").alias("t0"))).groupBy("symbol").agg(F.min("t0").alias("t0"))
    starts.write.mode("overwrite").parquet(at(STARTS, name))

    volume = kept(level_volume(traded, config), "volume")
    active = kept(activations(orders(due(spark.read.parquet(at(STARTS, name)), marks, config), state, config), state, config), "active")
    bins(kept(terminals(active, traded, volume, state, config), "ended"), volume, state, config).write.mode("overwrite").parquet(at(INTERVALS, name))

    # an open decision is above to_ms; it needs the last book up to it, and all later rows
    ends = marks.select("symbol", "to_ms")
    marked = state.join(ends, "symbol")
    latest = marked.where("ts_ms <= to_ms").groupBy("symbol").agg(F.max_by(F.struct(*names), "ts_ms").alias("s")).select("symbol", "s.*")
    marked.where("ts_ms > to_ms").select(*held.columns).unionByName(latest.select(*held.columns)).write.mode("overwrite").parquet(at(STATE, name))
    traded.join(ends, "symbol").where("ts_ms > to_ms").select(*TRADE).write.mode("overwrite").parquet(at(TRADES, name))


def episode_stream(folder: str, lateness_ms: int, config: EpisodeConfig) -> Callable[[DataFrame, int], None]:
    """For foreachBatch, on rows of SCHEMA: folder/intervals gets, under the batch's number, the intervals of the orders that have
    ended for sure. A symbol's watermark is its latest time less lateness_ms. Rows without a symbol or kind are passed by, as in
    batch; an invalid row raises once the watermark has passed it."""
    apart, life = router(folder, lateness_ms), config.placement_latency_ms + config.horizon_ms

    def step(batch: DataFrame, number: int) -> None:
        apart(batch, number)
        spark = batch.sparkSession
        now = spark.read.parquet(f"{folder}/{CLOCKS}/batch={number}").where("clock_ms is not null")
        then = spark.read.parquet(f"{folder}/{CLOCKS}/batch={number - 1}").withColumnRenamed("clock_ms", "then_ms") if number else spark.createDataFrame([], "symbol string, then_ms long")
        closed = F.col("clock_ms") - lateness_ms
        marks = now.join(then, "symbol", "left").select("symbol", closed.alias("closed_ms"), (F.col("then_ms") - lateness_ms - life).alias("from_ms"), (closed - life - 1).alias("to_ms"), F.col("clock_ms").alias("last_ms"))
        fresh = spark.read.schema(SCHEMA).parquet(f"{folder}/{ON_TIME}/batch={number}")
        _advance(spark, folder, number - 1 if number else None, str(number), fresh, marks, config)

    return step


def finish(spark: SparkSession, folder: str, lateness_ms: int, config: EpisodeConfig) -> None:
    """The end of all feeds: what is open is given out too, orders that still rest censored at their symbol's last row, as at the end
    of a batch run. It may be run again. A stream that had no batch has no folder and nothing to finish."""
    last = spark.read.parquet(f"{folder}/{CLOCKS}").agg(F.max("batch")).first()[0]
    clocks, life = spark.read.parquet(f"{folder}/{CLOCKS}/batch={last}").where("clock_ms is not null"), config.placement_latency_ms + config.horizon_ms
    clock = F.col("clock_ms")
    marks = clocks.select("symbol", (clock + 1).alias("closed_ms"), (clock - lateness_ms - life).alias("from_ms"), clock.alias("to_ms"), clock.alias("last_ms"))
    _advance(spark, folder, int(last), "end", spark.createDataFrame([], SCHEMA), marks, config)


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    """All intervals given out so far."""
    return spark.read.parquet(f"{folder}/{INTERVALS}").drop("batch")
