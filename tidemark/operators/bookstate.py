"""Recursive book state: order-flow imbalance and volatility steps and their exponential averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import DAY_MS, asof_backward
from tidemark.operators.scans import CHUNK, affine_scan, in_chunks


def mid(bid: str = "bid_price", ask: str = "ask_price") -> Column:
    return 0.5 * (F.col(bid) + F.col(ask))


def imbalance() -> Column:
    depth = F.col("bid_qty") + F.col("ask_qty")
    return F.when(depth <= 0, F.lit(0.0)).otherwise((F.col("bid_qty") - F.col("ask_qty")) / depth)


def derived(books: DataFrame) -> DataFrame:
    return books.withColumns({"mid": mid(), "spread": F.col("ask_price") - F.col("bid_price"), "imbalance": imbalance()})


def with_previous(books: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """books with the previous book's columns as p_*, by (ts, sequence); blocks are carried, not sorted together."""
    cols = ["ts_ms", "bid_price", "bid_qty", "ask_price", "ask_qty"]
    b = books.withColumn("__b", F.floor(F.col("ts_ms") / block_ms))
    w = Window.partitionBy("symbol", "__b").orderBy("ts_ms", "sequence")
    own = b.withColumn("__p", F.lag(F.struct(*cols)).over(w))
    last = b.groupBy("symbol", "__b").agg(F.max_by(F.struct(*cols), F.struct("ts_ms", "sequence")).alias("e"))
    carried = last.withColumn("c", F.lag("e").over(Window.partitionBy("symbol").orderBy("__b"))).select("symbol", "__b", "c")
    out = own.join(carried, ["symbol", "__b"]).withColumn("__p", F.coalesce("__p", "c"))
    return out.select(*books.columns, *(F.col(f"__p.{c}").alias(f"p_{c}") for c in cols))


def flow_steps(books: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """books with `ofi_step` (net signed touch flow, twice over the depth of both snapshots) and `move` (mid move in basis
    points per square-root second); null on the first book."""
    z = F.lit(0.0)
    b, p = F.col, lambda c: F.col(f"p_{c}")
    raw = (
        F.when(b("bid_price") >= p("bid_price"), b("bid_qty")).otherwise(z) - F.when(b("bid_price") <= p("bid_price"), p("bid_qty")).otherwise(z)
        - F.when(b("ask_price") <= p("ask_price"), b("ask_qty")).otherwise(z) + F.when(b("ask_price") >= p("ask_price"), p("ask_qty")).otherwise(z)
    )
    depth = F.greatest(b("bid_qty") + b("ask_qty") + p("bid_qty") + p("ask_qty"), F.lit(2.220446049250313e-16))
    before = mid("p_bid_price", "p_ask_price")
    elapsed = F.greatest((b("ts_ms") - p("ts_ms")) / 1000.0, F.lit(1e-3))
    known = p("ts_ms").isNotNull()
    return with_previous(books, block_ms).withColumns({"ofi_step": F.when(known, 2.0 * raw / depth), "move": F.when(known, (mid() - before) / before * 10_000.0 / F.sqrt(elapsed))})


def ewma_state(books: DataFrame, alpha: float = 0.05, block_ms: int = DAY_MS, chunk: int = CHUNK, known: tuple[str, str] | None = None) -> DataFrame:
    """books with `ofi` and `volatility` after each book, seeds 0 at a symbol's first book: s = (1 - alpha) s + alpha x, by an affine
    scan over chunks of rows, so no task sees a whole history. known: columns with both after a book where an earlier run has
    found them, else null; the recursion goes on from there."""
    steps = in_chunks(flow_steps(books, block_ms), ["symbol"], ["ts_ms", "sequence"], chunk)
    x, y = F.coalesce("ofi_step", F.lit(0.0)), F.coalesce(F.pow("move", F.lit(2.0)), F.lit(0.0))
    maps = {"ofi": (F.lit(1.0 - alpha), alpha * x), "volatility": (F.lit(1.0 - alpha), alpha * y)}
    if known is not None:
        found = {"ofi": F.col(known[0]), "volatility": F.pow(F.col(known[1]), F.lit(2.0))}
        maps = {n: (F.when(found[n].isNotNull(), 0.0).otherwise(a), F.coalesce(found[n], b)) for n, (a, b) in maps.items()}
    out = affine_scan(steps, maps)
    return out.select(*books.columns, "ofi", F.sqrt(F.greatest("volatility", F.lit(0.0))).alias("volatility"))


def end_of_ms(state: DataFrame) -> DataFrame:
    """The last book of each millisecond."""
    cols = [c for c in state.columns if c not in ("symbol", "ts_ms")]
    return state.groupBy("symbol", "ts_ms").agg(F.max_by(F.struct(*cols), "sequence").alias("s")).select("symbol", "ts_ms", "s.*")


def book_at(left: DataFrame, state: DataFrame, at: str, prefix: str = "", cols: tuple[str, ...] = ("bid_price", "bid_qty", "ask_price", "ask_qty", "ofi", "volatility")) -> DataFrame:
    return asof_backward(left, state, list(cols), at, prefix)
