"""Counterfactual passive orders as relational plans: decision grid, activation, queue depletion, competing risks, intervals.

An order never affects another, so an episode is: as-of look-ups for its quote and activation, a range join with the
trades of its life, a running sum for its queue, and the first of fill, adverse move, cancel. Ties follow one rule: at a
millisecond trades come first, then books, then adverse moves, cancels, activations, bin boundaries, decisions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_backward, interval_join
from tidemark.operators.bookstate import book_at, end_of_ms, ewma_state
from tidemark.operators.crossing import VALUE, first_crossing
from tidemark.sources.feeds import book_faults, step_multiple, trade_faults
from tidemark.sources.folders import kept

#: Order of terminal events that share a millisecond.
FILL, ADVERSE, CANCEL, CENSORED = 0, 1, 2, 3


@dataclass(frozen=True)
class EpisodeConfig:
    tick_size: float
    order_quantity: float = 1.0
    distance_ticks: tuple[int, ...] = (0, 1, 2)
    decision_interval_ms: int = 60_000
    placement_latency_ms: int = 10
    horizon_ms: int = 5_000
    observation_interval_ms: int = 250
    adverse_move_ticks: float = 2.0
    state_ewma_alpha: float = 0.05
    quantity_step: float | None = None

    def __post_init__(self) -> None:
        positive = {x: getattr(self, x) for x in ("tick_size", "order_quantity", "adverse_move_ticks", "decision_interval_ms", "horizon_ms", "observation_interval_ms")}
        for name, v in positive.items():
            if isinstance(v, bool) or not math.isfinite(v) or v <= 0 or (name.endswith("_ms") and int(v) != v):
                raise ValueError(f"{name} must be positive and finite (times: whole milliseconds)")
        if isinstance(self.placement_latency_ms, bool) or int(self.placement_latency_ms) != self.placement_latency_ms or self.placement_latency_ms < 0:
            raise ValueError("placement_latency_ms must be a whole number, not negative")
        d = self.distance_ticks
        if not d or len(set(d)) != len(d) or any(isinstance(x, bool) or int(x) != x or x < 0 for x in d):
            raise ValueError("distance_ticks must be different whole numbers, not negative")
        if not 0 < self.state_ewma_alpha <= 1:
            raise ValueError("state_ewma_alpha: above 0, and 1 at most")
        if self.quantity_step is not None:
            if isinstance(self.quantity_step, bool) or not math.isfinite(self.quantity_step) or self.quantity_step <= 0:
                raise ValueError("quantity_step must be positive and finite")
            units = self.order_quantity / self.quantity_step
            if abs(units - round(units)) > max(1e-9, 8 * math.ulp(units)):
                raise ValueError("order_quantity: not a whole number of quantity steps")

    @property
    def tolerance(self) -> float:
        return self.tick_size * 1e-6


#: For the fixture feeds, which have a trade every few minutes.
FIXTURE = EpisodeConfig(tick_size=0.5, order_quantity=3.0, distance_ticks=(0, 1, 2), decision_interval_ms=3_600_000, placement_latency_ms=60_000, horizon_ms=1_800_000, observation_interval_ms=600_000)


def snap(price: Column, tick: float, side: Column) -> Column:
    """Tick rounding in floats, a hair's breadth tolerant: down for bids, up for asks."""
    scaled = price / tick
    return F.when(side == "bid", F.floor(scaled + 1e-10)).otherwise(F.ceil(scaled - 1e-10)).cast("double") * tick


def decision_grid(books: DataFrame, trades: DataFrame, config: EpisodeConfig) -> DataFrame:
    """(symbol, decision, decision_ms, last_ms): from a symbol's first book to its last market row, step by step."""
    b = books.groupBy("symbol").agg(F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("tb"))
    t = trades.groupBy("symbol").agg(F.max("ts_ms").alias("tt"))
    span = b.join(t, "symbol", "left").withColumn("last_ms", F.greatest("tb", "tt"))
    grid = span.select("symbol", "last_ms", F.posexplode(F.sequence("t0", "last_ms", F.lit(config.decision_interval_ms).cast("long"))).alias("decision", "decision_ms"))
    return grid.select("symbol", F.col("decision").cast("long").alias("decision"), "decision_ms", "last_ms")


def orders(grid: DataFrame, state: DataFrame, config: EpisodeConfig) -> DataFrame:
    """Every decision fans out into a bid and an ask per distance; ids count on even if an order is later rejected."""
    n = len(config.distance_ticks)
    fan = F.array(*(F.struct(F.lit(2 * k + s).alias("k"), F.lit(d).cast("long").alias("ticks"), F.lit(side).alias("side")) for k, d in enumerate(config.distance_ticks) for s, side in enumerate(("bid", "ask"))))
    at = book_at(grid, state, "decision_ms", "d_", ("bid_price", "ask_price")).withColumn("o", F.explode(fan))
    side, away = F.col("o.side"), F.col("o.ticks") * config.tick_size
    raw = F.when(side == "bid", F.col("d_bid_price") - away).otherwise(F.col("d_ask_price") + away)
    return at.select(
        "symbol", (F.col("decision") * (2 * n) + F.col("o.k")).alias("episode_id"), side.alias("side"), F.col("o.ticks").alias("distance_ticks"),
        snap(raw, config.tick_size, side).alias("quote_price"), "decision_ms", (F.col("decision_ms") + config.placement_latency_ms).alias("activated_ms"), "last_ms",
    )


def activations(placed: DataFrame, state: DataFrame, config: EpisodeConfig) -> DataFrame:
    """Orders that rest: acknowledged by the end of the data and post-only against the book then; with queue and mid."""
    a = book_at(placed.where("activated_ms <= last_ms"), state, "activated_ms", "a_", ("bid_price", "bid_qty", "ask_price", "ask_qty"))
    q, tol, bid = F.col("quote_price"), config.tolerance, F.col("side") == "bid"
    rests = F.when(bid, q < F.col("a_ask_price") - tol).otherwise(q > F.col("a_bid_price") + tol)
    queue = F.when(bid & (F.abs(q - F.col("a_bid_price")) <= tol), F.col("a_bid_qty")).when(~bid & (F.abs(q - F.col("a_ask_price")) <= tol), F.col("a_ask_qty")).otherwise(F.lit(0.0))
    return a.where(rests).select(*placed.columns, (F.col("activated_ms") + config.horizon_ms).alias("expires_ms"), queue.alias("queue0"), (0.5 * (F.col("a_bid_price") + F.col("a_ask_price"))).alias("mid0"))


def depletion(active: DataFrame, trades: DataFrame, config: EpisodeConfig) -> DataFrame:
    """Trades that match a resting order, with `through` (beyond its price) and `taken` (running volume since activation)."""
    t = trades.select("symbol", "ts_ms", "sequence", "price", "quantity", F.when(F.col("buyer_is_maker"), "bid").otherwise("ask").alias("side"))
    pairs = interval_join(active, t, "activated_ms", "expires_ms", config.horizon_ms, ["side"])
    q, tol, bid = F.col("quote_price"), config.tolerance, F.col("side") == "bid"
    pairs = pairs.where(F.when(bid, F.col("price") <= q + tol).otherwise(F.col("price") >= q - tol))
    through = F.when(bid, F.col("price") < q - tol).otherwise(F.col("price") > q + tol)
    life = Window.partitionBy("symbol", "episode_id").orderBy("ts_ms", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    return pairs.withColumns({"through": through, "taken": F.sum("quantity").over(life)})


def level_volume(trades: DataFrame, config: EpisodeConfig, block_ms: int = 60_000) -> DataFrame:
    """(symbol, k, ts_ms, v, p): running volume v of each side and price level at the end of each millisecond, p that of the
    millisecond itself, exact in decimals. k names side and level. Windows hold a minute's milliseconds, so busy times are
    spread; one row a minute carries on."""
    level = F.rint(F.col("price") / config.tick_size).cast("long")
    own = trades.where(F.abs(F.col("price") - level * config.tick_size) <= config.tolerance)
    k = series("volume", F.when(F.col("buyer_is_maker"), "bid").otherwise("ask"), level)
    ms = own.groupBy("symbol", k.alias("k"), "ts_ms").agg(F.sum(F.col("quantity").cast("decimal(26,12)")).cast(VALUE).alias("p")).withColumn("__b", F.floor(F.col("ts_ms") / block_ms))
    w = Window.partitionBy("symbol", "k", "__b").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("symbol", "k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ms.groupBy("symbol", "k", "__b").agg(F.sum("p").alias("t")).withColumn("at", F.coalesce(F.sum("t").over(earlier), F.lit(0))).drop("t")
    return ms.withColumn("own", F.sum("p").over(w)).join(starts, ["symbol", "k", "__b"]).select("symbol", "k", "ts_ms", (F.col("own") + F.col("at")).cast(VALUE).alias("v"), "p")


def series(kind: str, side: Column | None = None, level: Column | None = None) -> Column:
    return F.concat_ws(":", F.lit(kind), *([side] if side is not None else []), *([level.cast("string")] if level is not None else []))


def volume_before(rows: DataFrame, volume: DataFrame, at: str, name: str) -> DataFrame:
    """rows (with side and quote_price) with `name`, the volume at their side and price up to the millisecond `at`, its own included."""
    named = volume.select(F.concat_ws("|", "k", "symbol").alias("symbol"), "ts_ms", "v")
    asked = rows.withColumn("__symbol", F.col("symbol")).withColumn("symbol", F.concat_ws("|", "k", "symbol"))
    found = asof_backward(asked, named, ["v"], at, "__")
    return found.withColumn("symbol", F.col("__symbol")).withColumn(name, F.coalesce("__v", F.lit(0).cast(VALUE))).drop("__symbol", "__v")


def terminals(active: DataFrame, trades: DataFrame, volume: DataFrame, state: DataFrame, config: EpisodeConfig) -> DataFrame:
    """One row per resting order: end_ms, risk, filled_quantity, and k and base (its level's name and volume at activation); the
    first event wins, on a tie fill, adverse, cancel.

    A trade beyond the order's price fills it, so ahead of that only volume at its own price counts: the fill is the first
    crossing of the running volume of its level, or the first trade through. Both, and the adverse move, are looked up
    as first crossings; only the trades of the filling millisecond itself are met one by one."""
    tick, bid, size = config.tick_size, F.col("side") == "bid", float(config.order_quantity)
    away, tol = config.adverse_move_ticks * tick, config.tolerance
    orders_ = active.withColumn("k", series("volume", F.col("side"), F.rint(F.col("quote_price") / tick).cast("long")))
    orders_ = kept(volume_before(orders_, volume, "activated_ms", "base"), "orders")
    sign = F.when(bid, -1.0).otherwise(1.0)
    ask = lambda kind, k, thr, up, strict: F.struct(F.concat_ws("|", k, "symbol").alias("k"), F.struct("symbol", "episode_id", F.lit(kind).alias("kind")).alias("id"), F.col("activated_ms").alias("lo"), F.least("expires_ms", "last_ms").alias("hi"), thr.cast(VALUE).alias("thr"), up.alias("up"), F.lit(strict).alias("strict"))
    asked = orders_.select(F.explode(F.array(
        ask("adverse", series("mid"), F.col("mid0") + sign * away, ~bid, False), ask("through", series("trade", F.col("side")), F.col("quote_price") + sign * tol, ~bid, True),
        ask("volume", F.col("k"), F.col("base") + F.col("queue0").cast(VALUE), F.lit(True), True),
    )).alias("x")).select("x.*")
    point = lambda df, k, s, v, p: df.select(F.concat_ws("|", k, "symbol").alias("k"), F.col("ts_ms").alias("t"), s.cast("long").alias("s"), v.cast(VALUE).alias("v"), p.cast(VALUE).alias("p"))
    none = F.lit(0)
    points = point(state, series("mid"), none, 0.5 * (F.col("bid_price") + F.col("ask_price")), none)
    points = points.unionByName(point(trades, series("trade", F.when(F.col("buyer_is_maker"), "bid").otherwise("ask")), F.col("sequence"), F.col("price"), none))
    points = kept(points.unionByName(point(volume, F.col("k"), none, F.col("v"), F.col("p"))), "points")
    hits = first_crossing(asked, points, config.horizon_ms).groupBy("id.symbol", "id.episode_id").agg(*(F.max(F.when(F.col("id.kind") == x, F.col("hit"))).alias(x) for x in ("adverse", "through", "volume")))
    met = kept(orders_.join(hits, ["symbol", "episode_id"], "left"), "met")
    # the millisecond in which volume at the order's price fills it: its trades in their order, as one through may come first
    t = trades.select("symbol", F.col("ts_ms").alias("__t"), "sequence", "price", "quantity", F.when(F.col("buyer_is_maker"), "bid").otherwise("ask").alias("__side"))
    close = met.where("volume is not null and (through is null or volume.t <= through.t)").withColumns({"__t": F.col("volume.t"), "__side": F.col("side")}).join(t, ["symbol", "__t", "__side"])
    beyond = F.when(bid, F.col("price") < F.col("quote_price") - tol).otherwise(F.col("price") > F.col("quote_price") + tol)
    matched = F.when(bid, F.col("price") <= F.col("quote_price") + tol).otherwise(F.col("price") >= F.col("quote_price") - tol)
    life = Window.partitionBy("symbol", "episode_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    own = close.where(matched).withColumn("__through", beyond)
    own = own.withColumn("__taken", F.col("volume.v") - F.col("volume.p") - F.col("base") + F.sum(F.col("quantity").cast("decimal(26,12)")).over(life))
    part = F.when(F.col("__through"), size).otherwise(F.least(F.lit(size), (F.col("__taken") - F.col("queue0").cast(VALUE)).cast("double")))
    filled = own.where("__through or __taken > queue0").groupBy("symbol", "episode_id").agg(F.min_by(part, "sequence").alias("part"))
    out = met.join(filled, ["symbol", "episode_id"], "left")
    event = lambda t, p: F.when(t.isNotNull(), F.struct(t.cast("long").alias("t"), F.lit(p).alias("p")))
    ends = F.array_min(F.array_compact(F.array(
        event(F.least("through.t", "volume.t"), FILL), event(F.col("adverse.t"), ADVERSE), event(F.when(F.col("expires_ms") <= F.col("last_ms"), F.col("expires_ms")), CANCEL), event(F.col("last_ms"), CENSORED),
    )))
    out = out.withColumn("end", ends)
    risk = F.when(F.col("end.p") == FILL, "fill").when(F.col("end.p") == ADVERSE, "adverse_move").when(F.col("end.p") == CANCEL, "cancel").otherwise("none")
    return out.select(*active.columns, "k", "base", F.col("end.t").alias("end_ms"), risk.alias("risk"), F.when(F.col("end.p") == FILL, F.coalesce("part", F.lit(size))).otherwise(0.0).alias("filled_quantity"))


def bins(ended: DataFrame, volume: DataFrame, state: DataFrame, config: EpisodeConfig) -> DataFrame:
    """Exposure intervals: bins anchored at activation up to the terminal event, each with the state at its start."""
    step = config.observation_interval_ms
    cut = ended.where("end_ms > activated_ms").withColumn("start_ms", F.explode(F.sequence(F.col("activated_ms"), F.col("end_ms") - 1, F.lit(step).cast("long"))))
    cut = cut.withColumn("stop_ms", F.least(F.col("start_ms") + step, F.col("end_ms")))
    # volume taken up to a bin's start: trades of that millisecond come first, and none beyond the price came before the end
    both = volume_before(cut, volume, "start_ms", "upto").withColumn("taken", (F.col("upto") - F.col("base")).cast("double"))
    at = book_at(both, state, "start_ms", "s_")
    tick = config.tick_size
    gap = F.when(F.col("side") == "bid", F.col("s_bid_price") - F.col("quote_price")).otherwise(F.col("quote_price") - F.col("s_ask_price")) / tick
    depth = F.col("s_bid_qty") + F.col("s_ask_qty")
    end = F.col("stop_ms") == F.col("end_ms")
    return at.select(
        "symbol", "episode_id", F.col("start_ms").alias("start_timestamp"), F.col("stop_ms").alias("end_timestamp"), "side",
        F.greatest(gap, F.lit(0.0)).alias("distance"), ((F.col("s_ask_price") - F.col("s_bid_price")) / tick).alias("spread"),
        F.when(depth <= 0, F.lit(0.0)).otherwise((F.col("s_bid_qty") - F.col("s_ask_qty")) / depth).alias("imbalance"), F.col("s_ofi").alias("ofi"), F.col("s_volatility").alias("volatility"),
        F.greatest(F.col("queue0") - F.col("taken"), F.lit(0.0)).alias("queue_ahead"), ((F.col("start_ms") - F.col("activated_ms")) / 1000.0).alias("order_age"),
        F.expr("cast((start_ms div 1000) % 86400 as double)").alias("time_of_day"), ((F.col("stop_ms") - F.col("start_ms")) / 1000.0).alias("exposure"),
        (end & (F.col("risk") == "fill")).cast("long").alias("count"), F.when(end, F.col("risk")).otherwise("none").alias("risk"), "quote_price",
        F.col("distance_ticks").alias("requested_distance_ticks"), F.when(end & (F.col("risk") == "fill"), F.col("filled_quantity")).otherwise(0.0).alias("filled_quantity"), F.lit(True).alias("queue_is_approximate"),
    )


def checked_rows(books: DataFrame, trades: DataFrame, config: EpisodeConfig) -> tuple[DataFrame, DataFrame]:
    """Both feeds as they are; a row that is not finite, crossed, not positive or off the quantity step raises before any order
    meets it."""
    def told(df: DataFrame, quantities: tuple[str, ...], what: str) -> DataFrame:
        fault = F.col("fault")
        if config.quantity_step is not None:
            off = F.lit(False)
            for q in quantities:
                off = off | ~step_multiple(F.col(q), config.quantity_step)
            fault = F.coalesce(fault, F.when(off, "off_step"))
        fine = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit(f"invalid {what} row: "), fault)).cast("long")).otherwise(F.col("ts_ms"))
        return df.withColumn("ts_ms", fine).drop("fault")

    return told(book_faults(books), ("bid_qty", "ask_qty"), "book"), told(trade_faults(trades), ("quantity",), "trade")


def build_intervals(books: DataFrame, trades: DataFrame, config: EpisodeConfig) -> DataFrame:
    """All steps together: feeds to hazard intervals. What several steps read is written to the shared folder once. Invalid rows
    of either feed raise."""
    books, trades = checked_rows(books, trades, config)
    state = kept(end_of_ms(ewma_state(books, config.state_ewma_alpha)), "state")
    volume = kept(level_volume(trades, config), "volume")
    active = kept(activations(orders(decision_grid(books, trades, config), state, config), state, config), "active")
    return bins(kept(terminals(active, trades, volume, state, config), "ended"), volume, state, config)
