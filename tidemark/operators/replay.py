"""Latency-aware execution replay: one state machine per run key, its logs as DataFrames.

Time is integer milliseconds. At one millisecond: market rows by sequence, cancels due, activations due, the policy's
quote (once, if a book came) and external commands, then zero-latency cancels and activations. Live orders are kept
per side and price in time priority, so a market row touches only the levels it can reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import accounting
from tidemark.functions.quotes import QuoteModel, deltas
from tidemark.operators.asof import asof_forward
from tidemark.operators.ordering import largest_fall
from tidemark.sources.feeds import step_multiple
from tidemark.sources.folders import kept

EPS = 1e-12
TERMINAL = frozenset({"filled", "canceled", "rejected", "expired"})


@dataclass(frozen=True)
class ReplayConfig:
    tick_size: float
    placement_latency_ms: int = 0
    cancel_latency_ms: int = 0
    maker_fee_rate: float = 0.0
    taker_fee_rate: float = 0.0
    initial_cash: float = 0.0
    initial_inventory: float = 0.0
    liquidate_at_end: bool = True
    inverse: bool = False
    multiplier: float = 1.0
    initial_entry_price: float | None = None
    quantity_step: float | None = None

    def __post_init__(self) -> None:
        if not (math.isfinite(self.tick_size) and self.tick_size > 0 and self.multiplier > 0):
            raise ValueError("tick_size and multiplier must be positive and finite")
        if self.placement_latency_ms < 0 or self.cancel_latency_ms < 0:
            raise ValueError("latencies must not be negative")
        if min(self.maker_fee_rate, self.taker_fee_rate) <= -1:
            raise ValueError("fee rates must be above -1")
        if self.inverse and abs(self.initial_inventory) > EPS and self.initial_entry_price is None:
            raise ValueError("an inverse position needs an entry price")


@dataclass
class _Order:
    order_id: str
    side: str
    price: float
    quantity: float
    requested_ms: int
    activation_ms: int
    sequence: int
    status: str = "pending"
    active_ms: int | None = None
    cancel_requested_ms: int | None = None
    cancel_due_ms: int | None = None
    closed_ms: int | None = None
    filled: float = 0.0
    queue: float | None = None
    queue0: float | None = None
    reason: str | None = None
    number: int = 0

    @property
    def left(self) -> float:
        return max(0.0, self.quantity - self.filled)

    @property
    def done(self) -> bool:
        return self.status in TERMINAL

    @property
    def live(self) -> bool:
        return self.active_ms is not None and not self.done

    @property
    def priority(self) -> tuple:
        return (self.active_ms, self.sequence, self.order_id)


def decimal_tick(price: float, side: str, tick: float) -> float:
    p, t = Decimal(str(price)), Decimal(str(tick))
    out = (p / t).to_integral_value(rounding=ROUND_FLOOR if side == "buy" else ROUND_CEILING) * t
    if out <= 0:
        raise ValueError("price rounds to zero or less")
    return float(out)


@dataclass
class QuotePolicy:
    """Closed-loop quoting: model distances around the mid for the gridded inventory, held off the far touch by a tick;
    renewed every `interval_ms`, at once when the gridded inventory changes, and withdrawn at the horizon."""

    model: QuoteModel
    config: ReplayConfig
    unit: float
    order_quantity: float
    horizon_ms: int
    interval_ms: int = 1000
    start_ms: int | None = None
    last_ms: int | None = None
    last_q: int | None = None
    ended: bool = False

    def on_book(self, ts: int, book: tuple, inventory: float) -> tuple | None:
        """(bid price or None, ask price or None), or None for no change."""
        self.start_ms = ts if self.start_ms is None else self.start_ms
        gone = ts - self.start_ms
        if gone >= self.horizon_ms:
            if self.ended:
                return None
            self.ended = True
            return (None, None)
        u = inventory / self.unit
        q = int(max(-self.model.max_inventory, min(self.model.max_inventory, math.copysign(math.floor(abs(u) + 0.5), u))))
        if self.last_ms is not None and q == self.last_q and ts - self.last_ms < self.interval_ms:
            return None
        self.last_ms, self.last_q = ts, q
        bid_delta, ask_delta = deltas(self.model, q, (self.horizon_ms - gone) / 1000.0)
        bid, _, ask, _ = book
        mid, tick = 0.5 * (bid + ask), self.config.tick_size
        b = None if bid_delta is None else min(mid - bid_delta, ask - tick)
        a = None if ask_delta is None else max(mid + ask_delta, bid + tick)
        return (b if b is None or b >= tick else None, a)


@dataclass
class Replay:
    config: ReplayConfig
    policy: QuotePolicy | None = None
    order_quantity: float = 1.0
    orders: dict[str, _Order] = field(default_factory=dict)
    fills: list[dict] = field(default_factory=list)
    equity: list[dict] = field(default_factory=list)
    book: tuple | None = None
    due: dict[int, tuple[list[_Order], list[_Order]]] = field(default_factory=dict)  # ms -> cancels, activations
    levels: dict[str, dict[int, list[_Order]]] = field(default_factory=lambda: {"buy": {}, "sell": {}})
    quoted: dict[str, str] = field(default_factory=dict)
    made: int = 0
    placed: int = 0
    marks: bool = True  # whether equity is logged
    ids: set[str] | None = None  # every id ever placed, where closed orders are given out and dropped

    def __post_init__(self) -> None:
        c = self.config
        self.cash, self.inventory = c.initial_cash, c.initial_inventory
        self.entry = c.initial_entry_price if c.inverse and abs(self.inventory) > EPS else None

    def _level(self, price: float) -> int:
        return round(price / self.config.tick_size)

    # -- commands
    def place(self, order_id: str, side: str, price: float, quantity: float, ts: int, sequence: int, not_before: int = 0) -> None:
        if order_id in self.orders or (self.ids is not None and order_id in self.ids):
            raise ValueError(f"order {order_id} was placed before")
        if self.config.quantity_step and abs((u := quantity / self.config.quantity_step) - round(u)) > 1e-9:
            raise ValueError(f"{quantity} is no whole number of steps of {self.config.quantity_step}")
        o = _Order(order_id, side, decimal_tick(price, side, self.config.tick_size), quantity, ts, max(ts + self.config.placement_latency_ms, not_before), sequence)
        o.number, self.placed = self.placed, self.placed + 1
        self.orders[order_id] = o
        if self.ids is not None:
            self.ids.add(order_id)
        self.due.setdefault(o.activation_ms, ([], []))[1].append(o)

    def cancel(self, order_id: str, ts: int) -> int | None:
        o = self.orders.get(order_id)
        if o is None or o.done:
            return None
        if o.status != "cancel_pending":
            o.cancel_requested_ms, o.cancel_due_ms, o.status = ts, ts + self.config.cancel_latency_ms, "cancel_pending"
            self.due.setdefault(o.cancel_due_ms, ([], []))[0].append(o)
        return o.cancel_due_ms

    def quote(self, bid: float | None, ask: float | None, quantity: float, ts: int, sequence: int, quote_id: str) -> None:
        for side, price in (("buy", bid), ("sell", ask)):
            now = self.orders.get(self.quoted.get(side, ""))
            alive = now is not None and not now.done
            if price is None:
                if alive:
                    self.cancel(now.order_id, ts)
                self.quoted.pop(side, None)
                continue
            rounded = decimal_tick(price, side, self.config.tick_size)
            if alive and now.status != "cancel_pending" and self._level(now.price) == self._level(rounded) and abs(now.quantity - quantity) <= EPS:
                continue  # an identical quote keeps its place and age
            not_before = (self.cancel(now.order_id, ts) or ts) if alive else ts
            self.made += 1
            self.quoted[side] = f"{quote_id}:{side}:{self.made}"
            self.place(self.quoted[side], side, price, quantity, ts, sequence, not_before)

    # -- acknowledgements
    def settle_due(self, ts: int) -> None:
        cancels, starts = self.due.pop(ts, ([], []))
        for o in sorted(cancels, key=lambda o: (o.sequence, o.order_id)):
            if o.done:
                continue
            if o.live:
                own = self.levels[o.side].get(self._level(o.price), [])
                for x in own:
                    if x.priority > o.priority and x.queue is not None:
                        x.queue = max(0.0, x.queue - o.left)
                self._leave(o)
            o.status, o.closed_ms = "canceled", ts
        for o in sorted(starts, key=lambda o: (o.sequence, o.order_id)):
            if o.done or o.active_ms is not None:
                continue
            if self.book is None:
                o.status, o.reason, o.closed_ms = "rejected", "no book", ts
                continue
            bid, _, ask, _ = self.book
            if o.price >= ask - EPS if o.side == "buy" else o.price <= bid + EPS:
                o.status, o.reason, o.closed_ms = "rejected", "would cross", ts
                continue
            o.active_ms = ts
            o.queue = o.queue0 = self._queue(o)
            o.status = "cancel_pending" if o.status == "cancel_pending" else "active"
            self.levels[o.side].setdefault(self._level(o.price), []).append(o)

    def _leave(self, o: _Order) -> None:
        own = self.levels[o.side].get(self._level(o.price), [])
        if o in own:
            own.remove(o)
            if not own:
                del self.levels[o.side][self._level(o.price)]

    def _queue(self, o: _Order) -> float | None:
        """Ahead of an order: displayed size at the touch, nothing inside the spread, plus own earlier orders; unknown behind."""
        bid, bid_qty, ask, ask_qty = self.book
        touch, shown = (bid, bid_qty) if o.side == "buy" else (ask, ask_qty)
        if self._level(o.price) == self._level(touch):
            outside = shown
        elif bid < o.price < ask:
            outside = 0.0
        else:
            return None
        return outside + sum(x.left for x in self.levels[o.side].get(self._level(o.price), []) if x is not o and x.priority < o.priority)

    # -- market rows
    def on_book(self, ts: int, bid: float, bid_qty: float, ask: float, ask_qty: float) -> None:
        self.book = (bid, bid_qty, ask, ask_qty)
        for side, touch in (("buy", bid), ("sell", ask)):
            for o in self.levels[side].get(self._level(touch), []):
                if o.queue is None:
                    o.queue = self._queue(o)
                    o.queue0 = o.queue if o.queue0 is None else o.queue0
        self._mark(ts, "book")

    def on_trade(self, ts: int, price: float, quantity: float, aggressor: str) -> None:
        side = "buy" if aggressor == "sell" else "sell"
        at = self._level(price)
        beyond = sorted((k for k in self.levels[side] if (k > at if side == "buy" else k < at)))
        through = sorted((o for k in beyond for o in self.levels[side][k]), key=lambda o: (-o.price if side == "buy" else o.price, *o.priority))
        for o in through:
            self._fill(o, o.left, ts)
        for o in sorted(self.levels[side].get(at, []), key=lambda o: o.priority):
            if o.queue is None:
                continue
            ahead, o.queue = o.queue, max(0.0, o.queue - quantity)
            self._fill(o, min(o.left, max(0.0, quantity - ahead)), ts)

    def _fill(self, o: _Order, quantity: float, ts: int) -> None:
        if quantity <= EPS:
            return
        money = self._book_fill(o.side, quantity, o.price, self.config.maker_fee_rate)
        o.filled += quantity
        if o.left <= EPS:
            o.filled, o.status, o.closed_ms = o.quantity, "filled", ts
            self._leave(o)
        else:
            o.status = "cancel_pending" if o.cancel_requested_ms is not None else "partially_filled"
        self.fills.append({"ts_ms": ts, "order_id": o.order_id, "side": o.side, "price": o.price, "quantity": quantity, "liquidity": "maker", "quote_age_ms": max(0, ts - o.active_ms), **money})
        self._mark(ts, "maker_fill")

    def _book_fill(self, side: str, quantity: float, price: float, rate: float) -> dict:
        s, c, pnl = (1 if side == "buy" else -1), self.config, 0.0
        if not c.inverse:
            notional = settled = price * quantity
            fee = notional * rate
            self.cash -= s * notional + fee
            self.inventory += s * quantity
            self.inventory = 0.0 if abs(self.inventory) <= EPS else self.inventory
        else:
            notional = c.multiplier * quantity
            settled = notional / price
            fee = settled * rate
            old, d = self.inventory, s * quantity
            if old * d < 0:
                pnl = c.multiplier * min(abs(old), quantity) * math.copysign(1, old) * (1 / self.entry - 1 / price)
            new = 0.0 if abs(old + d) <= EPS else old + d
            if new == 0.0:
                self.entry = None
            elif abs(old) <= EPS or (old * d < 0 and quantity > abs(old) + EPS):
                self.entry = price
            elif old * d > 0:
                self.entry = (abs(old) + quantity) / (abs(old) / self.entry + quantity / price)
            self.inventory = new
            self.cash += pnl - fee
        return {"notional": notional, "settlement_notional": settled, "fee": fee, "realized_pnl": pnl, "cash_after": self.cash, "inventory_after": self.inventory, "average_entry": self.entry}

    def value(self, mark: float) -> float:
        if not self.config.inverse:
            return self.inventory * mark
        return 0.0 if abs(self.inventory) <= EPS else self.config.multiplier * self.inventory * (1 / self.entry - 1 / mark)

    def _mark(self, ts: int, reason: str) -> None:
        if self.marks and self.book is not None:
            mid = 0.5 * (self.book[0] + self.book[2])
            self.equity.append({"ts_ms": ts, "reason": reason, "mid": mid, "cash_after": self.cash, "inventory_after": self.inventory, "equity": self.cash + self.value(mid)})

    # -- the run
    def run(self, rows: list[dict]) -> None:
        """A whole history, sorted by (ts_ms, phase, sequence). Acknowledgements due after the last row never happen; their
        orders expire."""
        if rows:
            self.advance(rows)
            self.finish(rows[-1]["ts_ms"])

    def _cutoff(self) -> list[int]:
        """When quotes are to be withdrawn, until they are."""
        p = self.policy
        return [] if p is None or p.ended or p.start_ms is None else [p.start_ms + p.horizon_ms]

    def _idle(self) -> bool:
        """No order lives or waits and no policy quotes: market rows change nothing but the book."""
        return not self.due and not self.levels["buy"] and not self.levels["sell"] and (self.policy is None or self.policy.ended)

    def advance(self, rows: list[dict]) -> None:
        """Rows of kind book, trade, place, cancel or quote, whole milliseconds, and what falls due up to the last one."""
        end, i, n = rows[-1]["ts_ms"], 0, len(rows)
        while True:
            if self._idle():
                while i < n and (kind := rows[i]["kind"]) in ("book", "trade"):
                    if kind == "book":
                        r = rows[i]
                        self.book = (r["bid_price"], r["bid_qty"], r["ask_price"], r["ask_qty"])
                        if self.marks:
                            self._mark(r["ts_ms"], "book")
                    i += 1
            ts = rows[i]["ts_ms"] if i < n else None
            for t in (*self.due, *self._cutoff()):
                if t <= end and (ts is None or t < ts):
                    ts = t
            if ts is None:
                break
            booked, commands, last = False, [], 0
            while i < n and rows[i]["ts_ms"] == ts:
                r = rows[i]
                i += 1
                if r["kind"] == "book":
                    self.on_book(ts, r["bid_price"], r["bid_qty"], r["ask_price"], r["ask_qty"])
                    booked, last = True, r["sequence"]
                elif r["kind"] == "trade":
                    self.on_trade(ts, r["price"], r["quantity"], r["side"])
                else:
                    commands.append(r)
            self.settle_due(ts)
            if booked and self.policy is not None:
                got = self.policy.on_book(ts, self.book, self.inventory)
                if got is not None:
                    if len(got) != 2 or not all(x is None or (math.isfinite(x) and x > 0) for x in got):
                        raise ValueError(f"a policy gives a bid and an ask, each a positive price or None, not {got!r}")
                    self.quote(got[0], got[1], self.order_quantity, ts, last, f"q{ts}")
            if ts in self._cutoff():  # no book at the horizon
                self.policy.ended = True
                self.quote(None, None, self.order_quantity, ts, 2**63 - 1, f"q{ts}")
            for r in commands:
                if r["kind"] == "place":
                    self.place(r["order_id"], r["side"], r["price"], r["quantity"], ts, r["sequence"])
                elif r["kind"] == "cancel":
                    self.cancel(r["order_id"], ts)
                else:
                    self.quote(r["bid_price"], r["ask_price"], r["quantity"], ts, r["sequence"], r["order_id"])
            self.settle_due(ts)

    def finish(self, end: int) -> None:
        for o in self.orders.values():
            if not o.done:
                o.status, o.closed_ms = "expired", end
        if self.config.liquidate_at_end and abs(self.inventory) > EPS:
            if self.book is None:
                raise ValueError("cannot liquidate without a book")
            side, quantity = ("sell" if self.inventory > 0 else "buy"), abs(self.inventory)
            price = self.book[0] if side == "sell" else self.book[2]
            money = self._book_fill(side, quantity, price, self.config.taker_fee_rate)
            self.fills.append({"ts_ms": end, "order_id": "liquidation", "side": side, "price": price, "quantity": quantity, "liquidity": "taker", "quote_age_ms": 0, **money})
            self._mark(end, "liquidation")


#: One schema for all logs of a run; `log` says which: order, fill or equity.
LOGS = (
    "symbol string, log string, n long, ts_ms long, order_id string, side string, price double, quantity double, status string, reason string, requested_ms long, active_ms long, closed_ms long, filled double, "
    "queue0 double, liquidity string, quote_age_ms long, notional double, settlement_notional double, fee double, realized_pnl double, cash_after double, inventory_after double, average_entry double, mid double, equity double"
)
_NAMES = [x.split()[0] for x in LOGS.split(", ")]
#: Log rows that a run collects before it gives them out.
_TOLD = 1 << 14
_KINDS = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in LOGS.split(", ")]


def logs_of(key: str, run: Replay, counts: dict[str, int] | None = None, orders: list[_Order] | None = None) -> pa.Table:
    """The logs that a run holds, of its orders all or the given ones; fills and points of equity are numbered on from counts."""
    counts = {} if counts is None else counts
    own = [{"n": o.number, "ts_ms": o.requested_ms, **{f.name: getattr(o, f.name) for f in fields(o) if f.name in _NAMES}} for o in (run.orders.values() if orders is None else orders)]
    tables = []
    for log, rows in (("order", own), ("fill", run.fills), ("equity", run.equity)):
        if not rows:
            continue
        first, held = counts.get(log, 0), rows[0].keys()
        counts[log] = first + len(rows)
        given = {"symbol": [key] * len(rows), "log": [log] * len(rows), "n": range(first, first + len(rows))} | {x: [r[x] for r in rows] for x in held}
        tables.append(pa.table([pa.array(given[x], k) if x in given else pa.nulls(len(rows), k) for x, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES))
    return pa.concat_tables(tables) if tables else pa.schema(zip(_NAMES, _KINDS, strict=True)).empty_table()


def event_rows(books: DataFrame, trades: DataFrame, multiplier_units: float | None = None) -> DataFrame:
    """Feeds as one stream of replay rows. multiplier_units: trade sizes are in the base asset and become contracts,
    quantity * price / multiplier."""
    size = F.col("quantity") if multiplier_units is None else F.rint(F.col("quantity") * F.col("price") / multiplier_units)
    t = trades.select("symbol", "ts_ms", "sequence", F.lit("trade").alias("kind"), F.lit(0).alias("phase"), F.when(F.col("buyer_is_maker"), "sell").otherwise("buy").alias("side"), "price", size.alias("quantity"))
    b = books.select("symbol", "ts_ms", "sequence", F.lit("book").alias("kind"), F.lit(1).alias("phase"), "bid_price", "bid_qty", "ask_price", "ask_qty")
    out = t.unionByName(b, allowMissingColumns=True)
    # the two feeds number their rows apart: one sequence per millisecond, trades first
    return out.withColumn("sequence", (F.row_number().over(Window.partitionBy("symbol", "ts_ms").orderBy("phase", "sequence")) - 1).cast("long"))


#: What decides between rows of one millisecond and sequence: the kind, then these columns.
TIES = {
    "book": (0, "bid_price", "ask_price", "bid_qty", "ask_qty"), "trade": (1, "price", "quantity", "side"),
    "cancel": (0, "order_id"), "quote": (1, "order_id", "bid_price", "ask_price", "quantity"), "place": (2, "order_id", "side", "price", "quantity"),
}


def canonical(row: dict) -> tuple:
    """The order of replay: time, market rows before commands, sequence, kind, payload; the same for any order of input."""
    rank, *names = TIES[row["kind"]]
    return (row["ts_ms"], row["kind"] not in ("book", "trade"), row["sequence"], rank, *(-1.0 if row[x] is None or row[x] != row[x] else row[x] for x in names))


def event_fault(events: DataFrame, config: ReplayConfig) -> Column:
    """What is wrong with a row of events, null if nothing: kind, order, price, quantity, crossed, side, order_id or, for
    inverse contracts with a quantity_step, step (fractional contracts tell of a source in other units)."""
    col = {x: F.col(x) if x in events.columns else F.lit(None).cast(k) for x, k in (*((x, "string") for x in ("order_id", "side")), *((x, "double") for x in ("price", "quantity", "bid_price", "bid_qty", "ask_price", "ask_qty")))}
    kind = F.col("kind")

    def least(x: str, zero: bool = False) -> Column:
        c = col[x]
        return F.coalesce(~F.isnan(c) & (c < float("inf")) & ((c >= 0) if zero else (c > 0)), F.lit(False))

    def all_of(*names: str, zero: bool = False) -> Column:
        out = F.lit(True)
        for x in names:
            out = out & least(x, zero)
        return out

    sided = F.coalesce(col["side"].isin("buy", "sell"), F.lit(False))
    named = F.coalesce(F.length(col["order_id"]) > 0, F.lit(False))
    quoted = col["bid_price"].isNotNull() | col["ask_price"].isNotNull()
    fault = F.when(F.col("ts_ms").isNull() | F.col("sequence").isNull(), "order").when(kind.isNull() | ~kind.isin(*TIES), "kind")
    fault = fault.when(kind.isin("trade", "place") & ~least("price"), "price").when(kind.isin("trade", "place") & ~least("quantity"), "quantity").when(kind.isin("trade", "place") & ~sided, "side")
    fault = fault.when((kind == "book") & ~all_of("bid_price", "ask_price"), "price").when((kind == "book") & ~all_of("bid_qty", "ask_qty", zero=True), "quantity")
    fault = fault.when((kind == "book") & (col["bid_price"] >= col["ask_price"]), "crossed").when(kind.isin("place", "cancel", "quote") & ~named, "order_id")
    fault = fault.when((kind == "quote") & ((col["bid_price"].isNotNull() & ~least("bid_price")) | (col["ask_price"].isNotNull() & ~least("ask_price"))), "price").when((kind == "quote") & quoted & ~least("quantity"), "quantity")
    if config.inverse and config.quantity_step:
        whole = {x: F.coalesce(step_multiple(col[x], config.quantity_step), F.lit(True)) for x in ("quantity", "bid_qty", "ask_qty")}
        fault = fault.when(~(whole["quantity"] & whole["bid_qty"] & whole["ask_qty"]), "step")
    return fault


def checked(events: DataFrame, config: ReplayConfig, but: Column | None = None) -> DataFrame:
    """events; the first faulty row met raises, those of `but` aside."""
    fault = event_fault(events, config)
    where = F.concat_ws(" ", F.lit("bad replay event:"), fault, F.lit("at"), F.coalesce(F.col("ts_ms").cast("string"), F.lit("null")), F.coalesce("kind", F.lit("null")))
    return events.where(F.when(fault.isNull() | (F.lit(False) if but is None else but), True).otherwise(F.raise_error(where).cast("boolean")))


def fill_markouts(fills: DataFrame, books: DataFrame, horizons_ms: list[int], config: ReplayConfig) -> DataFrame:
    """(symbol, order_id, ts_ms, n, horizon_ms, observed_ms, mid, signed_pnl, signed_bps): each maker fill against the first book at or
    after fill + horizon; null where the feed ends before. Liquidations have none."""
    asked = fills.where("liquidity = 'maker'").select("symbol", "order_id", "side", "price", "ts_ms", "n", F.explode(F.array(*(F.lit(h).cast("long") for h in horizons_ms))).alias("horizon_ms"))
    asked = asked.withColumn("due_ms", F.col("ts_ms") + F.col("horizon_ms"))
    mids = books.select("symbol", "ts_ms", "sequence", F.col("ts_ms").alias("observed_ms"), (0.5 * (F.col("bid_price") + F.col("ask_price"))).alias("mid"))
    pnl, bps = accounting.markout(F.col("side"), F.col("price"), F.col("mid"), config.inverse, config.multiplier)
    seen = asof_forward(asked, mids, ["observed_ms", "mid"], at="due_ms")
    return seen.select("symbol", "order_id", "ts_ms", "n", "horizon_ms", "observed_ms", "mid", pnl.alias("signed_pnl"), bps.alias("signed_bps"))


#: A row of replay on its way to its run: a kind is 0 or 1 among market rows, 2 to 4 among commands; x holds the payload in its order.
_CODES = {"book": 0, "trade": 1, "cancel": 2, "quote": 3, "place": 4}
_PAYLOAD = {"book": ("bid_price", "ask_price", "bid_qty", "ask_qty"), "trade": ("price", "quantity"), "cancel": (), "quote": ("bid_price", "ask_price", "quantity"), "place": ("price", "quantity")}


def packed_rows(events: DataFrame) -> DataFrame:
    """(symbol, ts_ms, sequence, code, sell, order_id, x0 to x3), by symbol and, within it, in the order of `canonical`; sorted by
    Spark, so no history is held anywhere."""
    have = set(events.columns)
    kind, null = F.col("kind"), F.lit(None)
    x = []
    for i in range(4):
        c = null.cast("double")
        for k, names in _PAYLOAD.items():
            if i < len(names) and names[i] in have:
                c = F.when(kind == k, F.col(names[i]).cast("double")).otherwise(c)
        x.append(c.alias(f"x{i}"))
    code = null.cast("byte")
    for k, v in _CODES.items():
        code = F.when(kind == k, F.lit(v).cast("byte")).otherwise(code)
    sided = (F.col("side") == "sell") if "side" in have else null.cast("boolean")
    named = F.col("order_id").cast("string") if "order_id" in have else null.cast("string")
    command = ~kind.isin("book", "trade")
    rows = events.select(
        F.col("symbol").cast("string").alias("symbol"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("sequence").cast("long").alias("sequence"), code.alias("code"),
        F.when(kind.isin("trade", "place"), sided).alias("sell"), F.when(command, named).alias("order_id"), *x,
    )
    first = F.when(F.col("code") == _CODES["place"], F.col("sell"))
    return rows.repartition("symbol").sortWithinPartitions("symbol", "ts_ms", F.col("code") > 1, "sequence", "code", "order_id", first, "x0", "x1", "x2", "x3", "sell")


def _unpacked(ts: int, sequence: int, code: int, sell: bool | None, order_id: str | None, *x: float | None) -> dict:
    if code == 0:
        return {"kind": "book", "ts_ms": ts, "sequence": sequence, "bid_price": x[0], "ask_price": x[1], "bid_qty": x[2], "ask_qty": x[3]}
    side = "sell" if sell else "buy"
    if code == 1:
        return {"kind": "trade", "ts_ms": ts, "sequence": sequence, "price": x[0], "quantity": x[1], "side": side}
    row = {"ts_ms": ts, "sequence": sequence, "order_id": order_id}
    if code == 2:
        return {"kind": "cancel", **row}
    if code == 3:
        return {"kind": "quote", **row, "bid_price": x[0], "ask_price": x[1], "quantity": x[2]}
    return {"kind": "place", **row, "side": side, "price": x[0], "quantity": x[1]}


def replay(events: DataFrame, make: Callable[[], Replay], max_events: int | None = None, logs: tuple[str, ...] = ("order", "fill", "equity")) -> DataFrame:
    """The wanted logs of every symbol's run. events: symbol, ts_ms, sequence, kind and the kinds' columns. A run is one
    sequential history, hence one task, which reads it as a sorted stream: it holds a batch of rows, the open orders and the ids of
    those placed. Orders are given out once they are closed. Runs of different symbols are parallel. More than
    max_events rows of a symbol raise, and so does a faulty row."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, list[dict]]]:
        """(symbol, some rows that follow), a symbol's rows in their order."""
        for batch in batches:
            who, *cols = (c.to_pylist() for c in batch.columns)
            rows = list(map(_unpacked, *cols))
            a = 0
            while a < len(rows):
                b = len(rows) if who[-1] == who[a] else next(k for k in range(a, len(rows)) if who[k] != who[a])
                yield who[a], rows[a:b]
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pieces in groupby(steps(batches), lambda x: x[0]):
            r, counts, held, n, end = make(), {}, [], 0, None
            r.marks, r.ids = "equity" in logs, set()

            def told(at_end: bool = False) -> Iterator[pa.RecordBatch]:
                closed = [o for o in r.orders.values() if o.done]
                if at_end or len(closed) + len(r.fills) + len(r.equity) > _TOLD:
                    if "fill" not in logs:
                        r.fills.clear()
                    yield from logs_of(key, r, counts, closed if "order" in logs else []).to_batches()
                    r.fills, r.equity = [], []
                    for o in closed:
                        del r.orders[o.order_id]

            for _, rows in pieces:
                n, end = n + len(rows), rows[-1]["ts_ms"]
                if max_events is not None and n > max_events:
                    raise ValueError(f"{n} events or more; max_events is {max_events}")
                held += rows  # the last millisecond may go on in the next piece
                cut = len(held)
                while cut and held[cut - 1]["ts_ms"] == end:
                    cut -= 1
                if cut:
                    r.advance(held[:cut])
                    held = held[cut:]
                    yield from told()
            r.advance(held)
            r.finish(end)
            yield from told(True)

    return packed_rows(checked(events, make().config)).mapInArrow(run, LOGS)


def fixture_run(tick: float = 0.5) -> Callable[[], Replay]:
    def make() -> Replay:
        config = ReplayConfig(tick_size=tick, placement_latency_ms=60_000, cancel_latency_ms=60_000, maker_fee_rate=-0.0001, taker_fee_rate=0.0005)
        model = QuoteModel(A=1.0, k=1.5, gamma=0.1, sigma=0.05, max_inventory=5)
        return Replay(config, QuotePolicy(model, config, unit=3.0, order_quantity=3.0, horizon_ms=40 * 86_400_000, interval_ms=600_000), order_quantity=3.0)

    return make


def quote_segments(orders: DataFrame, fills: DataFrame, end_ms: int | None = None) -> DataFrame:
    """(symbol, order_id, side, price, start_ms, stop_ms): when each quote was live; it ends with its last fill if filled, else
    when it closed, else with the run."""
    last = fills.where("liquidity = 'maker'").groupBy("symbol", "order_id").agg(F.max("ts_ms").alias("last_fill"))
    stop = F.when(F.col("status") == "filled", F.col("last_fill")).otherwise(F.coalesce("closed_ms", F.lit(end_ms).cast("long")))
    return orders.where("active_ms is not null").join(last, ["symbol", "order_id"], "left").select("symbol", "order_id", "side", "price", F.col("active_ms").alias("start_ms"), stop.alias("stop_ms"))


def summary(logs: DataFrame) -> DataFrame:
    """One row per symbol: orders, fills, fees, maker quantity, largest inventory, drawdown from the running peak, net profit."""
    logs = kept(logs.select("symbol", "log", "n", "liquidity", "quantity", "fee", "inventory_after", "equity"), "logs")
    e = logs.where("log = 'equity'")
    fall = largest_fall(e, "equity", ["n"], ["symbol"], True, 1 << 17).withColumnRenamed("fall", "max_drawdown")
    eq = e.groupBy("symbol").agg(F.max(F.abs("inventory_after")).alias("max_abs_inventory"), (F.max_by("equity", "n") - F.min_by("equity", "n")).alias("net_pnl"))
    rest = logs.where("log <> 'equity'").groupBy("symbol").agg(
        F.sum((F.col("log") == "order").cast("long")).alias("n_orders"), F.sum((F.col("log") == "fill").cast("long")).alias("n_fills"), F.sum("fee").alias("fees"), F.sum(F.when((F.col("log") == "fill") & (F.col("liquidity") == "maker"), F.col("quantity"))).alias("maker_quantity")
    )
    return rest.join(fall.join(eq, "symbol"), "symbol", "full").select("symbol", "n_orders", "n_fills", "fees", "maker_quantity", "max_drawdown", "max_abs_inventory", "net_pnl")
