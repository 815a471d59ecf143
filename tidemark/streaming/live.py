"""The stateful operators over streams. Late rows never change what was given out: they go to a log of their own."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.replay import LOGS, Replay, canonical, checked, logs_of


def stream_counts(trades: DataFrame, lateness: str = "10 seconds", width: str = "100 milliseconds") -> DataFrame:
    """Epoch-aligned tumbling trade counts under a watermark; empty windows give no row (count them by time, as in batch)."""
    t = trades.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", lateness)
    return t.groupBy(F.window("at", width), "symbol").agg(F.count("*").alias("c")).select("symbol", F.unix_millis("window.start").alias("bin_ms"), "c")


def stream_replay(events: DataFrame, make: Callable[[], Replay]) -> DataFrame:
    """Replay logs as they arise, keyed by symbol. Rows of a batch are put in order; those of its last millisecond wait in state
    for the next batch, as more of that millisecond may come. A row older than what was processed is logged as 'late'
    and changes nothing. Fills and equity points come as they happen; orders once, when they are terminal. A row of kind
    'end' closes a symbol's run: what waits is processed, open orders expire and the position is liquidated, as
    at the end of a batch run; later rows are late. A faulty row raises."""
    columns = [x.split()[0] for x in LOGS.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, held, seen, told = pickle.loads(state.get[0]) if state.exists else (make(), [], None, {})
        fresh = [r for b in batches for r in b.to_dict("records")]
        ended = any(r["kind"] == "end" for r in fresh)
        rows = held + [r for r in fresh if r["kind"] != "end"]
        late = [r for r in rows if seen is not None and r["ts_ms"] <= seen]
        rows = sorted((r for r in rows if seen is None or r["ts_ms"] > seen), key=canonical)
        held = [r for r in rows if r["ts_ms"] == rows[-1]["ts_ms"]] if rows and not ended else []
        ready = rows[: len(rows) - len(held)]
        if ready:
            run.advance(ready)
            seen = ready[-1]["ts_ms"]
        if ended and seen is not None:
            run.finish(seen)
            seen = 2**63 - 1
        table = logs_of(key[0], run).to_pandas()
        closed = [o.order_id for o in run.orders.values() if o.done]
        out = table[(table["log"] != "order") | table["order_id"].isin(closed)]
        out = out.assign(n=out.groupby("log").cumcount() + out["log"].map(told).fillna(0).astype("int64"))  # numbers go on
        told = {k: told.get(k, 0) + int((out["log"] == k).sum()) for k in ("order", "fill", "equity")}
        run.fills, run.equity = [], []
        for k in closed:  # told once, then gone: the state holds open orders only
            del run.orders[k]
        state.update((pickle.dumps((run, held, seen, told)),))
        if late:
            out = pd.concat([out, pd.DataFrame([{"symbol": key[0], "log": "late", "n": k, "ts_ms": r["ts_ms"]} for k, r in enumerate(late)])])
        yield out.reindex(columns=columns)

    end = F.coalesce(F.col("kind") == "end", F.lit(False))
    return checked(events, make().config, but=end).groupBy("symbol").applyInPandasWithState(step, LOGS, "run binary", "append", GroupStateTimeout.NoTimeout)
