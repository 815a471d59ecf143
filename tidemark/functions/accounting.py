"""Linear and inverse contract accounting over ordered fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import CHUNK, affine_scan, in_chunks, running_total
from tidemark.sources.folders import kept


def sign(side: Column) -> Column:
    return F.when(side == "buy", 1.0).otherwise(-1.0)


def linear(fills: DataFrame, key: list[str], order: list[str], fee_rate: float = 0.0, cash: float = 0.0, inventory: float = 0.0) -> DataFrame:
    """fills with notional, fee, cash_after, inventory_after as running totals."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = sign(F.col("side"))
    f = fills.withColumns({"notional": F.col("price") * F.col("quantity"), "fee": F.col("price") * F.col("quantity") * fee_rate})
    return f.withColumns({"cash_after": cash - F.sum(s * F.col("notional") + F.col("fee")).over(w), "inventory_after": inventory + F.sum(s * F.col("quantity")).over(w)})


def inverse(fills: DataFrame, key: list[str], order: list[str], multiplier: float = 1.0, fee_rate: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """One row per fill with inventory_after, average_entry (null when flat), realized_pnl, fee and cash_after in the base asset.
    Average entry is harmonic while a position grows; a fill through zero closes at the old entry and opens at its price.

    The position is a running sum, exact in decimals of 12 places. With it known, w = |position| / entry follows w' = a w + b: a
    growing fill adds quantity / price, a shrinking one scales w, flat and flip start it anew. So histories are scanned in
    chunks of rows, and a key's fills are many tasks' work. order[0] is a number; ties of the order go by price, quantity, side."""
    used = fills.select(*key, *(c for c in order if c not in key), *(F.col(c).cast("double").alias(c) for c in ("price", "quantity")), sign(F.col("side")).alias("__s"))
    rows = kept(in_chunks(used, key, [*dict.fromkeys([*order, "price", "quantity", "__s"])], chunk), "fills")
    step = (F.col("__s") * F.col("quantity")).cast("decimal(26,12)")
    rows = running_total(rows, step, "__q").withColumns({"__old": (F.col("__q") - step).cast("double"), "__new": F.col("__q").cast("double")})
    old, new, p, n = F.col("__old"), F.col("__new"), F.col("price"), F.col("quantity")
    opens = (old == 0) | (old * new < 0)
    grows = old * F.col("__s") > 0
    a = F.when(opens | (new == 0), 0.0).when(grows, 1.0).otherwise(F.abs(new) / F.abs(old))
    b = F.when(new == 0, 0.0).when(opens, F.abs(new) / p).when(grows, n / p).otherwise(0.0)
    held = affine_scan(rows, {"__w": (a, b)})
    closes = old * F.col("__s") < 0
    pnl = F.when(closes, multiplier * F.least(F.abs(old), n) * F.signum(old) * (F.col("__w_before") / F.abs(old) - 1.0 / p)).otherwise(0.0)
    out = held.withColumns({"inventory_after": new, "average_entry": F.when(new != 0, F.abs(new) / F.col("__w")), "realized_pnl": pnl, "fee": multiplier * n / p * fee_rate})
    out = running_total(out, F.col("realized_pnl") - F.col("fee"), "cash_after")
    return out.select(*(c for c in used.columns if c != "__s"), "inventory_after", "average_entry", "realized_pnl", "fee", "cash_after")


def position_value(inventory: Column, average_entry: Column, mark: Column, inverse_contract: bool, multiplier: float = 1.0) -> Column:
    if not inverse_contract:
        return inventory * mark
    return F.when(F.abs(inventory) <= 1e-12, 0.0).otherwise(multiplier * inventory * (1.0 / average_entry - 1.0 / mark))


def markout(side: Column, price: Column, mid: Column, inverse_contract: bool = False, multiplier: float = 1.0) -> tuple[Column, Column]:
    """(signed profit a unit, signed basis points) of a fill against a later mid; null where there is none."""
    if inverse_contract:
        pnl = multiplier * sign(side) * (1.0 / price - 1.0 / mid)
        return pnl, 10_000.0 * pnl / (multiplier / price)
    pnl = sign(side) * (mid - price)
    return pnl, 10_000.0 * pnl / price
