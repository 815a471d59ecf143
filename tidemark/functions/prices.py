"""Price and inventory arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tick_round(price: Column, tick: str, side: Column) -> Column:
    """Exact decimal rounding to a tick, down for buys, up for sells; a result of zero or less raises. The double goes through
    its shortest text, so 100.09 at a tick of 0.1 is 1000 ticks and 0.9, not a float's neighbour."""
    units = price.cast("string").cast("decimal(28,12)") / F.lit(tick).cast("decimal(10,8)")
    whole = F.when(side == "buy", F.floor(units)).otherwise(F.ceil(units)).cast("decimal(20,0)")
    out = (whole * F.lit(tick).cast("decimal(10,8)")).cast("double")
    return F.when(out <= 0, F.raise_error(F.lit("price rounds to zero or less")).cast("double")).otherwise(out)


def grid_inventory(inventory: Column, unit: float, bound: int) -> Column:
    """Inventory in units, half away from zero, clipped to the grid -bound..bound."""
    u = inventory / unit
    return F.greatest(F.least(F.signum(u) * F.floor(F.abs(u) + 0.5), F.lit(float(bound))), F.lit(float(-bound))).cast("int")


def post_only(price: Column, side: Column, bid: Column, ask: Column, tick: float) -> Column:
    """A quote held off the other side of the book by a tick."""
    return F.when(side == "buy", F.least(price, ask - tick)).otherwise(F.greatest(price, bid + tick))


def quote_asset(symbol: Column) -> Column:
    """The quote asset by a symbol's suffix (before '_'); null when none of the known ones fits."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(F.upper(symbol), "_"), 1), "(USDT|USDC|BUSD|FDUSD|USD|BTC|ETH)$", 1), F.lit(""))
