"""The registered queries over the fixture feeds, and the SQL that gives the same rows.

Floats are rounded on both sides, since sums may be taken in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import accounting as acc
from tidemark.functions import prices as px
from tidemark.functions import quotes as gq
from tidemark.operators import arrivals as arr
from tidemark.operators import asof
from tidemark.operators import bookstate as bs
from tidemark.operators import diagnostics as dg
from tidemark.operators import episodes as ep
from tidemark.operators import hazard as hz
from tidemark.operators import replay as rp
from tidemark.operators import walkforward as wf
from tidemark.sources import feeds
from tidemark.sources.folders import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "episode_bins"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c: str | Column, n: int = 8) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, n)
    return out.alias(c) if isinstance(c, str) else out


def rounded(df: DataFrame, n: int = 8) -> DataFrame:
    return df.select(*(_r(c, n) if k == "double" else F.col(c) for c, k in df.dtypes))


# --- shared SQL -------------------------------------------------------------------------------------------------------

EV = """ev as (select 'S' as symbol, epoch_us(ts)//1000 as ts_ms, event_id as sequence, user_id, event_type, value, 1000 + (event_id//20) % 10 as n from events),
bk as (select symbol, ts_ms, sequence, (n + sequence % 3) * 0.5::double as bid_price, (1 + user_id % 5)::double as bid_qty, (n + 1 + sequence % 3 + sequence % 2) * 0.5::double as ask_price, (1 + sequence % 4)::double as ask_qty
  from ev where event_type in ('click','view','signup')),
tr as (select symbol, ts_ms, sequence, (n + sequence % 5) * 0.5::double as price, (1 + floor(value)::bigint % 10)::double as quantity, event_type = 'error' as buyer_is_maker from ev where event_type in ('purchase','error'))"""
W = f"with {EV} "
MONTHLY = """mo as (select date_trunc('month', l_shipdate)::date as month, epoch_us(l_shipdate)//1000 as ts_ms, l_orderkey as k1, l_linenumber as k2, case when l_linestatus = 'O' then 'bid' else 'ask' end as side,
  (l_returnflag = 'R')::bigint as count, 1 + l_tax as exposure, l_discount as distance, (1.0 + l_linenumber % 3)::double as spread, (l_quantity - 25.5) / 24.5 as imbalance, l_quantity as queue_ahead, l_extendedprice / 1000 as value from lineitem)"""
M = f"with {MONTHLY} "
OFI = """pv as (select *, lag(ts_ms) over w as pt, lag(bid_price) over w as pb, lag(bid_qty) over w as pbq, lag(ask_price) over w as pa, lag(ask_qty) over w as paq from bk window w as (order by ts_ms, sequence)),
fs as (select *, case when pt is not null then 2 * (case when bid_price >= pb then bid_qty else 0 end - case when bid_price <= pb then pbq else 0 end - case when ask_price <= pa then ask_qty else 0 end + case when ask_price >= pa then paq else 0 end)
    / (bid_qty + ask_qty + pbq + paq) end as ofi_step,
  case when pt is not null then ((bid_price + ask_price) / 2 - (pb + pa) / 2) / ((pb + pa) / 2) * 10000 / sqrt(greatest((ts_ms - pt) / 1000.0::double, 0.001)) end as move, row_number() over (order by ts_ms, sequence) as rn from pv)"""
# an exponential average as a weighted sum of the last 1,200 steps: what lies before weighs less than 1e-26
STATE = f"""{OFI},
st as (select a.symbol, a.ts_ms, a.sequence, a.bid_price, a.bid_qty, a.ask_price, a.ask_qty, sum(0.05 * pow(0.95::double, (a.rn - b.rn)::double) * coalesce(b.ofi_step, 0)) as ofi,
  sqrt(sum(0.05 * pow(0.95::double, (a.rn - b.rn)::double) * coalesce(b.move * b.move, 0))) as volatility from fs a join fs b on b.rn between a.rn - 1200 and a.rn group by all)"""

# episode steps under the fixture configuration
LAST = "lm as (select greatest((select max(ts_ms) from bk), (select max(ts_ms) from tr)) as last_ms, (select min(ts_ms) from bk) as t0)"
GRID = f"""{LAST},
gr as (select 'S' as symbol, g.i as decision, t0 + g.i * 3600000 as decision_ms, last_ms from lm, lateral (select unnest(generate_series(0, (last_ms - t0)//3600000)) as i) g)"""
EOM = "bm as (select ts_ms, arg_max(bid_price, sequence) as bid_price, arg_max(bid_qty, sequence) as bid_qty, arg_max(ask_price, sequence) as ask_price, arg_max(ask_qty, sequence) as ask_qty from bk group by ts_ms)"
ORDERS = f"""{GRID}, {EOM},
fan(k, ticks, side) as (values (0,0,'bid'),(1,0,'ask'),(2,1,'bid'),(3,1,'ask'),(4,2,'bid'),(5,2,'ask')),
od as (select g.symbol, g.decision * 6 + f.k as episode_id, f.side, f.ticks::bigint as distance_ticks,
  case when f.side = 'bid' then floor((b.bid_price - f.ticks * 0.5) / 0.5 + 1e-10) * 0.5 else ceil((b.ask_price + f.ticks * 0.5) / 0.5 - 1e-10) * 0.5 end as quote_price, g.decision_ms, g.decision_ms + 60000 as activated_ms, g.last_ms
  from gr g asof join bm b on g.decision_ms >= b.ts_ms, fan f)"""
ACTIVE = f"""{ORDERS},
ac as (select o.*, o.activated_ms + 1800000 as expires_ms, case when side = 'bid' and abs(quote_price - b.bid_price) <= 5e-7 then b.bid_qty when side = 'ask' and abs(quote_price - b.ask_price) <= 5e-7 then b.ask_qty else 0.0::double end as queue0,
  (b.bid_price + b.ask_price) / 2 as mid0 from (select * from od where activated_ms <= last_ms) o asof join bm b on o.activated_ms >= b.ts_ms
  where case when side = 'bid' then quote_price < b.ask_price - 5e-7 else quote_price > b.bid_price + 5e-7 end)"""
DEPLETED = f"""{ACTIVE},
dp as (select a.*, t.ts_ms, t.sequence, t.price, t.quantity, case when a.side = 'bid' then t.price < a.quote_price - 5e-7 else t.price > a.quote_price + 5e-7 end as through,
  sum(t.quantity) over (partition by a.episode_id order by t.ts_ms, t.sequence rows unbounded preceding) as taken from ac a join tr t on t.ts_ms > a.activated_ms and t.ts_ms <= a.expires_ms
  and case when a.side = 'bid' then t.buyer_is_maker and t.price <= a.quote_price + 5e-7 else not t.buyer_is_maker and t.price >= a.quote_price - 5e-7 end)"""
ENDED = f"""{DEPLETED},
fl as (select episode_id, arg_min(ts_ms, (ts_ms, sequence)) as ft, arg_min(case when through then 3.0::double else least(3.0::double, taken - queue0) end, (ts_ms, sequence)) as fq from dp where through or taken > queue0 group by 1),
ad as (select a.episode_id, min(b.ts_ms) as adv from ac a join bm b on b.ts_ms > a.activated_ms and b.ts_ms <= a.expires_ms and case when a.side = 'bid' then (b.bid_price + b.ask_price) / 2 <= a.mid0 - 1.0 else (b.bid_price + b.ask_price) / 2 >= a.mid0 + 1.0 end group by 1),
en0 as (select a.*, fl.ft, fl.fq, ad.adv, case when expires_ms <= last_ms then expires_ms end as ct from ac a left join fl using (episode_id) left join ad using (episode_id)),
en as (select * exclude (ft, fq, adv, ct), least(coalesce(ft, last_ms), coalesce(adv, last_ms), coalesce(ct, last_ms), last_ms) as end_ms, ft, fq, adv, ct from en0),
et as (select *, case when ft = end_ms then 'fill' when adv = end_ms then 'adverse_move' when ct = end_ms then 'cancel' else 'none' end as risk, case when ft = end_ms then fq else 0.0::double end as filled_quantity from en)"""
BINS = f"""{STATE}, {ENDED},
sm as (select ts_ms, arg_max(ofi, sequence) as ofi, arg_max(volatility, sequence) as volatility from st group by 1),
cu as (select e.*, s.start_ms, least(s.start_ms + 600000, e.end_ms) as stop_ms from et e, lateral (select unnest(generate_series(e.activated_ms, e.end_ms - 1, 600000)) as start_ms) s where e.end_ms > e.activated_ms),
qu as (select c.episode_id, c.start_ms, coalesce(sum(d.quantity), 0) as taken from cu c left join dp d on d.episode_id = c.episode_id and d.ts_ms <= c.start_ms group by 1, 2),
c2 as (select cu.*, qu.taken from cu join qu using (episode_id, start_ms)),
c3 as (select c2.*, b.bid_price, b.bid_qty, b.ask_price, b.ask_qty from c2 asof join bm b on c2.start_ms >= b.ts_ms),
c4 as (select c3.*, s.ofi, s.volatility from c3 asof join sm s on c3.start_ms >= s.ts_ms)"""


# --- sources and projections ------------------------------------------------------------------------------------------


@query(W + "select kind, phase::int as phase, ts_ms, sequence, ms_seq from (select *, row_number() over (partition by ts_ms order by phase, sequence) - 1 as ms_seq from (select 'trade' as kind, 0 as phase, ts_ms, sequence from tr union all select 'book', 1, ts_ms, sequence from bk))")
def merged_stream(spark: SparkSession, d: str) -> DataFrame:
    return asof.within_ms(asof.merged_stream(feeds.books(spark, d), feeds.trades(spark, d))).select("kind", "phase", "ts_ms", "sequence", "ms_seq")


@query(W + "select sequence, (bid_price + ask_price) / 2 as mid, ask_price - bid_price as spread, round((bid_qty - ask_qty) / (bid_qty + ask_qty), 8) as imbalance from bk")
def book_derived(spark: SparkSession, d: str) -> DataFrame:
    return bs.derived(feeds.books(spark, d)).select("sequence", "mid", "spread", _r("imbalance"))


@query(W + "select 'book' as feed, count(*) as n, sum((not (bid_price > 0 and ask_price > bid_price and bid_qty >= 0 and ask_qty >= 0))::int)::bigint as faults, sum((bid_qty % 2 <> 0)::int)::bigint as off_step from bk union all select 'trade', count(*), sum((not (price > 0 and quantity > 0))::int)::bigint, sum((quantity % 2 <> 0)::int)::bigint from tr")
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    b, t = feeds.book_faults(feeds.books(spark, d)), feeds.trade_faults(feeds.trades(spark, d))
    count = lambda df, name, q: df.agg(F.lit(name).alias("feed"), F.count("*").alias("n"), F.sum(F.col("fault").isNotNull().cast("long")).alias("faults"), F.sum((~feeds.step_multiple(F.col(q), 2.0)).cast("long")).alias("off_step"))
    return count(b, "book", "bid_qty").unionByName(count(t, "trade", "quantity"))


@query(W + "select 'book' as feed, count(*) as violations from (select ts_ms, lag(ts_ms) over (order by sequence) as p from bk) where p > ts_ms union all select 'trade', count(*) from (select ts_ms, lag(ts_ms) over (order by sequence) as p from tr) where p > ts_ms")
def sortedness(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df, name: feeds.order_violations(df, "sequence").agg(F.lit(name).alias("feed"), F.count("*").alias("violations"))
    return count(feeds.books(spark, d), "book").unionByName(count(feeds.trades(spark, d), "trade"))


@query(W + "select sequence, ts_ms, case when buyer_is_maker then 'sell' else 'buy' end as aggressor from tr where ts_ms >= 1704672000000 and ts_ms < 1705276800000 order by ts_ms, sequence limit 500")
def windowed_trades(spark: SparkSession, d: str) -> DataFrame:
    t = feeds.in_window(feeds.trades(spark, d), 1_704_672_000_000, 1_705_276_800_000)
    return feeds.first_rows(t, 500).select("sequence", "ts_ms", feeds.aggressor_side(F.col("buyer_is_maker")).alias("aggressor"))


@query(W + "select sequence, case when sequence % 2 = 0 then 'bid' else 'ask' end as side from tr")
def side_aliases(spark: SparkSession, d: str) -> DataFrame:
    alias = F.element_at(F.array(*map(F.lit, ("BID", "sell", " b ", "A", "0", "1"))), (F.col("sequence") % 6 + 1).cast("int"))
    return feeds.trades(spark, d).select("sequence", feeds.normalise_side(alias).alias("side"))


@query(W + "select s.sequence, s.symbol, case when s.symbol like '%USDT%' then 'USDT' when s.symbol like '%BTC' then 'BTC' else 'USD' end as asset from (select sequence, case sequence % 3 when 0 then 'ethusdt' when 1 then 'BTCUSD_PERP' else 'ETHBTC' end as symbol from tr) s")
def quote_assets(spark: SparkSession, d: str) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, ("ethusdt", "BTCUSD_PERP", "ETHBTC"))), (F.col("sequence") % 3 + 1).cast("int"))
    # the first is lower case in both, so upper-casing decides the asset
    return feeds.trades(spark, d).select("sequence", s.alias("symbol"), px.quote_asset(s).alias("asset"))


ORACLE_SQL["quote_assets"] = ORACLE_SQL["quote_assets"].replace("s.symbol like '%USDT%'", "upper(s.symbol) like '%USDT%'")

# --- arrivals ---------------------------------------------------------------------------------------------------------


@query(W + "select symbol, count(d) as delta_count, round(avg(d), 8) as mean_ms, median(d)::double as median_ms, round(stddev_pop(d) / avg(d), 8) as cv from (select symbol, ts_ms - lag(ts_ms) over (order by ts_ms, sequence) as d from tr) group by symbol")
def arrival_interarrival(spark: SparkSession, d: str) -> DataFrame:
    x = arr.interarrival(feeds.trades(spark, d))
    return x.select("symbol", "delta_count", _r("mean_ms"), F.col("median_ms").cast("double").alias("median_ms"), _r("cv"))


BIN = "bc as (select symbol, ts_ms//100 as bin, count(*) as c from tr group by 1, 2), bd as (select min(bin) as f, max(bin) as l from bc)"


@query(W + f", {BIN} select symbol, sum(c)::bigint as events, (any_value(l) - any_value(f) + 1)::bigint as bins, round((sum(c*c)::double / any_value(l-f+1) - pow(sum(c)::double / any_value(l-f+1), 2)) / (sum(c)::double / any_value(l-f+1)), 8) as fano from bc, bd group by symbol")
def arrival_fano(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arr.count_fano(feeds.trades(spark, d)))


@query(W + f""", {BIN}, mm as (select symbol, bin//600 as minute, sum(c)::bigint as events, sum(c*c)::double as sq from bc group by 1, 2),
mb as (select *, least(l, (minute + 1) * 600 - 1) - greatest(f, minute * 600) + 1 as bins from mm, bd)
select symbol, minute, events, bins::bigint as bins, round((sq / bins - pow(events::double / bins, 2)) / (events::double / bins), 8) as fano from mb""")
def arrival_minute_fano(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arr.minute_fano(feeds.trades(spark, d)))


# --- as-of, book state ------------------------------------------------------------------------------------------------


@query(W + f", {EOM} select t.sequence, t.ts_ms, b.bid_price, b.ask_price from tr t asof left join bm b on t.ts_ms >= b.ts_ms")
def asof_book_at_trade(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof_backward(feeds.trades(spark, d), bs.end_of_ms(feeds.books(spark, d)), ["bid_price", "ask_price"]).select("sequence", "ts_ms", "bid_price", "ask_price")


FWD = """fb as (select ts_ms, arg_min((bid_price + ask_price) / 2, sequence) as mid from bk group by ts_ms),
mk as (select t.sequence, h.h as horizon_ms, case when t.buyer_is_maker then 'buy' else 'sell' end as side, t.price, b.mid from (select *, unnest([0, 600000, 3600000]) as h from tr) h join tr t using (sequence) asof left join fb b on t.ts_ms + h.h <= b.ts_ms),
mo2 as (select sequence, horizon_ms::bigint as horizon_ms, mid, case when side = 'buy' then mid - price else price - mid end as pnl, 10000 * case when side = 'buy' then mid - price else price - mid end / price as bps from mk)"""


def _markouts(spark: SparkSession, d: str) -> DataFrame:
    t = feeds.trades(spark, d).withColumn("horizon_ms", F.explode(F.array(*(F.lit(h).cast("long") for h in (0, 600_000, 3_600_000))))).withColumn("at_ms", F.col("ts_ms") + F.col("horizon_ms"))
    out = asof.asof_forward(t, bs.derived(feeds.books(spark, d)), ["mid"], "at_ms")
    pnl, bps = acc.markout(F.when(F.col("buyer_is_maker"), "buy").otherwise("sell"), F.col("price"), F.col("mid"))
    return out.select("sequence", "horizon_ms", "mid", pnl.alias("pnl"), bps.alias("bps"))


@query(W + f", {FWD} select sequence, horizon_ms, mid, round(pnl, 8) as pnl, round(bps, 8) as bps from mo2")
def markout_forward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_markouts(spark, d))


@query(W + f", {FWD} select horizon_ms, count(bps) as n, round(avg(bps), 7) as mean_markout, round(median(bps), 7) as median_markout, round(avg((bps < 0)::int), 7) as adverse_fraction, round(quantile_cont(bps, 0.05), 7) as markout_tail from mo2 where bps is not null group by 1")
def markout_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dg.markout_stats(_markouts(spark, d), "bps", ["horizon_ms"]), 7)


@query(W + f", {OFI} select sequence, round(ofi_step, 8) as ofi_step from fs")
def ofi_steps(spark: SparkSession, d: str) -> DataFrame:
    return bs.flow_steps(feeds.books(spark, d)).select("sequence", _r("ofi_step"))


@query(W + f", {OFI} select sequence, round(move, 7) as move from fs")
def mid_moves(spark: SparkSession, d: str) -> DataFrame:
    return bs.flow_steps(feeds.books(spark, d)).select("sequence", _r("move", 7))


@query(W + f", {STATE} select sequence, round(ofi, 7) as ofi, round(volatility, 7) as volatility from st")
def ewma_state(spark: SparkSession, d: str) -> DataFrame:
    return bs.ewma_state(feeds.books(spark, d)).select("sequence", _r("ofi", 7), _r("volatility", 7))


# --- episodes ---------------------------------------------------------------------------------------------------------


def _episode_steps(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    b, t, c = feeds.books(spark, d), feeds.trades(spark, d), ep.FIXTURE
    state = bs.end_of_ms(b).withColumns({"ofi": F.lit(0.0), "volatility": F.lit(0.0)})
    placed = ep.orders(ep.decision_grid(b, t, c), state, c)
    return t, state, placed, ep.activations(placed, state, c)


def _ended(spark: SparkSession, d: str) -> DataFrame:
    t, state, _, active = _episode_steps(spark, d)
    return ep.terminals(kept(active, "active"), t, kept(ep.level_volume(t, ep.FIXTURE), "volume"), kept(state, "state"), ep.FIXTURE)


@query(W + f", {GRID} select decision, decision_ms from gr")
def decision_grid(spark: SparkSession, d: str) -> DataFrame:
    return ep.decision_grid(feeds.books(spark, d), feeds.trades(spark, d), ep.FIXTURE).select("decision", "decision_ms")


@query(W + f", {ORDERS} select episode_id, side, distance_ticks, quote_price, activated_ms from od")
def episode_orders(spark: SparkSession, d: str) -> DataFrame:
    return _episode_steps(spark, d)[2].select("episode_id", "side", "distance_ticks", "quote_price", "activated_ms")


@query(W + f", {ACTIVE} select episode_id, queue0, mid0, expires_ms from ac")
def episode_activation(spark: SparkSession, d: str) -> DataFrame:
    return _episode_steps(spark, d)[3].select("episode_id", "queue0", "mid0", "expires_ms")


@query(W + f", {DEPLETED} select episode_id, sequence, through, taken from dp")
def episode_queue_depletion(spark: SparkSession, d: str) -> DataFrame:
    t, _, _, active = _episode_steps(spark, d)
    return ep.depletion(active, t, ep.FIXTURE).select("episode_id", "sequence", "through", "taken")


@query(W + f", {ENDED} select episode_id, end_ms, risk, filled_quantity from et")
def episode_terminal(spark: SparkSession, d: str) -> DataFrame:
    return _ended(spark, d).select("episode_id", "end_ms", "risk", "filled_quantity")


BIN_ROWS = W + f""", {BINS} select episode_id, start_ms as start_timestamp, stop_ms as end_timestamp, side, greatest(case when side = 'bid' then bid_price - quote_price else quote_price - ask_price end / 0.5, 0.0)::double as distance,
  (ask_price - bid_price) / 0.5 as spread, round((bid_qty - ask_qty) / (bid_qty + ask_qty), 8) as imbalance, round(ofi, 7) as ofi, round(volatility, 7) as volatility, greatest(queue0 - taken, 0.0)::double as queue_ahead,
  ((start_ms - activated_ms) / 1000.0::double) as order_age, ((start_ms//1000) % 86400)::double as time_of_day, (stop_ms - start_ms) / 1000.0::double as exposure, (stop_ms = end_ms and risk = 'fill')::bigint as count,
  case when stop_ms = end_ms then risk else 'none' end as risk, quote_price, distance_ticks as requested_distance_ticks, case when stop_ms = end_ms then filled_quantity else 0.0::double end as filled_quantity from c4"""


def bin_rows(intervals: DataFrame) -> DataFrame:
    return intervals.drop("symbol", "queue_is_approximate").withColumns({"imbalance": _r("imbalance"), "ofi": _r("ofi", 7), "volatility": _r("volatility", 7)})


@query(BIN_ROWS)
def episode_bins(spark: SparkSession, d: str) -> DataFrame:
    return bin_rows(ep.build_intervals(feeds.books(spark, d), feeds.trades(spark, d), ep.FIXTURE))


@query(W + f", {ENDED} select side, risk, count(*) as episodes, round(sum((end_ms - activated_ms) / 1000.0::double), 6) as exposure, round(count(*) / sum((end_ms - activated_ms) / 1000.0::double), 10) as rate from et where end_ms > activated_ms group by 1, 2")
def risk_rates_by_side(spark: SparkSession, d: str) -> DataFrame:
    e = _ended(spark, d).where("end_ms > activated_ms").groupBy("side", "risk").agg(F.count("*").alias("episodes"), F.sum((F.col("end_ms") - F.col("activated_ms")) / 1000.0).alias("e"))
    return e.select("side", "risk", "episodes", F.round("e", 6).alias("exposure"), F.round(F.col("episodes") / F.col("e"), 10).alias("rate"))


@query("select event_id, case when f is null and a is null and c is null then 'none' when f = least(f, a, c) then 'fill' when a = least(f, a, c) then 'adverse_move' else 'cancel' end as label from (select event_id, case when event_id % 3 = 0 then event_id % 7 + 0.1 end as f, case when event_id % 5 < 2 then event_id % 11 + 0.2 end as a, case when event_id % 2 = 0 then event_id % 13 + 0.3 end as c from events)")
def competing_risk(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    f, a, c = F.when(i % 3 == 0, i % 7 + 0.1), F.when(i % 5 < 2, i % 11 + 0.2), F.when(i % 2 == 0, i % 13 + 0.3)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", hz.competing_risk(f, a, c).alias("label"))


# --- hazard -----------------------------------------------------------------------------------------------------------

SMALL = ("distance", "spread", "imbalance", "queue_ahead")
SC = ", ".join(f"median({n}) as c_{n}, case when (quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25)) / 1.349 > 1e-12 then (quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25)) / 1.349 when stddev_pop({n}) > 1e-12 then stddev_pop({n}) else 1.0 end as s_{n}" for n in SMALL)


@query(M + "select " + ", ".join(f"round(c_{n}, 8) as c_{n}, round(s_{n}, 8) as s_{n}" for n in SMALL) + f" from (select {SC} from mo)")
def scaler_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hz.scaler_stats(feeds.monthly_episodes(spark, d), SMALL))


@query(M + f", sc as (select {SC} from mo) select k1, k2, " + ", ".join(f"round(greatest(least(({n} - c_{n}) / s_{n}, 12.0), -12.0), 8) as x_{n}" for n in SMALL) + " from mo, sc")
def scaled_features(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.monthly_episodes(spark, d)
    return rounded(hz.scaled(rows, hz.scaler_stats(rows, SMALL), SMALL).select("k1", "k2", *(f"x_{n}" for n in SMALL)))


@query(W + "select sequence, round(sin(2 * pi() * (ts_ms % 86400000) / 86400000.0::double), 8) as tod_sin, round(cos(2 * pi() * (ts_ms % 86400000) / 86400000.0::double), 8) as tod_cos from tr")
def tod_features(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.trades(spark, d).withColumns({c: F.lit(0.0) for c in hz.RAW})
    return hz.features(rows, hz.time_fraction(F.col("ts_ms"))).select("sequence", _r("tod_sin"), _r("tod_cos"))


RATE = f"{MONTHLY}, ra as (select *, 0.05 + distance * 3 as rate, 1 - exp(-(0.05 + distance * 3) * exposure) as p, (count > 0)::int as event from mo)"


def _rated(spark: SparkSession, d: str) -> DataFrame:
    x = feeds.monthly_episodes(spark, d).withColumn("rate", 0.05 + F.col("distance") * 3)
    return x.withColumns({"probability": hz.fill_probability(F.col("rate"), F.col("exposure")), "event": (F.col("count") > 0).cast("double")})


@query(f"with {RATE} select k1, k2, round(p, 8) as probability from ra")
def fill_probability(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).select("k1", "k2", _r("probability"))


@query(f"with {RATE} select round(sum(count * ln(rate * exposure) - rate * exposure), 5) as log_likelihood from ra")
def poisson_loglik(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).agg(F.round(hz.log_likelihood(), 5).alias("log_likelihood"))


@query(f"with {RATE} select round(2 * sum(rate * exposure - count + case when count > 0 then count * ln(count / (rate * exposure)) else 0 end), 5) as deviance from ra")
def poisson_deviance(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).agg(F.round(hz.deviance(), 5).alias("deviance"))


@query(f"with {RATE} select round(avg((event - p) * (event - p)), 8) as brier from ra")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).agg(F.round(hz.brier(F.col("event"), F.col("probability")), 8).alias("brier"))


@query(f"with {RATE} select side, count(*) as n_observations, sum(count)::double as event_count, round(sum(exposure), 5) as total_exposure, round(avg(event), 8) as observed_event_frequency, round(avg(p), 8) as predicted_event_frequency, round(sum(count) / sum(exposure), 8) as observed_rate, round(sum(rate * exposure) / sum(exposure), 8) as predicted_rate from ra group by side")
def evaluation_bundle(spark: SparkSession, d: str) -> DataFrame:
    e = hz.evaluation(_rated(spark, d), ["side"])
    return e.select("side", "n_observations", "event_count", F.round("total_exposure", 5).alias("total_exposure"), *(_r(c) for c in ("observed_event_frequency", "predicted_event_frequency", "observed_rate", "predicted_rate")))


@query(f"with {RATE} select bin::int as bin, round(avg(p), 8) as predicted, round(avg(event), 8) as observed, count(*) as count from (select *, least(floor(p * 10 + 1e-12), 9) as bin from ra) group by 1")
def calibration_fixed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hz.calibration(_rated(spark, d)))


@query(f"with {RATE}, ed as (select list_distinct(quantile_cont(round(p, 12), [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) as u from ra), eg as (select list_sort(u) as e from ed) select len(list_filter(e[2:len(e)-1], lambda x: x <= round(p, 12)))::int as bin, round(avg(round(p, 12)), 8) as predicted, round(avg(event), 8) as observed, count(*) as count from ra, eg group by 1")
def calibration_quantile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hz.reliability(_rated(spark, d).withColumn("probability", F.round("probability", 12))))


@query()
def glm_fit(spark: SparkSession, d: str) -> DataFrame:
    m = hz.PoissonGlm(SMALL).fit(feeds.monthly_episodes(spark, d))
    rows = [(s, i, float(b), m.results[s]["log_likelihood"], m.results[s]["converged"]) for s, beta in m.beta.items() for i, b in enumerate(beta)]
    return spark.createDataFrame(rows, "side string, term int, coefficient double, log_likelihood double, converged boolean")


# --- walk-forward and diagnostics ------------------------------------------------------------------------------------


SPLIT = "um as (select month, row_number() over (order by month) - 1 as k from (select distinct month from mo))"


@query(M + f", {SPLIT} select t.k::int as fold, t.month as test_month, u.month as train_month from um t join um u on u.k < t.k")
def month_splits_expanding(spark: SparkSession, d: str) -> DataFrame:
    return wf.monthly_splits(feeds.monthly_episodes(spark, d))


@query(M + f", {SPLIT} select t.k::int as fold, t.month as test_month, u.month as train_month from um t join um u on u.k < t.k and u.k >= t.k - 6 where t.k >= 3")
def month_splits_rolling(spark: SparkSession, d: str) -> DataFrame:
    return wf.monthly_splits(feeds.monthly_episodes(spark, d), "rolling", 3, 6)


OOS = f"""{MONTHLY}, {SPLIT}, sm2 as (select side, month, sum(count) as y, sum(exposure) as e from mo group by 1, 2),
rt as (select t.k as fold, t.month, s.side, sum(s.y) / sum(s.e) as rate from um t join um u on u.k < t.k join sm2 s on s.month = u.month group by 1, 2, 3),
oo as (select mo.*, rt.fold, rt.rate, 1 - exp(-rt.rate * exposure) as probability, (count - rt.rate * exposure) / sqrt(greatest(rt.rate * exposure, 2.2250738585072014e-308)) as residual from mo join rt using (month, side))"""


@query(f"with {OOS} select fold::int as fold, month, count(*) as n, round(avg(probability), 8) as predicted, round(avg((count > 0)::int), 8) as observed, round(avg(((count > 0)::int - probability) * ((count > 0)::int - probability)), 8) as brier from oo group by 1, 2")
def walkforward_constant_rate(spark: SparkSession, d: str) -> DataFrame:
    e = wf.fold_metrics(wf.constant_rate(feeds.monthly_episodes(spark, d)))
    return e.select("fold", "month", F.col("n_observations").alias("n"), _r(F.col("predicted_event_frequency")).alias("predicted"), _r(F.col("observed_event_frequency")).alias("observed"), _r(F.col("brier_score")).alias("brier"))


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    return dg.pearson(wf.constant_rate(feeds.monthly_episodes(spark, d)))


ORDER = ["ts_ms", "k1", "k2"]
LAGS = ", ".join(f"lag(c, {k}) over (partition by side order by ts_ms, k1, k2, c) as l{k}" for k in (1, 2, 3))
ACF = f"ce as (select side, ts_ms, k1, k2, residual - avg(residual) over (partition by side) as c from oo), lg as (select side, c, {LAGS} from ce), ac2 as (select side, sum(c*c) as d, sum(c*l1) as s1, sum(c*l2) as s2, sum(c*l3) as s3 from lg group by side)"


@query(f"with {OOS}, {ACF} select side, 0 as lag, 1.0::double as acf from ac2 union all select side, 1, round(s1/d, 7) from ac2 union all select side, 2, round(s2/d, 7) from ac2 union all select side, 3, round(s3/d, 7) from ac2")
def residual_acf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dg.acf(_residuals(spark, d), "residual", ORDER, ["side"], 3), 7)


XS = "ms as (select ts_ms, side, avg(residual) as r from oo group by 1, 2), pr as (select b.r as b, a.r as a from ms b join ms a on a.ts_ms = b.ts_ms and b.side = 'bid' and a.side = 'ask')"


@query(f"with {OOS}, {XS} select round(covar_pop(b, a) / (stddev_pop(b) * stddev_pop(a)), 7) as correlation, count(*) as pair_count from pr")
def cross_side_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dg.cross_side(_residuals(spark, d)), 7)


@query(f"with {OOS} select count(*) as n, round(sum(residual * residual) / greatest(count(*) - 2, 1), 7) as dispersion from oo")
def dispersion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dg.dispersion(_residuals(spark, d), 2), 7)


@query(f"""with {OOS}, {ACF}, {XS}, nn as (select count(*) as n, sum(residual * residual) / count(*) as disp from oo), pk as (select max(case when side = 'bid' then greatest(abs(s1/d), abs(s2/d), abs(s3/d)) end) as bid_peak, max(case when side = 'ask' then greatest(abs(s1/d), abs(s2/d), abs(s3/d)) end) as ask_peak from ac2),
cx as (select covar_pop(b, a) / (stddev_pop(b) * stddev_pop(a)) as corr from pr) select n, round(greatest(0.1, 1.96 / sqrt(n)), 8) as threshold, greatest(bid_peak, ask_peak) > greatest(0.1, 1.96 / sqrt(n)) as serial_dependence, coalesce(abs(corr) > greatest(0.1, 1.96 / sqrt(n)), false) as cross_side_dependence, disp > 1.5 as overdispersed,
greatest(bid_peak, ask_peak) > greatest(0.1, 1.96 / sqrt(n)) or coalesce(abs(corr) > greatest(0.1, 1.96 / sqrt(n)), false) as warranted from nn, pk, cx""")
def hawkes_gate(spark: SparkSession, d: str) -> DataFrame:
    return dg.gate_frame(_residuals(spark, d), ORDER, 3).select("n", _r("threshold"), "serial_dependence", "cross_side_dependence", "overdispersed", "warranted")


@query(f"with {MONTHLY}, v as (select side, value - 38 as v from mo), q as (select side, quantile_cont(v, 0.05) as cut from v group by 1) select side, round(sum(v), 3) as net_pnl, round(avg(v), 8) as mean_pnl, round(stddev_pop(v), 8) as pnl_volatility, round(-any_value(cut), 8) as value_at_risk, round(-avg(case when v <= cut then v end), 8) as expected_shortfall from v join q using (side) group by 1")
def pnl_risk(spark: SparkSession, d: str) -> DataFrame:
    x = feeds.monthly_episodes(spark, d).withColumn("v", F.col("value") - 38)
    return dg.pnl_stats(x, "v", ["side"]).select("side", F.round("net_pnl", 3).alias("net_pnl"), *(_r(c) for c in ("mean_pnl", "pnl_volatility", "value_at_risk", "expected_shortfall")))


@query(f"with {MONTHLY} select side, round(sqrt(avg(imbalance * imbalance)), 8) as inventory_rms, round(avg(abs(imbalance)), 8) as mean_absolute_inventory, round(max(abs(imbalance)), 8) as max_absolute_inventory, round(arg_max(imbalance, (ts_ms, k1, k2, imbalance)), 8) as terminal_inventory from mo group by 1")
def inventory_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dg.inventory_stats(feeds.monthly_episodes(spark, d), "imbalance", ORDER, ["side"]))


@query(f"with {MONTHLY}, cu as (select month, side, ts_ms, k1, k2, sum(value - 38) over (partition by month, side order by ts_ms, k1, k2, value rows unbounded preceding) as e, value from mo), pk as (select month, side, greatest(max(e) over (partition by month, side order by ts_ms, k1, k2, value rows unbounded preceding), 0) - e as dd from cu) select month, side, round(greatest(max(dd), 0), 6) as max_drawdown from pk group by 1, 2")
def drawdown(spark: SparkSession, d: str) -> DataFrame:
    x = feeds.monthly_episodes(spark, d).withColumn("v", F.col("value") - 38)
    return rounded(dg.drawdown(x, "v", ORDER, ["month", "side"]), 6)


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    x = _rated(spark, d).withColumns({"bin": hz.fixed_bin(F.col("probability")), "cluster": F.col("month").cast("string")})
    return rounded(dg.bootstrap_ci(x, "cluster", "bin", "event"))


# --- accounting, prices, quotes ---------------------------------------------------------------------------------------


@query(W + "select sequence, round(-sum(case when buyer_is_maker then -1 else 1 end * price * quantity + price * quantity * 0.0002) over w, 4) as cash_after, sum(case when buyer_is_maker then -1 else 1 end * quantity) over w as inventory_after from tr window w as (partition by ts_ms//86400000 order by ts_ms, sequence rows unbounded preceding)")
def linear_accounting(spark: SparkSession, d: str) -> DataFrame:
    f = feeds.trades(spark, d).withColumns({"side": feeds.aggressor_side(F.col("buyer_is_maker")), "day": F.floor(F.col("ts_ms") / 86_400_000)})
    return acc.linear(f, ["day"], ["ts_ms", "sequence"], 0.0002).select("sequence", F.round("cash_after", 4).alias("cash_after"), "inventory_after")


INVERSE = f"""with recursive {EV}, f as materialized (select ts_ms//86400000 as day, ts_ms, sequence, price, quantity, case when buyer_is_maker then -1.0::double else 1.0::double end as s, row_number() over (partition by ts_ms//86400000 order by ts_ms, sequence) as k from tr),
st as (select 0::bigint as k, day, null::bigint as ts_ms, null::bigint as sequence, null::double as price, null::double as quantity, 0.0::double as q, null::double as avg, 0.0::double as pnl, 0.0::double as fee, 0.0::double as cash from (select distinct day from f)
union all select k, day, ts_ms, sequence, price, quantity, q1, case when q1 = 0 then null when abs(q) <= 1e-12 or (q * d < 0 and quantity > abs(q) + 1e-12) then price when q * d > 0 then (abs(q) + quantity) / (abs(q) / avg + quantity / price) else avg end, p1, fee1, cash + p1 - fee1
from (select f.k, f.day, f.ts_ms, f.sequence, f.price, f.quantity, st.q, st.avg, st.cash, f.s * f.quantity as d, case when abs(st.q + f.s * f.quantity) <= 1e-12 then 0 else st.q + f.s * f.quantity end as q1,
case when st.q * f.s * f.quantity < 0 then 100.0::double * least(abs(st.q), f.quantity) * sign(st.q) * (1 / st.avg - 1 / f.price) else 0.0::double end as p1, 100.0::double * f.quantity / f.price * 0.0002::double as fee1 from st join f on f.day = st.day and f.k = st.k + 1) x)
select day, ts_ms, sequence, price, quantity, q as inventory_after, round(avg, 10) as average_entry, round(pnl, 10) as realized_pnl, round(fee, 10) as fee, round(cash, 10) as cash_after from st where k > 0"""


@query(INVERSE)
def inverse_accounting(spark: SparkSession, d: str) -> DataFrame:
    f = feeds.trades(spark, d).withColumns({"side": feeds.aggressor_side(F.col("buyer_is_maker")), "day": F.floor(F.col("ts_ms") / 86_400_000)})
    return rounded(acc.inverse(f, ["day"], ["ts_ms", "sequence"], 100.0, 0.0002), 10)


@query(W + "select sequence, (floor((price + sequence % 7 * 0.013)::varchar::decimal(28,12) / 0.1) * 0.1)::double as buy_price, (ceil((price + sequence % 7 * 0.013)::varchar::decimal(28,12) / 0.1) * 0.1)::double as sell_price from tr")
def tick_round(spark: SparkSession, d: str) -> DataFrame:
    p = F.round(F.col("price") + F.col("sequence") % 7 * 0.013, 6)
    return feeds.trades(spark, d).select("sequence", px.tick_round(p, "0.1", F.lit("buy")).alias("buy_price"), px.tick_round(p, "0.1", F.lit("sell")).alias("sell_price"))


ORACLE_SQL["tick_round"] = W + (
    "select sequence, (floor(round((price + sequence % 7 * 0.013::double) * 1000)::bigint / 100)::bigint / 10.0::double) as buy_price, (ceil(round((price + sequence % 7 * 0.013::double) * 1000)::bigint / 100)::bigint / 10.0::double) as sell_price from tr"
)


@query("select event_id, greatest(least(sign(value - 50) * floor(abs(value - 50) / 10 + 0.5), 3), -3)::int as q from events")
def grid_inventory(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", px.grid_inventory(F.col("value") - 50, 10.0, 3).alias("q"))


def _params(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(p.cast("long").alias("id"), (0.5 + (p % 5) * 0.1).alias("A"), (1 + (p % 4) * 0.25).alias("k"), (0.05 + (p % 3) * 0.05).alias("gamma"), (0.1 + (p % 2) * 0.2).alias("sigma"), ((p % 3 - 1) * 0.01).alias("mu"), F.lit(2).alias("max_inventory"))


PAR = "pa as (select p_partkey::bigint as id, 0.5::double + (p_partkey % 5) * 0.1::double as A, 1 + (p_partkey % 4) * 0.25::double as k, 0.05::double + (p_partkey % 3) * 0.05::double as g, 0.1::double + (p_partkey % 2) * 0.2::double as s, (p_partkey % 3 - 1) * 0.01::double as mu from part), co as (select *, ln(1 + g / k) / g as c, A * exp(-(1 + k / g) * ln(1 + g / k)) as eta, 0.5 * k * g * s * s as alpha, k * mu as beta from pa)"


@query(f"with {PAR} select id, round(c, 8) as c, round(eta, 8) as eta, round(alpha, 8) as alpha, round(beta, 8) as beta from co")
def glft_constants(spark: SparkSession, d: str) -> DataFrame:
    return gq.constants_frame(_params(spark, d)).select("id", *(_r(c) for c in ("c", "eta", "alpha", "beta")))


@query(f"with {PAR}, qq as (select unnest([-2,-1,0,1,2]) as q), q3 as (select unnest([-2,-1,0,1,2]) as q2) select id, q::int as q, q2::int as q2, round(case when q = q2 then alpha * q * q - beta * q else -eta end, 8) as value from co, qq, q3 where abs(q - q2) <= 1")
def glft_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gq.matrix_frame(_params(spark, d)))


@query(f"with {PAR} select id, x.delta, round(A * exp(-k * x.delta), 8) as intensity from co, (select unnest([0.0::double, 0.5, 1.0, 2.0]) as delta) x")
def poisson_intensity(spark: SparkSession, d: str) -> DataFrame:
    p = _params(spark, d).withColumn("delta", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0, 2.0)))))
    return p.select("id", "delta", gq.intensity(F.col("A"), F.col("k"), F.col("delta")).alias("x")).select("id", "delta", _r(F.col("x")).alias("intensity"))


def _taylor() -> str:
    """v = exp(-M tau) 1 at Q = 2, tau = 1, by its Taylor series over the five states."""
    new = []
    for i, q in enumerate(range(-2, 3)):
        near = " + ".join(f"eta * t{j}" for j in (i - 1, i + 1) if 0 <= j < 5)
        new.append(f"(-(alpha * {q * q} - beta * ({q})) * t{i} + {near}) / (n + 1) as t{i}")
    seed = ", ".join(f"1.0::double as t{i}" for i in range(5)) + ", " + ", ".join(f"1.0::double as v{i}" for i in range(5))
    step = f"select n + 1 as n, id, c, k, eta, alpha, beta, {', '.join(new)}, {', '.join(f'v{i}' for i in range(5))} from ty where n < 30"
    terms = f"ty as (select 0 as n, id, c, k, eta, alpha, beta, {seed} from co union all {step})"
    sums = "vv as (select id, any_value(c) as c, any_value(k) as k, " + ", ".join(f"sum(t{i}) as v{i}" for i in range(5)) + " from ty group by id)"
    rows = " union all ".join(
        f"select id, 1.0::double as tau, {q}::int as q, " + (f"round(c + ln(v{i} / v{i + 1}) / k, 8)" if q < 2 else "null::double") + " as bid, " + (f"round(c + ln(v{i} / v{i - 1}) / k, 8)" if q > -2 else "null::double") + " as ask from vv"
        for i, q in enumerate(range(-2, 3))
    )
    return f"with recursive {PAR}, {terms}, {sums} {rows}"


@query(_taylor())
def glft_quotes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gq.quote_distances(_params(spark, d), [1.0]))


@query()
def poisson_simulation(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("seed"))
    return rounded(gq.simulate_paths(seeds, gq.QuoteModel(1.0, 1.5, 0.1, 0.3, 0.0, 5), 60.0, 0.5, 100.0))


# --- replay -----------------------------------------------------------------------------------------------------------


def _replay(spark: SparkSession, d: str, *logs: str) -> DataFrame:
    return rp.replay(rp.event_rows(feeds.books(spark, d), feeds.trades(spark, d)), rp.fixture_run(), logs=logs)


@query()
def replay_orders(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d, "order").select("order_id", "side", "price", "quantity", "status", "requested_ms", "active_ms", "closed_ms", "filled", "queue0")


@query()
def replay_fills(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_replay(spark, d, "fill").select("n", "ts_ms", "order_id", "side", "price", "quantity", "liquidity", "fee", "cash_after", "inventory_after"), 6)


@query()
def replay_equity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_replay(spark, d, "equity").select("n", "ts_ms", "reason", "mid", "cash_after", "inventory_after", "equity"), 6)


@query()
def replay_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rp.summary(_replay(spark, d, "order", "fill", "equity")), 6)


@query()
def quote_segments(spark: SparkSession, d: str) -> DataFrame:
    logs = kept(_replay(spark, d, "order", "fill"), "logs")
    return rp.quote_segments(logs.where("log = 'order'"), logs.where("log = 'fill'"))


@query()
def replay_markouts(spark: SparkSession, d: str) -> DataFrame:
    """The run's maker fills against the book ten minutes and a day later."""
    logs = _replay(spark, d, "fill").select("symbol", "log", "n", "ts_ms", "order_id", "side", "price", "liquidity")
    return rounded(rp.fill_markouts(logs, feeds.books(spark, d), [600_000, 86_400_000], rp.fixture_run()().config))


@query(W + "select sequence, case when buyer_is_maker then 'sell' else 'buy' end as side, rint_qty as contracts, ms_seq from (select *, round_even(quantity * price / 100, 0) as rint_qty, row_number() over (partition by ts_ms order by sequence) - 1 as ms_seq from tr)")
def replay_events(spark: SparkSession, d: str) -> DataFrame:
    t = feeds.trades(spark, d)
    e = rp.event_rows(feeds.books(spark, d), t, 100.0).where("kind = 'trade'")
    w = Window.partitionBy("ts_ms").orderBy("sequence")
    own = t.select("ts_ms", F.col("sequence").alias("id"), (F.row_number().over(w) - 1).cast("long").alias("sequence"))
    return e.join(own, ["ts_ms", "sequence"]).select(F.col("id").alias("sequence"), "side", F.col("quantity").alias("contracts"), F.col("sequence").alias("ms_seq"))


@query(W + """select symbol, ts_ms, row_number() over (partition by ts_ms order by phase, sequence) - 1 as ms_seq, kind, side, price, contracts, bid_price, bid_qty, ask_price, ask_qty from (
select symbol, ts_ms, sequence, 0 as phase, 'trade' as kind, case when buyer_is_maker then 'sell' else 'buy' end as side, price, round_even(quantity * price / 100, 0) as contracts, null::double as bid_price, null::double as bid_qty, null::double as ask_price, null::double as ask_qty from tr
union all select symbol, ts_ms, sequence, 1, 'book', null, null, null, bid_price, bid_qty, ask_price, ask_qty from bk)""")
def replay_stream(spark: SparkSession, d: str) -> DataFrame:
    """Both feeds as one stream of replay events."""
    e = rp.event_rows(feeds.books(spark, d), feeds.trades(spark, d), 100.0)
    return e.select("symbol", "ts_ms", F.col("sequence").alias("ms_seq"), "kind", "side", "price", F.col("quantity").alias("contracts"), "bid_price", "bid_qty", "ask_price", "ask_qty")


# --- slices, rebased curves, values -----------------------------------------------------------------------------------


@query(W + ", bn as (select ts_ms//100 as b, count(*) as c from tr group by 1), ed as (select min(b) as lo, max(b) as hi from bn), mi as (select b//600 as m, sum(c)::double as ev, sum(c*c)::double as sq, least(hi, (b//600 + 1) * 600 - 1) - greatest(lo, b//600 * 600) + 1 as n from bn, ed group by m, hi, lo, n), fa as (select (sq / n - ev / n * ev / n) / (ev / n) as fano from mi) select 'S' as symbol, count(*) as minutes, round(median(fano), 8) as median_fano from fa".replace("group by m, hi, lo, n", "group by all"))
def arrival_minute_fano_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arr.median_minute_fano(arr.minute_fano(feeds.trades(spark, d))))


@query(f"with {MONTHLY}, v as (select side, count, case when count > 0 and k1 % 7 = 0 then 'nan'::double when k1 % 11 = 0 then null when k1 % 13 = 0 then 'infinity'::double else value - 38 end as v from mo) select side, count(*) as n, round(avg(v), 8) as mean_markout, round(median(v), 8) as median_markout, round(avg((v < 0)::int), 8) as adverse_fraction, round(quantile_cont(v, 0.05), 8) as markout_tail from v where count > 0 and v is not null and isfinite(v) group by 1")
def finite_event_slice(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when((F.col("count") > 0) & (F.col("k1") % 7 == 0), float("nan")).when(F.col("k1") % 11 == 0, None).when(F.col("k1") % 13 == 0, float("inf")).otherwise(F.col("value") - 38)
    rows = dg.metric_slice(feeds.monthly_episodes(spark, d).withColumn("v", odd), "v", "count")
    return rounded(dg.markout_stats(rows, "v", ["side"]))


@query(f"with {MONTHLY}, pt as (select *, arg_min(value, (ts_ms, k1, k2, value)) over (partition by side) as f from mo where ts_ms >= 820454400000 and ts_ms < 852076800000) select side, ts_ms, k1, k2, round(value - f, 6) as rebased from pt")
def rebased_equity(spark: SparkSession, d: str) -> DataFrame:
    """The year 1996 of a curve, from its first point."""
    out = dg.rebased(feeds.monthly_episodes(spark, d), "value", ORDER, ["side"], 820_454_400_000, 852_076_800_000)
    return rounded(out.select("side", "ts_ms", "k1", "k2", "rebased"), 6)


@query(f"with {OOS}, n as (select side, residual, row_number() over (partition by side order by ts_ms, k1, k2, residual) as k from oo) select b.k, round(b.residual, 7) as bid_residual, round(a.residual, 7) as ask_residual from n b join n a on a.k = b.k and b.side = 'bid' and a.side = 'ask'")
def paired_residuals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dg.paired_sides(_residuals(spark, d), ORDER).withColumn("k", F.col("k").cast("long")), 7)


@query(W + "select sequence, least(bid_price + 0.25 * (sequence % 9), ask_price - 0.5) as buy_price, greatest(ask_price - 0.25 * (sequence % 9), bid_price + 0.5) as sell_price from bk")
def post_only_projection(spark: SparkSession, d: str) -> DataFrame:
    step = 0.25 * (F.col("sequence") % 9)
    side = lambda s, p: px.post_only(p, F.lit(s), F.col("bid_price"), F.col("ask_price"), 0.5)
    return feeds.books(spark, d).select("sequence", side("buy", F.col("bid_price") + step).alias("buy_price"), side("sell", F.col("ask_price") - step).alias("sell_price"))


@query(W + "select sequence, (sequence % 5 - 2) * price as linear_value, round(case when sequence % 5 = 2 then 0 else 100.0 * (sequence % 5 - 2) * (1.0::double / (price + 5) - 1.0::double / price) end, 10) as inverse_value from tr")
def position_value(spark: SparkSession, d: str) -> DataFrame:
    q = (F.col("sequence") % 5 - 2).cast("double")
    value = lambda inverse: acc.position_value(q, F.col("price") + 5, F.col("price"), inverse, 100.0)
    return feeds.trades(spark, d).select("sequence", value(False).alias("linear_value"), F.round(value(True), 10).alias("inverse_value"))
