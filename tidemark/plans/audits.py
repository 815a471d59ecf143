"""Queries that put the sources, the replay and the models before SQL where it can tell their rows: files written and read back,
runs of one order each, models with a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import quotes as gq
from tidemark.operators import asof
from tidemark.operators import diagnostics as dg
from tidemark.operators import hazard as hz
from tidemark.operators import replay as rp
from tidemark.operators import walkforward as wf
from tidemark.operators.episodes import FIXTURE
from tidemark.plans.catalog import BIN_ROWS, GRID, MONTHLY, OOS, ORDER, W, _params, _residuals, _taylor, bin_rows, query, rounded
from tidemark.sources import feeds
from tidemark.sources.folders import kept, new_folder
from tidemark.streaming import live_episodes

# --- files ------------------------------------------------------------------------------------------------------------


@query(W + "select symbol, ts_ms, sequence, bid_price, bid_qty, ask_price, ask_qty, case when sequence % 3 <> 0 then ts_ms + 1 end as event_time_ms from bk")
def book_csv(spark: SparkSession, d: str) -> DataFrame:
    """The book feed through a CSV file: columns in another order, one more, empty optional values."""
    path, b = new_folder(spark, "book-csv"), feeds.books(spark, d)
    event = F.when(F.col("sequence") % 3 != 0, (F.col("ts_ms") + 1).cast("string")).otherwise(F.lit(" "))
    b.select(
        F.lit("x").alias("extra"), F.col("ask_qty").alias("best_ask_qty"), F.col("ask_price").alias("best_ask_price"), F.col("ts_ms").alias("transaction_time"), F.col("bid_price").alias("best_bid_price"),
        event.alias("event_time"), F.col("bid_qty").alias("best_bid_qty"), F.col("sequence").alias("update_id"),
    ).write.csv(path, header=True)
    return feeds.read_book_csv(spark, path, "S")


@query(W + "select symbol, ts_ms, sequence, price, quantity, buyer_is_maker, sequence * 2 as first_trade_id, case when sequence % 2 = 0 then sequence * 2 + 1 end as last_trade_id from tr")
def trade_csv(spark: SparkSession, d: str) -> DataFrame:
    """The trade feed through a CSV file, its flag spelled in all allowed ways."""
    path, t = new_folder(spark, "trade-csv"), feeds.trades(spark, d)
    spelled = lambda *words: F.element_at(F.array(*map(F.lit, words)), (F.col("sequence") % len(words) + 1).cast("int"))
    t.select(
        F.when(F.col("buyer_is_maker"), spelled("true", " TRUE", "1", "True ")).otherwise(spelled("false", "0", " False ")).alias("is_buyer_maker"), F.col("quantity"), F.col("price"), F.col("sequence").alias("agg_trade_id"),
        (F.col("sequence") * 2).alias("first_trade_id"), F.when(F.col("sequence") % 2 == 0, (F.col("sequence") * 2 + 1).cast("string")).otherwise(F.lit("")).alias("last_trade_id"), F.col("ts_ms").alias("transact_time"),
    ).write.csv(path, header=True)
    return feeds.read_trade_csv(spark, path, "S")


@query(f"with {MONTHLY} select case when side = 'bid' then '0:' else '1:' end || k1 || '-' || k2 as episode_id, side, ts_ms / 1000.0::double as timestamp, count, exposure, case when count = 0 then value end as markout from mo")
def episode_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Episode rows through two JSONL sources, joined again: ids get their source's number, NaN comes back as null."""
    x = feeds.monthly_episodes(spark, d)
    rows = x.select(
        (F.col("ts_ms") / 1000.0).alias("timestamp"), "side", "distance", "spread", "imbalance", *(F.lit(0.0).alias(c) for c in ("ofi", "volatility")), "queue_ahead", F.lit(0.0).alias("order_age"), "count", "exposure",
        F.concat_ws("-", "k1", "k2").alias("episode_id"), F.when(F.col("count") > 0, float("nan")).otherwise(F.col("value")).alias("markout"),
    )
    paths = [new_folder(spark, f"episodes-{side}") for side in ("bid", "ask")]
    for side, path in zip(("bid", "ask"), paths, strict=True):
        feeds.write_jsonl(rows.where(F.col("side") == side), path)
    return feeds.read_episodes_jsonl(spark, paths).select("episode_id", "side", "timestamp", "count", "exposure", "markout")


@query(f"""with {MONTHLY} select '{{"events":' || sum(count)::bigint || ',"month":"' || month || '","n":' || count(*) || ',"odd":null,"side":"' || side || '"}}' as report from mo group by month, side""")
def json_reports(spark: SparkSession, d: str) -> DataFrame:
    s = feeds.monthly_episodes(spark, d).groupBy(F.col("month").cast("string").alias("month"), "side").agg(F.count("*").alias("n"), F.sum("count").alias("events"), F.lit(float("inf")).alias("odd"))
    return feeds.json_report(s)


# --- runs of one order ------------------------------------------------------------------------------------------------

HOUR = 3_600_000
#: Own books and trades of a run, from an hour before its decision to six after; an order of three at a price that walks
#: through the book, a minute of latency either way, the cancel asked for after three hours.
SINGLE = W + f""", {GRID},
od1 as (select decision as run, decision_ms as d, decision_ms + 60000 as a, decision_ms + 10860000 as c, case when decision % 2 = 0 then 'buy' else 'sell' end as side, case when decision % 2 = 0 then 1 else -1 end as s, (1000 + decision % 12) * 0.5::double as p from gr),
mb as (select o.run, o.a, b.ts_ms, b.sequence, b.bid_price, b.bid_qty, b.ask_price, b.ask_qty from od1 o join bk b on b.ts_ms > o.d - {HOUR} and b.ts_ms <= o.d + {6 * HOUR}),
mt as (select o.run, t.ts_ms, t.sequence, t.price, t.quantity, t.buyer_is_maker from od1 o join tr t on t.ts_ms > o.d - {HOUR} and t.ts_ms <= o.d + {6 * HOUR}),
ls as (select run, max(ts_ms) as l from (select run, ts_ms from mb union all select run, ts_ms from mt) group by run),
ab as (select run, arg_max(bid_price, (ts_ms, sequence)) as bid, arg_max(bid_qty, (ts_ms, sequence)) as bq, arg_max(ask_price, (ts_ms, sequence)) as ask, arg_max(ask_qty, (ts_ms, sequence)) as aq from mb where ts_ms <= a group by run),
st1 as (select o.*, greatest(o.d + {3 * HOUR}, coalesce(l, 0)) as e, case when bid is null then 'no book' when side = 'buy' and p >= ask or side = 'sell' and p <= bid then 'would cross' end as reason,
  case when side = 'buy' and p = bid then bq when side = 'sell' and p = ask then aq when bid < p and p < ask then 0.0::double end as at0 from od1 o left join ls using (run) left join ab using (run)),
rv as (select s1.run, min(b.ts_ms) as seen, arg_min(case when side = 'buy' then b.bid_qty else b.ask_qty end, (b.ts_ms, b.sequence)) as shown from st1 s1 join mb b on b.run = s1.run and b.ts_ms > s1.a and b.ts_ms <= c
  and case when side = 'buy' then b.bid_price else b.ask_price end = p where reason is null and at0 is null group by 1),
kn as (select st1.*, coalesce(at0, shown) as q0, case when at0 is not null then a else seen end as known from st1 left join rv using (run)),
cu1 as (select k.*, t.ts_ms, t.sequence, bool_or(case when side = 'buy' then t.price < p else t.price > p end) over w as thr, sum(case when t.price = p and t.ts_ms > known then t.quantity else 0 end) over w as v
  from kn k join mt t on t.run = k.run and t.ts_ms > a and t.ts_ms <= c and case when side = 'buy' then t.buyer_is_maker and t.price <= p else not t.buyer_is_maker and t.price >= p end
  where reason is null window w as (partition by k.run order by t.ts_ms, t.sequence rows unbounded preceding)),
ff as (select *, case when thr then 3.0::double when q0 is null then 0.0::double else least(3.0::double, greatest(0.0::double, v - q0)) end as f from cu1),
fl1 as (select * from (select *, f - coalesce(lag(f) over (partition by run order by ts_ms, sequence), 0) as q from ff) where q > 0),
fs1 as (select run, max(f) as filled, max(case when f = 3 then ts_ms end) as done from fl1 group by run),
lb as (select run, arg_max(bid_price, (ts_ms, sequence)) as bid, arg_max(ask_price, (ts_ms, sequence)) as ask from mb group by run),
lq as (select k.run, k.e as ts_ms, case when side = 'buy' then 'sell' else 'buy' end as side, case when side = 'buy' then lb.bid else lb.ask end as price, filled as q, k.s, p from kn k join fs1 using (run) join lb using (run)),
al as (select run, ts_ms, side, p as price, q, 'maker' as liquidity, ts_ms - a as quote_age_ms, p * q * -0.0001::double as fee, -s * p * f + p * f * 0.0001::double as cash_after, s * f as inventory_after, sequence from fl1
  union all select run, ts_ms, side, price, q, 'taker', 0, price * q * 0.0005::double, -s * p * q + p * q * 0.0001::double + s * price * q - price * q * 0.0005::double, 0.0::double, 9223372036854775807 from lq),
eq as (select b.run, b.ts_ms, 1 as o, b.sequence, 'book' as reason, (b.bid_price + b.ask_price) / 2 as mid, coalesce(arg_max(f.cash_after, (f.ts_ms, f.sequence)), 0) as cash_after, coalesce(arg_max(f.inventory_after, (f.ts_ms, f.sequence)), 0) as inventory_after
  from mb b left join al f on f.run = b.run and f.liquidity = 'maker' and f.ts_ms <= b.ts_ms group by all
  union all select f.run, f.ts_ms, case when liquidity = 'maker' then 0 else 2 end, f.sequence, case when liquidity = 'maker' then 'maker_fill' else 'liquidation' end, arg_max((b.bid_price + b.ask_price) / 2, (b.ts_ms, b.sequence)), f.cash_after, f.inventory_after
  from al f join mb b on b.run = f.run and (b.ts_ms < f.ts_ms or liquidity = 'taker') group by f.run, f.ts_ms, liquidity, f.sequence, f.cash_after, f.inventory_after),
eqv as (select *, cash_after + inventory_after * mid as equity from eq)
"""


def _single(spark: SparkSession, d: str, *logs: str) -> DataFrame:
    """The logs of one run for each hour of the feed, `run` its number."""
    books, trades = feeds.books(spark, d), feeds.trades(spark, d)
    ends = books.select("ts_ms", F.lit(True).alias("book")).unionAll(trades.select("ts_ms", F.lit(False).alias("book")))
    ends = ends.agg(F.min(F.when(F.col("book"), F.col("ts_ms"))).alias("t0"), F.max("ts_ms").alias("t1"))
    runs = ends.where("t0 is not null").select("t0", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / HOUR))).alias("run"))
    runs = runs.select(F.lit("S").alias("symbol"), "run", (F.col("t0") + F.col("run") * HOUR).alias("d"))
    spans = runs.select("symbol", "run", (F.col("d") - HOUR).alias("lo"), (F.col("d") + 6 * HOUR).alias("hi"))
    market = asof.interval_join(spans, rp.event_rows(books, trades), "lo", "hi", 7 * HOUR).drop("symbol", "lo", "hi")
    side = F.when(F.col("run") % 2 == 0, "buy").otherwise("sell")
    own = runs.select("run", F.lit(2).alias("phase"), F.lit(0).cast("long").alias("sequence"), F.lit("o").alias("order_id"), "d", side.alias("side"), ((1000 + F.col("run") % 12) * 0.5).alias("price"))
    place = own.select("run", "phase", "sequence", "order_id", F.lit("place").alias("kind"), F.col("d").alias("ts_ms"), "side", "price", F.lit(3.0).alias("quantity"))
    cancel = own.select("run", "phase", "sequence", "order_id", F.lit("cancel").alias("kind"), (F.col("d") + 3 * HOUR).alias("ts_ms"))
    events = market.unionByName(place, allowMissingColumns=True).unionByName(cancel, allowMissingColumns=True)
    config = rp.ReplayConfig(tick_size=0.5, placement_latency_ms=60_000, cancel_latency_ms=60_000, maker_fee_rate=-0.0001, taker_fee_rate=0.0005)
    return rp.replay(events.withColumn("symbol", F.col("run").cast("string")), lambda: rp.Replay(config), logs=logs).withColumn("run", F.col("symbol").cast("long"))


@query(SINGLE + """select k.run, side, p as price, case when reason is not null then 'rejected' when filled = 3 then 'filled' when c <= e then 'canceled' else 'expired' end as status, reason, case when reason is null then a end as active_ms,
case when reason is not null then a when filled = 3 then done when c <= e then c else e end as closed_ms, coalesce(filled, 0)::double as filled, case when reason is null and (at0 is not null or done is null or known < done) then q0 end as queue0 from kn k left join fs1 using (run)""")
def replay_single_orders(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of one order a run: refusals, queues at the touch, inside the spread and not yet seen, cancels, expiry."""
    return _single(spark, d, "order").select("run", "side", "price", "status", "reason", "active_ms", "closed_ms", "filled", "queue0")


@query(SINGLE + "select run, ts_ms, side, price, q as quantity, liquidity, quote_age_ms, round(fee, 6) as fee, round(cash_after, 6) as cash_after, inventory_after from al")
def replay_single_fills(spark: SparkSession, d: str) -> DataFrame:
    """Their fills and liquidations, with fees, cash and age."""
    return rounded(_single(spark, d, "fill").select("run", "ts_ms", "side", "price", "quantity", "liquidity", "quote_age_ms", "fee", "cash_after", "inventory_after"), 6)


@query(SINGLE + "select run, ts_ms, reason, mid, round(cash_after, 6) as cash_after, inventory_after, round(equity, 6) as equity from eqv")
def replay_single_equity(spark: SparkSession, d: str) -> DataFrame:
    """Their equity at each book, fill and liquidation."""
    return rounded(_single(spark, d, "equity").select("run", "ts_ms", "reason", "mid", "cash_after", "inventory_after", "equity"), 6)


@query(SINGLE + """, dd as (select *, max(equity) over w - equity as fall, first_value(equity) over w as e0, last_value(equity) over (partition by run order by o = 2, ts_ms, o, sequence rows between unbounded preceding and unbounded following) as e1 from eqv window w as (partition by run order by o = 2, ts_ms, o, sequence rows unbounded preceding)),
de as (select run, max(fall) as max_drawdown, max(abs(inventory_after)) as max_abs_inventory, any_value(e1 - e0) as net_pnl from dd group by run),
af as (select run, count(*) as n_fills, sum(fee) as fees, sum(case when liquidity = 'maker' then q end) as maker_quantity from al group by run)
select k.run, 1 as n_orders, coalesce(n_fills, 0) as n_fills, round(fees, 6) as fees, maker_quantity, round(max_drawdown, 6) as max_drawdown, max_abs_inventory, round(net_pnl, 6) as net_pnl from kn k left join de using (run) left join af using (run)""")
def replay_single_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each run's fees, largest inventory, drawdown and profit."""
    s = rp.summary(_single(spark, d, "order", "fill", "equity")).withColumn("run", F.col("symbol").cast("long"))
    return rounded(s.select("run", "n_orders", "n_fills", "fees", "maker_quantity", "max_drawdown", "max_abs_inventory", "net_pnl"), 6)


@query(SINGLE + "select k.run, side, p as price, a as start_ms, case when filled = 3 then done when c <= e then c else e end as stop_ms from kn k left join fs1 using (run) where reason is null")
def replay_single_segments(spark: SparkSession, d: str) -> DataFrame:
    """When each of these orders was live."""
    logs = kept(_single(spark, d, "order", "fill"), "single-runs")
    return rp.quote_segments(logs.where("log = 'order'"), logs.where("log = 'fill'")).select(F.col("symbol").cast("long").alias("run"), "side", "price", "start_ms", "stop_ms")


# --- models -----------------------------------------------------------------------------------------------------------


@query(f"with {MONTHLY}, x as (select side, (k2 > 3)::double as late, (k1 % 5 = 0 or k2 > 5)::bigint as count, exposure from mo) select side, late, round(sum(count) / sum(exposure), 7) as rate from x group by 1, 2")
def glm_two_groups(spark: SparkSession, d: str) -> DataFrame:
    """With one feature of two values and no ridge, the fitted rate of a side's group is its events over its exposure."""
    x = feeds.monthly_episodes(spark, d)
    x = x.select("side", (F.col("k2") > 3).cast("double").alias("late"), ((F.col("k1") % 5 == 0) | (F.col("k2") > 5)).cast("long").alias("count"), "exposure")
    m = hz.PoissonGlm(("late",), l2=0.0).fit(x)
    return rounded(m.predict(x.select("side", "late").distinct()).select("side", "late", "rate"), 7)


@query(f"with {MONTHLY}, x as (select l_linenumber as bin, avg((l_returnflag = 'R')::int) as v from lineitem group by 1) select bin, round(v, 8) as observed, round(v, 8) as lower, round(v, 8) as upper from x")
def bootstrap_one_cluster(spark: SparkSession, d: str) -> DataFrame:
    """With one cluster every draw is the sample itself."""
    x = feeds.monthly_episodes(spark, d).select(F.lit("all").alias("cluster"), F.col("k2").cast("int").alias("bin"), F.col("count").alias("event"))
    return rounded(dg.bootstrap_ci(x, "cluster", "bin", "event"))


@query(f"with {MONTHLY} select strftime(month, '%Y-%m') as month, case when month < date '1998-01-01' then 'train' else 'test' end as part, side, count(*) as n from mo where month in (date '1997-12-01', date '1998-01-01') group by month, side")
def month_pair(spark: SparkSession, d: str) -> DataFrame:
    got = wf.month_pair(feeds.monthly_episodes(spark, d), "1997-12", "1998-01")
    return got.groupBy(F.date_format("month", "yyyy-MM").alias("month"), "part", "side").agg(F.count("*").alias("n"))


@query("select event_id, date_trunc('month', ts)::date as from_us, date_trunc('month', ts - interval 45 day)::date as from_s from events")
def month_units(spark: SparkSession, d: str) -> DataFrame:
    """Months of epoch times in microseconds and, 45 days before, in seconds."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    return e.select("event_id", wf.month_of(F.col("us"), "us").alias("from_us"), wf.month_of(F.floor(F.col("us") / 1_000_000) - 45 * 86_400, "s").alias("from_s"))


@query("""with pa as (select p_partkey::bigint as id, (1 + p_partkey % 9) * 0.5::double as horizon, (1 + p_partkey % 7) * 0.1::double as dt from part),
n as (select *, case when abs(horizon / dt - round_even(horizon / dt, 0)) <= 1e-12 * greatest(horizon / dt, 1) then round_even(horizon / dt, 0) else ceil(horizon / dt) end::int as n from pa)
select id, step::int as step, round(case when step = greatest(n, 1) then horizon else least(step * dt, horizon) end, 10) as time from n, lateral (select unnest(generate_series(0, greatest(n, 1))) as step)""")
def time_grids(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    params = spark.read.parquet(f"{d}/part.parquet").select(p.cast("long").alias("id"), ((1 + p % 9) * 0.5).alias("horizon"), ((1 + p % 7) * 0.1).alias("dt"))
    return rounded(gq.time_grids(params), 10)


_VALUES = " union all ".join(f"select id, 1.0::double as tau, {q}::int as q, round(v{q + 2}, 8) as value from vv" for q in range(-2, 3))


@query(_taylor().rpartition(" select id, 1.0::double as tau, -2::int")[0] + " " + _VALUES)
def value_vector(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gq.value_frame(_params(spark, d), [1.0]))


BUNDLE = ", ".join(f"lag(c, {k}) over (partition by series, scope order by ts_ms, k1, k2, c) as l{k}" for k in (1, 2))


@query(f"""with {OOS}, sr as (select 'count' as series, side, ts_ms, k1, k2, count::double as v from oo union all select 'residual', side, ts_ms, k1, k2, residual from oo), sc as (select *, side as scope from sr union all select *, 'all' from sr),
ce as (select series, scope, ts_ms, k1, k2, v - avg(v) over (partition by series, scope) as c from sc), lg as (select series, scope, c, {BUNDLE} from ce), su as (select series, scope, sum(c * c) as d, sum(c * l1) as s1, sum(c * l2) as s2 from lg group by 1, 2)
select series, scope, lag, round(case lag when 0 then 1.0::double when 1 then s1 / d else s2 / d end, 7) as acf from su, (select unnest([0, 1, 2])::int as lag) where d > 2.3e-16 union all select series, scope, lag, case when lag = 0 then 1.0::double else 0.0::double end from su, (select unnest([0, 1, 2])::int as lag) where d <= 2.3e-16""")
def acf_bundle(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dg.acf_bundle(_residuals(spark, d), ORDER, 2), 7)


@query("""select event_id, case when (f + a + c) = 0 then 'none' when f * t1 + (1 - f) * 999 < least(a * t2 + (1 - a) * 999, c * t3 + (1 - c) * 999) then 'fill' when a * t2 + (1 - a) * 999 < c * t3 + (1 - c) * 999 then 'adverse_move' else 'cancel' end as risk
from (select event_id, (event_id % 2 = 0)::int as f, (event_id % 3 = 0)::int as a, (event_id % 5 = 0)::int as c, event_id % 7 * 3 as t1, event_id % 11 * 3 + 1 as t2, event_id % 13 * 3 + 2 as t3 from events)""")
def flagged_risk(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    label = hz.flagged_risk((i % 2 == 0, i % 3 == 0, i % 5 == 0), (i % 7 * 3, i % 11 * 3 + 1, i % 13 * 3 + 2))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", label.alias("risk"))


@query(W + """select sequence, ts_ms, p_ts, p_seq from (select sequence, ts_ms, lag(ts_ms) over w as p_ts, lag(sequence) over w as p_seq from tr window w as (order by sequence % 7, sequence // 64 % 5, sequence))
where p_ts > ts_ms or (p_ts = ts_ms and p_seq > sequence)""")
def source_violations(spark: SparkSession, d: str) -> DataFrame:
    """A trade file out of order: which rows come too late, by their places in the files alone."""
    path, t = new_folder(spark, "unsorted"), feeds.trades(spark, d)
    t.orderBy(F.col("sequence") % 7, F.floor(F.col("sequence") / 64) % 5, "sequence").select(
        F.col("sequence").alias("agg_trade_id"), "price", "quantity", F.col("ts_ms").alias("transact_time"), F.col("buyer_is_maker").alias("is_buyer_maker"),
    ).write.csv(path, header=True)
    return feeds.source_violations(feeds.read_trade_csv(spark, path, "S", source=True)).select("sequence", "ts_ms", "p_ts", "p_seq")


@query(W + "select symbol, ts_ms, sequence, price, quantity, buyer_is_maker from tr where ts_ms >= 1704672000000 and ts_ms < 1705000000000")
def feed_store_window(spark: SparkSession, d: str) -> DataFrame:
    """A stretch of time from a feed kept by symbol and day."""
    path = new_folder(spark, "feed-store")
    feeds.write_feed_store(feeds.trades(spark, d), path)
    return feeds.read_feed_store(spark, path, "S", 1_704_672_000_000, 1_705_000_000_000).select("symbol", "ts_ms", "sequence", "price", "quantity", "buyer_is_maker")


# --- streams ----------------------------------------------------------------------------------------------------------


@query(BIN_ROWS)
def streamed_episode_bins(spark: SparkSession, d: str) -> DataFrame:
    """The episodes of both feeds as a stream: two micro-batches in which rows come up to six hours late, then the end."""
    lateness, source, out, log = 21_600_000, new_folder(spark, "stream-in"), new_folder(spark, "stream-out"), new_folder(spark, "stream-log")
    delay = F.pmod(F.xxhash64("kind", "sequence"), F.lit(lateness))
    rows = kept(live_episodes.feed_rows(feeds.books(spark, d), feeds.trades(spark, d)).withColumn("at", F.col("ts_ms") + delay), "arrivals")
    half = rows.agg(((F.min("at") + F.max("at")) / 2).cast("long")).first()[0]
    for part in (F.col("at") <= half, F.col("at") > half):
        rows.where(part).drop("at").write.mode("append").parquet(source)
        stream = spark.readStream.schema(live_episodes.SCHEMA).parquet(source).writeStream.foreachBatch(live_episodes.episode_stream(out, lateness, FIXTURE))
        stream.option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    live_episodes.finish(spark, out, lateness, FIXTURE)
    return bin_rows(live_episodes.intervals(spark, out))
