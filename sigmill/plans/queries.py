"""One query for each operator of the library, with the SQL that states its definition."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import cross_section as xs
from ..operators import factors as fac
from ..operators import folds, market, panel, performance, portfolio, statistics, weights
from ..sources import io
from ..sources.stage import shared_folder, staged
from . import fixtures as fx
from .fixtures import BARS_SQL, COUNTRY_SQL, FACTORS_SQL, INDEX_SQL, MARKET_SQL, PRICES_SQL, RET_SQL, frame, gate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 8


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS places, whole numbers as long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, DIGITS) + 0.0 if kind == "double" else c.cast("long") if kind in ("int", "bigint") else c).alias(f.name))
    return df.select(*out)


def r(*names: str) -> str:
    return ", ".join(f"round({n}, {DIGITS}) + 0.0 as {n.split('.')[-1]}" for n in names)


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor rows that have a return."""
    return panel.drop_unreturned(fac.add_factors(fx.bars(spark, sf_dir)))


K = "date, ticker"

# sources


@query(f"with {PRICES_SQL}, raw as (select date, ticker, case when substr(ticker, 7, 1) <> '7' then price_eur end as close from prices) select date, ticker, {r('close')} from raw where ticker in (select ticker from raw group by 1 having count(close) > 0)")
def s4_assemble_prices(spark, d):
    raw = fx.prices(spark, d).select("date", "ticker", F.when(F.substring("ticker", 7, 1) != "7", F.col("price_eur")).alias("Close"))
    return io.assemble_prices(raw).withColumnRenamed("Close", "close")


@query(f"""with {INDEX_SQL}, raw as (select date, index_ticker as ticker, case when country = 'ASIA' and extract(day from date) > 10 then null else index_close end as close from index_prices)
select date, ticker, {r('close')}, substr(ticker, 5) as country from raw where ticker in (select ticker from raw group by 1 having count(close) > 0 and avg(case when close is null then 1.0 else 0.0 end) < 0.5)""")
def s5_assemble_index(spark, d):
    index = fx.index_prices(spark, d)
    raw = index.select("date", F.col("index_ticker").alias("ticker"), F.when(~((F.col("country") == "ASIA") & (F.dayofmonth("date") > 10)), F.col("index_close")).alias("Close"))
    names = index.select(F.col("index_ticker").alias("ticker"), F.col("country").alias("Country")).distinct()
    return io.assemble_index(raw, names).toDF("ticker", "date", "close", "country").select("date", "ticker", "close", "country")


@query("select n_name as name, ticker from (select n_name, concat('S', lpad(cast(s_suppkey as varchar(10)), 6, '0')) as ticker, row_number() over (partition by n_name order by s_suppkey desc) as k from supplier join nation on s_nationkey = n_nationkey) where k = 1")
def s6_symbol_map(spark, d):
    s, n = fx.table(spark, d, "supplier"), fx.table(spark, d, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("name"), fx._ticker("s_suppkey").alias("ticker"), "s_suppkey")
    return io.symbol_map(rows, "name", "s_suppkey")


@query(f"with {PRICES_SQL}, m as (select strftime(date, '%Y-%m') as month, ticker from prices group by 1, 2) select month, count(*) as n, min(ticker) as first_ticker from m group by 1")
def s8_parse_ticker_list(spark, d):
    listed = panel.universe_monthly(fx.prices(spark, d)).select("month", F.to_json("tickers").alias("text"))
    text = F.when(F.right("month", F.lit(1)).isin("1", "3"), F.translate("text", '"', "'")).otherwise(F.col("text"))  # Python's quotes for some
    parsed = listed.select("month", io.parse_ticker_list(text).alias("t"))
    return parsed.select("month", F.size("t").alias("n"), F.array_min("t").alias("first_ticker"))


@query(f"with {PRICES_SQL} select date, ticker, round(cast(price_eur as float), 4) as price, cast(volume as float) as volume from prices")
def s10_narrow_doubles(spark, d):
    small = io.narrow_doubles(fx.prices(spark, d))
    return small.select("date", "ticker", F.round("price_eur", 4).alias("price"), "volume")


@query(f"with {PRICES_SQL} select {K}, {r('price_eur', 'volume')} from prices")
def s3_export_round_trip(spark, d):
    """Exports the bars (S3, S9), finds the export again (S2, S7) and reads it."""
    folder = f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"
    io.write_artefacts({"factors_daily": fx.prices(spark, d)}, folder)
    return io.load_exports(spark, folder)["panel"].select("date", "ticker", "price_eur", "volume")


@query(f"with {PRICES_SQL} select {K}, {r('price_eur', 'volume')} from prices")
def s1_read_csv(spark, d):
    """Exports the bars and reads their CSV."""
    base = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    io.export(fx.prices(spark, d), base)
    return io.read_csv_flex(spark, f"{base}.csv", "date date, ticker string, price_eur double, volume double").select("date", "ticker", "price_eur", "volume")


# projections and filters


def _raw(spark, d):
    """Bars as text with faults: bad dates, bad closes, repeated keys."""
    lines = fx.table(spark, d, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    day = F.when(key % 101 == 0, F.lit("no date")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    close = F.when(key % 97 == 0, F.lit("n/a")).otherwise((F.round(F.col("l_extendedprice") * 100).cast("long")).cast("string"))
    return lines.select(day.alias("Date"), close.alias("Close"), F.col("l_quantity").cast("string").alias("Volume"), fx._ticker("l_suppkey").alias("Ticker_YF"), F.lit("SEC").alias("Supersector"), F.col("l_returnflag").alias("Country"), key.alias("ord"))


_RAW_SQL = """raw as (select case when (l_orderkey * 10 + l_linenumber) % 101 = 0 then null else cast(l_shipdate as date) end as date,
 concat('S', lpad(cast(l_suppkey as varchar(10)), 6, '0')) as ticker, case when (l_orderkey * 10 + l_linenumber) % 97 = 0 then null else cast(cast(round(l_extendedprice*100) as bigint) as double) end as price_eur,
 cast(l_quantity as double) as volume, l_returnflag as country, l_orderkey * 10 + l_linenumber as ord from lineitem)"""


@query(f"with {_RAW_SQL} select date, ticker, {r('price_eur', 'volume')}, 'SEC' as supersector, country from raw where date is not null and price_eur is not null")
def p1_standardize_prices(spark, d):
    return panel.standardize_prices(_raw(spark, d))


@query(f"with {_RAW_SQL} select date, ticker, {r('price_eur')}, ord from (select *, row_number() over (partition by ticker, date order by ord) as k from raw where date is not null and price_eur is not null) where k = 1")
def p2_dedupe_daily(spark, d):
    typed = _raw(spark, d).select(cal.to_date(F.col("Date")).alias("date"), F.col("Ticker_YF").alias("ticker"), F.col("Close").try_cast("double").alias("price_eur"), "ord").dropna()
    return panel.dedupe_daily(typed, "ord")


@query(f"with {INDEX_SQL} select date, case when country = 'ASIA' then 'APAC' else country end as country, index_ticker, {r('index_close')} from index_prices where extract(day from date) <> 5")
def p3_standardize_index(spark, d):
    index = fx.index_prices(spark, d)
    text = index.select(F.when(F.dayofmonth("date") == 5, "?").otherwise(F.col("date").cast("string")).alias("DATE"), F.col("country").alias("Country"), F.col("index_ticker").alias("Ticker"), F.col("index_close").cast("string").alias("close"))
    return panel.standardize_index(text, {"ASIA": "APAC"})


@query(f"with {RET_SQL} select {K}, {r('ret_1d_eur')} from ret where ret_1d_eur is not null")
def p4_drop_unreturned(spark, d):
    return panel.drop_unreturned(fac.add_returns(fx.bars(spark, d))).select("date", "ticker", "ret_1d_eur")


@query(f"with {FACTORS_SQL}, {COUNTRY_SQL} select f.date, f.ticker, round(f.ret_1d_eur - c.country_mkt_ret_1d, {DIGITS}) + 0.0 as ret from factors f left join country_market c on f.country = c.country and f.date = c.date")
def p5_pick_return(spark, d):
    df = _with_country(spark, d)
    return df.select("date", "ticker", panel.pick_return(df).alias("ret"))


@query(f"with {BARS_SQL} select {K} from bars where date in (select max(date) from bars group by date_trunc('month', date))")
def p6_month_end_rows(spark, d):
    return panel.month_end_rows(fx.bars(spark, d)).select("date", "ticker")


_LAST_WEEKDAY = "(last_day(date) - cast(greatest(isodow(last_day(date)) - 5, 0) as integer))"


@query(f"with {PRICES_SQL} select distinct date, date = {_LAST_WEEKDAY} as month_end, isodow(date) = 5 as week_end from prices")
def p7_rebalance_flag(spark, d):
    days = fx.prices(spark, d).select("date").distinct()
    return days.select("date", cal.is_rebalance(F.col("date"), "M").alias("month_end"), cal.is_rebalance(F.col("date"), "W").alias("week_end"))


@query(f"with {PRICES_SQL} select distinct date, last_day(date) as month_end, last_day(date) between date '1996-01-31' and date '1997-06-30' as inside from prices")
def p8_month_range(spark, d):
    days = fx.prices(spark, d).select("date").distinct()
    return days.select("date", cal.month_end(F.col("date")).alias("month_end"), cal.in_months(F.col("date"), F.lit("1996-01-31").cast("date"), F.lit("1997-06-30").cast("date")).alias("inside"))


@query(f"with {PRICES_SQL}, days as (select distinct date, isodow(date) as w from prices) select date, date + cast(case when w = 5 then 3 when w = 6 then 2 when w = 7 then 1 else 1 end as integer) as next_1, date + cast(case when w <= 2 then 3 when w <= 5 then 5 when w = 6 then 4 else 3 end as integer) as next_3 from days")
def p9_embargo(spark, d):
    days = fx.prices(spark, d).select("date").distinct()
    return days.select("date", cal.add_business_days(F.col("date"), 1).alias("next_1"), cal.add_business_days(F.col("date"), 3).alias("next_3"))


@query(f"""with {FACTORS_SQL}, {COUNTRY_SQL}, x as (select f.date, f.ticker, f.ret_1d_eur, f.ret_1d_eur - c.country_mkt_ret_1d as ex from factors f left join country_market c on f.country = c.country and f.date = c.date),
q as (select quantile_cont(ex, 0.01) as el, quantile_cont(ex, 0.99) as eh, quantile_cont(ret_1d_eur, 0.01) as rl, quantile_cont(ret_1d_eur, 0.99) as rh from x)
select date, ticker, round(coalesce(case when ex is not null then least(greatest(ex, el), eh) end, least(greatest(ret_1d_eur, rl), rh)), {DIGITS}) + 0.0 as ret_effective from x, q""")
def p10_effective_return(spark, d):
    return panel.effective_return(_with_country(spark, d)).select("date", "ticker", "ret_effective")


_ALL = ["mom_12_1", "mom_6_1", "vol_60d", "vol_252d", "adv_eur_20", "hi52_prox", "amihud_20d", "zero_ret_20d", "rev_5d", "size_proxy", "liq_proxy", "max5_21d"]


@query(f"with {FACTORS_SQL} " + " union all ".join(f"select '{f}' as factor, count({f}) as non_null from factors" for f in _ALL))
def p11_factor_columns(spark, d):
    df = built(spark, d)
    return statistics.completeness(df, panel.factor_columns(df)).select("factor", "non_null")


@query(f"with {_RAW_SQL} select ticker, date, count(*) as n_rows from raw where date is not null group by 1, 2 having count(*) > 1")
def p13_key_faults(spark, d):
    return panel.key_faults(_raw(spark, d).select(F.col("Ticker_YF").alias("ticker"), cal.to_date(F.col("Date")).alias("date")).dropna())


@query(f"with {FACTORS_SQL} select {K}, {r('mom_6_1')} from factors where date = (select max(date) from factors) and mom_6_1 is not null")
def p14_snapshot(spark, d):
    return panel.snapshot(built(spark, d), ["mom_6_1"]).select("date", "ticker", "mom_6_1")


# joins


@query(f"with {BARS_SQL} select {K}, country, supersector, {r('price_eur')} from bars")
def j1_crosswalk(spark, d):
    return fx.bars(spark, d).select("date", "ticker", "country", "supersector", "price_eur")


def _with_country(spark, d):
    return market.add_country_market(built(spark, d), market.country_market_returns(fx.index_prices(spark, d)))


@query(f"with {FACTORS_SQL}, {COUNTRY_SQL} select f.date, f.ticker, {r('c.country_mkt_ret_1d')}, round(f.ret_1d_eur - c.country_mkt_ret_1d, {DIGITS}) + 0.0 as excess_ret_1d_eur from factors f left join country_market c on f.country = c.country and f.date = c.date")
def j2_country_return(spark, d):
    return _with_country(spark, d).select("date", "ticker", "country_mkt_ret_1d", "excess_ret_1d_eur")


@query(f"with {FACTORS_SQL}, {MARKET_SQL} select f.date, f.ticker, {r('g.mkt_ret')} from factors f join global_market g on f.date = g.date")
def j3_global_market(spark, d):
    return market.add_market(built(spark, d), "global").select("date", "ticker", "mkt_ret")


@query(f"with {BARS_SQL} select {K} from bars b where exists (select 1 from bars u where u.ticker = b.ticker and last_day(u.date) = last_day(b.date) and extract(day from u.date) <= 15)")
def j4_universe_filter(spark, d):
    bars = fx.bars(spark, d)
    return panel.universe_filter(bars, panel.universe_monthly(bars.filter(F.dayofmonth("date") <= 15))).select("date", "ticker")


# holdings that several queries share: long-only on momentum
_HOLD_SQL = f"""{FACTORS_SQL}, reb as (select date, ticker, mom_6_1 as s from factors where date = {_LAST_WEEKDAY}),
rk as (select *, count(s) over (partition by date) as n, row_number() over (partition by date order by s desc nulls last, ticker) as t from reb),
hold as (select date, ticker, case when t <= greatest(1, floor(n * cast(0.2 as double))) then 1.0 / greatest(1, floor(n * cast(0.2 as double))) else 0.0 end as w from rk where n > 0),
rebs as (select distinct date as reb_id from hold)"""
_TURN_SQL = f"""{_HOLD_SQL}, nx as (select reb_id, lead(reb_id) over (order by reb_id) as nxt from rebs),
moves as (select date as reb_id, ticker, w from hold union all select n.nxt, h.ticker, -h.w from hold h join nx n on h.date = n.reb_id where n.nxt is not null),
turn as (select reb_id, case when reb_id = (select min(reb_id) from rebs) then 0.0 else sum(abs(dw)) end as turnover from (select reb_id, ticker, sum(w) as dw from moves group by 1, 2) group by 1)"""
_HELD_SQL = f"""{_TURN_SQL}, held as (select f.date, f.ticker, f.ret_1d_eur, (select max(reb_id) from rebs where reb_id <= f.date) as reb_id from factors f),
port as (select d.date, d.reb_id, coalesce(sum(d.ret_1d_eur * coalesce(h.w, 0)), 0) as gross from held d left join hold h on d.reb_id = h.date and d.ticker = h.ticker where d.date > d.reb_id group by 1, 2),
net as (select p.date, p.reb_id, p.gross - case when p.date = (select min(date) from port q where q.reb_id = p.reb_id) then coalesce(t.turnover, 0) * 5.0 / 10000 else 0 end as ret_port from port p left join turn t on p.reb_id = t.reb_id)"""


def _holdings(spark, d):
    df = built(spark, d)
    return df, portfolio.long_only(df, "mom_6_1")


@query(f"with {_HELD_SQL} select date, ticker, reb_id from held where date > reb_id")
def j5_held_since(spark, d):
    df, hold = _holdings(spark, d)
    return portfolio.held_since(df.select("date", "ticker"), hold).select("date", "ticker", "reb_id")


@query(f"with {_TURN_SQL} select reb_id, {r('turnover')} from turn")
def j7_turnover(spark, d):
    return portfolio.turnover(_holdings(spark, d)[1])


@query(f"with {_HELD_SQL} select date, reb_id, {r('ret_port')} from net")
def a22_portfolio_returns(spark, d):
    df, hold = _holdings(spark, d)
    return portfolio.portfolio_returns(df, hold, "ret_1d_eur", 5.0)


# aggregations


@query(f"with {PRICES_SQL} select strftime(date, '%Y-%m') as month, last_day(date) as month_end, count(distinct ticker) as n, string_agg(distinct ticker, ',' order by ticker) as tickers from prices group by 1, 2")
def a1_universe(spark, d):
    return panel.universe_monthly(fx.prices(spark, d)).select("month", "month_end", F.size("tickers").alias("n"), F.array_join("tickers", ",").alias("tickers"))


@query(f"with {COUNTRY_SQL} select country, date, {r('country_mkt_ret_1d')} from country_market")
def a2_country_market(spark, d):
    return market.country_market_returns(fx.index_prices(spark, d))


@query(f"with {FACTORS_SQL}, {MARKET_SQL} select date, {r('mkt_ret')} from global_market")
def a3_global_market(spark, d):
    return market.global_market(built(spark, d))


_FS = ["mom_12_1", "mom_6_1", "rev_5d", "vol_60d", "size_proxy"]


@query(f"""with {FACTORS_SQL}, c as (select date, count(*) as rows_, {", ".join(f"count({f}) as {f}" for f in _FS)} from factors group by 1), l as (unpivot c on {", ".join(_FS)} into name factor value n)
select factor, cast(sum(n) as bigint) as non_null, cast(sum(rows_) as bigint) as total_rows, round(100.0 * sum(n) / sum(rows_), {DIGITS}) as pct_non_null, round(avg(n), {DIGITS}) as avg_names_per_date, min(case when n > 0 then date end) as first_date, max(case when n > 0 then date end) as last_date from l group by 1""")
def a4_completeness(spark, d):
    return statistics.completeness(built(spark, d), _FS)


@query(f"with {FACTORS_SQL} select date, {', '.join(f'count({f}) as {f}' for f in _FS)} from factors group by 1")
def a5_daily_coverage(spark, d):
    return statistics.daily_coverage(built(spark, d), _FS)


_ZS = ["mom_6_1", "rev_5d", "vol_60d"]
_EOM_SQL = f"""{FACTORS_SQL}, eom as (select * from factors where date in (select max(date) from factors group by date_trunc('month', date))),
z as (select date, ticker, country, supersector, {", ".join(f"case when stddev_pop({f}) over w = 0 then {f} * 0.0 else ({f} - avg({f}) over w) / stddev_pop({f}) over w end as {f}_z" for f in _ZS)} from eom window w as (partition by date))"""


def _corr_sql(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def _matrix_sql(source: str, names: list[str], tail: str = "", extra: str = "") -> str:
    return " union all ".join(f"select {extra}'{a}' as f1, '{b}' as f2, {_corr_sql(a, b)} as c from {source}{tail}" for a in names for b in names)


_ZN = [f"{f}_z" for f in _ZS]
_COMPLETE = " and ".join(f"{f} is not null" for f in _ZN)


@query(f"with {_EOM_SQL}, x as (select * from z where {_COMPLETE} and date = (select max(date) from z)) select f1, f2, round(c, {DIGITS}) + 0.0 as corr from ({_matrix_sql('x', _ZN)})")
def a6_correlation_latest(spark, d):
    return statistics.correlation_latest(xs.month_end_scores(built(spark, d), _ZS), _ZN)


@query(f"with {_EOM_SQL}, x as (select * from z where {_COMPLETE}), ok as (select * from x where date in (select date from x group by 1 having count(*) >= 3)) select f1, f2, round(case when count(c) > 0 then sum(c) / count(*) end, {DIGITS}) + 0.0 as corr from ({_matrix_sql('ok', _ZN, ' group by date')}) group by 1, 2")
def a7_correlation_average(spark, d):
    return statistics.correlation_average(xs.month_end_scores(built(spark, d), _ZS), _ZN)


@query(f"with {PRICES_SQL} select date, count(distinct ticker) as n_tickers from prices group by 1")
def a8_coverage_by_date(spark, d):
    return statistics.coverage_by_date(fx.prices(spark, d))


@query(f"with {FACTORS_SQL} select date, {', '.join(f'round(1 - count({f}) * 1.0 / count(*), {DIGITS}) as {f}' for f in _FS)} from factors group by 1")
def a9_null_share(spark, d):
    return statistics.null_share_by_date(built(spark, d), _FS)


@query(f"with {FACTORS_SQL} select country, round(avg(vol_60d), {DIGITS}) as mean from factors where date = date '1999-03-15' and vol_60d is not null and country is not null group by 1")
def a10_mean_by_group(spark, d):
    return statistics.mean_by_group(built(spark, d), "country", "vol_60d", "1999-03-15")


_RANKED = ", ".join(f"rank() over (order by {f}) + (count(*) over (partition by {f}) - 1) / 2.0 as {f}" for f in _ZS)


@query(f"""with {FACTORS_SQL}, x as (select * from factors where date = date '1999-03-15' and {" and ".join(f"{f} is not null" for f in _ZS)}), rk as (select {_RANKED} from x)
select a.f1, a.f2, round(a.c, {DIGITS}) + 0.0 as pearson, round(b.c, {DIGITS}) + 0.0 as spearman from ({_matrix_sql("x", _ZS)}) a join ({_matrix_sql("rk", _ZS)}) b on a.f1 = b.f1 and a.f2 = b.f2""")
def a11_correlation_table(spark, d):
    return statistics.correlation_table(built(spark, d), _ZS, "1999-03-15")


@query(f"with {FACTORS_SQL}, l as (select min(vol_60d) as lo, max(vol_60d) as hi from factors) select cast(least(floor((vol_60d - lo) / (hi - lo) * 30) + 1, 30) as bigint) as bin, count(*) as n from factors, l where vol_60d is not null group by 1")
def a12_histogram(spark, d):
    return statistics.histogram(built(spark, d), "vol_60d", 30)


@query(f"""with {FACTORS_SQL}, x as (select *, row_number() over (order by mom_6_1, ticker) as r, count(*) over () as n from factors where date = date '1999-03-15' and mom_6_1 is not null)
select cast(greatest(1, ceil(5.0 * (r - 1) / (n - 1))) as bigint) as bucket, round(avg(ret_1d_eur), {DIGITS}) + 0.0 as mean, count(*) as n from x group by 1""")
def a13_quantile_means(spark, d):
    return statistics.quantile_means(built(spark, d), "mom_6_1", "ret_1d_eur", 5, "1999-03-15")


_NEXT_DAY = "(date + cast(case when isodow(date) = 5 then 3 when isodow(date) = 6 then 2 else 1 end as integer))"
_FWD = "case when count(ret_1d_eur) over (partition by ticker order by date rows between 1 following and {h} following) = {h} then product(1 + ret_1d_eur) over (partition by ticker order by date rows between 1 following and {h} following) - 1 end"
_IC_SQL = f"""{FACTORS_SQL}, f40 as (select *, {_FWD.format(h=40)} as fwd_40d from factors),
m as (select *, {_NEXT_DAY} as d from f40 where date = {_LAST_WEEKDAY}), days as (select d, count(distinct ticker) as n, max(last_day(date)) as month from m group by 1),
long as ({" union all ".join(f"select d, '{f}' as factor, {f} as x, fwd_40d as y from m where {f} is not null and fwd_40d is not null" for f in _ZS)}),
rk as (select d, factor, rank() over (partition by d, factor order by x) + (count(*) over (partition by d, factor, x) - 1) / 2.0 as x, rank() over (partition by d, factor order by y) + (count(*) over (partition by d, factor, y) - 1) / 2.0 as y from long),
ics as (select d, factor, case when count(*) >= 10 then {_corr_sql("x", "y")} end as ic from rk group by 1, 2),
ic as (select g.d as date, g.month, g.n, f.factor, case when g.n >= 10 then i.ic end as ic from days g cross join (select unnest([{", ".join(f"'{f}'" for f in _ZS)}]) as factor) f left join ics i on i.d = g.d and i.factor = f.factor)"""


def _ic(spark, d):
    df = fac.add_forward_returns(built(spark, d), horizons=(40,))
    return statistics.ic_timeseries(statistics.with_embargo(df), _ZS, "fwd_40d", "M")


@query(f"with {_IC_SQL} select date, factor, {r('ic')}, n, month from ic")
def a14_ic_timeseries(spark, d):
    return _ic(spark, d)


_SUM_SQL = f"""{_IC_SQL}, v as (select factor, ic, row_number() over (partition by factor order by date) as i, ic - avg(ic) over (partition by factor) as c from ic where ic is not null),
g as (select a.factor, sum(2 * (1 - (b.i - a.i) / 40.0) * a.c * b.c) as g from v a join v b on a.factor = b.factor and b.i - a.i between 1 and 39 group by 1),
s as (select v.factor, avg(ic) as mean, stddev_samp(ic) as std, avg(ic) / stddev_samp(ic) * sqrt(12.0) as ir_ann, avg(case when ic > 0 then 1.0 else 0.0 end) as hit_rate, count(*) as n, sum(c * c) as g0 from v group by 1),
summ as (select s.*, case when n >= 5 and (g0 + g.g) / n > 0 then mean / sqrt((g0 + g.g) / n / n) end as t_nw from s left join g on s.factor = g.factor)"""


@query(f"with {_SUM_SQL} select factor, {r('mean', 'std', 'ir_ann', 'hit_rate')}, n from summ")
def a15_ic_summary(spark, d):
    return statistics.ic_summary(_ic(spark, d), "M", 40).select("factor", "mean", "std", F.col("IR_ann").alias("ir_ann"), "hit_rate", "n")


@query(f"with {_SUM_SQL} select factor, {r('t_nw')} from summ")
def a16_newey_west(spark, d):
    return statistics.newey_west(_ic(spark, d), 39).select("factor", F.col("t_NW").alias("t_nw"))


#: erfc(z) = 1 - 2 / sqrt(pi) * exp(-z * z) * sum of 4^k * k! / (2k + 1)! * z^(2k + 1); SQL has no erfc.
_ERFC = "1 - 2 / sqrt(pi()) * exp(-t_nw * t_nw / 2) * list_sum(list_transform(range(0, 80), lambda k: pow(4.0, k) * gamma(k + 1) / gamma(2 * k + 2) * pow(abs(t_nw) / sqrt(2.0), 2 * k + 1)))"


@query(f"""with {_SUM_SQL}, pv as (select factor, case when abs(t_nw) > 6 then 0.0 when t_nw is not null then {_ERFC} end as p from (select distinct factor from ic) left join summ using (factor)),
o as (select *, row_number() over (order by coalesce(p, 1), factor) as i, count(*) over () as m from pv)
select factor, {r('p')}, round(least(1.0, min(m * coalesce(p, 1) / i) over (order by i desc rows between unbounded preceding and current row)), {DIGITS}) + 0.0 as q from o""")
def a17_significance(spark, d):
    return statistics.ic_significance(_ic(spark, d), "M", 40).select("factor", F.col("p_NW").alias("p"), F.col("q_BH").alias("q"))


_PSQL = f"{_IC_SQL}, p as (select factor, 1 - avg(case when ic > 0 then 1.0 else 0.0 end) as p, avg(ic) as mean from ic where ic is not null group by 1), o as (select *, row_number() over (order by p, factor) as i, count(*) over () as m from p), bh as (select factor, mean, least(1.0, min(m * p / i) over (order by i desc rows between unbounded preceding and current row)) as q from o)"


def _p_values(spark, d):
    """A p value that SQL can state: the share of non-positive ICs."""
    ic = _ic(spark, d).filter("ic is not null")
    return statistics.fdr_bh(ic.groupBy("factor").agg((1 - F.avg((F.col("ic") > 0).cast("double"))).alias("p_NW"), F.avg("ic").alias("mean")))


@query(f"with {_PSQL} select factor, {r('q')} from bh")
def a17_fdr_bh(spark, d):
    return _p_values(spark, d).select("factor", F.col("q_BH").alias("q"))


@query(f"with {_PSQL}, k as (select *, max(case when q <= 0.1 and mean > 0 then 1 else 0 end) over () as any_ok, row_number() over (order by mean desc, factor) as k from bh) select factor, {r('mean')} from k where case when any_ok = 1 then q <= 0.1 and mean > 0 else k <= 5 end")
def p12_select_factors(spark, d):
    return statistics.select_factors(_p_values(spark, d)).select("factor", "mean")


_ICW_SQL = f"""{_IC_SQL}, mm as (select factor, avg(ic) as mean from ic where ic is not null group by 1), th as (select quantile_cont(abs(mean), 0.2) as t from mm),
ss as (select factor, case when abs(mean) >= t then mean else 0.0 end as s from mm, th), icw as (select factor, 0.5 * (case when s <> 0 then 1.0 / sum(case when s <> 0 then 1 else 0 end) over () else 0.0 end) + 0.5 * s / sum(abs(s)) over () as weight from ss)"""


@query(f"with {_ICW_SQL} select factor, {r('weight')} from icw")
def a18_ic_weights(spark, d):
    return weights.ic_weights(_ic(spark, d).groupBy("factor").agg(F.avg("ic").alias("mean")))


@query(f"""with {FACTORS_SQL}, f5 as (select *, {_FWD.format(h=5)} as fwd_5d from factors), x as (select date, mom_6_1 as x, fwd_5d as y from f5 where mom_6_1 is not null and fwd_5d is not null),
b as (select date, sum(x * y) / (sum(x * x) + 2.0) as b from x group by 1 having count(*) >= 15 and stddev_pop(x) > 0) select 'mom_6_1' as factor, round(coalesce((0.5 + 0.5 * avg(b)) / (0.5 + 0.5 * avg(b)), 1), {DIGITS}) as weight from b""")
def a19_ridge_one(spark, d):
    return weights.ridge_weights(fac.add_forward_returns(built(spark, d), horizons=(5,)), ["mom_6_1"], "fwd_5d")


@query(f"""with {FACTORS_SQL}, f5 as (select *, {_FWD.format(h=5)} as fwd_5d from factors), x as (select date, mom_6_1 as a, vol_60d as b, fwd_5d as y from f5 where mom_6_1 is not null and vol_60d is not null and fwd_5d is not null),
m as (select date, sum(a*a) + 2.0 as aa, sum(a*b) as ab, sum(b*b) + 2.0 as bb, sum(a*y) as ay, sum(b*y) as yb from x group by 1 having count(*) >= 15),
s as (select coalesce(avg((bb*ay - ab*yb) / (aa*bb - ab*ab)), 1) as wa, coalesce(avg((aa*yb - ab*ay) / (aa*bb - ab*ab)), 1) as wb from m), w as (select 0.25 + 0.5 * wa as wa, 0.25 + 0.5 * wb as wb from s)
select 'mom_6_1' as factor, round(wa / (wa + wb), {DIGITS}) as weight from w union all select 'vol_60d', round(wb / (wa + wb), {DIGITS}) from w""")
def a19_ridge_weights(spark, d):
    return weights.ridge_weights(fac.add_forward_returns(built(spark, d), horizons=(5,)), ["mom_6_1", "vol_60d"], "fwd_5d")


_SERIES_SQL = f"{_HELD_SQL}, series as (select 'momentum' as strategy, date, ret_port as ret from net)"
_CURVE_SQL = f"{_SERIES_SQL}, curve as (select *, product(1 + ret) over (partition by strategy order by date rows between unbounded preceding and current row) as equity from series), dd as (select *, equity / max(equity) over (partition by strategy order by date rows between unbounded preceding and current row) - 1 as drawdown from curve)"


def _series(spark, d):
    df, hold = _holdings(spark, d)
    return portfolio.portfolio_returns(df, hold, "ret_1d_eur", 5.0).select(F.lit("momentum").alias("strategy"), "date", F.col("ret_port").alias("ret"))


@query(f"with {_CURVE_SQL} select strategy, round(pow(product(1 + ret), 252.0 / count(*)) - 1, {DIGITS}) + 0.0 as ann_ret, round(stddev_samp(ret) * sqrt(252.0), {DIGITS}) as ann_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252.0), {DIGITS}) + 0.0 as sharpe, round(min(drawdown), {DIGITS}) as max_dd from dd group by 1")
def a20_perf_summary(spark, d):
    return performance.perf_summary(_series(spark, d))


@query(f"with {PRICES_SQL}, t as (select ticker as strategy, date, datediff('day', lag(date) over (partition by ticker order by date), date) as g from prices where isodow(date) = 5 or ticker < 'S000050'), s as (select strategy, count(*) as n, median(g) as m from t group by 1) select strategy, cast(case when n < 40 or m is null or m <= 0 then 252 when m >= 18 then 12 when m >= 3 then 52 else 252 end as bigint) as ppy from s")
def a21_periods_per_year(spark, d):
    rows = fx.prices(spark, d).filter((F.weekday("date") == 4) | (F.col("ticker") < "S000050"))
    return performance.periods_per_year(rows.select(F.col("ticker").alias("strategy"), "date"))


# windows


def _factor_query(name: str, *columns: str) -> None:
    def run(spark, d):
        return built(spark, d).select("date", "ticker", *columns)

    query(f"with {FACTORS_SQL} select {K}, {r(*columns)} from factors", name)(run)


for _name, _columns in {
    "w1_ret_1d": ("ret_1d_eur",), "w2_mom_12_1": ("mom_12_1",), "w3_mom_6_1": ("mom_6_1",), "w4_rev_5d": ("ret_5d", "rev_5d"), "w5_volatility": ("vol_60d", "vol_252d"),
    "w6_size": ("size_proxy",), "w7_hi52_prox": ("hi52_prox",), "w8_liquidity": ("liq_proxy",), "w9_zero_ret": ("zero_ret_20d",), "w10_max5": ("max5_21d",),
}.items():
    _factor_query(_name, *_columns)


@query(f"with {FACTORS_SQL} select {K}, round(ln(turnover_eur), 8) + 0.0 as log_turnover, round(ln(adv_eur_20), 8) + 0.0 as log_adv from factors")
def w6_turnover(spark, d):
    return built(spark, d).select("date", "ticker", F.ln("turnover_eur").alias("log_turnover"), F.ln("adv_eur_20").alias("log_adv"))


@query(f"with {FACTORS_SQL} select {K}, round(case when country is not null then mom_6_1 - median(mom_6_1) over (partition by date, country) end, {DIGITS}) + 0.0 as country_rel_mom_6_1, round(case when supersector is not null then mom_6_1 - median(mom_6_1) over (partition by date, supersector) end, {DIGITS}) + 0.0 as sector_rel_mom_6_1 from factors")
def w11_relative_momentum(spark, d):
    return xs.add_groups(built(spark, d)).select("date", "ticker", "country_rel_mom_6_1", "sector_rel_mom_6_1")


def _bucket_sql(c: str) -> str:
    return f"case when len({c}_e) > 1 and {c} >= {c}_e[1] then cast(greatest(len(list_filter({c}_e, lambda e: e < {c})) - 1, 0) as bigint) end"


@query(f"""with {FACTORS_SQL}, e as (select date, list_sort(list_distinct(quantile_cont(size_proxy, [0.2, 0.4, 0.6, 0.8, 1.0]))) as size_proxy_e, list_sort(list_distinct(quantile_cont(liq_proxy, [0.2, 0.4, 0.6, 0.8, 1.0]))) as liq_proxy_e from factors group by 1)
select f.date, f.ticker, {_bucket_sql("size_proxy")} as size_bucket, {_bucket_sql("liq_proxy")} as liq_bucket from factors f join e on f.date = e.date""")
def w12_buckets(spark, d):
    return xs.add_groups(built(spark, d)).select("date", "ticker", "size_bucket", "liq_bucket")


_NEAR = " or ".join(f"abs(ratio - {k!r}) <= 0.02 + 1e-5 * {k!r}" for x in fac.RATIOS for k in (float(x), 1.0 / x))


@query(f"with {BARS_SQL}, x as (select date, ticker, volume, price_eur / lag(price_eur) over (partition by ticker order by date) as ratio, lag(volume) over (partition by ticker order by date) as pv from bars) select ticker, date, {r('ratio')} from x where ({_NEAR}) and abs(volume / pv - 1) > 1")
def w13_splits(spark, d):
    return fac.detect_splits(fx.bars(spark, d))


_BETA_SQL = f"""{FACTORS_SQL}, {MARKET_SQL}, fm as (select f.*, g.mkt_ret from factors f join global_market g on f.date = g.date),
betas as (select *, {gate("regr_slope(ret_1d_eur, mkt_ret)", "mkt_ret", 252, 200)} as beta_252, {gate("regr_slope(ret_1d_eur, mkt_ret)", "mkt_ret", 60, 40)} as beta_60 from fm)"""


def _betas(spark, d):
    return market.add_betas(market.add_market(built(spark, d), "global"))


@query(f"with {_BETA_SQL} select {K}, {r('beta_252', 'beta_60')} from betas")
def w14_betas(spark, d):
    return _betas(spark, d).select("date", "ticker", "beta_252", "beta_60")


@query(f"""with {_BETA_SQL}, mo as (select *, {", ".join(f"{gate(f'avg({e})', e, 252, 200)} as {n}" for n, e in (("er", "ret_1d_eur"), ("em", "mkt_ret"), ("erm", "ret_1d_eur * mkt_ret"), ("er2", "ret_1d_eur * ret_1d_eur"), ("em2", "mkt_ret * mkt_ret")))}, count(ret_1d_eur) {frame(252)} as n from betas),
v as (select *, em2 - em * em as vm, greatest(er2 - er * er - 2 * beta_252 * (erm - er * em) + beta_252 * beta_252 * (em2 - em * em), 0) as vr from mo)
select {K}, round(case when vm is not null and beta_252 is not null then beta_252 / nullif(sqrt(n * vr / ((n - 2) * vm)), 0) end, 5) as beta_tstat from v""")
def w15_beta_tstat(spark, d):
    return market.beta_tstat(_betas(spark, d)).select("date", "ticker", F.round("beta_tstat", 5).alias("beta_tstat"))


_HALF = "extract(month from f.date) between 1 and 9"
_FLAT_SQL = f"""{FACTORS_SQL}, {MARKET_SQL}, fm as (select f.*, case when {_HALF} then 0.003 else g.mkt_ret end as mkt_ret from factors f join global_market g on f.date = g.date)"""


@query(f"""with {_FLAT_SQL}, n as (select *, count(distinct mkt_ret) {frame(60)} as k from fm)
select {K}, round(case when k > 1 then {gate("regr_slope(ret_1d_eur, mkt_ret)", "mkt_ret", 60, 40)} end, 3) + 0.0 as beta_60 from n""")
def w14_flat_market(spark, d):
    """Betas where the market stands still for most of the year: none in windows in which it does not vary."""
    df = market.add_market(built(spark, d), "global").withColumn("mkt_ret", F.when(F.month("date") <= 9, F.lit(0.003)).otherwise(F.col("mkt_ret")))
    return market.add_betas(df).select("date", "ticker", (F.round("beta_60", 3) + 0.0).alias("beta_60"))


@query(f"with {FACTORS_SQL} select {K}, {', '.join(f'round({_FWD.format(h=h)}, {DIGITS}) + 0.0 as fwd_{h}d' for h in fac.HORIZONS)} from factors")
def w16_forward_returns(spark, d):
    return fac.add_forward_returns(built(spark, d)).select("date", "ticker", *(f"fwd_{h}d" for h in fac.HORIZONS))


@query(f"""with {FACTORS_SQL}, x as (select date, ticker, {", ".join(f"({c} - {gate(f'avg({c})', c, 60, 40)}) / ({gate(f'stddev_samp({c})', c, 60, 40)} + 1e-9) as {n}" for n, c in (("vol_z", "volume"), ("ret_z", "ret_1d_eur")))} from factors)
select {K}, {r("vol_z", "ret_z")}, cast(case when coalesce(abs(vol_z) > 3, false) or coalesce(abs(ret_z) > 3, false) then 1 else 0 end as bigint) as shock_day from x""")
def w17_shock_tags(spark, d):
    return fac.shock_tags(built(spark, d))


@query(f"with {_EOM_SQL} select {K}, {r(*_ZN)} from z")
def w18_zscore(spark, d):
    return xs.month_end_scores(built(spark, d), _ZS).select("date", "ticker", *_ZN)


@query(f"""with {FACTORS_SQL}, m as (select date, ticker, vol_60d as x, median(vol_60d) over (partition by date) as med, stddev_pop(vol_60d) over (partition by date) as sd from factors), a as (select *, 1.4826 * median(abs(x - med)) over (partition by date) as mad from m)
select {K}, round((x - med) / case when mad > 0 then mad when sd > 0 then sd else 1.0 end, {DIGITS}) + 0.0 as z from a""")
def w19_robust_z(spark, d):
    return xs.add_robust_z(built(spark, d), "vol_60d", "z").select("date", "ticker", "z")


@query(f"with {FACTORS_SQL}, q as (select date, quantile_cont(mom_6_1, 0.01) as lo, quantile_cont(mom_6_1, 0.99) as hi from factors group by 1) select f.date, f.ticker, round(case when mom_6_1 is not null then least(greatest(mom_6_1, lo), hi) end, {DIGITS}) + 0.0 as x from factors f join q on f.date = q.date")
def w20_winsorize(spark, d):
    return built(spark, d).select("date", "ticker", xs.winsorize("mom_6_1").alias("x"))


@query(f"with {FACTORS_SQL}, q as (select quantile_cont(ret_1d_eur, 0.01) as lo, quantile_cont(ret_1d_eur, 0.99) as hi from factors) select date, ticker, round(least(greatest(ret_1d_eur, lo), hi), {DIGITS}) + 0.0 as ret_1d_eur from factors, q")
def w21_clip_global(spark, d):
    return panel.clip_global(built(spark, d), "ret_1d_eur").select("date", "ticker", "ret_1d_eur")


_ROLL_SQL = f"""{_IC_SQL}, rr as (select last_day(date) as month_eom, factor, coalesce(avg(ic) over b, 0) as m, count(*) over b as k from ic window b as (partition by factor order by date rows between 17 preceding and current row)),
ra as (select *, count(*) over (partition by month_eom) as names, sum(abs(m)) over (partition by month_eom) as tot from rr), rc as (select *, least(greatest(m / nullif(tot, 0), -0.4), 0.4) as c from ra),
roll as (select month_eom, factor, case when k < 10 then 1.0 / names else 0.6 / names + 0.4 * case when tot > 0 then c / sum(abs(c)) over (partition by month_eom) else 1.0 / names end end as weight from rc)"""


@query(f"with {_ROLL_SQL} select month_eom, factor, {r('weight')} from roll")
def w22_rolling_weights(spark, d):
    return weights.rolling_ic_weights(_ic(spark, d))


@query(f"with {_CURVE_SQL} select strategy, date, round(ln(equity), 6) + 0.0 as log_equity from curve")
def w23_equity_curve(spark, d):
    return performance.equity_curve(_series(spark, d)).select("strategy", "date", (F.round(F.ln("equity"), 6) + 0.0).alias("log_equity"))


@query(f"with {_CURVE_SQL} select strategy, date, {r('drawdown')} from dd")
def w24_drawdown(spark, d):
    return performance.drawdown(_series(spark, d)).select("strategy", "date", "drawdown")


@query(f"with {_HOLD_SQL} select {K}, {r('w')} from hold")
def w25_long_only(spark, d):
    return _holdings(spark, d)[1]


@query(f"""with {FACTORS_SQL}, reb as (select date, ticker, mom_6_1 as s from factors where date = {_LAST_WEEKDAY}),
rk as (select *, count(s) over (partition by date) as n, row_number() over (partition by date order by s desc nulls last, ticker) as t, row_number() over (partition by date order by s nulls last, ticker) as b from reb), k as (select *, greatest(1, floor(n * cast(0.2 as double))) as k from rk where n > 0)
select {K}, round(case when b <= k and s is not null then -0.5 / k when t <= k then 0.5 / k else 0.0 end, {DIGITS}) as w from k""")
def w26_long_short(spark, d):
    return portfolio.long_short(built(spark, d), "mom_6_1")


@query(f"""with {INDEX_SQL}, s as (select index_ticker as strategy, date, index_close / lag(index_close) over (partition by index_ticker order by date) - 1 as ret from index_prices), g as (select * from (select distinct date from s), (select distinct strategy from s)),
f as (select g.strategy, g.date, coalesce(s.ret, 0) as ret from g left join s on s.strategy = g.strategy and s.date = g.date) select strategy, date, {r('ret')}, round(product(1 + ret) over (partition by strategy order by date rows between unbounded preceding and current row), 6) as equity from f""")
def w27_align_curves(spark, d):
    rows = fac.index_returns(fx.index_prices(spark, d)).select(F.col("index_ticker").alias("strategy"), "date", F.col("ret_1d").alias("ret"))
    return performance.align_curves(rows).select("strategy", "date", "ret", F.round("equity", 6).alias("equity"))


# regressions and scores


@query(f"with {_EOM_SQL} select date, ticker, round(mom_6_1 - avg(mom_6_1) over (partition by date, coalesce(country, 'AFRICA')), 7) + 0.0 as resid from eom where date in (select date from eom group by 1 having count(mom_6_1) >= 2)")
def n1_neutralize_one(spark, d):
    out = xs.neutralize(panel.month_end_rows(built(spark, d)), ["mom_6_1"], ["country"])
    out = out.withColumn("_n", F.count("mom_6_1").over(Window.partitionBy("date"))).filter("_n >= 2")
    return out.select("date", "ticker", (F.round("mom_6_1_neu", 7) + 0.0).alias("resid"))


def _residual_sql(source: str, factors: list[str], by: dict[str, list], least: int, ridge: float = 0.0, full: bool = False, numeric: str | None = None) -> str:
    """res: residuals x on intercept and dummies by normal equations, which are swept column by column (Gauss-Jordan); a column
    without anything left is passed over. scale: the date's root mean square. `by` has the levels of each group."""
    terms = ["1.0"]
    for c, levels in by.items():
        own = f"cast({c} as varchar)" if full else f"coalesce(cast({c} as varchar), '{levels[0]}')"
        terms += [f"case when {own} = '{v}' then 1.0 else 0.0 end" for v in levels[0 if full else 1 :]]
    terms += [f"cast({numeric} as double)"] if numeric else []
    p = len(terms)
    need = p + 1 if full else least
    rows = " union all ".join(f"select date, ticker, '{f}' as f, {f} as y, [{', '.join(terms)}]::double[] as z from {source} where {f} is not null {f'and {numeric} is not null' if numeric else ''}" for f in factors)
    return f"""obs as (select * from (select *, count(*) over w as n, sqrt(avg(y * y) over w) as scale from ({rows}) window w as (partition by f, date)) where n >= {need}),
normal as (select f, date, i, j, sum(z[i] * case when j <= {p} then z[j] else y end) + case when i = j then {ridge} else 0.0 end as v from obs, range(1, {p + 1}) a(i), range(1, {p + 2}) b(j) group by f, date, i, j),
sw as (select 0 as k, * from normal union all select k + 1, f, date, i, j, case when p <= {1e-12 if ridge else 1e-9} then case when i = k + 1 or j = k + 1 then 0.0 else v end when i = k + 1 then kj / p else v - ik * kj / p end
 from (select *, max(case when i = k + 1 then v end) over (partition by f, date, j) as kj, max(case when j = k + 1 then v end) over (partition by f, date, i) as ik, max(case when i = k + 1 and j = k + 1 then v end) over (partition by f, date) as p from sw where k < {p})),
beta as (select f, date, list(v order by i) as b from sw where k = {p} and j = {p + 1} group by f, date),
res as (select date, ticker, f, scale, case when {int(not ridge)} = 1 and abs(e) <= 1e-9 * scale then 0.0 else e end as x from (select o.*, y - list_dot_product(z, b) as e from obs o join beta using (f, date)))"""


_TWO = {"country": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "supersector": [f"SEC_{k}" for k in range(4)]}
_PANEL_SQL = f"""{FACTORS_SQL}, be as (select date, list_sort(list_distinct(quantile_cont(size_proxy, [0.2, 0.4, 0.6, 0.8, 1.0]))) as size_proxy_e, list_sort(list_distinct(quantile_cont(liq_proxy, [0.2, 0.4, 0.6, 0.8, 1.0]))) as liq_proxy_e from factors group by 1),
grouped as (select f.*, {_bucket_sql("size_proxy")} as size_bucket, {_bucket_sql("liq_proxy")} as liq_bucket from factors f join be on f.date = be.date)"""
_FOUR = _TWO | {"size_bucket": [0, 1, 2, 3], "liq_bucket": [0, 1, 2, 3]}
GROUPS = ["country", "supersector", "size_bucket", "liq_bucket"]


def _residuals(df: DataFrame, factors: list[str]) -> DataFrame:
    """date, ticker, f, x of the residuals that are there."""
    return df.select("date", "ticker", *(F.col(f"{f}_neu").alias(f) for f in factors)).unpivot(["date", "ticker"], factors, "f", "x").filter("x is not null").withColumn("x", F.round("x", 5) + 0.0)


_RES = "select date, ticker, f, round(x, 5) + 0.0 as x from res"


@query(f"with recursive {_EOM_SQL}, {_residual_sql('eom', ['mom_6_1'], _TWO, 2)} {_RES}")
def n1_neutralize(spark, d):
    return _residuals(xs.neutralize(panel.month_end_rows(built(spark, d)), ["mom_6_1"], ["country", "supersector"]), ["mom_6_1"])


@query(f"with recursive {_PANEL_SQL}, eom as (select * from grouped where date in (select max(date) from grouped group by date_trunc('month', date))), {_residual_sql('eom', ['mom_6_1', 'rev_5d'], _FOUR, 2)} {_RES}")
def n1_neutralize_four(spark, d):
    """Month ends on all four groups of the research jobs; buckets have nulls, which share the baseline."""
    return _residuals(xs.neutralize(xs.add_groups(panel.month_end_rows(built(spark, d))).select("date", "ticker", "mom_6_1", "rev_5d", *GROUPS), ["mom_6_1", "rev_5d"], GROUPS), ["mom_6_1", "rev_5d"])


@query(f"with recursive {FACTORS_SQL}, {_residual_sql('factors', ['mom_6_1'], _TWO, 3, 1e-8)} {_RES}")
def n2_neutralize_ridge(spark, d):
    return _residuals(xs.neutralize(built(spark, d), ["mom_6_1"], ["country", "supersector"], least=3, ridge=1e-8), ["mom_6_1"])


@query(f"with recursive {_PANEL_SQL}, {_residual_sql('grouped', ['mom_6_1'], _TWO, 0, full=True, numeric='liq_bucket')} {_RES}")
def n3_neutralize_full(spark, d):
    """All dummies, and the liquidity bucket as a number."""
    return _residuals(xs.neutralize(xs.add_groups(built(spark, d)).select("date", "ticker", "mom_6_1", *GROUPS), ["mom_6_1"], ["country", "supersector"], mode="full", numeric=("liq_bucket",)), ["mom_6_1"])


def _z_sql(x: str) -> str:
    return f"round(case when stddev_pop({x}) over w = 0 then {x} * 0.0 else ({x} - avg({x}) over w) / stddev_pop({x}) over w end, 4) + 0.0"


_N4 = ["mom_6_1", "vol_60d"]


@query(f"""with recursive {FACTORS_SQL}, {_residual_sql('factors', _N4, _TWO, 3, 1e-8)}, raw as (select date, ticker, {", ".join(f"{_z_sql(f)} as {f}_z" for f in _N4)} from factors window w as (partition by date)),
nz as (select date, ticker, f, case when stddev_pop(x) over w > 1e-5 * any_value(scale) over w then {_z_sql("x")} end as z from res window w as (partition by date, f))
select raw.*, {", ".join(f"n{k}.z as {f}_neu_z" for k, f in enumerate(_N4))} from raw {" ".join(f"left join nz n{k} on n{k}.date = raw.date and n{k}.ticker = raw.ticker and n{k}.f = '{f}'" for k, f in enumerate(_N4))}""")
def n4_neutralize_and_z(spark, d):
    """Raw and neutralised z-scores on every date; the latter not where groups leave no residual but the ridge's."""
    out, w = xs.neutralize_and_z(built(spark, d), _N4, ["country", "supersector"], keep=True), Window.partitionBy("date")
    left = {f: F.stddev_pop(f"{f}_neu").over(w) > 1e-5 * F.sqrt(F.avg(F.col(f) * F.col(f)).over(w)) for f in _N4}
    return out.select("date", "ticker", *((F.round(f"{f}_z", 4) + 0.0).alias(f"{f}_z") for f in _N4), *((F.round(F.when(left[f], F.col(f"{f}_neu_z")), 4) + 0.0).alias(f"{f}_neu_z") for f in _N4))


_NEU = ", ".join(f"case when count({f}) over (partition by date) >= 2 then {f} - avg({f}) over (partition by date, coalesce(country, 'AFRICA')) end as {f}_neu" for f in _ZS)
_NEU_Z = ", ".join(f"round(case when stddev_pop({f}_neu) over w = 0 then {f}_neu * 0.0 else ({f}_neu - avg({f}_neu) over w) / stddev_pop({f}_neu) over w end, 6) + 0.0 as {f}_neu_z" for f in _ZS)


@query(f"with {_EOM_SQL}, neu as (select date, ticker, {_NEU} from eom), nz as (select date, ticker, {_NEU_Z} from neu window w as (partition by date)) select z.date, z.ticker, {r(*_ZN)}, {', '.join(f'{z[:-2]}_neu_z' for z in _ZN)} from z join nz on z.date = nz.date and z.ticker = nz.ticker")
def n5_month_end_scores(spark, d):
    out = xs.month_end_scores(built(spark, d), _ZS, ["country"])
    return out.select("date", "ticker", *_ZN, *((F.round(f"{f}_neu_z", 6) + 0.0).alias(f"{f}_neu_z") for f in _ZS))


def _scored(spark, d):
    return xs.month_end_scores(built(spark, d), _ZS)


_MEAN = f"({' + '.join(f'coalesce({z}, 0)' for z in _ZN)}) / nullif({' + '.join(f'case when {z} is null then 0 else 1 end' for z in _ZN)}, 0)"


@query(f"with {_EOM_SQL} select {K}, round({_MEAN}, {DIGITS}) + 0.0 as score_ew from z")
def c1_score_equal(spark, d):
    return weights.score_equal(_scored(spark, d), _ZN).select("date", "ticker", "score_ew")


_IC_ONLY = _IC_SQL[len(FACTORS_SQL) + 2 :]
_Z_ONLY = _EOM_SQL[len(FACTORS_SQL) + 2 :]
_ICW_ONLY = _ICW_SQL[len(_IC_SQL) + 2 :]
_ROLL_ONLY = _ROLL_SQL[len(_IC_SQL) + 2 :]


@query(f"with {_IC_SQL}, {_ICW_ONLY}, {_Z_ONLY} select {K}, round({' + '.join(f'(select weight from icw where factor = {chr(39)}{f}{chr(39)}) * coalesce({f}_z, 0)' for f in _ZS)}, {DIGITS}) + 0.0 as score_icw from z")
def c2_score_weighted(spark, d):
    w = weights.ic_weights(_ic(spark, d).groupBy("factor").agg(F.avg("ic").alias("mean"))).withColumn("factor", F.concat("factor", F.lit("_z")))
    return weights.score_weighted(_scored(spark, d), w, _ZN, "score_icw").select("date", "ticker", "score_icw")


@query(f"""with {_IC_SQL}, {_ROLL_ONLY}, {_Z_ONLY}, rw as (select month_eom, {", ".join(f"max(case when factor = '{f}' then weight end) as w_{f}" for f in _ZS)} from roll group by 1)
select z.date, z.ticker, round({" + ".join(f"w_{f} * coalesce({f}_z, 0)" for f in _ZS)}, {DIGITS}) + 0.0 as score_icw_roll from z left join rw on last_day(z.date) = rw.month_eom""")
def c3_score_rolling(spark, d):
    w = weights.rolling_ic_weights(_ic(spark, d)).withColumn("factor", F.concat("factor", F.lit("_z")))
    return weights.score_rolling(_scored(spark, d), w, _ZN).select("date", "ticker", "score_icw_roll")


@query(f"with {FACTORS_SQL} select {K}, {r('mom_6_1')} from factors where date = date '1999-03-15' order by mom_6_1 desc nulls last, ticker limit 20")
def t1_top_n(spark, d):
    return statistics.top_n(built(spark, d), "mom_6_1", 20, date="1999-03-15")


@query(f"with {FACTORS_SQL} select {K}, {r('mom_6_1')} from factors where date = date '1999-03-15' order by mom_6_1 nulls last, ticker limit 20")
def t1_bottom_n(spark, d):
    return statistics.top_n(built(spark, d), "mom_6_1", 20, ascending=True, date="1999-03-15")


@query(f"with {INDEX_SQL}, s as (select index_ticker as strategy, date, index_close / lag(index_close) over (partition by index_ticker order by date) - 1 as ret from index_prices), p as (select strategy, avg(ret) / stddev_samp(ret) * sqrt(252.0) as sharpe from s where ret is not null group by 1) select strategy, {r('sharpe')} from p")
def t2_rank_strategies(spark, d):
    rows = fac.index_returns(fx.index_prices(spark, d)).select(F.col("index_ticker").alias("strategy"), "date", F.col("ret_1d").alias("ret"))
    return performance.rank_strategies(performance.perf_summary(rows, ppy=252)).select("strategy", "sharpe")


@query(f"with {PRICES_SQL} select distinct last_day(date) as month_end, ticker from prices")
def u3_distinct_keys(spark, d):
    return fx.prices(spark, d).select(cal.month_end(F.col("date")).alias("month_end"), "ticker").distinct()


@query(f"with {PRICES_SQL}, {INDEX_SQL} select ticker, date, {r('price_eur')} from prices union all select index_ticker, date, round(index_close, {DIGITS}) + 0.0 from index_prices")
def u1_stack(spark, d):
    index = fx.index_prices(spark, d).select(F.col("index_ticker").alias("ticker"), "date", F.col("index_close").alias("price_eur"))
    return statistics.stack([fx.prices(spark, d).select("ticker", "date", "price_eur"), index])


# walk-forward

_BLOCKS_SQL = """months as (select m, row_number() over (order by m) - 1 as i, count(*) over () as n from (select distinct last_day(date) as m from prices)),
blocks as (select f.fold, a.m as train_start, b.m as train_end, c.m as test_start, e.m as test_end from (select unnest(range(0, 1000)) as fold) f
 join months a on a.i = f.fold * 6 join months b on b.i = f.fold * 6 + 35 join months c on c.i = f.fold * 6 + 37 join months e on e.i = f.fold * 6 + 42 where a.n >= 38)"""


@query(f"with {PRICES_SQL}, {_BLOCKS_SQL} select fold, train_start, train_end, test_start, test_end from blocks")
def v1_time_blocks(spark, d):
    return folds.time_blocks(fx.prices(spark, d))


@query(f"with {PRICES_SQL}, {_BLOCKS_SQL} select b.fold, p.date, p.ticker from prices p join blocks b on last_day(p.date) between b.train_start and b.train_end")
def j10_attach_folds(spark, d):
    p = fx.prices(spark, d)
    return folds.attach_folds(p, folds.time_blocks(p), "train").select("fold", "date", "ticker")


@query(f"with {_BETA_SQL} select {K}, {r('beta_60')}, round(case when country is not null then mom_6_1 - median(mom_6_1) over (partition by date, country) end, {DIGITS}) + 0.0 as country_rel_mom_6_1 from betas")
def d1_build_factors(spark, d):
    """The whole build job, two of its columns."""
    from . import jobs

    return jobs.build_factors(fx.bars(spark, d), fx.index_prices(spark, d)).select("date", "ticker", "beta_60", "country_rel_mom_6_1")


_FOLDS_SQL = f"""{_IC_SQL}, {_BLOCKS_SQL.replace("from prices", "from factors")}, fic as (select b.fold, ic.* from ic join blocks b on ic.month between b.train_start and b.train_end),
v as (select fold, factor, ic, row_number() over (partition by fold, factor order by date) as i, ic - avg(ic) over (partition by fold, factor) as c from fic where ic is not null),
g as (select a.fold, a.factor, sum(2 * (1 - (b.i - a.i) / 40.0) * a.c * b.c) as g from v a join v b on a.fold = b.fold and a.factor = b.factor and b.i - a.i between 1 and 39 group by all),
s as (select fold, factor, avg(ic) as mean, count(*) as n, sum(c * c) as g0 from v group by all),
summ as (select s.*, case when n >= 5 and (g0 + g.g) / n > 0 then mean / sqrt((g0 + g.g) / n / n) end as t_nw from s left join g using (fold, factor)),
pv as (select fold, factor, mean, case when abs(t_nw) > 6 then 0.0 when t_nw is not null then {_ERFC} end as p from (select distinct fold, factor from fic) left join summ using (fold, factor)),
o as (select *, row_number() over (partition by fold order by coalesce(p, 1), factor) as i, count(*) over (partition by fold) as m from pv),
q as (select *, least(1.0, min(m * coalesce(p, 1) / i) over (partition by fold order by i desc rows between unbounded preceding and current row)) as q from o),
pick as (select *, max(case when q <= 0.1 and mean > 0 then 1 else 0 end) over (partition by fold) as any_ok, row_number() over (partition by fold order by mean desc nulls last, factor) as k from q),
chosen as (select fold, factor, mean from pick where case when any_ok = 1 then q <= 0.1 and mean > 0 else k <= 5 end),
ss as (select fold, factor, case when abs(mean) >= quantile_cont(abs(mean), 0.2) over (partition by fold) then mean else 0.0 end as s from chosen where mean is not null),
icw as (select fold, factor, 0.5 * (case when s <> 0 then 1.0 / sum(case when s <> 0 then 1 else 0 end) over (partition by fold) else 0.0 end) + 0.5 * s / sum(abs(s)) over (partition by fold) as weight from ss),
rr as (select fold, last_day(date) as month_eom, factor, coalesce(avg(ic) over b, 0) as m, count(*) over b as k from fic join chosen using (fold, factor) window b as (partition by fold, factor order by date rows between 17 preceding and current row)),
ra as (select *, count(*) over w as names, sum(abs(m)) over w as tot, max(month_eom) over (partition by fold) as last_eom from rr window w as (partition by fold, month_eom)),
rc as (select *, least(greatest(m / nullif(tot, 0), -0.4), 0.4) as c from ra),
roll as (select fold, factor, case when k < 10 then 1.0 / names else 0.6 / names + 0.4 * case when tot > 0 then c / sum(abs(c)) over (partition by fold, month_eom) else 1.0 / names end end as weight from rc where month_eom = last_eom),
has as (select fold, {", ".join(f"max(case when factor = '{f}' then 1 else 0 end) as h_{f}" for f in _ZS)} from chosen group by 1),
zs as (select h.fold, f.date, fwd_40d as y, [{", ".join(f"coalesce(h_{f} * {f}, 0)" for f in _ZS)}] as z from f40 f join blocks b on last_day(f.date) between b.train_start and b.train_end join has h on h.fold = b.fold
 where fwd_40d is not null {" ".join(f"and (h_{f} = 0 or {f} is not null)" for f in _ZS)}),
normal as (select fold, date, i, j, sum(z[i] * case when j <= {len(_ZS)} then z[j] else y end) + case when i = j then 2.0 else 0.0 end as v from (select *, count(*) over (partition by fold, date) as n from zs), range(1, {len(_ZS) + 1}) a(i), range(1, {len(_ZS) + 2}) b(j) where n >= 15 group by fold, date, i, j),
sw as (select 0 as k, * from normal union all select k + 1, fold, date, i, j, case when i = k + 1 then kj / p else v - ik * kj / p end
 from (select *, max(case when i = k + 1 then v end) over (partition by fold, date, j) as kj, max(case when j = k + 1 then v end) over (partition by fold, date, i) as ik, max(case when i = k + 1 and j = k + 1 then v end) over (partition by fold, date) as p from sw where k < {len(_ZS)})),
slope as (select c.fold, c.factor, avg(v) as b from sw join chosen c on c.fold = sw.fold and c.factor = ([{", ".join(f"'{f}'" for f in _ZS)}])[i] where k = {len(_ZS)} and j = {len(_ZS) + 1} group by all),
half as (select c.fold, c.factor, 0.5 / count(*) over (partition by c.fold) + 0.5 * coalesce(b, 1) as w from chosen c left join slope s on c.fold = s.fold and c.factor = s.factor),
fold_weights as (select fold, factor, 'score_icw' as strategy, weight from icw union all select fold, factor, 'score_icw_roll', weight from roll
 union all select fold, factor, 'score_ridge', w / sum(w) over (partition by fold) from half union all select fold, factor, 'score_ew', 1.0 from chosen)"""


@query(f"with recursive {_FOLDS_SQL} select fold, factor, strategy, {r('weight')} from fold_weights")
def v2_fold_weights(spark, d):
    """What each fold's train months select, and the four weightings of it."""
    df = fac.add_forward_returns(built(spark, d), horizons=(40,))
    df = staged(df.select("date", "ticker", "fwd_40d", *_ZS), "fold-weights")
    return folds.train_weights(df, folds.time_blocks(df), _ZS, "fwd_40d").select("fold", "factor", "strategy", "weight")


_FS3 = "fold, strategy"
_OOS_SQL = f"""{_FOLDS_SQL}, wf as (select {_FS3}, {", ".join(f"coalesce(max(case when factor = '{f}' then weight end), 0) as w_{f}" for f in _ZS)} from fold_weights group by 1, 2),
tested as (select b.fold, w.strategy, f.date, f.ticker, f.ret_1d_eur as ret, {" + ".join(f"w_{f} * coalesce({f}, 0)" for f in _ZS)} as total, {" + ".join(f"case when {f} is not null then w_{f} else 0 end" for f in _ZS)} as there
 from f40 f join blocks b on last_day(f.date) between b.test_start and b.test_end join wf w on w.fold = b.fold),
sc as (select *, case when strategy = 'score_ew' then total / nullif(there, 0) else total end as s from tested),
ranked as (select {_FS3}, date, ticker, s, count(s) over (partition by {_FS3}, date) as n, row_number() over (partition by {_FS3}, date order by s desc nulls last, ticker) as t from sc where date = {_LAST_WEEKDAY}),
hold as (select {_FS3}, date as reb_id, ticker, case when t <= greatest(1, floor(n * cast(0.2 as double))) then 1.0 / greatest(1, floor(n * cast(0.2 as double))) else 0.0 end as w from ranked where n > 0),
nx as (select *, lead(reb_id) over (partition by {_FS3} order by reb_id) as nxt, min(reb_id) over (partition by {_FS3}) as first from (select distinct {_FS3}, reb_id from hold)),
moves as (select * from hold union all select {_FS3}, nxt, ticker, -w from hold join nx using ({_FS3}, reb_id) where nxt is not null),
turn as (select {_FS3}, reb_id, case when reb_id = first then 0.0 else sum(abs(dw)) end as turnover from (select {_FS3}, reb_id, ticker, sum(w) as dw from moves group by all) join nx using ({_FS3}, reb_id) group by {_FS3}, reb_id, first),
since as (select d.fold, d.strategy, d.date, n.reb_id from (select distinct {_FS3}, date from sc) d asof join nx n on d.fold = n.fold and d.strategy = n.strategy and d.date >= n.reb_id where d.date > n.reb_id),
port as (select {_FS3}, date, reb_id, coalesce(sum(ret * coalesce(w, 0)), 0) as gross from sc join since using ({_FS3}, date) left join hold using ({_FS3}, reb_id, ticker) group by all),
net as (select {_FS3}, date, gross - case when date = min(date) over (partition by {_FS3}, reb_id) then coalesce(turnover, 0) * 5.0 / 10000 else 0 end as ret from port left join turn using ({_FS3}, reb_id))"""


def _oos_perf_sql(keys: str) -> str:
    up_to = f"over (partition by {keys} order by date rows between unbounded preceding and current row)"
    return f"""with recursive {_OOS_SQL}, curve as (select *, product(1 + ret) {up_to} as equity from net), dd as (select *, equity / max(equity) {up_to} - 1 as drawdown from curve)
select {keys}, round(pow(product(1 + ret), 252.0 / count(*)) - 1, 7) + 0.0 as ann_ret, round(stddev_samp(ret) * sqrt(252.0), 7) as ann_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 6) + 0.0 as sharpe, round(min(drawdown), 7) + 0.0 as max_dd from dd group by all"""


def _oos(spark, d, part: int, *keys: str) -> DataFrame:
    df = folds.walk_forward(fac.add_forward_returns(built(spark, d), horizons=(40,)), _ZS, "fwd_40d", "ret_1d_eur")[part]
    return df.select(*keys, *((F.round(c, n) + 0.0).alias(c) for c, n in (("ann_ret", 7), ("ann_vol", 7), ("sharpe", 6), ("max_dd", 7))))


@query(_oos_perf_sql(_FS3))
def v2_oos_by_fold(spark, d):
    """Walk-forward on raw factors, so that SQL can say all of it: train weights, scores, holdings, costs, performance."""
    return _oos(spark, d, 1, "fold", "strategy")


@query(_oos_perf_sql("strategy"))
def a23_oos_pooled(spark, d):
    """The same test months, pooled over the folds."""
    return _oos(spark, d, 2, "strategy")


def _daily(spark, d) -> DataFrame:
    """The whole panel of the build job."""
    from . import jobs

    return jobs.build_factors(fx.bars(spark, d), fx.index_prices(spark, d))


@query()
def v2_walk_forward(spark, d):
    """Performance by fold and strategy, all factors, neutralised on four groups; its parts have their own oracles."""
    from . import jobs

    return jobs.walk_forward(_daily(spark, d), jobs.FACTORS)["cv_oos_summary_by_fold"]


@query()
def a23_oos_summary(spark, d):
    """Performance by strategy over all test months."""
    from . import jobs

    return jobs.walk_forward(_daily(spark, d), jobs.FACTORS)["cv_oos_summary_overall"]


@query()
def d3_research(spark, d):
    """The whole-sample research job's performance table, over the months' universe, with robust scores."""
    from . import jobs

    df = _daily(spark, d)
    return jobs.research(df, jobs.FACTORS, universe=panel.universe_monthly(df), robust=True)["IS_summary_overall"]


_EXPLORED = ["mom_12_1", "size_proxy", "beta_252"]
_EXPLORE_SQL = f"""{_BETA_SQL}, q as (select date, {", ".join(f"quantile_cont({c}, [0.01, 0.99]) as {c}_q" for c in _EXPLORED)} from betas group by 1),
ex as (select b.date, b.ticker, b.country, b.supersector, b.ret_1d_eur, {", ".join(f"case when {c} is not null then least(greatest({c}, {c}_q[1]), {c}_q[2]) end as {c}" for c in _EXPLORED)} from betas b join q on b.date = q.date),
day as (select * from ex where date = date '1999-03-15')"""
_TOPS = " union all ".join(
    f"(select '{side}20_{name}' as name, ticker as key, {c} as value from day order by {c} {'desc' if side == 'top' else ''} nulls last, ticker limit 20)"
    for name, c in (("beta", "beta_252"), ("momentum", "mom_12_1"), ("size", "size_proxy")) for side in ("top", "bottom")
)
_QUINTILES = " union all ".join(
    f"select 'ret_by_{name}_quintile', cast(cast(greatest(1, ceil(5.0 * (r - 1) / (n - 1))) as bigint) as varchar), avg(ret_1d_eur) from (select *, row_number() over (order by {c}, ticker) as r, count(*) over () as n from day where {c} is not null) group by 2"
    for name, c in (("momentum", "mom_12_1"), ("size", "size_proxy"))
)


@query(f"""with {_EXPLORE_SQL}, l as (select min(beta_252) as lo, max(beta_252) as hi from day), t as ({_TOPS} union all {_QUINTILES}
 union all select 'beta_by_country', country, avg(beta_252) from day where beta_252 is not null group by 2 union all select 'beta_by_supersector', supersector, avg(beta_252) from day where beta_252 is not null group by 2
 union all select 'beta_252_histogram', cast(cast(least(floor((beta_252 - lo) / (hi - lo) * 30) + 1, 30) as bigint) as varchar), count(*) from day, l where beta_252 is not null group by 2
 union all select 'coverage', cast(date as varchar), count(distinct ticker) from ex group by 2 union all select 'null_share', cast(date as varchar), 1 - count(mom_12_1) * 1.0 / count(*) from ex group by 2)
select name, key, round(value, 7) + 0.0 as value from t""")
def d2_explore(spark, d):
    """The tables of the exploring job, one behind the other."""
    from . import jobs

    df = market.add_betas(market.add_market(built(spark, d), "global"))
    tables = jobs.explore(df.withColumn("ret_stock", F.col("ret_1d_eur")), _EXPLORED, last="1999-03-15", lean=True)
    columns = {"coverage": ("date", "n_tickers"), "null_share": ("date", "mom_12_1"), "beta_by_country": ("country", "mean"), "beta_by_supersector": ("supersector", "mean"), "beta_252_histogram": ("bin", "n")}
    columns |= {f"ret_by_{n}_quintile": ("bucket", "mean") for n in ("momentum", "size")}
    columns |= {f"{side}20_{n}": ("ticker", c) for n, c in (("beta", "beta_252"), ("momentum", "mom_12_1"), ("size", "size_proxy")) for side in ("top", "bottom")}
    rows = [tables[n].select(F.lit(n).alias("name"), F.col(k).cast("string").alias("key"), F.col(v).cast("double").alias("value")) for n, (k, v) in columns.items()]
    return statistics.stack(rows).withColumn("value", F.round("value", 7) + 0.0)


@query(f"""with {_BETA_SQL}, last_day_ as (select * from betas where date = (select max(date) from betas)), t as ({" union all ".join(f"select 'factor_completeness' as name, '{f}' as key, count({f}) as value from betas having count(*) > 0" for f in _FS)}
 union all select 'factor_coverage_daily', cast(date as varchar), count(mom_6_1) from betas group by 2 union all select 'universe_monthly', strftime(date, '%Y-%m'), count(distinct ticker) from betas group by 2
 union all (select 'top20_beta', ticker, beta_252 from last_day_ order by beta_252 desc nulls last, ticker limit 20) union all (select 'bottom20_beta', ticker, beta_252 from last_day_ order by beta_252 nulls last, ticker limit 20)
 union all select 'factors_eom_z', cast(date as varchar), case when count(mom_6_1) >= 2 then count(mom_6_1) else 0 end from betas where date in (select max(date) from betas group by date_trunc('month', date)) group by 2)
select name, key, round(value, 7) + 0.0 as value from t""")
def d1_diagnostics(spark, d):
    """The tables beside the panel, one behind the other; scores by their number."""
    from . import jobs

    tables = jobs.factor_diagnostics(_betas(spark, d), _FS, ["country", "supersector"])
    tables["universe_monthly"] = tables["universe_monthly"].select("month", F.size("tickers").alias("n"))
    tables["factors_eom_z"] = tables["factors_eom_z"].groupBy("date").agg(F.count("mom_6_1_neu_z").alias("n"))
    columns = {"factor_completeness": ("factor", "non_null"), "factor_coverage_daily": ("date", "mom_6_1"), "universe_monthly": ("month", "n"), "top20_beta": ("ticker", "beta_252"), "bottom20_beta": ("ticker", "beta_252"), "factors_eom_z": ("date", "n")}
    rows = [tables[n].select(F.lit(n).alias("name"), F.col(k).cast("string").alias("key"), F.col(v).cast("double").alias("value")) for n, (k, v) in columns.items()]
    return statistics.stack(rows).withColumn("value", F.round("value", 7) + 0.0)


@query(f"with {PRICES_SQL} select {K}, {r('price_eur', 'volume')} from prices where date between date '1996-03-10' and date '1996-05-05'")
def s3_partitioned_panel(spark, d):
    """Exports the bars by year and month and reads a stretch of days back; other months are not read."""
    base = f"{shared_folder(spark)}/months-{uuid.uuid4().hex}"
    io.export_by_month(fx.prices(spark, d), base)
    return io.read_months(spark, base, dt.date(1996, 3, 10), dt.date(1996, 5, 5)).select("date", "ticker", "price_eur", "volume")


@query(f"with {PRICES_SQL}, t as (select 'factor' as item, unnest([{', '.join(repr(f) for f in _FS)}]) as value union all select 'last_date', cast(max(date) as varchar) from prices union all select 'universe', cast(count(distinct strftime(date, '%Y-%m')) as varchar) from prices union all select 'rows', cast(count(*) as varchar) from prices) select item, value from t")
def s7_load_exports(spark, d):
    """Exports the bars with a universe, a factor list and a last date, and loads them by the exploring job's names."""
    folder = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    bars = fx.prices(spark, d)
    io.export_panel(bars, folder, _FS, {"universe_monthly": panel.universe_monthly(bars).withColumn("tickers", F.to_json("tickers"))})
    found = io.load_exports(spark, folder, io.EXPLORE_NAMES)
    listed = spark.createDataFrame([("factor", f) for f in found["factors"]], "item string, value string")
    counted = found["universe_monthly"].filter(F.size("tickers") > 0).agg(F.lit("universe").alias("item"), F.count(F.lit(1)).cast("string").alias("value"))
    return statistics.stack([listed, found["last_date"].select(F.lit("last_date").alias("item"), F.col("last_date").cast("string").alias("value")), counted, found["panel"].agg(F.lit("rows").alias("item"), F.count(F.lit(1)).cast("string").alias("value"))])


@query(f"with {_SUM_SQL} select 'ic_timeseries' as name, (select count(*) from ic) as counted, (select count(*) from ic) as read, '40' as horizon union all select 'ic_summary', (select count(distinct factor) from ic), (select count(distinct factor) from ic), '40'")
def s9_publish_run(spark, d):
    """Publishes an IC study as a run and reads the last run back: counts of the manifest and of what is read."""
    from . import jobs

    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    ic = _ic(spark, d)
    jobs.write_research({"ic_timeseries": ic, "ic_summary": statistics.ic_significance(ic, "M", 40)}, folder, {"horizon": 40})
    settings, tables, counts = io.read_run(spark, folder)
    return statistics.stack([df.agg(F.lit(n).alias("name"), F.lit(counts[n]).cast("long").alias("counted"), F.count(F.lit(1)).alias("read"), F.lit(settings["horizon"]).alias("horizon")) for n, df in tables.items()])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty names of highest momentum score on the last month end that has one."""
    scores = xs.month_end_scores(built(spark, sf_dir), ["mom_12_1", "mom_6_1", "vol_60d"])
    return scores.withColumn("_k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("mom_6_1_z"), "ticker"))).filter("_k <= 20").drop("_k")
