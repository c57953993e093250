"""The daily panel that the queries run on, derived from the order tables. Integer cents keep its doubles the same in
every engine; the SQL text is the same panel for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import add_crosswalk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ticker(key: str):
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 6, "0"))


def _mean_price(total: str, unit: float):
    cents = F.sum(F.round(F.col(total) * 100).cast("long")).cast("double")
    return F.lit(100) + cents / (F.count(F.lit(1)) * F.lit(unit))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, price_eur, volume."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), _ticker("l_suppkey").alias("ticker"), "l_extendedprice", "l_quantity")
    return lines.groupBy("date", "ticker").agg(_mean_price("l_extendedprice", 100000.0).alias("price_eur"), F.sum("l_quantity").cast("double").alias("volume"))


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, country, supersector."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(_ticker("s_suppkey").alias("ticker"), F.col("r_name").alias("country"), F.concat(F.lit("SEC_"), (F.col("s_suppkey") % 4).cast("string")).alias("supersector"))


def index_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, country, index_ticker, index_close."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rows = joined.select(F.col("o_orderdate").cast("date").alias("date"), F.col("r_name").alias("country"), "o_totalprice")
    return rows.groupBy("date", "country").agg(_mean_price("o_totalprice", 500000.0).alias("index_close")).withColumn("index_ticker", F.concat(F.lit("IDX_"), F.col("country")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_crosswalk(prices(spark, sf_dir), crosswalk(spark, sf_dir))


PRICES_SQL = """prices as (select cast(l_shipdate as date) as date, concat('S', lpad(cast(l_suppkey as varchar(10)), 6, '0')) as ticker,
  100 + cast(sum(cast(round(l_extendedprice*100) as bigint)) as double) / (count(*) * cast(100000 as double)) as price_eur,
  cast(sum(l_quantity) as double) as volume from lineitem group by 1, 2)"""
CROSSWALK_SQL = """crosswalk as (select concat('S', lpad(cast(s_suppkey as varchar(10)), 6, '0')) as ticker, r_name as country,
  concat('SEC_', cast(s_suppkey % 4 as varchar(10))) as supersector
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
INDEX_SQL = """index_prices as (select cast(o_orderdate as date) as date, r_name as country, concat('IDX_', r_name) as index_ticker,
  100 + cast(sum(cast(round(o_totalprice*100) as bigint)) as double) / (count(*) * cast(500000 as double)) as index_close
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey group by 1, 2, 3)"""
BARS_SQL = f"{PRICES_SQL}, {CROSSWALK_SQL}, bars as (select p.*, x.country, x.supersector from prices p left join crosswalk x on p.ticker = x.ticker)"
RET_SQL = f"{BARS_SQL}, ret as (select *, price_eur / lag(price_eur) over (partition by ticker order by date) - 1 as ret_1d_eur, price_eur * coalesce(volume, 0) as turnover_eur from bars)"


def frame(rows: int) -> str:
    return f"over (partition by ticker order by date rows between {rows - 1} preceding and current row)"


def gate(expression: str, counted: str, rows: int, least: int) -> str:
    return f"case when count({counted}) {frame(rows)} >= {least} then {expression} {frame(rows)} end"


#: The factors by their definition: momentum by the cumulative product of returns, not by price ratios.
FACTORS_SQL = f"""{RET_SQL}, cum as (select *, product(1 + coalesce(ret_1d_eur, 0)) over (partition by ticker order by date rows between unbounded preceding and current row) as cs,
  case when turnover_eur <> 0 then abs(ret_1d_eur) / turnover_eur end as illiq from ret),
fac as (select date, ticker, country, supersector, price_eur, volume, ret_1d_eur, turnover_eur,
  lag(cs, 21) over (partition by ticker order by date) / lag(cs, 273) over (partition by ticker order by date) - 1 as mom_12_1,
  lag(cs, 21) over (partition by ticker order by date) / lag(cs, 147) over (partition by ticker order by date) - 1 as mom_6_1,
  case when count(ret_1d_eur) {frame(5)} = 5 then product(1 + ret_1d_eur) {frame(5)} - 1 end as ret_5d,
  {gate("stddev_samp(ret_1d_eur)", "ret_1d_eur", 60, 40)} as vol_60d,
  {gate("stddev_samp(ret_1d_eur)", "ret_1d_eur", 252, 200)} as vol_252d,
  {gate("avg(turnover_eur)", "turnover_eur", 20, 10)} as adv_eur_20,
  price_eur / {gate("max(price_eur)", "price_eur", 252, 20)} - 1 as hi52_prox,
  {gate("avg(illiq)", "illiq", 20, 10)} as amihud_20d,
  {gate("avg(case when coalesce(ret_1d_eur, 0) = 0 then 1.0 else 0.0 end)", "ticker", 20, 10)} as zero_ret_20d,
  case when count(ret_1d_eur) {frame(21)} >= 10 then list(ret_1d_eur) {frame(21)} end as recent
  from cum),
factors as (select * exclude (recent), -ret_5d as rev_5d, ln(nullif(adv_eur_20, 0)) as size_proxy, -ln(nullif(amihud_20d, 0)) as liq_proxy,
  list_avg(list_slice(list_reverse_sort(list_filter(recent, lambda x: x is not null)), 1, 5)) as max5_21d from fac where ret_1d_eur is not null)"""
MARKET_SQL = """global_market as (select date, avg(ret_1d_eur) as mkt_ret from factors group by date having count(distinct ticker) >= 10)"""
COUNTRY_SQL = f"""{INDEX_SQL}, country_market as (select country, date, avg(r) as country_mkt_ret_1d from
  (select *, index_close / lag(index_close) over (partition by index_ticker order by date) - 1 as r from index_prices) group by 1, 2)"""
