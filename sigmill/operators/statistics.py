"""Coverage, correlations, information coefficients and their significance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import add_business_days, last_weekday
from ..functions.numbers import ratio, two_sided_p
from .panel import snapshot


def daily_coverage(df: DataFrame, factors: list[str]) -> DataFrame:
    return df.groupBy("date").agg(*(F.count(f).alias(f) for f in factors))


def completeness(df: DataFrame, factors: list[str]) -> DataFrame:
    """factor, non_null, total_rows, pct_non_null, avg_names_per_date, first_date, last_date: from counts per date."""
    per_date = df.groupBy("date").agg(F.count(F.lit(1)).alias("_rows"), *(F.count(f).alias(f) for f in factors))
    long = per_date.unpivot(["date", "_rows"], factors, "factor", "n")
    has = F.when(F.col("n") > 0, F.col("date"))
    return long.groupBy("factor").agg(
        F.sum("n").alias("non_null"), F.sum("_rows").alias("total_rows"), (100.0 * F.sum("n") / F.sum("_rows")).alias("pct_non_null"),
        F.avg("n").alias("avg_names_per_date"), F.min(has).alias("first_date"), F.max(has).alias("last_date"),
    )


def coverage_by_date(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(F.countDistinct("ticker").alias("n_tickers"))


def null_share_by_date(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("date").agg(*((1 - F.count(c) / F.count(F.lit(1))).alias(c) for c in columns))


def mean_by_group(df: DataFrame, group: str, column: str, date=None) -> DataFrame:
    return snapshot(df, [column], date).filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(column).alias("mean"))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation as an aggregate; null without spread (corr() raises there)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in columns for b in columns]


def _long(df: DataFrame, ids: list[str], columns: list[str], name: str) -> DataFrame:
    packed = F.array(*(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"`{a}|{b}`").alias(name)) for a, b in _pairs(columns)))
    return df.select(*ids, F.explode(packed).alias("e")).select(*ids, "e.*")


def _matrix(df: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """All pairs of complete cases in one aggregation; a pair is computed once."""
    found = {(a, b): pearson(a, b).alias(f"{a}|{b}") for i, a in enumerate(columns) for b in columns[i:]}
    wide = df.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"), *found.values())
    mirrored = {f"{b}|{a}": F.col(f"`{a}|{b}`") for a, b in found if a != b}
    return wide.withColumns(mirrored) if mirrored else wide


def correlation_latest(df: DataFrame, columns: list[str]) -> DataFrame:
    """f1, f2, corr over complete cases of the last date."""
    return _long(_matrix(snapshot(df, columns), columns, []), [], [f for f in columns], "corr")


def correlation_average(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """f1, f2, corr: the mean over dates with enough complete cases, an undefined correlation counting as 0."""
    daily = _long(_matrix(df.dropna(subset=columns), columns, ["date"]).filter(F.col("_n") >= least), ["date"], columns, "c")
    return daily.groupBy("f1", "f2").agg(F.when(F.count("c") > 0, F.sum("c") / F.count(F.lit(1))).alias("corr"))


def ranks(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Average ranks in place of the columns."""
    out = {}
    for c in columns:
        w = Window.partitionBy(*by)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
        out[c] = F.rank().over(w.orderBy(c)) + (ties - 1) / 2.0
    return df.withColumns(out)


def correlation_table(df: DataFrame, columns: list[str], date=None) -> DataFrame:
    """f1, f2, pearson, spearman on one date's complete cases."""
    rows = snapshot(df, columns, date).withColumn("_one", F.lit(1))
    a = _long(_matrix(rows, columns, []), [], columns, "pearson")
    b = _long(_matrix(ranks(rows, columns, ["_one"]), columns, []), [], columns, "spearman")
    return a.join(F.broadcast(b), ["f1", "f2"])


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (1 to bins) and n over equal widths from minimum to maximum, the last bin closed."""
    x = df.filter(F.col(column).isNotNull())
    limits = x.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.when(F.col("_lo") == F.col("_hi"), F.lit(1)).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins) + 1, F.lit(bins)))
    return x.join(F.broadcast(limits)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantile_means(df: DataFrame, factor: str, target: str, q: int = 5, date=None) -> DataFrame:
    """bucket, mean, n: equal-count buckets of first-come ranks on one date."""
    rows = snapshot(df, [factor, target], date).withColumn("_all", F.lit(1))
    w = Window.partitionBy("_all")
    r, n = F.row_number().over(w.orderBy(factor, "ticker")), F.count(F.lit(1)).over(w)
    place = F.when(n > 1, F.greatest(F.lit(1), F.ceil(F.lit(q) * (r - 1) / F.nullif(n - 1, F.lit(0)))))
    return rows.withColumn("bucket", place.cast("int")).groupBy("bucket").agg(F.avg(target).alias("mean"), F.count(F.lit(1)).alias("n"))


def with_embargo(df: DataFrame, days: int = 1) -> DataFrame:
    return df.withColumn("date_eff", add_business_days(F.col("date"), days))


def ic_timeseries(df: DataFrame, factors: list[str], forward: str, freq: str = "D", least: int = 10, method: str = "spearman", date: str = "date_eff") -> DataFrame:
    """date, factor, ic, n, and month (of the trading date). Every date has a row for every factor; ic is null where names
    are too few or have no spread. Rebalance dates are taken before the factors are stacked."""
    if freq[:1].upper() == "M":
        df = df.filter(F.col("date") == last_weekday(F.col("date")))
    names = df.groupBy(F.col(date).alias("_d")).agg(F.countDistinct("ticker").alias("n"), F.max(F.last_day("date")).alias("month"))
    long = df.select(F.col(date).alias("_d"), F.col(forward).alias("y"), *factors).unpivot(["_d", "y"], factors, "factor", "x").dropna(subset=["x", "y"])
    if method == "spearman":
        long = ranks(long, ["x", "y"], ["_d", "factor"])
    ic = long.groupBy("_d", "factor").agg(F.when(F.count(F.lit(1)) >= least, pearson("x", "y")).alias("ic"))
    grid = names.select("_d", "n", "month", F.explode(F.array(*map(F.lit, factors))).alias("factor"))
    out = grid.join(ic, ["_d", "factor"], "left")
    return out.select(F.col("_d").alias("date"), "factor", F.when(F.col("n") >= least, F.col("ic")).alias("ic"), "n", "month")


def newey_west(ic: DataFrame, lags: int, keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    """keys, t_NW: Bartlett-kernel t statistic of the mean; null below five values. Self-join of the demeaned series by
    position, `lags` rows each."""
    w = Window.partitionBy(*keys)
    x = ic.filter(F.col("ic").isNotNull()).select(*keys, F.row_number().over(w.orderBy("date")).alias("i"), (F.col("ic") - F.avg("ic").over(w)).alias("c"), F.avg("ic").over(w).alias("m"), F.count("ic").over(w).alias("n"))
    own = x.groupBy(*keys).agg(F.first("m").alias("m"), F.first("n").alias("n"), F.sum(F.col("c") * F.col("c")).alias("g0"))
    if lags > 0:
        ahead = x.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), F.col("i").alias("_i"), F.col("c").alias("_c")).withColumn("i", F.col("_i") + F.col("lag"))
        weight = 1 - F.col("lag") / F.lit(lags + 1.0)
        cross = x.join(ahead, [*keys, "i"]).groupBy(*keys).agg(F.sum(2 * weight * F.col("c") * F.col("_c")).alias("g"))
        own = own.join(cross, list(keys), "left")
    else:
        own = own.withColumn("g", F.lit(0.0))
    variance = (F.col("g0") + F.coalesce("g", F.lit(0.0))) / F.col("n")
    error = F.sqrt(F.when(variance > 0, variance / F.col("n")))
    return own.select(*keys, F.when(F.col("n") >= 5, ratio(F.col("m"), error)).alias("t_NW"))


def ic_summary(ic: DataFrame, freq: str = "D", horizon: int = 1, keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    """keys, mean, std, IR_ann, hit_rate, n, t_NW."""
    year = 252.0 if freq[:1].upper() == "D" else 12.0
    base = ic.groupBy(*keys).agg(
        F.avg("ic").alias("mean"), F.nullif(F.when(F.count("ic") > 1, F.stddev_samp("ic")), F.lit(0.0)).alias("_sd"), F.when(F.count("ic") > 1, F.stddev_samp("ic")).alias("std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.count("ic").alias("n"),
    )
    base = base.withColumn("IR_ann", F.col("mean") / F.col("_sd") * F.sqrt(F.lit(year))).drop("_sd")
    return base.join(newey_west(ic, max(0, horizon - 1), keys), list(keys), "left")


def fdr_bh(df: DataFrame, p: str = "p_NW", by: tuple[str, ...] = ()) -> DataFrame:
    """q_BH: Benjamini-Hochberg, a null p counting as 1. Only for summaries: a group is one window partition."""
    df = df.withColumns({"_p": F.coalesce(p, F.lit(1.0)), "_all": F.lit(1)})
    w = Window.partitionBy("_all", *by)
    df = df.withColumns({"_i": F.row_number().over(w.orderBy("_p", "factor")), "_m": F.count(F.lit(1)).over(w)})
    back = w.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("q_BH", F.least(F.lit(1.0), F.min(F.col("_m") * F.col("_p") / F.col("_i")).over(back))).drop("_p", "_i", "_m", "_all")


def ic_significance(ic: DataFrame, freq: str = "D", horizon: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """ic_summary with two-sided p values and false-discovery q values."""
    out = ic_summary(ic, freq, horizon, (*by, "factor")).withColumn("p_NW", two_sided_p("t_NW"))
    return fdr_bh(out, by=by)


def select_factors(summary: DataFrame, q: float = 0.10, top: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Factors with q_BH <= q and a positive mean; where there are none, the first by mean."""
    df = summary.withColumns({"_ok": (F.col("q_BH") <= q) & (F.col("mean") > 0), "_all": F.lit(1)})
    w = Window.partitionBy("_all", *by)
    df = df.withColumns({"_any": F.coalesce(F.max(F.col("_ok").cast("int")).over(w), F.lit(0)), "_k": F.row_number().over(w.orderBy(F.desc_nulls_last("mean"), "factor"))})
    return df.filter(F.when(F.col("_any") == 1, F.col("_ok")).otherwise(F.col("_k") <= top)).select(*by, "factor", "mean", "q_BH")


def top_n(df: DataFrame, column: str, n: int = 20, ascending: bool = False, date=None) -> DataFrame:
    """The n first rows of one date, nulls last either way, ties by ticker."""
    rows = snapshot(df, [], date)
    order = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return rows.orderBy(order, "ticker").limit(n).select("date", "ticker", column)


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
