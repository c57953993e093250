"""Cleaning and keys of the daily panel (date, ticker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import last_weekday, month_end, month_label, to_date
from ..functions.numbers import clip, number
from ..sources.stage import release, staged

#: Panel columns that are no factors. Fixed values.
NOT_FACTORS = {
    "price_eur", "volume", "ret_1d_eur", "excess_ret_1d_eur", "country_mkt_ret_1d", "mkt_ret",
    "turnover_eur", "ret_5d", "ret_effective", "fwd_1d", "fwd_5d", "fwd_21d", "fwd_40d",
}


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def standardize_prices(df: DataFrame) -> DataFrame:
    """Typed and renamed bars; rows without date, close or ticker go."""
    require_columns(df, "Date", "Close", "Volume", "Ticker_YF", "Supersector", "Country")
    out = df.select(
        to_date(F.col("Date")).alias("date"), F.col("Ticker_YF").alias("ticker"), number(F.col("Close")).alias("price_eur"),
        number(F.col("Volume")).alias("volume"), F.col("Supersector").alias("supersector"), F.col("Country").alias("country"),
    )
    return out.dropna(subset=["date", "price_eur", "ticker"])


def dedupe_daily(df: DataFrame, order: str) -> DataFrame:
    """One row for each (ticker, date): the first by `order`. Hashed by ticker alone, so the factor windows reuse it."""
    first = Window.partitionBy("ticker", "date").orderBy(F.col(order).asc_nulls_last())
    return df.repartition("ticker").withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def standardize_index(df: DataFrame, country_map: dict[str, str] | None = None) -> DataFrame:
    """date, country, index_ticker, index_close from columns in any case; incomplete rows go."""
    have = {c.lower(): c for c in df.columns}

    def pick(*names: str) -> Column:
        for n in names:
            if n in have:
                return F.col(f"`{have[n]}`")
        raise KeyError(f"none of {names}")

    country = pick("country")
    if country_map:
        country = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in country_map.items() for x in kv)), country), country)
    return df.select(
        to_date(pick("date")).alias("date"), country.cast("string").alias("country"),
        pick("index_ticker", "ticker").cast("string").alias("index_ticker"), number(pick("index_close", "close")).alias("index_close"),
    ).dropna()


def drop_unreturned(df: DataFrame, ret: str = "ret_1d_eur") -> DataFrame:
    return df.filter(F.col(ret).isNotNull())


def pick_return(df: DataFrame, prefer_excess: bool = True) -> Column:
    """The excess return column where it exists and is preferred, else the raw one."""
    if prefer_excess and "excess_ret_1d_eur" in df.columns:
        return F.col("excess_ret_1d_eur")
    require_columns(df, "ret_1d_eur")
    return F.col("ret_1d_eur")


def month_end_rows(df: DataFrame) -> DataFrame:
    """Rows of the last date that the data has in each month."""
    last = df.groupBy(month_end(F.col("date")).alias("_m")).agg(F.max("date").alias("date")).select("date")
    return df.join(F.broadcast(last), "date", "left_semi")  # a row a month


def last_weekday_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("date") == last_weekday(F.col("date")))


def effective_return(df: DataFrame, prefer: str = "excess_ret_1d_eur", fallback: str = "ret_1d_eur", winsorize: bool = True,
                     low: float = 0.01, high: float = 0.99, approximate: bool = False, stage: bool = True) -> DataFrame:
    """ret_effective: the preferred return, else the fallback, each clipped at quantiles of the whole table. stage=False: the
    table is a stored one and is read as it is."""
    if not winsorize:
        return df.withColumn("ret_effective", F.coalesce(prefer, fallback))
    names = list(dict.fromkeys([prefer, fallback]))
    limits = global_limits(df, names, low, high, approximate, stage)
    return df.withColumn("ret_effective", F.coalesce(*(clip(F.col(c), *map(F.lit, limits[c])) for c in names)))


def global_limits(df: DataFrame, columns: list[str], low: float, high: float, approximate: bool = False, stage: bool = True) -> dict[str, list[float | None]]:
    """The two quantiles of each column over the whole table (an action)."""
    if approximate:
        row = df.agg(*(F.percentile_approx(c, [low, high], 100_000).cast("array<double>").alias(c) for c in columns)).first()
        return {c: list(row[c] or [None, None]) for c in columns}
    return exact_quantiles(df, columns, [low, high], stage=stage)


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], brackets: dict[str, list[tuple[float, float]]], most: int = 10_000, accuracy: int = 10_000) -> dict[str, list[float]]:
    """The values of these ranks (from 0) of each column, by distributed selection from a first guess of brackets.

    Each round counts what lies below, on and inside every bracket. A value on an edge is found; a bracket that misses its
    rank moves; one that holds few values hands them over; else an approximate quantile of what is inside, and two beside it,
    narrow it. No task or driver ever holds more than `most` values of a bracket."""
    open_ = {(c, k): list(at) for c in ranks for k, at in zip(ranks[c], brackets[c])}
    low, high = float("-inf"), float("inf")
    found: dict[tuple[str, int], float] = {}
    while open_:
        keys = list(open_)

        def inside(key: tuple[str, int]) -> Column:
            a, b = open_[key]
            return F.when((F.col(key[0]) > a) & (F.col(key[0]) < b), F.col(key[0]))

        counts = df.agg(*(F.array(F.count(F.when(F.col(c) < open_[c, k][0], 1)), F.count(F.when(F.col(c) == open_[c, k][0], 1)), F.count(inside((c, k))), F.count(F.when(F.col(c) == open_[c, k][1], 1))).alias(str(i)) for i, (c, k) in enumerate(keys))).first()
        few, many = {}, {}
        for i, key in enumerate(keys):
            below, left, between, right = counts[str(i)]
            a, b = open_[key]
            at = key[1] - below
            if at < 0:
                open_[key] = [low, a]
            elif at < left:
                found[key] = a
            elif at < left + between:
                (few if between <= most else many)[key] = (at - left, between)
            elif at < left + between + (right if b > a else 0):
                found[key] = b
            else:
                open_[key] = [b, high]
        if few:
            rows = df.agg(*(F.sort_array(F.collect_list(inside(key))).alias(str(i)) for i, key in enumerate(few))).first()
            found |= {key: rows[str(i)][at] for i, (key, (at, _)) in enumerate(few.items())}
        if many:
            step = 2.0 / accuracy
            near = {key: [min(1.0, max(0.0, (at + 0.5) / n + d)) for d in (-step, 0.0, step)] for key, (at, n) in many.items()}
            rows = df.agg(*(F.percentile_approx(inside(key), near[key], accuracy).alias(str(i)) for i, key in enumerate(many))).first()
            for i, key in enumerate(many):
                a, mid, b = rows[str(i)]
                open_[key] = [a, b] if (a, b) != tuple(open_[key]) else [mid, b]
        open_ = {key: at for key, at in open_.items() if key not in found}
    return {c: [found[c, k] for k in ranks[c]] for c in ranks}


def exact_quantiles(df: DataFrame, columns: list[str], quantiles: list[float], most: int = 10_000, accuracy: int = 10_000, stage: bool = True) -> dict[str, list[float | None]]:
    """Quantiles of each column over the whole table, interpolated linearly; None without values. The columns are staged
    (unless stage=False: a stored table) until the values are found; every pass over them is a small aggregate that executors
    merge."""
    df = df.select(*columns)
    if stage:
        df = staged(df, "quantiles")
    step = 2.0 / accuracy
    near = [min(1.0, max(0.0, q + d)) for q in quantiles for d in (-step, step)]
    row = df.agg(*(F.struct(F.count(c).alias("n"), F.percentile_approx(c, near, accuracy).alias("q")).alias(c) for c in columns)).first()
    ranks, brackets = {}, {}
    for c in columns:
        if row[c]["n"]:
            at = [q * (row[c]["n"] - 1) for q in quantiles]
            pairs = [(int(h), min(int(h) + 1, row[c]["n"] - 1)) for h in at]
            ranks[c] = list(dict.fromkeys(k for pair in pairs for k in pair))
            of = {k: (float(row[c]["q"][2 * i]), float(row[c]["q"][2 * i + 1])) for i, pair in enumerate(pairs) for k in pair}
            brackets[c] = [of[k] for k in ranks[c]]
    values = order_statistics(df, ranks, brackets, most, accuracy)
    if stage:
        release(df)
    out: dict[str, list[float | None]] = {c: [None] * len(quantiles) for c in columns}
    for c in ranks:
        known = dict(zip(ranks[c], values[c]))
        for i, q in enumerate(quantiles):
            h = q * (row[c]["n"] - 1)
            a, b = known[int(h)], known[min(int(h) + 1, row[c]["n"] - 1)]
            out[c][i] = a + (b - a) * (h - int(h))
    return out


def clip_global(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, approximate: bool = False) -> DataFrame:
    limits = global_limits(df, [column], low, high, approximate)[column]
    return df.withColumn(column, clip(F.col(column), *map(F.lit, limits)))


def factor_columns(df: DataFrame, only: list[str] | None = None) -> list[str]:
    """The floating columns that are factors."""
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in NOT_FACTORS]
    return [c for c in found if only is None or c in only]


def key_faults(df: DataFrame) -> DataFrame:
    """ticker, date and rows of keys that occur more than once."""
    return df.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def snapshot(df: DataFrame, columns: list[str], date=None) -> DataFrame:
    """Rows of one date (the last one if none is given) that have all columns."""
    if date is not None:
        return df.filter(F.col("date") == F.lit(date).cast("date")).dropna(subset=columns)
    last = df.agg(F.max("date").alias("date"))
    return df.join(F.broadcast(last), "date", "left_semi").dropna(subset=columns)


def add_crosswalk(prices: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Adds supersector and country by ticker. The crosswalk has a row for each name; Spark broadcasts it while small."""
    return prices.join(crosswalk, "ticker", "left")


def universe_monthly(df: DataFrame) -> DataFrame:
    """month, month_end and the sorted tickers seen in it."""
    seen = df.select("date", "ticker").dropna().select(month_label(F.col("date")).alias("month"), month_end(F.col("date")).alias("month_end"), "ticker").distinct()
    return seen.groupBy("month", "month_end").agg(F.sort_array(F.collect_list("ticker")).alias("tickers"))


def universe_filter(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows whose ticker is listed for their month. A ticker's months are one row, so that a panel dealt by ticker stays so."""
    listed = universe.select(F.col("month_end").alias("_m"), F.explode("tickers").alias("ticker")).groupBy("ticker").agg(F.collect_set("_m").alias("_months"))
    return df.join(listed, "ticker").filter(F.array_contains("_months", month_end(F.col("date")))).select(*df.columns)
