"""Time-series factors per ticker. All windows partition by ticker and order by date, so a frame is sorted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import by_ticker, ratio, running, with_trailing, within

RATIOS = (2, 3, 5, 10)
HORIZONS = (1, 5, 21, 40)


def daily_return(price: str = "price_eur", window=None) -> Column:
    return ratio(F.col(price), F.lag(price).over(window or by_ticker())) - 1


def past_return(near: int, far: int, price: str = "price_eur") -> Column:
    """Price `near` rows ago over price `far` rows ago, less one (the product of the returns between)."""
    w = by_ticker()
    return ratio(F.lag(price, near).over(w) if near else F.col(price), F.lag(price, far).over(w)) - 1


def _lags(column: str, step: int, most: int) -> list[Column]:
    """The column and what it was `step`, 2 * step, ... rows ago, `most` rows ago at the farthest."""
    at = sorted({min(k, most) for k in range(0, most + step, step)})
    return [F.lag(column, k).over(by_ticker()) if k else F.col(column) for k in at]


def _largest(arrays: Column, n: int) -> Column:
    return F.slice(F.sort_array(arrays, asc=False), 1, n)


def _mean(values: Column) -> Column:
    there = F.filter(values, lambda x: x.isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0))


def add_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"ret_1d_eur": daily_return(), "turnover_eur": F.col("price_eur") * F.coalesce("volume", F.lit(0.0))})


def deviation(rows: int, least: int) -> Column:
    """Sample deviation of the returns in the last `rows` rows, from running sums _n, _s and _ss. Daily returns lie near
    zero, so their squares need no centring."""
    n, s, ss = (within(c, rows) for c in ("_n", "_s", "_ss"))
    spread = F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1)
    return F.when(n >= least, F.sqrt(spread))


def add_factors(bars: DataFrame) -> DataFrame:
    """Momentum, reversal, volatility, size, liquidity and lottery factors of every row.

    No frame slides: sums and counts are differences of running ones; means of 20 rows are made from sums of 4, the maximum of
    252 rows from maxima of 4, 16 and 64 rows, and the five largest of 21 from the five largest of seven, by lags (a
    greatest() or an array skips rows that are not there)."""
    p, r, t = F.col("price_eur"), F.col("ret_1d_eur"), F.col("turnover_eur")
    df = add_returns(bars).withColumn("_illiq", ratio(F.abs(r), F.nullif(t, F.lit(0.0))))
    zero = (F.coalesce(r, F.lit(0.0)) == 0).cast("double")
    df = df.withColumns({
        "_n": running(r.isNotNull().cast("double")), "_s": running(r), "_ss": running(r * r), "_rows": running(F.lit(1.0)), "_zeros": running(zero), "_prices": running(p.isNotNull().cast("double")),
        "_max4": F.greatest(*_lags("price_eur", 1, 3)), "_top7": _largest(F.array(*_lags("ret_1d_eur", 1, 6)), 5),
    }).withColumns({"_max16": F.greatest(*_lags("_max4", 4, 12)), "_top21": _largest(F.flatten(F.filter(F.array(*_lags("_top7", 7, 14)), lambda a: a.isNotNull())), 5)})
    df = df.withColumn("_max64", F.greatest(*_lags("_max16", 16, 48)))
    df = with_trailing(df, {"t": t, "i": F.col("_illiq")}, (4, 5))
    df = df.withColumns({
        "mom_12_1": past_return(21, 273),
        "mom_6_1": past_return(21, 147),
        "ret_5d": F.when(F.lag(p, 5).over(by_ticker()).isNotNull(), past_return(0, 5)),
        "vol_60d": deviation(60, 40),
        "vol_252d": deviation(252, 200),
        "adv_eur_20": F.when(F.col("_n_t") >= 10, F.col("_s_t") / F.col("_n_t")),
        "hi52_prox": ratio(p, F.when(within("_prices", 252) >= 20, F.greatest(*_lags("_max64", 64, 188)))) - 1,
        "amihud_20d": F.when(F.col("_n_i") >= 10, F.col("_s_i") / F.col("_n_i")),
        "zero_ret_20d": F.when(within("_rows", 20) >= 10, within("_zeros", 20) / within("_rows", 20)),
        "max5_21d": F.when(within("_n", 21) >= 10, _mean(F.col("_top21"))),
    })
    return df.withColumns({
        "rev_5d": -F.col("ret_5d"),
        "size_proxy": F.ln(F.nullif(F.col("adv_eur_20"), F.lit(0.0))),
        "liq_proxy": -F.ln(F.nullif(F.col("amihud_20d"), F.lit(0.0))),
    }).drop("_illiq", "_n", "_s", "_ss", "_rows", "_zeros", "_prices", "_max4", "_max16", "_max64", "_top7", "_top21", "_n_t", "_s_t", "_n_i", "_s_i")


def detect_splits(bars: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """ticker, date, ratio of price jumps near 2, 3, 5, 10 or their inverses with volume more than doubled or halved away."""
    df = bars.select("ticker", "date", "price_eur", "volume").dropna().withColumns({"_p": F.lag("price_eur").over(by_ticker()), "_v": F.lag("volume").over(by_ticker())})
    v, df = F.col("volume"), df.withColumn("ratio", ratio(F.col("price_eur"), F.col("_p")))
    near = [F.abs(F.col("ratio") - F.lit(k)) <= tolerance + 1e-5 * k for x in RATIOS for k in (float(x), 1.0 / x)]
    hit = near[0]
    for n in near[1:]:
        hit = hit | n
    blip = F.when(F.col("_v") == 0, v != 0).otherwise(F.abs(v / F.nullif(F.col("_v"), F.lit(0.0)) - 1) > 1)
    return df.filter(hit & blip).select("ticker", "date", "ratio")


def _with_growth(df: DataFrame, ret: str) -> DataFrame:
    """Running counts of returns, total losses and signs, and the running sum of log growth."""
    growth = 1 + F.col(ret)
    return df.withColumns({
        "_gn": running(F.col(ret).isNotNull().cast("double")), "_gz": running((growth == 0).cast("double")), "_gm": running((growth < 0).cast("double")),
        "_gl": running(F.when(growth != 0, F.ln(F.abs(growth)))),
    })


def forward_return(horizon: int) -> Column:
    """Compounded return of the next `horizon` rows, null unless all of them have one: from what is running, so that a row
    costs the same however long the horizon is. A total loss stays one."""
    n, zeros, below, logs = (F.lead(c, horizon).over(by_ticker()) - F.col(c) for c in ("_gn", "_gz", "_gm", "_gl"))
    sign = F.when(below % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(n == horizon, F.when(zeros > 0, F.lit(0.0)).otherwise(sign * F.exp(logs)) - 1)


def add_forward_returns(df: DataFrame, ret: str = "ret_1d_eur", horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    return _with_growth(df, ret).withColumns({f"fwd_{h}d": forward_return(h) for h in horizons}).drop("_gn", "_gz", "_gm", "_gl")


def shock_tags(df: DataFrame, z: float = 3.0, ret_sigma: float = 3.0) -> DataFrame:
    """vol_z and ret_z against the last 60 rows, and shock_day where either is beyond its limit. Moments of 60 rows are merged
    from those of 3 and 12."""
    ret = "ret_1d_eur" if "ret_1d_eur" in df.columns else "ret_effective"
    there = [c for c in ("volume", ret) if c in df.columns]
    df = with_trailing(df, {c: F.col(c) for c in there}, (3, 4, 5), spread=True)

    def score(c: str) -> Column:
        n, s, v = (F.col(f"_{k}_{c}") for k in "nsv")
        return F.when(n >= 40, (F.col(c) - s / n) / (F.sqrt(v / (n - 1)) + 1e-9))

    df = df.withColumns({"vol_z": score("volume") if "volume" in df.columns else F.lit(None).cast("double"), "ret_z": score(ret)})
    shock = F.coalesce(F.abs("vol_z") > z, F.lit(False)) | F.coalesce(F.abs("ret_z") > ret_sigma, F.lit(False))
    return df.select("date", "ticker", "vol_z", "ret_z", shock.cast("int").alias("shock_day"))


def index_returns(index: DataFrame) -> DataFrame:
    w = Window.partitionBy("index_ticker").orderBy("date")
    return index.withColumn("ret_1d", daily_return("index_close", w))
