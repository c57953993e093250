"""Per-date operators: scores, clipping, buckets and regressions on groups.

Windows partition by date, or by date and a group, so one exchange on the date serves them; regressions on several groups
exchange sums by date and levels, not names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clip
from ..sources.stage import drop_shuffles, staged
from .panel import month_end_rows

DATE = ("date",)
QUANTILES = (0.2, 0.4, 0.6, 0.8, 1.0)
#: Factors whose sums or values are exchanged at a time from a stored panel.
AT_ONCE = 6


def zscore(column: str, by: tuple[str, ...] = DATE) -> Column:
    """(x - mean) / population deviation; 0 where there is no deviation."""
    x, w = F.col(column), Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd == 0, x * 0.0).otherwise((x - F.avg(x).over(w)) / F.nullif(sd, F.lit(0.0)))


def add_zscores(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """zscore() on every date for several columns (name of the score by column): a row of means and deviations a date is
    joined, so that the panel itself is not exchanged. Rows without a date go."""
    return _joined_zscores(df, names, df.groupBy("date").agg(*(f(c).alias(f"_{k}_{c}") for c in names for k, f in (("avg", F.avg), ("sd", F.stddev_pop)))))


def _joined_zscores(df: DataFrame, names: dict[str, str], moments: DataFrame) -> DataFrame:
    out = {}
    for c, name in names.items():
        x, mean, sd = F.col(c), F.col(f"_avg_{c}"), F.col(f"_sd_{c}")
        out[name] = F.when(sd == 0, x * 0.0).otherwise((x - mean) / F.nullif(sd, F.lit(0.0)))
    return df.join(F.broadcast(moments), "date").withColumns(out).drop(*(f"_{k}_{c}" for c in names for k in ("avg", "sd")))


def add_robust_z(df: DataFrame, column: str, name: str, by: tuple[str, ...] = DATE) -> DataFrame:
    """(x - median) / (1.4826 * MAD); where the MAD is 0 the population deviation, where that is 0 one."""
    return add_robust_zs(df, {column: name}, by)


def add_robust_zs(df: DataFrame, names: dict[str, str], by: tuple[str, ...] = DATE) -> DataFrame:
    """add_robust_z for several columns (name of the score by column) in the same three steps."""
    w = Window.partitionBy(*by)
    df = df.withColumns({f"_med_{c}": F.median(c).over(w) for c in names})
    df = df.withColumns({f"_dev_{c}": F.abs(F.col(c) - F.col(f"_med_{c}")) for c in names})
    df = df.withColumns({f"_mad_{c}": F.median(f"_dev_{c}").over(w) * 1.4826 for c in names} | {f"_sd_{c}": F.stddev_pop(c).over(w) for c in names})
    return _robust_zs(df, names).drop(*(f"_dev_{c}" for c in names))


def _robust_zs(df: DataFrame, names: dict[str, str]) -> DataFrame:
    out = {}
    for c, name in names.items():
        mad, sd = F.col(f"_mad_{c}"), F.col(f"_sd_{c}")
        out[name] = (F.col(c) - F.col(f"_med_{c}")) / F.when(mad > 0, mad).when(sd > 0, sd).otherwise(F.lit(1.0))
    return df.withColumns(out).drop(*(f"_{k}_{c}" for k in ("med", "mad", "sd") for c in names))


def _some(names: list[str]) -> list[list[str]]:
    return [names[i : i + AT_ONCE] for i in range(0, len(names), AT_ONCE)]


def add_stored_zs(df: DataFrame, names: dict[str, str], robust: bool, stored: list[DataFrame]) -> DataFrame:
    """add_zscores() or, if robust, add_robust_zs() on every date of a table that comes from a stored one: what they need, a
    row a date, is stored for a few columns at a time (and put into `stored`), then joined, so that scores are columns
    wherever they are read and the panel is neither exchanged nor stored again. Rows without a date go."""
    w, found = Window.partitionBy("date"), []
    for some in _some(list(names)):
        kinds = ("med", "mad", "sd") if robust else ("avg", "sd")
        if robust:
            rows = df.select("date", *some).withColumns({f"_med_{c}": F.median(c).over(w) for c in some})
            rows = rows.withColumns({f"_mad_{c}": F.median(F.abs(F.col(c) - F.col(f"_med_{c}"))).over(w) * 1.4826 for c in some} | {f"_sd_{c}": F.stddev_pop(c).over(w) for c in some})
            moments = rows.groupBy("date").agg(*(F.first(f"_{k}_{c}").alias(f"_{k}_{c}") for c in some for k in kinds))
        else:
            moments = df.groupBy("date").agg(*(f(c).alias(f"_{k}_{c}") for c in some for k, f in (("avg", F.avg), ("sd", F.stddev_pop))))
        stored.append(staged(moments, "moments"))
        drop_shuffles(df.sparkSession)
        found.append(({c: names[c] for c in some}, stored[-1]))
    for some, moments in found:
        df = _robust_zs(df.join(F.broadcast(moments), "date"), some) if robust else _joined_zscores(df, some, moments)
    return df


def winsorize(column: str, by: tuple[str, ...] = DATE, low: float = 0.01, high: float = 0.99) -> Column:
    w = Window.partitionBy(*by)
    q = F.percentile(F.col(column), F.array(F.lit(low), F.lit(high))).over(w)
    return clip(F.col(column), q[0], q[1])


def relative_to_group(column: str, group: str) -> Column:
    """x less the median of its group on its date; null without a group."""
    w = Window.partitionBy("date", group)
    return F.when(F.col(group).isNotNull(), F.col(column) - F.median(column).over(w))


def bucket(column: str) -> Column:
    """Quantile bucket of the date without a lower edge: below the 20 % quantile null, then 0 to 3. Equal edges fall
    together and the buckets above close up; with a single edge all are null."""
    return _place(F.col(column), _edges(column))


def _edges(column: str) -> Column:
    return F.array_distinct(F.percentile(F.col(column), F.array(*map(F.lit, QUANTILES))).over(Window.partitionBy("date")))


def _place(x: Column, edges: Column) -> Column:
    place = F.greatest(F.size(F.filter(edges, lambda e: e < x)) - 1, F.lit(0))
    return F.when((F.size(edges) > 1) & (x >= edges[0]), place)


def add_groups(df: DataFrame) -> DataFrame:
    """Relative momentum and the size and liquidity buckets. Dealt by date once: windows on (date, group) keep that."""
    return df.repartition("date").withColumns({
        "country_rel_mom_6_1": relative_to_group("mom_6_1", "country"),
        "sector_rel_mom_6_1": relative_to_group("mom_6_1", "supersector"),
        "size_bucket": bucket("size_proxy"),
        "liq_bucket": bucket("liq_proxy"),
    })


def add_stored_groups(df: DataFrame) -> DataFrame:
    """add_groups(), of which only the columns that medians and edges come from are dealt by date: these are stored, a row a
    date, and joined, so that the panel itself is not exchanged and stays dealt by ticker."""
    relative = {"country_rel_mom_6_1": "country", "sector_rel_mom_6_1": "supersector"}
    buckets = {"size_bucket": "size_proxy", "liq_bucket": "liq_proxy"}
    rows = df.select("date", *relative.values(), "mom_6_1", *buckets.values()).repartition("date")
    rows = rows.withColumns({f"_{n}": F.median("mom_6_1").over(Window.partitionBy("date", g)) for n, g in relative.items()} | {f"_{n}": _edges(c) for n, c in buckets.items()})
    limits = rows.groupBy(F.col("date").alias("_date")).agg(
        *(F.map_from_entries(F.collect_set(F.when(F.col(g).isNotNull(), F.struct(F.col(g), F.col(f"_{n}"))))).alias(f"_{n}") for n, g in relative.items()),
        *(F.first(f"_{n}").alias(f"_{n}") for n in buckets),
    )
    limits = F.broadcast(staged(limits, "groups"))
    drop_shuffles(df.sparkSession)
    out = df.join(limits, df["date"].eqNullSafe(limits["_date"]), "left").withColumns({n: F.col("mom_6_1") - F.try_element_at(f"_{n}", F.col(g)) for n, g in relative.items()} | {n: _place(F.col(c), F.col(f"_{n}")) for n, c in buckets.items()})
    return out.drop("_date", *(f"_{n}" for n in (*relative, *buckets)))


def demean_by(column: str, group: str, first: str, least: int = 2) -> Column:
    """The residual on one group's dummies, which is x less the group's mean. A null group counts as `first`; dates with
    fewer than `least` values have none."""
    x = F.col(column)
    own = F.avg(x).over(Window.partitionBy("date", F.coalesce(F.col(group).cast("string"), F.lit(first))))
    return F.when(F.count(x).over(Window.partitionBy("date")) >= least, x - own)


def _coefficients(factors: list[str], levels: list[int], numeric: int, full: bool, least: int, ridge: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sums of a month's cells to the coefficients of each date: intercept, levels of each group, numeric columns."""
    first = 0 if full else 1
    place = [0]  # of each design column in the full layout
    for k, n in enumerate(levels):
        place += range(1 + sum(levels[:k]) + first, 1 + sum(levels[: k + 1]))
    place += range(1 + sum(levels), 1 + sum(levels) + numeric)
    width, m = len(place), len(factors)

    def run(month: pd.DataFrame) -> pd.DataFrame:
        out = []
        for date, cells in month.groupby("date"):
            codes = np.stack([cells[f"_c{k}"].to_numpy() for k in range(len(levels))], axis=1) if levels else np.zeros((len(cells), 0))
            d = np.concatenate([np.ones((len(cells), 1)), *((codes[:, [k]] == np.arange(first, n)).astype(float) for k, n in enumerate(levels))], axis=1)
            n, y, yy = (np.stack(cells[c].to_numpy()) for c in ("_n", "_y", "_yy"))
            x, xx, xy = (np.stack(cells[c].to_numpy()).reshape(len(cells), m, *([numeric] * k)) for c, k in (("_x", 1), ("_xx", 2), ("_xy", 1)))
            row = {"date": date}
            for j, f in enumerate(factors):
                seen = n[:, j].sum()
                if seen < (width + 1 if full else least):
                    row[f"_b_{f}"], row[f"_s_{f}"] = None, None
                    continue
                gram = np.zeros((width, width))
                k = d.shape[1]
                gram[:k, :k] = d.T @ (n[:, [j]] * d)
                gram[:k, k:] = d.T @ x[:, j]
                gram[k:, :k] = gram[:k, k:].T
                gram[k:, k:] = xx[:, j].sum(axis=0)
                right = np.concatenate([d.T @ y[:, j], xy[:, j].sum(axis=0)])
                beta = np.zeros(1 + sum(levels) + numeric)
                beta[place] = np.linalg.solve(gram + ridge * np.eye(width), right) if ridge else np.linalg.lstsq(gram, right, rcond=1e-12)[0]
                row[f"_b_{f}"], row[f"_s_{f}"] = beta, None if ridge else float(np.sqrt(yy[:, j].sum() / seen))
            out.append(row)
        return pd.DataFrame(out)

    return run


def neutralize(df: DataFrame, factors: list[str], by: list[str], mode: str = "drop_first", least: int = 2, ridge: float = 0.0, numeric: tuple[str, ...] = (), stored: list[DataFrame] | None = None) -> DataFrame:
    """Adds <factor>_neu: per-date residuals on intercept and dummies of `by`.

    drop_first: a null level shares the baseline, the first level of the whole table. full: all levels get a dummy, null
    rows none, `numeric` columns enter as they are, and a date needs more rows than columns. Without a
    ridge a residual below 1e-9 of the date's root mean square is 0 (a date with no more names than columns has no others).

    With one key and no ridge the residuals are differences from group means. Else Spark sums each date's cells, the
    combinations of levels that occur; from these come the cross products of the dummies, a small solve a date gives the
    coefficients, and residuals are columns. The table is staged once; its levels, a row, are the codes. Given a list `stored`,
    the table is a stored one: the coefficients of a few factors at a time are stored, put into the list and broadcast, so
    that cells have few columns and rows of the panel are not exchanged. Rows without a date go."""
    if stored is None:
        df = staged(df, "neutralize")
    found_all = df.agg(*(F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in by)).first()  # a row of levels
    if len(by) == 1 and mode == "drop_first" and not ridge and not numeric:
        first = (found_all[0] or [""])[0]
        return df.withColumns({f"{f}_neu": demean_by(f, by[0], first, least) for f in factors})
    full, own, levels = mode == "full", df.columns, []
    for k, c in enumerate(by):
        found = found_all[k]
        levels.append(max(1, len(found)))
        code = F.array_position(F.array(*map(F.lit, found)), F.col(c).cast("string")) - 1 if found else F.lit(None)
        df = df.withColumn(f"_c{k}", F.coalesce(code, F.lit(-1 if full else 0)).cast("int"))
    codes, zero = [f"_c{k}" for k in range(len(by))], F.lit(0.0)
    complete = reduce(and_, (F.col(c).isNotNull() for c in numeric), F.lit(True))
    ys = {f: F.when(complete, F.col(f)) for f in factors}

    def sums(terms: list[Column]) -> Column:
        return F.array(*(F.coalesce(F.sum(t), zero) for t in terms)) if terms else F.array().cast("array<double>")

    xs = {f: [F.when(F.col(f).isNotNull() & complete, F.col(c).cast("double")) for c in numeric] for f in factors}

    def betas(some: list[str]) -> DataFrame:
        cells = sums_of.groupBy(F.date_trunc("month", "date").alias("_m"), "date", *codes).agg(
            F.array(*(F.count(ys[f]) for f in some)).alias("_n"), sums([ys[f] for f in some]).alias("_y"), sums([] if ridge else [ys[f] * ys[f] for f in some]).alias("_yy"),
            sums([x for f in some for x in xs[f]]).alias("_x"), sums([a * b for f in some for a in xs[f] for b in xs[f]]).alias("_xx"), sums([x * ys[f] for f in some for x in xs[f]]).alias("_xy"),
        )
        kinds = "date date, " + ", ".join(f"`_b_{f}` array<double>, `_s_{f}` double" for f in some)
        return cells.groupBy("_m").applyInPandas(_coefficients(some, levels, len(numeric), full, least, ridge), kinds)

    at, places = 1, {}
    for k, n in enumerate(levels):
        places[f"_p{k}"], at = F.when(F.col(f"_c{k}") >= 0, F.col(f"_c{k}") + at), at + n
    sums_of, df = df, df.withColumns(places) if places else df
    if stored is None:
        df = df.join(betas(factors), "date")  # a row a date; Spark broadcasts it while it is small
    else:
        found = []
        for some in _some(factors):
            found.append(staged(betas(some), "coefficients"))
            drop_shuffles(df.sparkSession)
        for few in found:
            df = df.join(F.broadcast(few), "date")
        stored += found
    out = {}
    for f in factors:
        b = F.col(f"_b_{f}")
        fit = F.get(b, F.lit(0))
        for p in places:
            fit = fit + (F.coalesce(F.get(b, F.col(p)), F.when(F.col(p).isNull(), zero)) if full else F.get(b, F.col(p)))
        for k, c in enumerate(numeric):
            fit = fit + F.get(b, F.lit(at + k)) * F.col(c)
        left = F.col(f) - fit
        out[f"{f}_neu"] = left if ridge else F.when(F.abs(left) <= 1e-9 * F.col(f"_s_{f}"), zero).otherwise(left)
    return df.select(*own, *(c.alias(n) for n, c in out.items()))


def neutralize_and_z(df: DataFrame, factors: list[str], by: list[str], robust: bool = False, keep: bool = False, raw: bool = True, stored: list[DataFrame] | None = None) -> DataFrame:
    """<factor>_z (if raw) and <factor>_neu_z on every date (regression with a small ridge), and with `keep` the residuals.
    stored: as neutralize() has it, for the scores too."""
    out = neutralize(df, factors, by, least=3, ridge=1e-8, stored=stored)
    names = {c: f"{c}_z" for f in factors for c in ((f, f"{f}_neu") if raw else (f"{f}_neu",))}
    if stored is not None:
        out = add_stored_zs(out, names, robust, stored)
    else:
        out = add_robust_zs(out, names) if robust else add_zscores(out, names)
    return out if keep else out.drop(*(f"{f}_neu" for f in factors))


def month_end_scores(df: DataFrame, factors: list[str], by: list[str] | None = None) -> DataFrame:
    """Ids, <factor>_z and, with `by`, <factor>_neu_z on the last date of each month."""
    df = month_end_rows(df)
    if by:
        df = neutralize(df, factors, by)
    z = {f"{f}_z": zscore(f) for f in factors} | ({f"{f}_neu_z": zscore(f"{f}_neu") for f in factors} if by else {})
    return df.withColumns(z).select("date", "ticker", "country", "supersector", *z)
