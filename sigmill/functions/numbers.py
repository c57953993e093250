"""Null-safe numbers: missing is NULL, never NaN."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """A double, or null where the text is none or the number is not finite."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def by_ticker(date: str = "date", ticker: str = "ticker") -> WindowSpec:
    return Window.partitionBy(ticker).orderBy(date)


def running(x: Column) -> Column:
    """Sum of the ticker's values up to this row, null ones counting as zero."""
    return F.sum(F.coalesce(x, F.lit(0.0))).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))


def within(total: str, rows: int) -> Column:
    """The sum over the last `rows` rows, by the running sum of that name: constant work a row, however long the window."""
    return F.col(total) - F.coalesce(F.lag(total, rows).over(by_ticker()), F.lit(0.0))


def with_trailing(df: DataFrame, columns: dict[str, Column], steps: tuple[int, ...], spread: bool = False) -> DataFrame:
    """Adds _n_<name> and _s_<name>, count and sum of each column's values in the last rows (as many as the product of
    `steps`), and with `spread` _v_<name>, the sum of their squared deviations. Blocks of steps[0] rows are merged to
    blocks of steps[0] * steps[1] and so on by lags: work by the sum of the steps, and nothing of older rows is subtracted."""
    df = df.withColumns({f"_n_{c}": x.isNotNull().cast("double") for c, x in columns.items()} | {f"_s_{c}": F.coalesce(x.cast("double"), F.lit(0.0)) for c, x in columns.items()})
    kinds, stride = ["n", "s"], 1
    for step in steps:
        past = {f"_{k}_{c}_{i}": F.lag(f"_{k}_{c}", i * stride, 0.0).over(by_ticker()) for k in kinds for c in columns for i in range(1, step)}
        df, merged = df.withColumns(past), {}
        for c in columns:
            part = {k: [F.col(f"_{k}_{c}"), *(F.col(f"_{k}_{c}_{i}") for i in range(1, step))] for k in kinds}
            total = {k: reduce(add, part[k]) for k in kinds}
            merged |= {f"_{k}_{c}": x for k, x in total.items()}
            if spread:
                off = [F.when(n > 0, n * F.pow(s / n - total["s"] / total["n"], F.lit(2.0))).otherwise(F.lit(0.0)) for n, s in zip(part["n"], part["s"])]
                merged[f"_v_{c}"] = reduce(add, off, total.get("v", F.lit(0.0)))
        df, stride = df.withColumns(merged).drop(*past), stride * step
        if spread:
            kinds = ["n", "s", "v"]
    return df


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; null stays null, and a null bound does not bind."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def flat(changed_at: str, count: str, rows: int) -> Column:
    """Whether a series had one value only in the last `rows` rows: it has `count` values up to this row, the last of another
    value than the one before it was number `changed_at`."""
    return F.col(count) - F.col(changed_at) + 1 >= within(count, rows)


def last_change(x: Column, count: str) -> Column:
    """The number, among the ticker's values of x, of the last one that differs from the value before it."""
    up_to = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    before = F.last(x, ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, -1))
    return F.max(F.when(x.isNotNull() & ~x.eqNullSafe(before), F.col(count))).over(up_to)


def erfc(z: Column, terms: int = 60) -> Column:
    """The complementary error function of z >= 0: the series of erf below 2, the continued fraction from there on."""
    steps, scale = F.sequence(F.lit(1), F.lit(terms)), F.exp(-z * z) / math.sqrt(math.pi)
    start = F.struct(z.alias("term"), z.alias("sum"))

    def term_of(a: Column, k: Column) -> Column:
        term = a["term"] * 2 * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    series = 1 - 2 * scale * F.aggregate(steps, start, term_of)["sum"]
    fraction = scale / (z + F.aggregate(F.reverse(steps), F.lit(0.0), lambda a, k: k / 2.0 / (z + a)))
    return F.when(z < 2, series).otherwise(fraction)


def two_sided_p(t: Column | str) -> Column:
    """erfc(|t| / sqrt 2)."""
    return erfc(F.abs(F.col(t) if isinstance(t, str) else t) / math.sqrt(2.0))


def row_mean(columns: list[Column]) -> Column:
    """Mean of the non-null columns; null if all are null."""
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(n > 0, total / n)


def weighted_sum(pairs: list[tuple[Column, Column]]) -> Column:
    """Sum of weight times value, a null value counting as zero (so 0 where all are null)."""
    return sum((w * F.coalesce(x, F.lit(0.0)) for w, x in pairs), F.lit(0.0))
