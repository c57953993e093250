import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.functions.numbers import two_sided_p
from sigmill.operators import cross_section, folds, performance, portfolio, statistics, weights


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def test_quintiles_of_first_come_ranks(spark):
    def run(n):
        df = spark.createDataFrame([(day(0), f"T{i:02d}", float(i), 1.0) for i in range(n)], "date date, ticker string, f double, y double")
        return [(r.bucket, r.n) for r in statistics.quantile_means(df, "f", "y").orderBy("bucket").collect()]

    assert run(7) == [(1, 2), (2, 1), (3, 1), (4, 1), (5, 2)]
    assert run(12) == [(1, 3), (2, 2), (3, 2), (4, 2), (5, 3)]
    assert run(1) == [(None, 1)]


def _newey_west(x, lags):
    x = np.array([v for v in x if v is not None])
    n, c = len(x), x - x.mean()
    var = c @ c / n + sum(2 * (1 - k / (lags + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    return x.mean() / np.sqrt(var / n) if var > 0 else None


@pytest.mark.parametrize("lags", [0, 3, 39])
def test_newey_west(spark, lags):
    x = list(np.random.RandomState(1).randn(30) + 0.4)
    x[4] = None
    df = spark.createDataFrame([(day(i), "f", v if v is None else float(v)) for i, v in enumerate(x)] + [(day(0), "few", 1.0), (day(1), "flat", 0.5)], "date date, factor string, ic double")
    got = {r.factor: r.t_NW for r in statistics.newey_west(df, lags).collect()}
    want = _newey_west(x, lags)
    assert got["f"] == (pytest.approx(want) if want is not None else None) and got["few"] is None


def test_false_discovery_and_p(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.02), ("d", None), ("e", 0.5)], "factor string, p_NW double")
    q = {r.factor: r.q_BH for r in statistics.fdr_bh(df).collect()}
    assert q == pytest.approx({"a": 0.1 / 3, "b": 0.1 / 3, "c": 0.1 / 3, "d": 1.0, "e": 0.625})
    t = spark.createDataFrame([(0.0,), (1.96,), (-1.96,), (None,)], "t double").select(two_sided_p("t").alias("p")).collect()
    assert [None if r.p is None else round(r.p, 3) for r in t] == [1.0, 0.05, 0.05, None]


def test_neutralising_regressions(spark):
    rng = np.random.RandomState(2)
    rows = []
    for d in (0, 1, 40):
        for i in range(25):
            rows.append((day(d), f"T{i}", None if i == 3 else f"C{i % 3}", f"S{i % 2}" if d != 1 else "S0", int(i % 4), float(rng.randn()) if i != 7 else None))
    df = spark.createDataFrame(rows, "date date, ticker string, country string, supersector string, size_bucket int, x double")
    for mode, by in (("drop_first", ["country", "supersector", "size_bucket"]), ("full", ["country", "supersector"])):
        out = cross_section.neutralize(df, ["x"], by, mode=mode).toPandas()
        for _, g in out.groupby("date"):
            y = g.x.to_numpy(float)
            ok = np.isfinite(y)
            cols = [np.ones(len(g))]
            for c in by:
                levels = sorted(str(v) for v in df.select(c).distinct().dropna().toPandas()[c])
                codes = g[c].map(lambda v: None if v is None or v != v else str(int(v)) if isinstance(v, float) else str(v))
                cols += [(codes == v).to_numpy(float) for v in levels[(0 if mode == "full" else 1) :]]
            x = np.stack(cols, axis=1)[ok]
            want = y[ok] - x @ np.linalg.lstsq(x, y[ok], rcond=None)[0]
            assert np.allclose(g.x_neu.to_numpy(float)[ok], want, atol=1e-9) and np.isnan(g.x_neu.to_numpy(float)[~ok]).all()
    one, ridge = (cross_section.neutralize(df, ["x"], ["country"], least=3, ridge=k).orderBy("date", "ticker").toPandas() for k in (0.0, 1e-8))
    assert np.allclose(one.x_neu.astype(float), ridge.x_neu.astype(float), atol=1e-6, equal_nan=True) and one.x_neu.astype(float).abs().max() > 0.1
    for _, g in ridge[ridge.x.notna()].groupby("date"):
        c = g.country.fillna("C0")
        a = np.stack([np.ones(len(g)), c == "C1", c == "C2"], axis=1).astype(float)
        want = g.x - a @ np.linalg.solve(a.T @ a + 1e-8 * np.eye(3), a.T @ g.x)
        assert np.allclose(g.x_neu.astype(float), want, atol=1e-12)


def test_no_look_ahead(spark):
    from sigmill.operators import factors

    rng = np.random.RandomState(3)
    p = 100 * np.exp(np.cumsum(rng.randn(320) * 0.02))
    make = lambda q: spark.createDataFrame([("A", day(i), float(v), 10.0) for i, v in enumerate(q)], "ticker string, date date, price_eur double, volume double")
    later = p.copy()
    later[310:] *= 3
    a, b = (factors.add_factors(make(q)).filter(F.col("date") < day(310)).orderBy("date").collect() for q in (p, later))
    assert a == b and a[-1].mom_12_1 is not None


def test_weights_sum(spark):
    rows = [(dt.date(2024, 3, 29), f"T{i}", [3.0, 3.0, 2.0, None, 1.0, 0.5, 0.1][i]) for i in range(7)] + [(dt.date(2024, 4, 30), "T0", 1.0), (dt.date(2024, 5, 31), "T0", None)]
    df = spark.createDataFrame(rows, "date date, ticker string, s double")
    lo = portfolio.long_only(df, "s", 0.5).collect()
    first = {r.ticker: r.w for r in lo if r.date.month == 3}
    assert first == pytest.approx({"T0": 1 / 3, "T1": 1 / 3, "T2": 1 / 3, "T3": 0, "T4": 0, "T5": 0, "T6": 0})
    assert not [r for r in lo if r.date.month == 5]
    ls = {(r.date.month, r.ticker): r.w for r in portfolio.long_short(df, "s", 0.2).collect()}
    assert ls[3, "T0"] == 0.5 and ls[3, "T6"] == -0.5 and ls[3, "T3"] == 0 and ls[4, "T0"] == -0.5


def test_portfolio_gap_day_turnover_and_cost(spark):
    days = [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 29), dt.date(2024, 3, 1)]
    df = spark.createDataFrame([(d, t, r) for k, d in enumerate(days) for t, r in (("A", 0.01 * (k + 1)), ("B", 0.02))], "date date, ticker string, ret_1d_eur double")
    hold = spark.createDataFrame([(days[1], "A", 1.0), (days[3], "B", 1.0)], "date date, ticker string, w double")
    got = {r.date: round(r.ret_port, 6) for r in portfolio.portfolio_returns(df, hold, tc_bps=100.0).collect()}
    assert got == {days[2]: 0.03, days[4]: round(0.02 - 2 * 0.01, 6)}
    through = {r.date: round(r.ret_port, 6) for r in portfolio.portfolio_returns(df, hold, hold_through=True).collect()}
    assert through == {days[2]: 0.03, days[3]: 0.04, days[4]: 0.02}


def test_performance_edges(spark):
    rows = [("s", day(i), r) for i, r in enumerate([-0.5, 0.1, 0.1])] + [("m", dt.date(2020 + i // 12, i % 12 + 1, 1), 0.01 * (i % 3)) for i in range(48)]
    df = spark.createDataFrame(rows, "strategy string, date date, ret double")
    got = {r.strategy: r for r in performance.perf_summary(df).collect()}
    assert got["s"].max_dd == 0.0  # a loss on the first day is not seen
    ppy = {r.strategy: r.ppy for r in performance.periods_per_year(df).collect()}
    assert ppy == {"s": 252, "m": 12}


def test_blocks(spark):
    def run(n, **kw):
        df = spark.createDataFrame([(dt.date(2000 + i // 12, i % 12 + 1, 1),) for i in range(n)], "date date")
        return [(r.fold, r.train_start, r.test_end) for r in folds.time_blocks(df, **kw).orderBy("fold").collect()]

    assert run(36) == [] and run(42) == [] and run(60, train=12, least=24) == []
    assert run(43) == [(0, dt.date(2000, 1, 31), dt.date(2003, 7, 31))]
    assert len(run(60)) == 3


def test_rolling_weights_shrink_and_keep_null_months(spark):
    rows = [(dt.date(2000 + i // 12, i % 12 + 1, 28), f, None if i == 3 else x) for i in range(12) for f, x in (("a", 0.2), ("b", 0.1), ("c", -0.1))]
    got = weights.rolling_ic_weights(spark.createDataFrame(rows, "date date, factor string, ic double"))
    w = {(r.month_eom, r.factor): r.weight for r in got.collect()}
    assert w[dt.date(2000, 9, 30), "a"] == pytest.approx(1 / 3)  # nine rows are too few
    clipped = np.array([0.4, 0.25, -0.25]) / 0.9
    want = 0.2 + 0.4 * clipped
    assert [w[dt.date(2000, 10, 31), f] for f in "abc"] == pytest.approx(list(want))


def test_p_values_at_all_sizes(spark):
    import math

    t = [k / 7 for k in range(-300, 300)]
    got = spark.createDataFrame([(x,) for x in t], "t double").select("t", two_sided_p("t").alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(abs(r.t) / math.sqrt(2)), rel=1e-11) for r in got)


def _bars(spark, prices):
    return spark.createDataFrame([(t, day(i), None if p is None else float(p), 10.0) for t, row in prices.items() for i, p in enumerate(row)], "ticker string, date date, price_eur double, volume double")


def test_lags_of_lags_give_the_window(spark):
    """Trailing maximum and mean of the five largest against slices of the series, where rows are few and where they are many."""
    from sigmill.operators import factors

    rng = np.random.RandomState(5)
    p = 100 * np.exp(np.cumsum(rng.randn(600) * 0.03))
    got = factors.add_factors(_bars(spark, {"A": p, "B": p[:30]})).filter("ticker = 'A'").orderBy("date").collect()
    r = p[1:] / p[:-1] - 1
    for i, row in enumerate(got):
        back = p[max(0, i - 251) : i + 1]
        assert row.hi52_prox == (pytest.approx(p[i] / back.max() - 1, abs=1e-12) if len(back) >= 20 else None)
        last = r[max(0, i - 21) : i]
        assert row.max5_21d == (pytest.approx(np.sort(last)[-5:].mean()) if len(last) >= 10 else None)
    assert len(got) == 600


def test_forward_returns_with_gaps_and_losses(spark):
    from sigmill.operators import factors

    rng = np.random.RandomState(6)
    r = [float(x) for x in rng.randn(80) * 0.05]
    r[20], r[45], r[60], r[61] = None, -1.0, -1.5, -2.0
    df = spark.createDataFrame([("A", day(i), x) for i, x in enumerate(r)], "ticker string, date date, ret_1d_eur double")
    for i, row in enumerate(factors.add_forward_returns(df).orderBy("date").collect()):
        for h in factors.HORIZONS:
            ahead = r[i + 1 : i + 1 + h]
            want = None if len(ahead) < h or None in ahead else float(np.prod([1 + x for x in ahead])) - 1
            assert row[f"fwd_{h}d"] == (None if want is None else pytest.approx(want, abs=1e-11)), (i, h)


def test_no_beta_where_the_market_stands_still(spark):
    from sigmill.operators import market

    rng = np.random.RandomState(7)
    m = [0.003] * 150 + list(rng.randn(60) * 0.01) + [0.003] * 100
    rows = [("A", day(i), None if i % 17 == 0 else float(rng.randn() * 0.02), None if i % 23 == 0 else float(x)) for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "ticker string, date date, ret_1d_eur double, mkt_ret double")
    got = market.beta_tstat(market.add_betas(df), beta="beta_60", window=60, least=40).orderBy("date").collect()
    for i, row in enumerate(got):
        pairs = [(a, b) for _, _, a, b in rows[max(0, i - 59) : i + 1] if a is not None and b is not None]
        a, b = np.array(pairs).T if pairs else (np.zeros(0), np.zeros(0))
        if len(pairs) < 40 or len(set(b)) == 1:
            assert row.beta_60 is None and row.beta_tstat is None, i
        else:
            assert row.beta_60 == pytest.approx(np.cov(a, b)[0, 1] / b.var(ddof=1), rel=1e-6)
    assert got[100].beta_60 is None and got[180].beta_60 is not None and got[309].beta_60 is None


@pytest.mark.parametrize("most, accuracy", [(10_000, 10_000), (5, 20), (1, 2)])
def test_exact_quantiles_by_selection(spark, most, accuracy):
    """Small limits make many rounds; ties, heavy tails and columns without values."""
    from sigmill.operators import panel

    rng = np.random.RandomState(8)
    a, b = np.exp(rng.randn(700) * 20), np.round(rng.randn(700))
    rows = [(float(x), float(y) if k % 3 else None, 1.5, None) for k, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, one double, none double").repartition(3)
    q = [0.0, 0.01, 0.37, 0.99, 1.0]
    got = panel.exact_quantiles(df, ["a", "b", "one", "none"], q, most, accuracy)
    there = np.array([y for _, y, _, _ in rows if y is not None])
    assert got["a"] == pytest.approx(list(np.quantile(a, q))) and got["b"] == pytest.approx(list(np.quantile(there, q)))
    assert got["one"] == [1.5] * 5 and got["none"] == [None] * 5
    assert panel.exact_quantiles(df.limit(0), ["a"], q)["a"] == [None] * 5


def test_ridge_of_folds_is_the_ridge_of_their_rows(spark):
    """One pass of cross products gives each fold's weights for whatever factors it chose, gaps included."""
    rng = np.random.RandomState(9)
    rows = []
    for m in range(46):
        for t in range(25):
            x = [float(v) if rng.rand() > 0.1 else None for v in rng.randn(3)]
            rows.append((dt.date(2000 + m // 12, m % 12 + 1, 15), f"T{t}", *x, float(rng.randn()) if rng.rand() > 0.05 else None))
    df = spark.createDataFrame(rows, "date date, ticker string, a double, b double, c double, y double")
    blocks = folds.time_blocks(df, test=3)
    sets = {0: ["a", "c"], 1: ["b"], 2: ["a", "b", "c"]}
    chosen = spark.createDataFrame(list(sets.items()), "fold int, chosen array<string>")
    moments = folds.attach_folds(weights.cross_moments(df, ["a", "b", "c"], "y"), blocks, "train").join(chosen, "fold")
    got = {(r.fold, r.factor): r.weight for r in weights.ridge_of_moments(moments, ["a", "b", "c"], by=("fold",)).collect()}
    assert blocks.count() >= 3
    for fold, names in sets.items():
        mine = folds.attach_folds(df, blocks.filter(F.col("fold") == fold), "train")
        want = {r.factor: r.weight for r in weights.ridge_weights(mine, names, "y").collect()}
        assert {f: w for (k, f), w in got.items() if k == fold} == pytest.approx(want)
