"""What a step costs: columns that it stores, rows that it exchanges, frames that slide."""

import datetime as dt
import os
import pathlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.functions.numbers import with_trailing
from sigmill.operators import cross_section, factors, folds, market, panel
from sigmill.plans import jobs, queries
from sigmill.sources.stage import shared_folder

from .test_sources import panel_of

DATA = pathlib.Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_moments_of_trailing_rows(spark):
    x = [None if k % 7 == 3 else 1e9 + np.sin(k) for k in range(150)]
    df = spark.createDataFrame([("A", day(k), v if v is None else float(v)) for k, v in enumerate(x)], "ticker string, date date, x double")
    for r in with_trailing(df, {"x": F.col("x")}, (3, 4, 5), spread=True).collect():
        at = (r.date - day(0)).days
        seen = np.array([v for v in x[max(0, at - 59) : at + 1] if v is not None])
        assert r._n_x == len(seen) and r._s_x == pytest.approx(seen.sum()) and r._v_x == pytest.approx(((seen - seen.mean()) ** 2).sum(), rel=1e-6, abs=1e-9)


def test_no_frame_slides(spark):
    bars = panel_of(spark)
    for df in (factors.add_factors(bars), factors.shock_tags(bars.withColumn("ret_1d_eur", F.col("price_eur")))):
        assert not re.search(r"RowFrame, -\d+, currentrow", plan(df))


def test_market_counts_names_without_exchanging_them(spark):
    rows = [(f"T{i}", day(k), float(i)) for k in range(2) for i in range(4 + 7 * k)] + [("T0", day(0), 9.0)] * 8 + [(None, day(0), 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, ret_1d_eur double")
    out = market.global_market(df)
    assert [(r.date, r.mkt_ret) for r in out.collect()] == [(day(1), 5.0)]  # the first date has 13 rows, but 4 names
    assert not re.search(r"Aggregate\(keys=\[[^\]]*ticker", plan(out))


def test_blocks_from_one_pass(spark):
    df = spark.range(2000).select(F.date_add(F.lit("2015-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    out = folds.time_blocks(df)
    assert out.count() == 4 and plan(out).split("== Physical Plan ==")[1].count("Range (0") == 1


def test_research_stores_what_it_needs(spark):
    daily = jobs.build_factors(panel_of(spark))
    root = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(root))
    df, z = jobs.scored_panel(daily, jobs.FACTORS, jobs.GROUPS, horizons=(40,), lean=True)
    assert set(df.columns) == {"date", "ticker", "volume", "ret_1d_eur", "ret_effective", "fwd_40d", *z}
    assert [n.split("-")[:2] for n in set(os.listdir(root)) - before] == [["research", "panel"]]
    want = jobs.scored_panel(daily, jobs.FACTORS, jobs.GROUPS)[0]
    assert df.count() == want.count() and df.select("date", "ticker", F.round("fwd_40d", 9), F.round("mom_6_1_neu_z", 6)).exceptAll(want.select("date", "ticker", F.round("fwd_40d", 9), F.round("mom_6_1_neu_z", 6))).count() == 0


def test_scores_by_date_are_the_window_scores(spark):
    rows = [(f"T{i}", day(k), None if i == k else float(i * i + k) if k else 5.0) for k in range(3) for i in range(6)]
    df = spark.createDataFrame(rows, "ticker string, date date, x double")
    got = cross_section.add_zscores(df, {"x": "z"}).withColumn("w", cross_section.zscore("x")).collect()
    assert len(got) == 18 and all(r.z == (pytest.approx(r.w) if r.w is not None else None) for r in got)


@tables
def test_neutralising_stores_no_other_factors(spark, monkeypatch):
    stored = []
    keep = cross_section.staged
    monkeypatch.setattr(cross_section, "staged", lambda df, name: stored.append(set(df.columns)) or keep(df, name))
    for name in ("n1_neutralize_four", "n3_neutralize_full"):
        queries.QUERIES[name](spark, str(DATA))
    assert len(stored) == 2 and all(c <= {"date", "ticker", "mom_6_1", "rev_5d", *jobs.GROUPS} for c in stored)


@tables
def test_diagnostics_store_no_other_factors(spark, monkeypatch):
    stored = {}
    keep = jobs.staged
    monkeypatch.setattr(jobs, "staged", lambda df, name: stored.update({name: df.columns}) or keep(df, name))
    queries.QUERIES["d1_diagnostics"](spark, str(DATA))
    assert "mom_12_1" in stored["diagnostics"] and "amihud_20d" not in stored["diagnostics"] and "max5_21d" not in stored["diagnostics"]


@tables
def test_exploring_stores_no_other_factors(spark, monkeypatch):
    stored = {}
    keep = jobs.staged
    monkeypatch.setattr(jobs, "staged", lambda df, name: stored.update({name: set(df.columns)}) or keep(df, name))
    queries.QUERIES["d2_explore"](spark, str(DATA))
    assert stored["explore"] == {"date", "ticker", "country", "supersector", "mom_12_1", "size_proxy", "vol_252d", "beta_252", "beta_tstat", "ret_stock", "mkt_ret"}


def test_a_lean_exploration_has_the_same_tables(spark):
    daily = jobs.build_factors(panel_of(spark))
    for by in (None, ["country", "liq_bucket"]):
        whole, lean = (jobs.explore(daily, ["mom_6_1", "vol_252d", "size_proxy"], by=by, lean=x) for x in (False, True))
        assert set(lean) == set(whole) and set(lean["panel"].columns) < set(whole["panel"].columns)
        for name in set(whole) - {"panel", "market_level"}:
            a, b = ([tuple(r) for r in x[name].orderBy(*x[name].columns).collect()] for x in (whole, lean))
            assert len(a) == len(b)
            for x, y in zip(a, b):
                assert all(u == (pytest.approx(v) if isinstance(v, float) else v) for u, v in zip(x, y))


def test_groups_from_stored_limits_are_the_window_groups(spark):
    rng = np.random.RandomState(5)
    some = lambda x, k: None if k % 11 == 3 else float(x)
    rows = [(f"T{i}", None if k == 3 else day(k), None if i % 9 == 4 else f"C{i % 3}", None if k == 2 else f"S{i % 2}", *(some(rng.randint(0, 40), i + j) for j in range(2)), None if k == 1 else 2.5) for k in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "ticker string, date date, country string, supersector string, mom_6_1 double, size_proxy double, liq_proxy double")
    want, got = cross_section.add_groups(df), cross_section.add_stored_groups(df)
    assert got.columns == want.columns and got.count() == 200 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("robust", [False, True])
def test_scores_from_stored_rows_are_the_plain_ones(spark, robust):
    rng = np.random.RandomState(6)
    names = [f"x{j}" for j in range(8)]  # more than are exchanged at a time
    rows = [(f"T{i}", day(k), f"C{i % 3}", i % 4 if i % 5 else None, *(None if (i + j) % 13 == 5 else float(rng.randn()) for j in range(8))) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "ticker string, date date, country string, size_bucket int, " + ", ".join(f"{n} double" for n in names))
    stored = []
    want = cross_section.neutralize_and_z(df, names, ["country", "size_bucket"], robust).orderBy("date", "ticker").collect()
    df = cross_section.neutralize_and_z(df, names, ["country", "size_bucket"], robust, raw=False, stored=stored)
    got = df.orderBy("date", "ticker").collect()
    assert len(got) == len(want) == 180 and len(stored) == 4 and "x0_z" not in df.columns
    for a, b in zip(got, want):
        assert all(a[f"{n}_neu_z"] == (pytest.approx(b[f"{n}_neu_z"], rel=1e-6, abs=1e-8) if b[f"{n}_neu_z"] is not None else None) for n in names)


def test_a_panel_keeps_its_order_of_tickers(spark):
    daily = jobs.build_factors(panel_of(spark))
    listed = spark.createDataFrame([(day(30), ["T01", "T02"]), (day(59), ["T02"])], "month_end date, tickers array<string>")
    assert "hashpartitioning(date" not in plan(daily)
    out = panel.universe_filter(daily, listed)
    assert not re.search(r"hashpartitioning\((_m|date)", plan(out)) and out.columns == daily.columns
    assert {(r.ticker, r.m): r["count"] for r in out.groupBy("ticker", F.month("date").alias("m")).count().collect()} == {("T01", 1): 30, ("T02", 1): 30, ("T02", 2): 29}


def test_research_stores_one_wide_table(spark, monkeypatch):
    stored = {}
    keep = jobs.staged

    def staged(df, name):
        stored[name] = keep(df, name)
        return stored[name]

    monkeypatch.setattr(jobs, "staged", staged)
    daily = jobs.build_factors(panel_of(spark))
    jobs.research(daily, ["mom_6_1", "rev_5d"], universe=panel.universe_monthly(daily))
    assert [n for n, df in stored.items() if "mom_6_1" in df.columns or "mom_6_1_neu_z" in df.columns] == ["research-daily"]
    scores = stored["research-scores"]
    assert scores.columns == ["date", "ticker", "score_ew", "score_icw", "score_ridge", "score_icw_roll"]
    assert scores.count() == scores.select("date").distinct().count() * 30 and scores.select(F.last_day("date")).distinct().count() == scores.select("date").distinct().count()


def test_walking_does_not_copy_returns_for_strategies(spark, monkeypatch):
    rng = np.random.RandomState(8)
    days = [d for d in (dt.date(2018, 1, 1) + dt.timedelta(days=k) for k in range(27 * 31)) if d.weekday() in (1, 4) or (d + dt.timedelta(days=4)).month != d.month]
    rows = [(d, f"T{i:02d}", *map(float, rng.randn(3) * 0.01), float(rng.randn())) for d in days for i in range(14)]
    df = spark.createDataFrame(rows, "date date, ticker string, r double, fwd double, a double, b double")
    calls = []
    keep = folds.portfolio.portfolio_returns
    monkeypatch.setattr(folds.portfolio, "portfolio_returns", lambda df, holdings, *rest, **by: calls.append((df, holdings)) or keep(df, holdings, *rest, **by))
    daily = folds.walk_forward(df, ["a", "b"], "fwd", "r", train=24, test=2)[0]
    assert len(calls) == 4 and daily.columns == ["fold", "strategy", "date", "ret"]
    assert {tuple(x.columns) for x, _ in calls} == {("date", "ticker", "_ret", "fold")} and calls[0][0].count() <= df.count()
    together, by = spark.createDataFrame([(s,) for s in folds.STRATEGIES], "strategy string"), ["fold", "strategy", "date"]
    holdings = None
    for (_, own), s in zip(calls, folds.STRATEGIES):
        own = own.withColumn("strategy", F.lit(s))
        holdings = own if holdings is None else holdings.unionByName(own)
    want = keep(calls[0][0].crossJoin(together), holdings, "_ret", 5.0, by=("fold", "strategy"))
    got, want = ({tuple(x[c] for c in by): x[n] for x in t.collect()} for t, n in ((daily, "ret"), (want, "ret_port")))
    assert len(got) > 40 and got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


@tables
def test_pooled_walk_stores_one_wide_table(spark, monkeypatch):
    stored = []
    for module in (jobs, folds, cross_section):
        monkeypatch.setattr(module, "staged", lambda df, name, keep=module.staged: stored.append((name, set(df.columns))) or keep(df, name))
    queries.QUERIES["a23_oos_summary"](spark, str(DATA))
    assert [name for name, columns in stored if {"mom_6_1", "mom_6_1_neu", "mom_6_1_neu_z"} & columns] == ["research-daily"]
    assert max(len(columns & {f"_b_{f}" for f in jobs.FACTORS}) for _, columns in stored) == cross_section.AT_ONCE
