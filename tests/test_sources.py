"""Exports by month, published runs, exports with their fallbacks, and the exploring job's tables."""

import datetime as dt
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.plans import jobs
from sigmill.sources import io
from sigmill.sources.stage import shared_folder


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def panel_of(spark, days=400, names=30, seed=3):
    rng = np.random.RandomState(seed)
    rows = [
        (dt.date(2020, 1, 1) + dt.timedelta(days=i), f"T{k:02d}", float(np.exp(rng.randn() * 0.1) * 100), float(rng.randint(1, 100)), f"S{k % 2}", f"C{k % 3}" if k != 7 else None)
        for i in range(days) for k in range(names)
    ]
    return spark.createDataFrame(rows, "date date, ticker string, price_eur double, volume double, supersector string, country string")


def test_a_stretch_of_days_reads_its_months_only(spark, folder):
    df = panel_of(spark, 200, 5)
    io.export_by_month(df, f"{folder}/bars")
    part = io.read_months(spark, f"{folder}/bars", dt.date(2020, 2, 10), dt.date(2020, 3, 5))
    assert part.columns == df.columns
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, df.filter("date between '2020-02-10' and '2020-03-05'").collect()))
    read = {r[0].split("/year=")[1].rsplit("/", 1)[0] for r in part.select(F.input_file_name()).distinct().collect()}
    assert read == {"2020/month=2", "2020/month=3"}
    scan = part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert scan.startswith("isnotnull(year") or "month" in scan.split("]")[0]


def test_runs_are_seen_whole_or_not_at_all(spark, folder):
    a = spark.range(5).withColumn("x", F.array(F.lit(1.5)))
    first = jobs.write_research({"scores": a, "summary": spark.range(2)}, folder, {"horizon": 40, "share": 0.2})

    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        jobs.write_research({"scores": spark.range(9), "summary": bad}, folder, {"horizon": 1})
    settings, tables, counts = io.read_run(spark, folder)
    assert settings == {"horizon": "40", "share": "0.2"} and counts == {"scores": 5, "summary": 2}
    assert {n: t.count() for n, t in tables.items()} == counts and tables["scores"].first()["x"] == [1.5]

    second = jobs.write_research({"scores": spark.range(7)}, folder, {"horizon": 5})
    assert io.read_run(spark, folder)[2] == {"scores": 7} and second != first
    assert io.read_run(spark, folder, first)[2] == counts
    with pytest.raises(FileNotFoundError):
        io.read_run(spark, folder, "none")


def test_exports_and_their_fallbacks(spark, folder):
    df = panel_of(spark, 40, 4)
    with pytest.raises(FileNotFoundError):
        io.load_exports(spark, folder)
    io.export(df, f"{folder}/df_with_beta", csv=False)
    bare = io.load_exports(spark, folder)
    assert bare["factors"] is None and bare["last_date"].first()[0] == dt.date(2020, 2, 9) and bare["universe_monthly"] is None and bare["market_series"] is None
    io.export(df.limit(3).select("date"), f"{folder}/global_market_ew", csv=False)
    io.export_panel(df.filter("date < '2020-02-01'"), folder, ["mom_12_1", "vol_60d"], {"universe_monthly": spark.createDataFrame([("2020-01", "['A', 'B ']"), ("2020-02", "?")], "month string, tickers string")})
    full = io.load_exports(spark, folder)
    assert full["factors"] == ["mom_12_1", "vol_60d"] and full["last_date"].first()[0] == dt.date(2020, 1, 31) and full["market_series"].count() == 3
    assert {r.month: r.tickers for r in full["universe_monthly"].collect()} == {"2020-01": ["A", "B"], "2020-02": []}
    assert full["panel"].count() == 31 * 4
    assert io.load_exports(spark, folder, io.EXPLORE_NAMES)["panel"].count() == 40 * 4
    io.write_text(spark, "{not a list", f"{folder}/factors_list.json")
    io.write_text(spark, "some day", f"{folder}/last_date.txt")
    again = io.load_exports(spark, folder)
    assert again["factors"] is None and again["last_date"].first()[0] == dt.date(2020, 1, 31)


def test_explore_on_neutralised_factors(spark):
    daily = jobs.build_factors(panel_of(spark))
    assert set(jobs.FACTORS) <= {*daily.columns, "country_mkt_ret_1d"}
    tables = jobs.explore(daily, ["mom_6_1", "vol_60d", "size_proxy"], by=["country", "supersector", "liq_bucket"], standardize=True)
    shown = tables["panel"].toPandas()
    for c in ("mom_6_1_neu", "vol_60d_neu", "size_proxy_neu"):
        by_date = shown.groupby("date")[c]
        sd = by_date.std(ddof=0)[by_date.count() > 12]
        assert (by_date.mean().abs().max() < 1e-9) and ((sd - 1).abs() < 1e-9).all() and len(sd) > 50, c
    assert tables["top20_size"].count() == 20 and tables["ret_by_size_quintile"].count() == 5 and tables["beta_252_histogram"].agg(F.sum("n")).first()[0] == 30
    assert tables["top50_beta_tstat"].count() == 30 and tables["coverage"].count() == 399 and tables["market_level"].count() == 399


def test_robust_research_runs_on_all_groups(spark):
    daily = jobs.build_factors(panel_of(spark))
    df, names = jobs.scored_panel(daily, [*jobs.FACTORS, "not there"], jobs.GROUPS, robust=True)
    assert len(names) == len(jobs.FACTORS) and {"fwd_40d", "ret_effective"} <= set(df.columns)
    last = df.filter("date = '2021-01-31'").toPandas()
    for n in ("mom_6_1", "vol_60d"):
        x = last[f"{n}"].to_numpy(float)
        mad = np.median(np.abs(x - np.median(x))) * 1.4826
        assert last[f"{n}_z"].to_numpy(float) == pytest.approx((x - np.median(x)) / mad)
        assert np.median(last[f"{n}_neu_z"].to_numpy(float)) == pytest.approx(0, abs=1e-9)
