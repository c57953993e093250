import datetime as dt

from pyspark.sql import functions as F

from sigmill.functions import calendar as cal
from sigmill.operators import cross_section, factors, panel
from sigmill.sources import io


def D(s):
    return dt.date.fromisoformat(s)


def test_embargo_and_last_weekday(spark):
    days = [("2024-03-28",), ("2024-03-29",), ("2024-03-30",), ("2024-03-31",), ("2024-04-01",)]
    df = spark.createDataFrame(days, "d string").select(F.col("d").cast("date").alias("d"))
    got = df.orderBy("d").select(cal.add_business_days(F.col("d"), 1).alias("e"), cal.last_weekday(F.col("d")).alias("w")).collect()
    assert [r.e for r in got] == [D("2024-03-29"), D("2024-04-01"), D("2024-04-01"), D("2024-04-01"), D("2024-04-02")]
    assert got[0].w == D("2024-03-29")
    june = spark.sql("select date '2024-06-05' as d").select(cal.last_weekday(F.col("d")).alias("w")).first()
    assert june.w == D("2024-06-28")


def test_dirty_prices(spark):
    rows = [("2024-01-01", "10", "5", "A"), ("bad", "10", "5", "A"), ("2024-01-02", "text", "5", "A"), ("2024-01-03", "11", None, None), ("2024-01-04", "NaN", "1", "A"), ("2024-01-05", "0", "0", "A")]
    df = spark.createDataFrame(rows, "Date string, Close string, Volume string, Ticker_YF string").withColumns({"Supersector": F.lit("S"), "Country": F.lit("C")})
    out = panel.standardize_prices(df).orderBy("date").collect()
    assert [(r.date, r.price_eur) for r in out] == [(D("2024-01-01"), 10.0), (D("2024-01-05"), 0.0)]


def test_zero_price_gives_null_return(spark):
    df = spark.createDataFrame([("A", D("2024-01-01"), 0.0, 1.0), ("A", D("2024-01-02"), 5.0, 0.0)], "ticker string, date date, price_eur double, volume double")
    assert [r.ret_1d_eur for r in factors.add_returns(df).orderBy("date").collect()] == [None, None]


def test_splits_need_a_volume_blip(spark):
    p = [("A", D("2024-01-01"), 100.0, 10.0), ("A", D("2024-01-02"), 50.0, 30.0), ("A", D("2024-01-03"), 25.0, 31.0), ("B", D("2024-01-01"), 10.0, 0.0), ("B", D("2024-01-02"), 20.0, 5.0), ("C", D("2024-01-01"), 10.0, 0.0), ("C", D("2024-01-02"), 20.0, 0.0)]
    got = factors.detect_splits(spark.createDataFrame(p, "ticker string, date date, price_eur double, volume double")).collect()
    assert sorted((r.ticker, r.date, r.ratio) for r in got) == [("A", D("2024-01-02"), 0.5), ("B", D("2024-01-02"), 2.0)]


def test_buckets_lose_the_lowest_fifth(spark):
    def run(values):
        df = spark.createDataFrame([(D("2024-01-01"), i, float(v)) for i, v in enumerate(values)], "date date, i int, x double")
        return [r.b for r in df.select("i", cross_section.bucket("x").alias("b")).orderBy("i").collect()]

    assert run(range(1, 11)) == [None, None, 0, 0, 1, 1, 2, 2, 3, 3]
    assert run([1] * 6 + [2, 3, 4]) == [0] * 7 + [1, 1]
    assert run([1, 1, 1]) == [None] * 3


def test_universe_and_lists(spark):
    df = spark.createDataFrame([('["A", " B "]',), ("['A', 'B']",), ("",), ("garbage",), (None,), ("[]",), ('["A","A"]',)], "s string")
    got = [r.t for r in df.select(io.parse_ticker_list(F.col("s")).alias("t")).collect()]
    assert got == [["A", "B"], ["A", "B"], [], [], [], [], ["A"]]


def test_assembly(spark):
    raw = spark.createDataFrame([("A", 1.0), ("A", None), ("B", None), ("B", None), ("C", 1.0), ("C", 1.0), ("C", None)], "ticker string, Close double")
    assert {r.ticker for r in io.assemble_prices(raw).collect()} == {"A", "C"}
    names = spark.createDataFrame([("A", "X"), ("B", "Y"), ("C", "Z")], "ticker string, Country string")
    assert {(r.ticker, r.Country) for r in io.assemble_index(raw, names).collect()} == {("C", "Z")}
    m = spark.createDataFrame([("n", "A", 1), ("n", "B", 2)], "name string, ticker string, k int")
    assert io.symbol_map(m, "name", "k").collect()[0].ticker == "B"


def test_exports_are_found_again(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0, ["x"])], "ticker string, v double, l array<string>").withColumn("date", F.lit("2024-01-01").cast("date"))
    io.export(df, f"{tmp_path}/df_with_beta")
    io.export(df.select("ticker"), f"{tmp_path}/only")
    got = io.load_exports(spark, str(tmp_path))
    assert got["panel"].count() == 1 and got["universe_monthly"] is None and got["last_date"].first().last_date == D("2024-01-01")
    assert io.read_best(spark, f"{tmp_path}/nothing") is None
    csv = io.read_csv_flex(spark, f"{tmp_path}/df_with_beta.csv")
    assert csv.first().l == '["x"]'
    assert io.nan_to_null(spark.sql("select double('NaN') as x")).first().x is None


def test_keys(spark):
    df = spark.createDataFrame([("A", D("2024-01-01"), 1), ("A", D("2024-01-01"), 0), ("B", D("2024-01-01"), 2)], "ticker string, date date, k int")
    assert [tuple(r) for r in panel.key_faults(df).collect()] == [("A", D("2024-01-01"), 2)]
    assert {(r.ticker, r.k) for r in panel.dedupe_daily(df, "k").collect()} == {("A", 0), ("B", 2)}
