"""Reading raw price files and exports, writing artefacts."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_SCHEMA = "`Unnamed: 0` string, Date string, Open string, High string, Low string, Close string, Volume string, ticker string"
#: Fallback names of the panel, in the order of the research and of the exploring job. Fixed values.
RESEARCH_NAMES = ("factors_daily", "panel_with_beta", "df_with_beta")
EXPLORE_NAMES = ("df_with_beta", "factors_daily")
MANIFEST = "run string, published timestamp, settings map<string,string>, counts map<string,bigint>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_csv_flex(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header, without its unnamed index column."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.drop(*(c for c in df.columns if c in ("Unnamed: 0", "_c0", "")))


def read_best(spark: SparkSession, base: str) -> DataFrame | None:
    """<base>.parquet, else <base>.csv, else None."""
    if exists(spark, f"{base}.parquet"):
        return spark.read.parquet(f"{base}.parquet")
    return read_csv_flex(spark, f"{base}.csv") if exists(spark, f"{base}.csv") else None


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def export(df: DataFrame, base: str, partition_by: list[str] | None = None, csv: bool = True) -> None:
    """Parquet and CSV; arrays become JSON text in the CSV."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{base}.parquet")
    if csv:
        flat = df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields))
        flat.write.mode("overwrite").option("header", True).csv(f"{base}.csv")


def write_artefacts(tables: dict[str, DataFrame], folder: str, small: tuple[str, ...] = ()) -> None:
    """One export for each table; those named in `small` (a row a factor, date or strategy) in one file."""
    for name, df in tables.items():
        export(df.coalesce(1) if name in small else df, f"{folder}/{name}")


def export_by_month(df: DataFrame, base: str) -> None:
    """The panel as Parquet in folders of year and month, dealt by ranges, so that a large month is many files."""
    dated = df.withColumns({"year": F.year("date"), "month": F.month("date")})
    dated.repartitionByRange("year", "month", "ticker").write.mode("overwrite").partitionBy("year", "month").parquet(f"{base}.parquet")


def read_months(spark: SparkSession, base: str, first: dt.date, last: dt.date) -> DataFrame:
    """Rows of a partitioned panel from one date to another, both included; other months are not read."""
    df = spark.read.parquet(f"{base}.parquet")
    months = (F.col("year") * 12 + F.col("month")).between(first.year * 12 + first.month, last.year * 12 + last.month)
    return df.filter(months & F.col("date").between(F.lit(first), F.lit(last))).drop("year", "month")


def publish(tables: dict[str, DataFrame], folder: str, settings: dict[str, object]) -> str:
    """Writes the tables of a run beside those of other runs and then, as the last thing, one line of the manifest with its
    settings and row counts. A reader knows runs by the manifest alone, so it sees a whole run or none."""
    run = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{folder}/runs/{run}/{name}")
    counts = {name: spark.read.parquet(f"{folder}/runs/{run}/{name}").count() for name in tables}
    line = (run, dt.datetime.now(dt.timezone.utc), {k: str(v) for k, v in settings.items()}, counts)
    spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return run


def read_run(spark: SparkSession, folder: str, run: str | None = None) -> tuple[dict[str, str], dict[str, DataFrame], dict[str, int]]:
    """Settings, tables and row counts of a published run, the last one if none is named."""
    lines = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    line = (lines.filter(F.col("run") == run) if run else lines.orderBy(F.desc("published"), "run")).first()  # a row a run
    if line is None:
        raise FileNotFoundError(f"no such run in {folder}")
    return dict(line["settings"]), {n: spark.read.parquet(f"{folder}/runs/{line['run']}/{n}") for n in line["counts"]}, dict(line["counts"])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file of a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text, file or folder, or None where there is none."""
    return "\n".join(r["value"] for r in spark.read.text(path).collect()) if exists(spark, path) else None


def export_panel(daily: DataFrame, folder: str, factors: list[str], others: dict[str, DataFrame] | None = None, name: str = "factors_daily") -> None:
    """The panel, further tables, the factor list and the last date, as load_exports() reads them."""
    spark = daily.sparkSession
    export(daily, f"{folder}/{name}", csv=False)
    for other, df in (others or {}).items():
        export(df, f"{folder}/{other}", csv=False)
    write_text(spark, json.dumps(factors), f"{folder}/factors_list.json")
    write_text(spark, str(spark.read.parquet(f"{folder}/{name}.parquet").agg(F.max("date")).first()[0]), f"{folder}/last_date.txt")


def _parsed(parse, text: str | None):
    """What the text says, or None where it is absent or says nothing."""
    try:
        return parse(text) if text else None
    except ValueError:
        return None


def load_exports(spark: SparkSession, folder: str, names: tuple[str, ...] = RESEARCH_NAMES) -> dict[str, object]:
    """panel: under the first of the names that exists; market_series, factors_eom_z and universe_monthly (None where absent);
    factors: the exported list, or None where it is absent or no list; last_date: a row with the exported one, else the panel's."""
    panel = next((df for n in names if (df := read_best(spark, f"{folder}/{n}")) is not None), None)
    if panel is None:
        raise FileNotFoundError(f"no panel in {folder}")
    out: dict[str, object] = {"panel": panel}
    out |= {n: read_best(spark, f"{folder}/{n}") for n in ("market_series", "factors_eom_z", "universe_monthly")}
    if out["market_series"] is None:
        out["market_series"] = read_best(spark, f"{folder}/global_market_ew")
    universe = out["universe_monthly"]
    if universe is not None and isinstance(universe.schema["tickers"].dataType, T.StringType):
        out["universe_monthly"] = universe.withColumn("tickers", parse_ticker_list(F.col("tickers")))
    listed = _parsed(json.loads, read_text(spark, f"{folder}/factors_list.json"))
    out["factors"] = listed if isinstance(listed, list) else None
    last = _parsed(lambda t: dt.date.fromisoformat(t.strip()[:10]), read_text(spark, f"{folder}/last_date.txt"))
    dates = panel.agg(F.max(F.col("date").cast("date")).alias("last_date"))
    out["last_date"] = dates if last is None else spark.createDataFrame([(last,)], "last_date date")
    return out


def narrow_doubles(df: DataFrame) -> DataFrame:
    """Doubles as floats, for export."""
    return df.select(*(F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields))


def assemble_prices(raw: DataFrame) -> DataFrame:
    """Bars of symbols that have a close at all."""
    has = raw.groupBy("ticker").agg(F.count("Close").alias("n")).filter("n > 0").select("ticker")
    return raw.join(has, "ticker", "left_semi")


def assemble_index(raw: DataFrame, indices: DataFrame, most_missing: float = 0.5) -> DataFrame:
    """Bars of indices with fewer than `most_missing` of their closes missing, with Country."""
    ok = raw.groupBy("ticker").agg(F.count("Close").alias("n"), F.avg(F.col("Close").isNull().cast("double")).alias("gone"))
    ok = ok.filter((F.col("n") > 0) & (F.col("gone") < most_missing)).select("ticker")
    return raw.join(ok, "ticker", "left_semi").join(indices.select("ticker", "Country"), "ticker")


def symbol_map(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, ticker: the last row of each key by `order`."""
    last = Window.partitionBy(key).orderBy(F.desc_nulls_last(order))
    return df.withColumn("_k", F.row_number().over(last)).filter("_k = 1").select(key, "ticker")


def parse_ticker_list(text: Column) -> Column:
    """Trimmed different tickers of a JSON list, or of a list in Python's single quotes; else an empty array."""
    js = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    quoted = F.regexp_extract_all(text, F.lit(r"'([^']*)'"), F.lit(1))
    listed = F.trim(text).startswith("[") & F.trim(text).endswith("]")
    found = F.when(listed, F.coalesce(F.when(F.size(js) > 0, js), quoted))
    return F.array_distinct(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
