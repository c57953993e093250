"""Library queries agree with their SQL on the smallest tables."""

import pathlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sigmill.plans import registry

DATA = pathlib.Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["s4_assemble_prices", "p9_embargo", "j7_turnover", "a14_ic_timeseries", "w3_mom_6_1", "w12_buckets", "n1_neutralize_one", "v1_time_blocks", "s1_read_csv", "p11_factor_columns", "w5_volatility", "w14_betas", "w15_beta_tstat", "n5_month_end_scores", "a17_significance", "d1_build_factors", "n1_neutralize", "n1_neutralize_four", "n2_neutralize_ridge", "n3_neutralize_full", "n4_neutralize_and_z", "w7_hi52_prox", "w10_max5", "w14_flat_market", "w16_forward_returns", "w21_clip_global", "p10_effective_return", "a19_ridge_weights", "d1_diagnostics", "d2_explore", "s3_partitioned_panel", "s7_load_exports", "s9_publish_run", "v2_fold_weights", "v2_oos_by_fold", "a23_oos_pooled"])
def test_query_and_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)

    def value(v):
        if pd.isna(v):
            return None
        return str(v)[:10] if hasattr(v, "year") else v if isinstance(v, str) else round(float(v), 4) + 0.0

    def table(df):
        df = df[sorted(df.columns)].astype(object)
        return [tuple(map(value, row)) for row in df.itertuples(index=False, name=None)]

    assert sorted(map(repr, table(got))) == sorted(map(repr, table(want)))


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["date", "ticker"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
