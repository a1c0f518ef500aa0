"""Every registered query against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from loomgrid import queries as registry

SF = "/root/testdata/sf0.001"
SLOW = {"model_comparison", "local_explanation", "model_importances", "best_model", "model_shapley", "replay_scores", "boosting_comparison"}  # fits need more samples than these tables give


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(df):
    out = df[sorted(df.columns)].copy()
    for c in out:
        if out[c].dtype != bool and pd.api.types.is_numeric_dtype(out[c]):
            out[c] = out[c].astype(float).round(5) + 0.0
        elif pd.api.types.is_datetime64_any_dtype(out[c]) or c == "date":
            out[c] = pd.to_datetime(out[c]).astype(str)
        out[c] = out[c].astype(str).replace({"nan": "", "None": "", "NaT": "", "<NA>": ""})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query_equals_sql(spark, duck, name):
    if name not in registry.oracle_sql():
        pytest.skip("no SQL form")
    found = registry.queries()[name](spark, SF).toPandas()
    wanted = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    pd.testing.assert_frame_equal(plain(found), plain(wanted))
