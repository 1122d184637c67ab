"""Every query with SQL against DuckDB on the smallest tables, plans, and the contract."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from wattloom.jobs import queries as jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        v = df[c]
        if v.dtype == object and len(v.dropna()) and type(v.dropna().iloc[0]).__name__ == "date":
            v = pd.to_datetime(v)
        if "datetime" in str(v.dtype):
            v = v.astype("datetime64[us]").astype(str)
        elif str(v.dtype) in ("bool", "boolean") or (v.dtype == object and v.dropna().map(lambda x: isinstance(x, bool)).all()):
            v = v.map(lambda x: "" if pd.isna(x) else str(bool(x))).astype(object)
        elif str(v.dtype) not in ("object", "str", "string"):
            v = v.astype(float)
        df[c] = v
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(jobs.SQL))
def test_sql_gives_the_same_rows(name, spark, duck, tiny):
    got, want = plain(jobs.QUERIES[name](spark, tiny).toPandas()), plain(duck.sql(jobs.SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", ["m3_importances", "m1_m2_fit_and_measure", "m4_benchmark", "m5_week_extract", "e8_model_benchmark", "e8_error_histogram"])
def test_without_sql(name, spark, tiny):
    assert jobs.QUERIES[name](spark, tiny).count() > 0


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if " Exchange " in line]


def test_one_exchange_for_all_windows(spark, tiny):
    from wattloom.jobs import baselines

    table = spark.read.parquet(f"{tiny}/events.parquet").selectExpr("event_type AS series", "ts", "value AS load")
    assert len(exchanges(baselines.predictions(table, ["series"]))) == 1


def test_keyed_jobs_have_no_single_partition(spark, tiny):
    for name in ("e1_clean_load", "e5_matrix_v1", "e6_matrix_v2"):
        assert not any("SinglePartition" in e for e in exchanges(jobs.QUERIES[name](spark, tiny))), name


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["series", "ts"]


def test_nothing_imports_the_subpackage():
    root = Path(jobs.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "wattloom.llm" not in p.read_text() and "import llm" not in p.read_text(), p
