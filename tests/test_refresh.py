"""Late deliveries: a refresh equals a run over everything, and writes few months."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.jobs import clean, refresh

K = ["k"]
START = datetime(2023, 11, 1)


def raw(spark, days=240, skip=()):
    """Two series of hourly rows over eight months, with outliers, nulls, a gap of six weeks in one column
    of one series, and days left out of the first delivery."""
    rng = np.random.default_rng(12)
    rows = []
    for k in ("a", None):
        for i in range(days * 24):
            t = START + timedelta(hours=i)
            load = 50 + 10 * np.sin(i / 4) + rng.normal() + (400 if rng.random() < 0.004 else 0)
            load = None if rng.random() < 0.05 or (k == "a" and 70 <= i // 24 < 112) else float(load)
            pv = None if rng.random() < 0.1 else float(max(0.0, 20 * np.sin((t.hour - 5) / 14 * np.pi)) if 5 < t.hour < 21 else 0.0)
            rows.append((k, t, 1, load, pv, i // 24))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, ingest_seq int, load double, pv_sion double, d int")
    return df.withColumn("month", F.date_format("ts", "yyyy-MM")).where(~F.col("d").isin(list(skip)) if skip else F.lit(True))


def forecast_of(load):
    leads = {f"{v}_ctrl_lt{i}": F.when(F.hour("ts") % (i + 2) != 0, F.col("load") * a + b + i) for v, (a, b) in {"T_2M": (0.3, 0.0), "GLOB": (2.0, -60.0), "PS": (20.0, 90_000.0)}.items() for i in (1, 2)}
    return load.select("k", "ts", "ingest_seq", *(e.alias(n) for n, e in leads.items()), "month")


def rows(df):
    return sorted(str(tuple(None if x is None else round(x, 8) if isinstance(x, float) else x for x in r)) for r in df.collect())


@pytest.fixture(scope="module")
def feeds(spark, tmp_path_factory):
    """All rows, and those of a first delivery without some days of March."""
    path = tmp_path_factory.mktemp("feeds")
    raw(spark).drop("d").write.parquet(str(path / "all"))
    raw(spark, skip=range(130, 137)).drop("d").write.parquet(str(path / "first"))
    return spark.read.parquet(str(path / "all")), spark.read.parquet(str(path / "first"))


def merged(spark, path):
    return refresh._read(spark, f"{path}/merged").drop("month")


def test_a_late_delivery_changes_what_a_whole_run_would(spark, feeds, tmp_path):
    whole, first = feeds
    path = str(tmp_path / "out")
    assert refresh.refresh(first, forecast_of(first), path, K) == ("2023-11", "2024-06")
    columns = merged(spark, path).columns
    want = lambda f: rows(clean.merge(clean.clean_load(f.drop("month"), K), clean.clean_forecast(forecast_of(f).drop("month"), K), K).select(*columns))
    assert rows(merged(spark, path)) == want(first)
    span = refresh.refresh(whole, forecast_of(whole), path, K, ["2024-03"], ["2024-03"])
    assert rows(merged(spark, path).select(*columns)) == want(whole)
    # the gap of one series from January to February keeps the range open to the left of it
    assert "2023-11" < span[0] <= "2024-01" and span[1] < "2024-06"
    assert refresh.refresh(whole, forecast_of(whole), path, K, [], []) is None


def test_a_new_gate_writes_all_months(spark, feeds, tmp_path):
    _, first = feeds
    path = str(tmp_path / "out")
    feed = refresh.load_feed(K)
    assert refresh.refresh_feed(first, feed, path, K) == ("2023-11", "2024-06")
    lit = first.withColumn("pv_sion", F.when((F.col("month") == "2024-05") & (F.hour("ts") == 23), 5.0).otherwise(F.col("pv_sion")))
    assert refresh.refresh_feed(lit, feed, path, K, ["2024-05"]) == ("2023-11", "2024-06")
    got = refresh._read(spark, f"{path}/load").drop("month")
    assert rows(got) == rows(clean.clean_load(lit.drop("month"), K).select(*got.columns))


def test_a_month_that_comes_before_and_after(spark, feeds, tmp_path):
    whole, _ = feeds
    path, feed = str(tmp_path / "out"), refresh.load_feed(K)
    inner = whole.where(F.col("month").between("2023-12", "2024-04") & (F.col("month") != "2024-02"))
    refresh.refresh_feed(inner, feed, path, K)
    refresh.refresh_feed(whole, feed, path, K, ["2023-11", "2024-02", "2024-05", "2024-06"])
    got = refresh._read(spark, f"{path}/load").drop("month")
    assert rows(got) == rows(clean.clean_load(whole.drop("month"), K).select(*got.columns))
