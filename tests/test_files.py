from __future__ import annotations

import os
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from wattloom.sources import files

RAW = """timestamp;standardised load [-];standardised forecast load [-];central valais solar production [kWh];sion area solar production [kWh];sierre area production [kWh];remote solar production [kWh]
01/02/2023 00:15;-0,5;#N/A;1,25;N/A;;NA
2023-02-01 00:30:00;0,75;1;2;3;4;5,5
"""


def test_raw_load(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(RAW)
    rows = files.read_raw_load(spark, str(tmp_path / "raw.csv")).orderBy("ts").collect()
    assert tuple(rows[0]) == (D(2023, 2, 1, 0, 15), -0.5, None, 1.25, None, None, None)
    assert tuple(rows[1]) == (D(2023, 2, 1, 0, 30), 0.75, 1.0, 2.0, 3.0, 4.0, 5.5)


def test_imported_load_and_latest(spark, tmp_path):
    for i, name in enumerate(("b.csv", "a.csv")):
        p = tmp_path / name
        p.write_text(f"timestamp,standardised load [-]\n2023-01-01 00:00:00,{i}\n")
        os.utime(p, (1000 + i, 1000 + i))
    latest = files.read_latest(spark, str(tmp_path / "*.csv"))
    assert latest.columns == ["ts", "load"] and latest.first().load == 1.0
    assert files.read_latest(spark, str(tmp_path / "*.csv"), by="file_name").first().load == 0.0
    with pytest.raises(Exception, match="(?i)path|exist"):
        files.read_latest(spark, str(tmp_path / "none*.csv"))


def test_forecast_matrix(spark, tmp_path):
    (tmp_path / "f.csv").write_text("time_utc;T_2M_ctrl_lt1;T_2M_ctrl_lt2\n02/01/2023 03:00;1,5;-99999\n03.01.2023 04:00;;2\n")
    rows = files.read_forecast(spark, str(tmp_path / "f.csv")).collect()
    assert [tuple(r) for r in rows] == [(D(2023, 1, 2, 3), 1.5, -99999.0), (D(2023, 1, 3, 4), None, 2.0)]


def test_observations_by_month(spark, tmp_path):
    rows = [(D(2023, m, 1, h), "s", "x", "Value", float(h), h) for m in (1, 2) for h in (0, 1)]
    df = spark.createDataFrame(rows, files.OBSERVATION_SCHEMA)
    path = str(tmp_path / "obs")
    files.write_by_month(df, path)
    files.write_by_month(df.where(F.month("ts") == 2).withColumn("value", F.lit(9.0)), path)
    back = files.read_table(spark, path)
    assert {(r.month, r.value) for r in back.collect()} == {("2023-01", 0.0), ("2023-01", 1.0), ("2023-02", 9.0)}
    got = files.select_observations(back, "2023-01-01 01:00:00", "2023-02-01", "s", ["x"])
    assert [r.value for r in got.collect()] == [1.0]
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan or "GreaterThanOrEqual(ts" in plan


def test_write_csv_with_header(spark, tmp_path):
    files.write_table(spark.createDataFrame([(D(2023, 1, 1), 1.5)], "ts timestamp_ntz, x double"), str(tmp_path / "out"), form="csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["ts", "x"]
