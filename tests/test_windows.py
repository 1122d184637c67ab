"""Window operators against pandas."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.operators import clean, forecast, grid, metrics, scale, windows

K = ["k"]


def frame(spark, values, keys=("a",), step=timedelta(hours=1)):
    start = datetime(2024, 1, 1)
    rows = [(k, start + i * step, None if v is None or np.isnan(v) else float(v)) for k in keys for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double")


def column(df, name="x", key="a"):
    return np.array([np.nan if r[0] is None else r[0] for r in df.where(F.col("k") == key).orderBy("ts").select(name).collect()], float)


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(5)
    x = rng.normal(10, 3, 240)
    x[rng.random(240) < 0.15] = np.nan
    x[[40, 130]] = 60
    x[:3] = x[100:111] = x[229:] = np.nan
    return x


def test_interpolation_is_pandas(spark, noisy):
    s = pd.Series(noisy, index=pd.date_range("2024-01-01", periods=len(noisy), freq="h"))
    want = s.interpolate(method="time", limit=6).ffill(limit=2).bfill(limit=2)
    got = windows.interpolate(frame(spark, noisy), K, ["x"])
    np.testing.assert_allclose(column(got), want.to_numpy(), rtol=1e-9)
    kept = ~np.isnan(noisy)
    np.testing.assert_array_equal(column(got)[kept], noisy[kept])


def test_strict_interpolation_leaves_long_gaps(spark, noisy):
    got = column(windows.interpolate(frame(spark, noisy), K, ["x"], strict=True))
    assert np.isnan(got[100:111]).all() and np.isnan(got[229:]).all() and np.isnan(got[:3]).all()


def test_zscore_is_pandas(spark, noisy):
    s = pd.Series(noisy)
    r = s.rolling(48, center=True, min_periods=12)
    z = ((s - r.mean()) / r.std().replace(0, np.nan)).abs()
    want = s.mask(z > 3)
    got = column(windows.null_zscore_outliers(frame(spark, noisy), K, ["x"], 48, 12, 3.0))
    np.testing.assert_allclose(got, want.to_numpy())
    assert np.isnan(got[40]) and np.isnan(got[130])


def test_spikes_null_both_steps(spark):
    got = column(windows.null_spikes(frame(spark, [1, 2, 30, 3, np.nan, 50]), K, {"x": 8.0}))
    np.testing.assert_array_equal(got, [1, 2, np.nan, np.nan, np.nan, 50])


def test_trailing_mean_is_pandas_and_leaks_nothing(spark, noisy):
    want = pd.Series(noisy).shift(1).rolling(24, min_periods=12).mean()
    got = windows.trailing_means(frame(spark, noisy), K, "x", {"m": (24, 12)})
    np.testing.assert_allclose(column(got, "m"), want.to_numpy())
    changed = noisy.copy()
    changed[120:] = 999
    later = windows.trailing_means(frame(spark, changed), K, "x", {"m": (24, 12)})
    np.testing.assert_allclose(column(later, "m")[:121], column(got, "m")[:121])


def test_rolling_stats_are_the_frames(spark, noisy):
    got = scale.rolling_stats(frame(spark, noisy), K, "x", 10, 9)
    r = pd.Series(noisy).rolling(20, center=True, min_periods=1)
    np.testing.assert_allclose(column(got, "roll_mean"), r.mean().to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(column(got, "roll_std"), r.std().to_numpy(), rtol=1e-6, atol=1e-9)


def test_halo_is_the_plain_window(spark, noisy):
    df = frame(spark, noisy, ("a", "b"))
    run = lambda rows, keys: windows.null_zscore_outliers(rows, keys, ["x"], 24, 6, 2.5)
    plain, chunked = run(df, K), scale.with_halo(df, K, run, 12, 11, size=37, part="day")
    assert chunked.columns == plain.columns and chunked.count() == plain.count()
    for k in ("a", "b"):
        np.testing.assert_allclose(column(chunked, key=k), column(plain, key=k))


def test_chunks_interpolate_as_the_whole_series(spark, noisy):
    x = np.concatenate([noisy, np.full(90, np.nan), noisy[::-1], np.full(3, np.nan)])  # a gap longer than two chunks, open ends
    df = frame(spark, x, ("a", "b", None)).withColumn("y", F.when(F.hour("ts") % 5 != 0, F.col("x") * 2)).withColumn("_c", F.lit("kept"))
    for size, strict in ((40, False), (7, False), (3, False), (40, True), (1000, False)):
        plain = windows.interpolate(df, K, ["x", "y"], strict=strict)
        cut = windows.interpolate_in_chunks(df, K, ["x", "y"], strict=strict, size=size, part="day")
        assert cut.columns == plain.columns
        a, b = (sorted((str(r.k), r.ts, r.x and round(r.x, 9), r.y and round(r.y, 9), r._c) for r in d.collect()) for d in (plain, cut))
        assert a == b, (size, strict)
    with pytest.raises(ValueError):
        windows.interpolate_in_chunks(df, K, ["x"], size=2)
    assert windows.interpolate_in_chunks(df.where("false"), K, ["x"]).collect() == []


@pytest.mark.parametrize("part", ["day", "week", "month"])
def test_gaps_and_stretches_over_parts(spark, part):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(24 * 20) < 0.5, np.nan, 1.0)
    x[:30] = x[100:180] = x[400:] = np.nan  # at the start, over three days and more, at the end
    df = frame(spark, x, ("a", None)).where("not (dayofmonth(ts) between 5 and 8) and hour(ts) not in (0, 23)")
    df = df.unionByName(frame(spark, np.full(60, np.nan), ("empty",))).unionByName(frame(spark, np.ones(60), ("full",)))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(scale.gaps_in_parts(df, K, "INTERVAL 1 HOUR", part=part)) == rows(grid.gaps(df, K, "INTERVAL 1 HOUR")) != []
    found = scale.stretches_in_parts(df, K, ["x"], part=part)
    assert rows(found) == rows(grid.empty_stretches(df, K, ["x"])) != []
    assert [(r.start, r.end) for r in found.where("k = 'empty'").collect()] == [(datetime(2024, 1, 1), datetime(2024, 1, 3, 11))]
    assert found.where("k = 'full'").count() == 0
    assert scale.stretches_in_parts(df.where("false"), K, ["x"]).collect() == scale.gaps_in_parts(df.where("false"), K, "INTERVAL 1 HOUR").collect() == []


def test_rolling_stats_of_any_size_and_with_nan(spark, noisy):
    s = pd.Series(noisy)
    for values, level in ((s + 1e9, 1e9), (s * 1e-6, 0)):
        got = scale.rolling_stats(frame(spark, values.to_numpy()), K, "x", 10, 9)
        r = values.rolling(20, center=True, min_periods=1)
        np.testing.assert_allclose(column(got, "roll_mean"), r.mean().to_numpy(), rtol=1e-12)
        np.testing.assert_allclose(column(got, "roll_std"), (values - level).rolling(20, center=True, min_periods=1).std().to_numpy(), rtol=1e-6, atol=1e-12)
    for before, after in ((0, 0), (3, 0), (0, 5), (1, 1), (500, 500)):
        got = scale.rolling_stats(frame(spark, noisy), K, {"x": "a"}, before, after)
        for i, n in enumerate(column(got, "a_n")):
            own = noisy[max(0, i - before) : i + after + 1]
            assert n == np.isfinite(own).sum()
    nan = frame(spark, noisy).withColumn("x", F.when(F.hour("ts") == 5, float("nan")).otherwise(F.col("x")))
    null = nan.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    for n in ("roll_mean", "roll_std", "roll_n"):
        a, b = (column(scale.rolling_stats(d, K, "x", 10, 9), n) for d in (nan, null))
        np.testing.assert_array_equal(a, b)


def test_an_outlier_is_found_after_a_nan(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    x[300] = 90
    df = frame(spark, x).withColumn("x", F.when(F.col("ts") == F.lit(datetime(2024, 1, 1, 5)), float("nan")).otherwise(F.col("x")))
    got = column(windows.null_zscore_outliers(df, K, ["x"], 48, 12))
    assert np.flatnonzero(np.isnan(got)).tolist() == [5, 300]
    far = column(windows.null_zscore_outliers(frame(spark, x + 1e9), K, ["x"], 48, 12))
    assert np.flatnonzero(np.isnan(far)).tolist() == [300]


def test_windows_take_one_exchange_and_one_task_a_chunk(spark, noisy):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    df = frame(spark, noisy).withColumn("y", F.col("x"))
    assert plan(windows.null_zscore_outliers(df, K, ["x", "y"], 24, 6)).count("Exchange hashpartitioning") == 1
    assert "hashpartitioning(k" in plan(windows.interpolate_in_chunks(df, K, ["x"])) and "_chunk" in plan(windows.interpolate_in_chunks(df, K, ["x"])).split("Window")[1]


@pytest.mark.parametrize("gather", [5, 200, 10_000])
def test_quantiles_are_exact_at_any_bracket(spark, gather):
    from wattloom.operators import ranks

    rng = np.random.default_rng(9)
    values = {
        "flat": rng.normal(size=4000), "few": rng.choice([0.0, 1.0], 3000), "atom": np.where(rng.random(3001) < 0.6, 5.0, rng.random(3001) * 10), "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]), "same": np.full(900, 3.0), None: rng.exponential(size=1500), "long": np.r_[np.zeros(500), 10.0 ** rng.uniform(-300, 300, 700), -np.inf, np.inf],
    }
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("flat", None), ("flat", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    shares = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q1": 1.0}
    got = {r.k: r for r in ranks.quantiles(df, ["k"], ["x"], shares, gather).collect()}
    assert set(got) == set(values)
    for k, x in values.items():
        if k != "long":
            np.testing.assert_allclose([got[k][n] for n in shares], np.quantile(x, list(shares.values())), rtol=1e-12, err_msg=str(k))
    assert (got["long"].q0, got["long"].q1) == (-np.inf, np.inf) and got["long"].q50 == pytest.approx(np.quantile(values["long"], 0.5), rel=1e-12)
    whole = ranks.quantiles(df, [], ["x"], {"m": 0.5}, gather).collect()
    assert [(r.column, r.m) for r in whole] == [("x", pytest.approx(np.nanquantile(np.concatenate(list(values.values())), 0.5), rel=1e-12))]
    assert ranks.quantiles(df.where("false"), ["k"], ["x"], shares).collect() == []


def test_loop_and_lag_means(spark):
    x = np.arange(24 * 40, dtype=float) ** 1.1
    df = frame(spark, x)
    a = column(windows.same_slot_mean(df, K, "x", "m"), "m")
    b = column(windows.mean_of_lags(df, K, "x", "m", [168, 336, 504, 672]), "m")
    np.testing.assert_allclose(a, b)  # equal on a complete grid


def test_resample_fills_the_grid(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 10), 1.0), ("a", datetime(2024, 1, 1, 0, 50), 3.0), ("a", datetime(2024, 1, 1, 2, 5), None), (None, datetime(2024, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double")
    got = grid.resample(df, K, {"m": ("x", "mean"), "s": ("x", "sum")}).orderBy("k", "ts").collect()
    assert [(r.k, r.ts.hour, r.m, r.s) for r in got] == [(None, 0, 5.0, 5.0), ("a", 0, 2.0, 4.0), ("a", 1, None, 0.0), ("a", 2, None, 0.0)]


def test_night_gate_and_median(spark):
    night = frame(spark, [np.nan, -1, 2, np.nan, 5, 6, 7, 8])  # hours 0..7
    np.testing.assert_array_equal(column(clean.zero_at_night(night, K, ["x"])), [0, 0, 0, 0, 0, 0, 7, 8])
    dark = frame(spark, [np.nan, -1, 0, np.nan, 0, 0, 7, 8])
    np.testing.assert_array_equal(column(clean.zero_at_night(dark, K, ["x"])), [np.nan, -1, 0, np.nan, 0, 0, 7, 8])
    assert column(clean.zero_at_night(dark, [], ["x"], mode="always"))[1] == 0
    np.testing.assert_array_equal(column(clean.scale_by_median(frame(spark, [20000, 30000, 100]), K, ["x"])), [200, 300, 1])
    rng = np.random.default_rng(6)
    for _ in range(12):
        x = rng.choice([9_000.0, 9_999.0, 10_000.0, 10_001.0, 12_000.0, np.nan], size=rng.integers(1, 7))
        above = np.nanmedian(x) > 10_000 if np.isfinite(x).any() else False
        for apart in (False, True):
            got = column(clean.scale_by_median(frame(spark, x), K, ["x"], apart=apart))
            np.testing.assert_array_equal(got, x / 100 if above else x)
    both = frame(spark, [1, 2, np.nan], ("a", None))
    for apart in (False, True):
        assert sorted(str(tuple(r)[2]) for r in clean.zero_at_night(both, K, ["x"], apart=apart).collect()) == ["0.0"] * 6


def test_run_summaries_agree(spark):
    leads = [(1, None, 4.0, 8.0), (2, None, None, None), (3, 7.0, None, None)]
    wide = spark.createDataFrame(leads, "ts int, v_lt1 double, v_lt2 double, v_lt10 double")
    a = wide.select("ts", *(e.alias(n) for n, e in forecast.wide_summary(wide.columns, "v", "v").items())).orderBy("ts").collect()
    long = forecast.melt_leads(wide, [], ["v"])
    b = forecast.summarize_runs(long, []).orderBy("ts").collect()
    want = [(4.0, 2, np.std([4, 8], ddof=1), 2), (None, None, 0.0, 0), (7.0, 1, 0.0, 1)]
    for got, plain, w in zip(a, b, want):
        assert (got.v_best, got.v_lead_time, got.v_n_runs) == (w[0], w[1], w[3]) == (plain.best, plain.lead_time, plain.n_runs)
        assert got.v_spread == pytest.approx(w[2]) == plain.spread


def test_measures(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 2.0, None), (5.0, None, None)], "y double, a double, b double")
    board = {r.name: r for r in metrics.scoreboard(metrics.melt_predictions(df, "y", {"a": "A", "b": "B"})).collect()}
    assert (board["A"].n, board["A"].mae, board["A"].nrmse_pct) == (2, 0.5, pytest.approx(np.sqrt(0.5) * 100))
    assert board["B"].n == 0 and board["B"].mae is None and board["B"].nrmse_pct is None
    p = spark.createDataFrame([(0.5, 30), (0.0, 30), (1.0, 5), (0.3, 2)], "r double, n long").select(metrics.p_value(F.col("r"), F.col("n")).alias("p"))
    assert [r.p for r in p.collect()] == [pytest.approx(0.0049, rel=1e-3), pytest.approx(1.0), 0.0, None]
