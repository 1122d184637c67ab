"""The feature matrices."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import calendar
from wattloom.functions.rows import at_least, require_columns, split_at
from wattloom.operators import grid, lookups, windows
from wattloom.sources.schemas import FEATURES_V1, FEATURES_V2, FORECAST_FEATURES_V1


def check_forecast_features(df: DataFrame, wanted: list[str] = FORECAST_FEATURES_V1) -> list[str]:
    """PR19: the forecast features that are there; warns of those that are not."""
    if missing := [c for c in wanted if c not in df.columns]:
        warnings.warn(f"forecast features missing: {missing}", stacklevel=2)
    return [c for c in wanted if c in df.columns]


def matrix_v1(df: DataFrame, keys: list[str], cut: str = "2024-10-01") -> DataFrame:
    """E5: 18 features and the load, rows with any null left out, with the split."""
    check_forecast_features(df)
    rows = calendar.calendar_v1(df)
    rows = windows.lags(rows, keys, "load", {"load_lag_24h": 24, "load_lag_48h": 48, "load_lag_168h": 168})
    rows = windows.trailing_means(rows, keys, "load", {"load_rolling_24h": (24, 12), "load_rolling_168h": (168, 84)})
    rows = require_columns(rows, [*keys, "ts", *FEATURES_V1, "load"]).na.drop(subset=[*FEATURES_V1, "load"])
    return rows.withColumn("split", split_at(cut))


def interactions(df: DataFrame) -> DataFrame:
    """PR18."""
    ratio = F.col("load_J1_mean") / at_least("radiation_obs_J1_mean", 1.0)
    return df.withColumns({"ratio_load_irad_J1": ratio, "delta_temp_pred_vs_obs": F.col("temp_pred_h") - F.col("temp_obs_J1_mean")})


def matrix_v2(df: DataFrame, obs: DataFrame, keys: list[str], site_keys: list[str] | None = None, cut: str = "2024-10-07", gap: str = "INTERVAL 0 HOURS", fit_before: str | None = None, zone: str = "Europe/Zurich") -> DataFrame:
    """19 features, load and load_forecast, with the split.  df(keys, ts, load, load_forecast,
    pred_*), obs(site keys, ts, temp_obs, radiation_obs, precip_obs); the site keys are keys of df."""
    site = keys if site_keys is None else site_keys
    rows = df.withColumns({"temp_pred_h": F.col("pred_temperature"), "irad_pred_h": F.col("pred_radiation"), "precip_risk_h": F.col("pred_precipitation")})
    rows = windows.lags(rows, keys, "load", {"load_J1_same_hour": 48})
    rows = lookups.day_total(rows, keys, "pred_radiation", "irad_pred_daily_sum")  # in the partitions by series that the lags need
    rows = calendar.calendar_v2(rows, zone)
    daily_obs = grid.resample(obs, site, {"temp": ("temp_obs", "mean"), "rad": ("radiation_obs", "mean"), "rad_sum": ("radiation_obs", "sum"), "precip": ("precip_obs", "sum")}, "day")
    daily_obs = daily_obs.select(*site, F.to_date("ts").alias("day"), "temp", "rad", "rad_sum", "precip")
    p95 = lookups.monthly_percentile(daily_obs, site, "rad_sum", 0.95, fit_before)
    rows = lookups.attach_monthly(rows, site, p95, "_p95")
    rows = rows.withColumn("clear_sky_ratio", F.col("irad_pred_daily_sum") / at_least("_p95", 1.0))
    daily_load = grid.resample(df, keys, {"m": ("load", "mean")}, "day").select(*keys, F.to_date("ts").alias("day"), "m")
    rows = lookups.attach_days(rows, [
        (site, daily_obs, {2: {"temp": "temp_obs_J1_mean", "rad": "radiation_obs_J1_mean", "precip": "precip_obs_J1_sum"}}),
        (keys, daily_load, {2: {"m": "load_J1_mean"}, 8: {"m": "load_J7_mean"}}),
    ])
    rows = require_columns(interactions(rows), [*keys, "ts", *FEATURES_V2, "load", "load_forecast"])
    rows = rows.na.drop(subset=["load", "load_J1_same_hour", "load_J1_mean", "load_J7_mean"])
    return rows.withColumn("split", split_at(cut, gap=gap))
