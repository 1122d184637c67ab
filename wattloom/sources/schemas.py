"""Names, bounds and column lists of the feeds and of the feature tables."""

from __future__ import annotations

# The feeds' columns, canonical names, limits and feature lists.
NULL_TOKENS = ["#N/A", "N/A", "", "NA"]
SENTINEL = -99999.0
LOAD_COLUMNS = {
    "standardised load [-]": "load",
    "standardised forecast load [-]": "load_forecast",
    "central valais solar production [kWh]": "pv_central_valais",
    "sion area solar production [kWh]": "pv_sion",
    "sierre area production [kWh]": "pv_sierre",
    "remote solar production [kWh]": "pv_remote",
}
PV_COLUMNS = ["pv_central_valais", "pv_sion", "pv_sierre", "pv_remote"]
PV_BOUNDS = {"pv_central_valais": (0, 5000), "pv_sion": (0, 1500), "pv_sierre": (0, 2000), "pv_remote": (0, 80000)}
OBSERVATIONS = {
    "Air temperature 2m above ground (current value)": "temp_obs",
    "Atmospheric pressure at barometric altitude": "pressure_obs",
    "Global radiation (ten minutes mean)": "radiation_obs",
    "Precipitation (ten minutes total)": "precip_obs",
    "Sunshine duration (ten minutes total)": "sunshine_obs",
}
OBSERVATION_RULES = {"temp_obs": "mean", "pressure_obs": "mean", "radiation_obs": "mean", "precip_obs": "sum", "sunshine_obs": "sum"}
FORECAST_ALIASES = {
    "T_2M": "pred_temperature",
    "GLOB": "pred_radiation",
    "TOT_PREC": "pred_precipitation",
    "DURSUN": "pred_sunshine",
    "PS": "pred_pressure",
    "RELHUM_2M": "pred_humidity",
    "FF_10M": "pred_wind_speed",
    "DD_10M": "pred_wind_dir",
}
BEST_BOUNDS = {"GLOB": (0, 1200), "T_2M": (-35, 45), "PS": (85000, 105000), "TOT_PREC": (0, 50), "DURSUN": (0, 3600), "RELHUM_2M": (0, 100), "FF_10M": (0, 50), "DD_10M": (0, 360)}
SPREAD_BOUNDS = {"GLOB": (0, 600), "T_2M": (0, 20), "TOT_PREC": (0, 30), "DURSUN": (0, 3600), "PS": (0, 5000)}
ALIAS_SPREAD_BOUNDS = {"RELHUM_2M": (0, 50), "FF_10M": (0, 30), "DD_10M": (0, 360)}  # of the pred_ columns only
SPIKES = {"T_2M": 8.0, "PS": 5.0}
FEATURES_V1 = [
    "hour_sin", "hour_cos", "weekday", "is_weekend", "month_sin", "month_cos", "is_holiday",
    "pred_radiation", "pred_temperature", "pred_humidity", "pred_wind_speed", "pred_radiation_spread", "pred_temperature_spread",
    "load_lag_24h", "load_lag_48h", "load_lag_168h", "load_rolling_24h", "load_rolling_168h",
]
FORECAST_FEATURES_V1 = [c for c in FEATURES_V1 if c.startswith("pred_")]
FEATURES_V2 = [
    "time_of_day_sin", "time_of_day_cos", "day_of_year_sin", "day_of_year_cos", "day_of_week", "is_holiday",
    "temp_pred_h", "irad_pred_h", "precip_risk_h", "irad_pred_daily_sum", "clear_sky_ratio",
    "temp_obs_J1_mean", "radiation_obs_J1_mean", "precip_obs_J1_sum", "load_J1_mean", "load_J1_same_hour", "load_J7_mean",
    "ratio_load_irad_J1", "delta_temp_pred_vs_obs",
]
FIXED_HOLIDAYS = [(1, 1), (1, 2), (3, 19), (5, 1), (8, 1), (8, 15), (9, 25), (11, 1), (12, 8), (12, 25), (12, 26)]
EASTER_OFFSETS = [-2, 1, 39, 50, 60]


def bounds_of_forecast() -> dict[str, tuple[float, float]]:
    """Column bounds of the forecast summary: best values, spreads, and their pred_ copies."""
    out = {}
    for short, alias in FORECAST_ALIASES.items():
        out[f"{short}_best"] = out[alias] = BEST_BOUNDS[short]
        if short in SPREAD_BOUNDS:
            out[f"{short}_spread"] = out[f"{alias}_spread"] = SPREAD_BOUNDS[short]
        else:
            out[f"{alias}_spread"] = ALIAS_SPREAD_BOUNDS[short]
    return out
