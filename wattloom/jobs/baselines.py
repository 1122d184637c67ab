"""Naive forecasts and their scoreboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.rows import split_at
from wattloom.operators import metrics, windows

MODELS = {"persistence_24h": "persistence 24 h", "persistence_168h": "persistence 168 h", "rolling_4weeks": "mean of 4 weeks", "load_forecast": "existing forecast"}


def predictions(df: DataFrame, keys: list[str]) -> DataFrame:
    """W10, W11 on the rows that have a load (so that lags count those), one window for all."""
    rows = df.where(F.col("load").isNotNull())
    rows = windows.lags(rows, keys, "load", {"persistence_24h": 24, "persistence_168h": 168})
    return windows.mean_of_lags(rows, keys, "load", "rolling_4weeks", [168, 336, 504, 672])


def scoreboard(df: DataFrame, keys: list[str], cut: str = "2024-10-01") -> DataFrame:
    """Measures of every model on the rows from the cut on; the lags are taken before the cut."""
    test = predictions(df, keys).where(split_at(cut) == "test")
    models = {c: n for c, n in MODELS.items() if c in test.columns}
    return metrics.scoreboard(metrics.melt_predictions(test, "load", models))


def with_best(board: DataFrame) -> DataFrame:
    """E7's table: the scoreboard with A26's choice marked."""
    best = metrics.best_model(board).select(F.col("best").alias("_best"))
    return board.crossJoin(F.broadcast(best)).select(*board.columns, F.coalesce(F.col("name") == F.col("_best"), F.lit(False)).alias("is_best"))  # one row
