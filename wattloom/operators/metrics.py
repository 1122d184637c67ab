"""Error measures, descriptions and correlations."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import average_rank, quantiles


def melt_predictions(df: DataFrame, truth: str, models: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """(keep, truth, name, pred), one row for each model {column: name}, without a union."""
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("pred")) for c, n in models.items()))
    return df.select(*(keep or []), F.col(truth).alias("y"), F.explode(rows).alias("_r")).select(*(keep or []), "y", "_r.*")


def _both(c: Column) -> Column:
    return F.when(F.col("y").isNotNull() & F.col("pred").isNotNull(), c)


def scoreboard(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """N, MAE, RMSE, RMSE in % of the truth's range, on pairs without a null; a model without
    pairs has n 0 and null measures."""
    e = F.col("y") - F.col("pred")
    rmse = F.sqrt(F.avg(_both(e * e)))
    span = F.max(_both(F.col("y"))) - F.min(_both(F.col("y")))
    return long.groupBy(*(by or []), "name").agg(F.count(_both(e)).alias("n"), F.avg(_both(F.abs(e))).alias("mae"), rmse.alias("rmse"), (rmse / F.nullif(span, F.lit(0.0)) * 100).alias("nrmse_pct"))


def fit_measures(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A10: MAE, RMSE and R2 = 1 - SSE / SST."""
    e = F.col("y") - F.col("pred")
    sst = F.var_pop(_both(F.col("y"))) * F.count(_both(e))
    return long.groupBy(*(by or []), "name").agg(F.count(_both(e)).alias("n"), F.avg(_both(F.abs(e))).alias("mae"), F.sqrt(F.avg(_both(e * e))).alias("rmse"), (1 - F.sum(_both(e * e)) / F.nullif(sst, F.lit(0.0))).alias("r2"))


def overfit(long: DataFrame, limit: float = 1.5) -> DataFrame:
    """Test RMSE over train RMSE (column split), and whether it is below the limit."""
    e = F.col("y") - F.col("pred")
    rmse = lambda part: F.sqrt(F.avg(F.when(F.col("split") == part, _both(e * e))))
    ratio = rmse("test") / F.nullif(rmse("train"), F.lit(0.0))
    return long.groupBy("name").agg(rmse("train").alias("rmse_train"), rmse("test").alias("rmse_test"), ratio.alias("ratio"), (ratio < limit).alias("ok"))


def monthly_gain(df: DataFrame, truth: str, a: str, b: str, ts: str = "ts") -> DataFrame:
    """By calendar month, n, the MAE of two models, and the gain of a over b in %."""
    ok = F.col(truth).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    mae = lambda c: F.avg(F.abs(F.col(truth) - F.col(c)))
    out = df.where(ok).groupBy(F.month(ts).alias("month")).agg(F.count("*").alias("n"), mae(a).alias("mae_a"), mae(b).alias("mae_b"))
    return out.withColumn("gain_pct", (1 - F.col("mae_a") / F.nullif("mae_b", F.lit(0.0))) * 100)


def best_model(board: DataFrame) -> DataFrame:
    """The name of the least RMSE, nulls left out."""
    return board.where("rmse is not null").agg(F.min_by("name", F.struct("rmse", "name")).alias("best"), F.min("rmse").alias("rmse"))


def _each(df: DataFrame, columns: list[str], facts: dict[str, object]) -> DataFrame:
    """(column, facts...) from one aggregate over all columns."""
    one = df.agg(*(f(c).alias(f"{n}__{c}") for c in columns for n, f in facts.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{n}__{c}").alias(n) for n in facts)) for c in columns))))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and share of values, in one pass."""
    n = F.count("*")
    return _each(df, columns, {"n_null": lambda c: n - F.count(c), "coverage_pct": lambda c: F.count(c) / F.nullif(n, F.lit(0)) * 100})


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, least, linear quartiles, greatest."""
    facts = _each(df, columns, {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    quartiles = quantiles(df, [], columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return facts.join(quartiles, "column", "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def extent_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least, greatest, mean of each column."""
    return _each(df, columns, {"min": F.min, "max": F.max, "mean": F.avg})


def table_extent(df: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Rows, first and last time."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def _tail_integral(low: Column, high: Column, power: Column, steps: int = 1_000) -> Column:
    """Integral of cos(x)^power by Simpson's rule."""
    step = (high - low) / steps
    weight = lambda i: F.when((i == 0) | (i == steps), 1).when(i % 2 == 1, 4).otherwise(2)
    value = lambda i: F.exp(power * F.ln(F.greatest(F.cos(low + step * i), F.lit(1e-300))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda total, i: total + weight(i) * value(i)) * step / 3


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of r in n pairs under none.  With r = sin(x), x has the density
    cos(x)^(n - 3) up to its integral, which is negligible 40 deviations on."""
    power, reach = F.greatest(n - 3, F.lit(0)), 40 / F.sqrt(n)
    at = F.asin(F.least(F.abs(r), F.lit(1.0)))
    tail = _tail_integral(at, F.least(F.lit(math.pi / 2), at + reach), power)
    whole = _tail_integral(F.lit(0.0), F.least(F.lit(math.pi / 2), reach), power)
    return F.when(F.abs(r) >= 1, 0.0).when(n >= 3, F.least(tail / whole, F.lit(1.0)))


def pearson(df: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """N, r and p of the pairs without a null; r and p are null with fewer than `least` pairs."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    out = df.where(ok).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"))
    out = out.select("n", F.when(F.col("n") >= least, F.col("r")).alias("r"))
    return out.withColumn("p", p_value(F.col("r"), F.col("n")))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """N and the correlation of the average ranks, on pairs without a null."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_rank(average_rank(rows, a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(var_a, var_b, r) of all pairs on rows without a null, from one aggregate."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.select(*columns).na.drop().agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = [F.struct(F.lit(x).alias("var_a"), F.lit(y).alias("var_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return one.select(F.inline(F.array(*rows)))


def with_target(matrix: DataFrame, target: str) -> DataFrame:
    """The target's row of the matrix."""
    return matrix.where((F.col("var_a") == target) & (F.col("var_b") != target)).select(F.col("var_b").alias("column"), "r")


def error_histogram(df: DataFrame, error: str, bins: int = 80) -> DataFrame:
    """(bin 1..bins, n) over equal bins from the least to the greatest error."""
    ends = df.agg(F.min(error).alias("_lo"), F.max(error).alias("_hi"))
    rows = df.where(F.col(error).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    at = F.when(F.col("_lo") == F.col("_hi"), F.lit(1)).otherwise(F.least(F.width_bucket(F.col(error), F.col("_lo"), F.col("_hi"), F.lit(bins)), F.lit(bins)))
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def error_moments(df: DataFrame, error: str) -> DataFrame:
    """Mean and population deviation."""
    return df.agg(F.avg(error).alias("mean"), F.stddev_pop(error).alias("std"))
