"""Boosted trees on the feature matrix, with the last part of the training rows for validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import NamedTuple

from py4j.java_gateway import JavaObject
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.functions.rows import at_most
from wattloom.operators import metrics
from wattloom.sources.files import scratch

ROWS_A_TASK = 50_000  # fewer rows than this don't pay for a task of their own
STAGE = 10  # trees after which the residuals are written


def leaf_value(total: float, n: float, l1: float, l2: float) -> float:
    """What a leaf adds under squared loss: the residuals' sum, drawn towards 0 by l1, over n + l2."""
    drawn = max(abs(total) - l1, 0.0)
    return (drawn if total > 0 else -drawn) / (n + l2) if n + l2 > 0 else 0.0


@dataclass
class BoostedTrees:
    """Trees of one GBTRegressionModel with leaf values of their own: the prediction is `base` and, for
    each tree, `step` times the value of the leaf that a row falls in.  `losses` are the mean squared
    errors on the held rows after 0, 1, 2, ... rounds, those after the best one included."""

    prepare: PipelineModel
    features: list[str]
    base: float
    step: float
    trees: GBTRegressionModel | None
    leaves: list[list[float]]
    losses: list[float] = field(default_factory=list)

    def transform(self, rows: DataFrame, name: str = "pred_model") -> DataFrame:
        """The rows with their prediction."""
        doubles = rows.withColumns({f"_x_{c}": F.col(c).cast("double") for c in self.features})
        ready = self.prepare.transform(doubles)
        return _with_margin(ready, self.trees and self.trees._java_obj, self.leaves, self.step, F.lit(self.base), name).drop("_features", *(f"_{k}_{c}" for k in "xf" for c in self.features))

    def importances(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        shares = self.trees.featureImportances.toArray().tolist() if self.trees else []
        return dict(zip(self.features, shares + [0.0] * (len(self.features) - len(shares))))  # it ends at the last one used

    def save(self, path: str) -> None:
        self.prepare.write().overwrite().save(f"{path}/prepare")
        if self.trees:
            self.trees.write().overwrite().save(f"{path}/trees")
        facts = json.dumps({"features": self.features, "base": self.base, "step": self.step, "leaves": self.leaves, "losses": self.losses})
        SparkSession.active().createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/leaves")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        facts = json.loads(spark.read.text(f"{path}/leaves").first()[0])
        trees = GBTRegressionModel.load(f"{path}/trees") if facts["leaves"] else None
        return cls(PipelineModel.load(f"{path}/prepare"), trees=trees, **facts)


def _together(trees: list[JavaObject], step: float) -> JavaObject:
    """One boosted model of trees grown one after the other, as the JVM holds them: wrapping each round's
    trees in Python would take longer than to grow them."""
    sc = SparkSession.active().sparkContext
    gateway, jvm = sc._gateway, sc._jvm
    own = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, t in enumerate(trees):
        own[i], weights[i] = t, step
    return jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"gbtr_{len(trees)}", own, weights)


def _with_leaves(rows: DataFrame, trees: JavaObject, name: str) -> DataFrame:
    """The rows with the number of the leaf that they fall in: of a tree, or as a vector of all trees."""
    trees.setFeaturesCol("_features")
    trees.setPredictionCol("")
    trees.setLeafCol(name)
    return DataFrame(trees.transform(rows._jdf), rows.sparkSession)


def _with_margin(rows: DataFrame, trees: JavaObject | None, leaves: list[list[float]], step: float, start: Column, name: str) -> DataFrame:
    """`start` plus what the trees add, from the leaf of every tree (one call for all trees)."""
    if trees is None:
        return rows.withColumn(name, start)
    values = F.from_json(F.lit(json.dumps(leaves)), "array<array<double>>")  # folded into one constant
    added = F.zip_with(vector_to_array("_leaves"), values, lambda leaf, value: F.get(value, leaf.cast("int")))
    sums = F.aggregate(added, F.lit(0.0), lambda total, x: total + x)
    return _with_leaves(rows, trees, "_leaves").withColumn(name, start + step * sums).drop("_leaves")


def fit(
    train: DataFrame, features: list[str], label: str = "load", rounds: int = 500, depth: int = 6, validation_share: float = 0.1, patience: int = 50, ts: str = "ts",
    step: float = 0.05, sample: float = 0.8, l1: float = 0.1, l2: float = 1.0, least: int = 5, seed: int = 42, at_once: int = 5,
) -> BoostedTrees:
    """M1: imputed medians, then at most `rounds` boosted trees with L1 and L2 terms.  The last
    `validation_share` of the time judges every round; growing stops `patience` rounds after the best
    one, whose trees stay.

    A tree grows once, on the residuals that those before leave.  One aggregate by leaf then gives
    its leaf values (leaf_value) and, as the rows' errors are known up to the leaf's value, the held
    rows' loss.  Rows are dealt and ordered by their values, so equal rows give equal trees.  After every STAGE trees the residuals are written, which starts a short plan anew: a
    row never passes more than STAGE trees (and `at_once`), and a lost executor costs one stage at most.

    `at_once` trees grow in one pass, on samples of their own of the residuals before the first of them.
    Their leaf values still come one after the other, each from exactly what the trees before leave: the
    one aggregate also counts in which leaves of two trees the rows are together.  A step of 0.05 changes
    the residuals little, and nearly all of the cost of a tree is in passes over the rows, which such
    trees share.  1 is plain boosting."""
    spark = train.sparkSession
    ends = train.agg(F.unix_micros(F.min(ts).cast("timestamp")).alias("a"), F.unix_micros(F.max(ts).cast("timestamp")).alias("b")).first()
    if ends.a is None:
        raise ValueError("no rows to learn from")
    cut = ends.a + (ends.b - ends.a) * (1 - validation_share)
    held = F.unix_micros(F.col(ts).cast("timestamp")) > cut
    rows = train.where(F.col(label).isNotNull()).select(*(F.col(c).cast("double").alias(f"_x_{c}") for c in features), F.col(label).cast("double").alias("_y"), held.alias("_held"))
    names, filled = [f"_x_{c}" for c in features], [f"_f_{c}" for c in features]
    stored = _written(rows, "model-rows")
    n = stored.count()
    parts = max(1, n // ROWS_A_TASK)
    prepare = Pipeline(stages=[Imputer(strategy="median", inputCols=names, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_features")]).fit(stored)
    base = stored.where("not _held").agg(F.avg("_y")).first()[0] or 0.0
    dealt = stored.repartition(parts, F.xxhash64("_y", *names)).sortWithinPartitions("_y", *names)
    stage = prepare.transform(dealt).select("_features", "_held", (F.col("_y") - base).alias("_r")).persist()

    trees: list[JavaObject] = []
    leaves: list[list[float]] = []
    errors = stage.where("_held").agg(F.count("*").alias("n"), F.avg(F.col("_r") * F.col("_r")).alias("e")).first()
    n_held, losses = errors.n, [] if errors.e is None else [errors.e]
    first = 0  # of the trees that the stage's residuals don't know yet
    best = lambda: min(range(len(losses)), key=losses.__getitem__) if losses else len(trees)
    while len(trees) < rounds and len(trees) - best() < patience:
        if len(trees) - first >= STAGE:
            done = stage
            stage = _written(_residuals(stage, trees[first:], leaves[first:], step), "model-residuals").persist()
            done.unpersist()
            first = len(trees)
        now = _residuals(stage, trees[first:], leaves[first:], step)
        grower = RandomForestRegressor(
            featuresCol="_features", labelCol="_r", numTrees=min(at_once, rounds - len(trees)), maxDepth=depth, minInstancesPerNode=least, bootstrap=False, subsamplingRate=sample,
            featureSubsetStrategy="0.8" if sample < 1 else "all", seed=seed + len(trees),
        )
        grown = list(grower.fit(now.where("not _held"))._java_obj.trees())
        sums = _leaf_sums(now, grown, step)
        start = len(trees)
        for t, tree in enumerate(grown):
            values, moved = _next_leaves(sums, t, leaves[start:], step, l1, l2)
            trees.append(tree)
            leaves.append(values)
            if losses:
                losses.append(losses[-1] + moved / n_held)
    stage.unpersist()
    keep = best()
    return BoostedTrees(prepare, features, base, step, GBTRegressionModel(_together(trees[:keep], step)) if keep else None, leaves[:keep], losses)


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _residuals(stage: DataFrame, trees: list[JavaObject], leaves: list[list[float]], step: float) -> DataFrame:
    if not trees:
        return stage
    return _with_margin(stage, _together(trees, step), leaves, -step, F.col("_r"), "_r")


class Sums(NamedTuple):
    """Of the rows to learn from and of the held ones: sum of residuals, number of rows."""

    s: float
    n: int
    hs: float
    hn: int


def _leaf_sums(rows: DataFrame, trees: list[JavaObject], step: float) -> dict[tuple[int, int, int, int], Sums]:
    """For the trees of one pass, from one aggregate: {(t, leaf, -1, -1)}: the rows in a leaf of tree t, and
    {(t, leaf, e, other)}: those of them that were in leaf `other` of an earlier tree e."""
    placed = _with_leaves(rows, _together(trees, step), "_leaves").withColumn("_at", F.transform(vector_to_array("_leaves"), lambda x: x.cast("int")))
    none = F.lit(-1)
    cells = [F.struct(F.lit(t).alias("t"), F.get("_at", F.lit(t)).alias("leaf"), (none if e < 0 else F.lit(e)).alias("e"), (none if e < 0 else F.get("_at", F.lit(e))).alias("other")) for t in range(len(trees)) for e in range(-1, t)]
    r, held, zero = F.col("_r"), F.col("_held"), F.lit(0.0)
    each = placed.select("_r", "_held", F.explode(F.array(*cells)).alias("_c")).groupBy("_c.t", "_c.leaf", "_c.e", "_c.other")
    sums = each.agg(F.coalesce(F.sum(F.when(~held, r)), zero).alias("s"), F.count_if(~held).alias("n"), F.coalesce(F.sum(F.when(held, r)), zero).alias("hs"), F.count_if(held).alias("hn"))
    return {(x.t, x.leaf, x.e, x.other): Sums(x.s, x.n, x.hs, x.hn) for x in sums.collect()}  # a cell for two leaves of two trees at most


def _next_leaves(sums: dict[tuple[int, int, int, int], Sums], t: int, before: list[list[float]], step: float, l1: float, l2: float) -> tuple[list[float], float]:
    """The leaf values of tree t of a pass, given those of the trees before it in the pass, and what they
    change in the sum of the held rows' squared residuals."""
    left, held, number = {}, {}, {}
    for (tree, leaf, e, other), x in sums.items():
        if tree == t:
            add = (x.s, x.hs) if e < 0 else (-step * before[e][other] * x.n, -step * before[e][other] * x.hn)
            left[leaf], held[leaf] = left.get(leaf, 0.0) + add[0], held.get(leaf, 0.0) + add[1]
            if e < 0:
                number[leaf] = x
    values = [leaf_value(left.get(k, 0.0), number[k].n if k in number else 0, l1, l2) for k in range(max(number, default=-1) + 1)]
    moved = sum(step * values[k] * (step * values[k] * x.hn - 2 * held[k]) for k, x in number.items())
    return values, moved


def predict(model: BoostedTrees, rows: DataFrame) -> DataFrame:
    """M2: rows with pred_model."""
    return model.transform(rows)


def importances(model: BoostedTrees, top: int = 10) -> DataFrame:
    """M3, TK2: the most important features, the first five marked."""
    rows = SparkSession.active().createDataFrame(list(model.importances().items()), "feature string, importance double")
    return top_features(rows, top)


def top_features(rows: DataFrame, top: int = 10, marked: int = 5) -> DataFrame:
    """TK2: (feature, importance, rank, is_top5)."""
    best = rows.orderBy(F.desc("importance"), "feature").limit(top)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # `top` rows
    return ranked.withColumn("is_top5", F.col("rank") <= marked)


BENCHMARK = {"pred_model": "trees", "load_forecast": "existing forecast", "load_J1_same_hour": "same hour, day before", "load_J7_mean": "mean of the day a week before"}


def benchmark_rows(matrix: DataFrame, top_ratio: float = 1.0) -> DataFrame:
    """E8 before the model: rows with a load, clear_sky_ratio clipped from above (PR12, PR15)."""
    return matrix.na.drop(subset=["load"]).withColumn("clear_sky_ratio", at_most("clear_sky_ratio", top_ratio))


def naive_measures(matrix: DataFrame) -> DataFrame:
    """M4 of the models that need no fit, on the test rows."""
    test = benchmark_rows(matrix).where("split = 'test'")
    return metrics.fit_measures(metrics.melt_predictions(test, "load", {c: n for c, n in BENCHMARK.items() if c != "pred_model"}))


def benchmark(predicted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E8 of rows with pred_model: measures of the four models, gain over the existing forecast by
    month, and the histogram of the trees' errors, on the test rows."""
    test = predicted.where("split = 'test'")
    errors = test.select((F.col("load") - F.col("pred_model")).alias("e"))
    return metrics.fit_measures(metrics.melt_predictions(test, "load", BENCHMARK)), metrics.monthly_gain(test, "load", "pred_model", "load_forecast"), metrics.error_histogram(errors, "e")
