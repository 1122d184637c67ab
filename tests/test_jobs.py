"""Jobs as a whole: trees, chunks, export."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.jobs import clean, model, queries, stand_ins
from wattloom.operators import scale, windows
from wattloom.sources import files


def hours(spark, n, value, key="a"):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(key, start + timedelta(hours=i), value(i)) for i in range(n)], "k string, ts timestamp_ntz, x double")


def test_trees_learn_steps_and_keep_the_best_round(spark):
    rng = np.random.default_rng(3)
    rows = hours(spark, 800, lambda i: float(rng.random())).withColumn("load", F.when(F.col("x") > 0.6, 5.0).otherwise(1.0)).withColumn("z", F.lit(1.0))
    fitted = model.fit(rows, ["x", "z"], rounds=24, patience=6)
    got = model.predict(fitted, rows).select(F.avg(F.abs(F.col("load") - F.col("pred_model")))).first()[0]
    assert got < 1.0 and fitted.trees.getNumTrees == len(fitted.leaves) <= 24
    top = model.importances(fitted).collect()
    assert top[0].feature == "x" and top[0].importance == pytest.approx(1) and [r.rank for r in top] == [1, 2]
    noise = rows.withColumn("load", F.rand(7))
    stopped = model.fit(noise, ["x", "z"], rounds=16, patience=3, at_once=1)
    assert len(stopped.leaves) < 13  # stopped before the last round
    assert len(stopped.losses) == len(stopped.leaves) + 4 and min(stopped.losses) == stopped.losses[len(stopped.leaves)]


def steps(spark, n=600):
    rng = np.random.default_rng(8)
    rows = hours(spark, n, lambda i: float(rng.random())).withColumn("z", F.sin(F.col("x") * 40))
    return rows.withColumn("load", F.when(F.col("x") > 0.6, 5.0).otherwise(1.0) + F.col("z") + F.sin(F.hour("ts") * 9.0))


def test_leaves_are_the_closed_formula(spark):
    rows, l1, l2 = steps(spark), 3.0, 2.0
    one = model.fit(rows, ["x", "z"], rounds=1, depth=3, step=1.0, sample=1.0, l1=l1, l2=l2, validation_share=0.0)
    placed = model._with_leaves(one.prepare.transform(rows.withColumns({"_x_x": F.col("x"), "_x_z": F.col("z")})), one.trees._java_obj, "leaf")
    groups = {}
    for r in placed.select(F.element_at(model.vector_to_array("leaf"), 1).cast("int").alias("leaf"), "load").collect():
        groups.setdefault(r.leaf, []).append(r.load - one.base)
    assert len(groups) > 4
    for k, residuals in groups.items():
        total = sum(residuals)
        assert one.leaves[0][k] == pytest.approx(np.sign(total) * max(abs(total) - l1, 0) / (len(residuals) + l2), abs=1e-9)
    assert model.leaf_value(2.0, 5, 3.0, 0.0) == 0.0 and model.leaf_value(-4.0, 1, 1.0, 1.0) == -1.5


def test_without_the_terms_a_leaf_is_the_tree_s_own(spark):
    rows = steps(spark)
    plain = model.fit(rows, ["x", "z"], rounds=1, depth=4, step=1.0, sample=1.0, l1=0.0, l2=0.0, validation_share=0.0)
    tree = plain.trees.trees[0]
    doubles = rows.withColumns({"_x_x": F.col("x"), "_x_z": F.col("z")})
    own = tree.setFeaturesCol("_features").setPredictionCol("own").setLeafCol("").transform(plain.prepare.transform(doubles))
    worst = plain.transform(own.select(*rows.columns, "own")).select(F.max(F.abs(F.col("pred_model") - F.col("own") - plain.base))).first()[0]
    assert worst < 1e-9


def test_predictions_are_the_sum_of_the_stages(spark, tmp_path):
    rows = steps(spark)
    fitted = model.fit(rows, ["x", "z"], rounds=7, depth=3, patience=2, at_once=1)
    ready = fitted.prepare.transform(rows.withColumns({"_x_x": F.col("x"), "_x_z": F.col("z")}))
    want = F.lit(fitted.base)
    for i, tree in enumerate(fitted.trees.trees):
        ready = model._with_leaves(ready, tree._java_obj, f"l{i}")
        want = want + fitted.step * F.get(F.array(*map(F.lit, fitted.leaves[i])), F.col(f"l{i}").cast("int"))
    both = fitted.transform(ready.withColumn("want", want).select(*rows.columns, "want"))
    assert both.select(F.max(F.abs(F.col("want") - F.col("pred_model")))).first()[0] < 1e-9
    assert len(fitted.leaves) > 2 and all(a > b for a, b in zip(fitted.losses, fitted.losses[1 : len(fitted.leaves) + 1]))
    ends = rows.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    held = F.unix_micros(F.col("ts").cast("timestamp")) > ends[0] + (ends[1] - ends[0]) * 0.9
    error = both.where(held).select(F.avg(F.pow(F.col("load") - F.col("pred_model"), 2))).first()[0]
    assert error == pytest.approx(fitted.losses[len(fitted.leaves)], rel=1e-9)
    several = model.fit(rows, ["x", "z"], rounds=12, depth=3, at_once=4, patience=12)
    assert len(several.losses) == 13 and several.losses[-1] < 0.7 * several.losses[0]
    error = several.transform(rows).where(held).select(F.avg(F.pow(F.col("load") - F.col("pred_model"), 2))).first()[0]
    assert error == pytest.approx(several.losses[len(several.leaves)], rel=1e-9)  # leaf values and losses know the trees of their own pass
    fitted.save(str(tmp_path / "model"))
    again = model.BoostedTrees.load(spark, str(tmp_path / "model"))
    assert again.transform(both.withColumnRenamed("pred_model", "was")).select(F.max(F.abs(F.col("was") - F.col("pred_model")))).first()[0] == 0.0


def test_no_rows_to_learn_from(spark):
    with pytest.raises(ValueError):
        model.fit(hours(spark, 1, float).withColumn("load", F.lit(1.0)).where("false"), ["x"])


def test_chunks_of_a_series_give_the_same_zscores(spark):
    rng = np.random.default_rng(4)
    rows = hours(spark, 3000, lambda i: float(rng.normal() + 40 * (i % 500 == 7))).withColumn("ingest_seq", F.lit(1)).withColumnRenamed("x", "load")
    whole, cut = (clean.clean_load(rows, ["k"], chunk_rows=c).orderBy("ts").select("load").collect() for c in (None, 700))
    assert len(whole) == 3000
    np.testing.assert_allclose(np.array(whole, float), np.array(cut, float))


def test_time_of_interpolation_is_linear_in_the_series(spark):
    import time

    took = []
    for n in (20_000, 40_000, 40_000, 20_000):
        rows = spark.range(n).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 900).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 7 < 4, F.col("id").cast("double")).alias("x"))
        began = time.time()
        windows.interpolate(rows, ["k"], ["x"]).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert min(took[1:3]) < 3 * max(took[0], took[3]) + 1


def test_chunk_bounds():
    assert files.chunk_bounds("2023-11-15", "2024-02-10") == [("2023-11-15", "2023-12-01"), ("2023-12-01", "2024-01-01"), ("2024-01-01", "2024-02-01"), ("2024-02-01", "2024-02-10")]
    assert files.chunk_bounds("2024-01-01", "2024-01-05", 3) == [("2024-01-01", "2024-01-04"), ("2024-01-04", "2024-01-05")]


def test_export_reports_gaps_and_coverage(spark, tmp_path):
    rows = hours(spark, 48, lambda i: None if i % 4 == 0 else float(i)).where("hour(ts) not in (3, 4)")
    back, gaps, cover, extent = clean.export(rows, str(tmp_path / "out"), ["k"])
    assert back.count() == 44
    assert [tuple(r) for r in extent.collect()] == [(44, datetime(2024, 1, 1), datetime(2024, 1, 2, 23))]
    assert [r.gap_s for r in gaps.collect()] == [3 * 3600] * 2
    (one,) = cover.collect()
    assert (one.column, one.n_null) == ("x", rows.where("x is null").count())


def feed(spark, n=600):
    rows = hours(spark, n, lambda i: 50.0 + i % 24 - 500 * (i % 97 == 3)).withColumn("ingest_seq", F.lit(1))
    rows = rows.unionByName(rows.where("hour(ts) = 4").withColumn("ingest_seq", F.lit(2)))
    return rows.select("k", "ts", "ingest_seq", F.when(F.hour("ts") != 9, F.col("x")).alias("load"), (F.col("x") - 60).alias("pv_sion"))


def jobs_of(spark, run) -> int:
    name = f"group-{np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(name, name)
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("after", "after")
    return n


def test_counts_come_from_the_run_itself(spark, tmp_path):
    rows, counts = feed(spark), clean.Counts()
    write = lambda name, c: files.write_table(clean.clean_load(rows, ["k"], bounds={"pv_sion": (0, 5)}, counts=c), str(tmp_path / name))
    without = jobs_of(spark, lambda: write("a", None))
    assert jobs_of(spark, lambda: write("b", counts)) == without  # no second job
    found = {(rule, c): n for rule, c, n in counts.found()}
    once = rows.where("ingest_seq = 1")
    assert found["duplicate", "ts"] == rows.count() - once.count() == 25
    assert found["negative", "pv_sion"] == once.where("pv_sion < 0").count() > 0
    assert found["filled", "load"] == once.where("load is null").count() + found["zscore", "load"]
    assert found["zscore", "load"] > 0 and found["bounds", "pv_sion"] > 0
    a, b = (sorted(map(str, spark.read.parquet(str(tmp_path / n)).collect())) for n in "ab")
    assert a == b


def test_run_writes_counts_and_covers_in_one_go(spark, tmp_path):
    load = feed(spark)
    predicted = load.select("k", "ts", "ingest_seq", *(F.when(F.hour("ts") != k, F.col("load")).alias(f"T_2M_ctrl_lt{k}") for k in (1, 2)))
    load.write.parquet(str(tmp_path / "load"))
    predicted.write.parquet(str(tmp_path / "forecast"))
    for chunk in (None, 200):
        out, a, b = clean.run(spark, str(tmp_path / "load"), str(tmp_path / "forecast"), str(tmp_path / f"out{chunk}"), ["k"], chunk)
        assert {n for rule, _, n in a.found() + b.found() if rule == "duplicate"} == {25}
        n = out.rows.count()
        assert out.extent.first().n == n == 600
        for r in out.coverage.collect():
            assert r.n_null == out.rows.where(F.col(r.column).isNull()).count()
            assert r.coverage_pct == pytest.approx(100 * (1 - r.n_null / n))
        rows = sorted(map(str, out.rows.select("k", "ts", "load", "pv_sion", "T_2M_best").collect()))
        assert chunk is None or rows == before
        before = rows


def test_reports_of_empty_feeds(spark):
    empty = hours(spark, 1, float).where("false").select("k", "ts", F.lit(1).alias("ingest_seq"), F.col("x").alias("load"), F.col("x").alias("pv_sion"))
    counts = clean.Counts()
    assert clean.clean_load(empty, ["k"], counts=counts).count() == 0
    assert {r.n for r in counts.report().collect()} == {0}
    assert scale.rolling_stats(empty, ["k"], "load", 2, 2).count() == 0


def test_run_summary_has_tasks_of_bounded_size_and_one_exchange(spark, tiny, monkeypatch):
    want = sorted(map(tuple, queries.QUERIES["a6_run_summary"](spark, tiny).collect()))
    monkeypatch.setattr(stand_ins, "ROWS_A_TASK", 500)
    got = queries.QUERIES["a6_run_summary"](spark, tiny)
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet").count()
    assert got.rdd.getNumPartitions() == -(-lines // 500) > 4
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert sorted(map(tuple, got.collect())) == want
