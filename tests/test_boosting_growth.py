"""What the boosted fits keep, store and read as tables grow."""

from __future__ import annotations

import glob
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicework.operators import boosting as B
from sluicework.operators import learning as L
from sluicework.operators.quality import QualityRules, dq_report
from tests.test_boosting import data_of, table_of


def state_of(spark, copies):
    x, y, fold = (np.concatenate([v] * copies) for v in data_of(60))
    cuts = B.quantile_cuts(table_of(spark, *data_of(60)), list("abcd"), 16)
    row = B._blocks(table_of(spark, x, y, fold), list("abcd"), "y", "fold", cuts, 1).first()
    return B.State.begin(B.Block.of(row, 4), np.zeros(4), B.Settings(bins=16))


def test_a_state_does_not_grow_with_equal_rows(spark):
    one, many = state_of(spark, 1), state_of(spark, 200)
    assert len(pickle.dumps(many)) < 2 * len(pickle.dumps(one))
    assert many.block.rows.sum() == 200 * one.block.rows.sum() and many.count.sum() == many.drawn.sum()
    assert many.drawn.sum() == pytest.approx(0.8 * 12000, rel=0.02) and many.total.sum() == pytest.approx(many.summed.sum())


def test_marks_and_steps_place_rows_alike():
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 64, (4, 3000)).astype(np.uint8)
    for depth in (1, 3, 6):
        tree = B.Tree.empty(depth)
        for k in range((1 << depth) - 1):
            if (k == 0 or tree.feature[(k - 1) // 2] >= 0) and rng.random() < 0.85:
                tree.feature[k], tree.cut[k] = rng.integers(0, 4), rng.integers(0, 64)
        assert all((tree._marked(bins, n) == tree._followed(bins, n)).all() for n in [*range(depth + 1), 64])


def stored(spark):
    return {f.rsplit("/", 1)[0] for f in glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/**/*", recursive=True)}


def test_fits_store_and_read_no_other_columns(spark):
    x, y, fold = data_of(300)
    df = table_of(spark, x, y, fold).withColumn("id", F.monotonically_increasing_id()).withColumn("words", F.lit("some words")).localCheckpoint()
    before = stored(spark)
    rows, _ = L.boost_out_of_fold(df, ["id"], list("abcd"), "y", trees=2, depth=2)
    for folder in stored(spark) - before:
        if glob.glob(f"{folder}/*.parquet"):
            assert "words" not in spark.read.parquet(folder).columns
    plan = rows.select("id", "prediction")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    assert rows.count() == 300 and "words" in rows.columns


def test_fits_write_no_checkpoints(spark, monkeypatch):
    from pyspark import RDD

    monkeypatch.setattr(RDD, "checkpoint", lambda rdd: pytest.fail("wrote a state"))
    monkeypatch.setattr(B, "STORE", 1)
    x, y, fold = data_of(200)
    B.fit_folds(table_of(spark, x, y, fold), list("abcd"), "y", "fold", 3, B.Settings(trees=3, depth=2))


def test_a_gate_measures_wide_tables_in_parts(spark):
    df = spark.range(20).select(*[(F.col("id") % (k + 1)).alias(f"c{k}") for k in range(7)], F.lit(None).cast("string").alias("none"))
    rules = QualityRules(50, ranges={"c3": (0, 2)}, key=("c6",))
    want, got = (sorted(map(str, dq_report(df, rules, n).collect())) for n in (0, 3))
    assert want == got and len(want) == 1 + 16 + 1 + 7 + 1


def test_stops_are_not_shuffled_for_a_few_constructors(spark, tables):
    from sluicework.catalog.views import pitstop_view

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        plan = pitstop_view(tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "constructorId" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning(constructorId" in line]
