"""Clustering held against Spark ML and counted in jobs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from sluicework.operators import clustering as C
from sluicework.operators import learning as L


def blobs(spark, copies=1):
    rng = np.random.default_rng(4)
    rows = [tuple(float(x) for x in rng.normal([6 * (i % 4), 3 * (i % 3)], 1.0)) for i in range(400)]
    return spark.createDataFrame(rows, "a double, b double").select("a", "b", F.explode(F.array_repeat(F.lit(1), copies)).alias("one")).drop("one")


def test_sweep_is_no_worse_than_spark_ml_and_scores_alike(spark):
    df = blobs(spark).repartition(3)
    model, rows = L.kmeans_sweep(df, ["a", "b"], [3, 4, 6], starts=6)
    vectors = L.assemble(df, ["a", "b"]).persist()
    for row in rows.collect():
        theirs = min(KMeans(k=row["k"], seed=s, maxIter=300).fit(vectors).summary.trainingCost for s in range(4))
        assert row["inertia"] <= 1.02 * theirs
    best = max(rows.collect(), key=lambda r: r["silhouette"])
    labelled = L.assign_clusters(df, model, ["a", "b"])
    scored = ClusteringEvaluator(predictionCol="cluster_id").evaluate(L.assemble(labelled, ["a", "b"]))
    vectors.unpersist()
    assert len(model.clusterCenters()) == best["k"] and scored == pytest.approx(best["silhouette"], abs=1e-4)


def test_copies_weigh_and_blocks_add_up(spark, monkeypatch):
    want = C.sweep(blobs(spark), ["a", "b"], [4], 3, 7)
    monkeypatch.setattr(C, "CELLS", 300)
    got = C.sweep(blobs(spark, 5), ["a", "b"], [4], 3, 7)
    assert got[0][3] == pytest.approx(5 * want[0][3], rel=1e-3) and got[0][2] == pytest.approx(want[0][2], abs=5e-3)


def test_the_fits_share_their_jobs(spark):
    context, df = spark.sparkContext, blobs(spark)
    context.setJobGroup("sweep", "sweep")
    L.kmeans_sweep(df, ["a", "b"], range(3, 9), starts=10)
    jobs = context.statusTracker().getJobIdsForGroup("sweep")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 120  # 60 fits


def test_few_points_and_none(spark):
    two = spark.createDataFrame([(0.0,), (0.0,), (3.0,)], "a double")
    model, rows = L.kmeans_sweep(two, ["a"], [3], starts=2)
    assert sorted(c[0] for c in model.clusterCenters()) == [0, 3] and rows.first()["inertia"] == 0
    assert L.kmeans_sweep(two.where("a = 0"), ["a"], [2], starts=1)[1].first()["silhouette"] == -1
    with pytest.raises(ValueError, match="no rows"):
        L.kmeans_sweep(two.where("a > 9"), ["a"], [2], starts=1)
