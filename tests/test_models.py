"""Model operators: closed forms and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.operators import isolation as I
from sluicework.operators import learning as L
from sluicework.plans import analyses as P
from sluicework.plans import bindings as B
from sluicework.plans import feature_views as FV
from sluicework.plans import publish as W


@pytest.fixture(scope="module")
def players(spark):
    rng = np.random.default_rng(42)
    names = ["goals", "assists", "tackles", "flat"]
    rows = [(str(i), "FW", "EPL", float(rng.integers(0, 30)), float(rng.integers(0, 20)), None if i == 3 else float(rng.integers(0, 100)), 7.0) for i in range(10)]
    return spark.createDataFrame(rows, "player_id string, position string, league string, " + ", ".join(f"{n} double" for n in names)), names


def test_scaling(players):
    df, names = players
    scaled = L.scale(df, names).toPandas()
    assert scaled.shape == (10, 7) and list(scaled.player_id) == [str(i) for i in range(10)]
    for c in names[:3]:
        assert abs(scaled[c].mean()) < 1e-9 and abs(scaled[c].std(ddof=0) - 1) < 1e-9
    assert (scaled.flat == 0).all()


def test_sweep_finds_the_blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *[float(x) for x in rng.normal([8 * (i % 3)] * 4, 0.5)]) for i in range(120)]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    model, sweep = L.kmeans_sweep(df, cols, range(2, 5), starts=3)
    best = max(sweep.collect(), key=lambda r: r["silhouette"])
    assert best["k"] == 3 and best["silhouette"] > 0.9 and len(model.clusterCenters()) == 3
    assigned = L.assign_clusters(df, model, cols).toPandas()
    assert assigned.groupby(assigned.id % 3).cluster_id.nunique().eq(1).all()
    centres = np.array(model.clusterCenters())[assigned.cluster_id]
    distance = np.linalg.norm(assigned[cols].to_numpy() - centres, axis=1)
    assert np.allclose(assigned.impact_score, 1 / (1 + distance), atol=6e-5)


def test_out_of_fold_covers_every_row_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, noise double").withColumn("y", F.col("x") * 3)
    out, imp = L.boost_out_of_fold(df, ["id"], ["x", "noise"], "y", trees=8, depth=3)
    p = out.toPandas()
    assert sorted(p.id) == list(range(200)) and set(p.fold) == set(range(5))
    assert np.allclose(p.residual, p.prediction - p.y, atol=2e-4)
    ranked = imp.orderBy("rank").collect()
    assert ranked[0]["feature_name"] == "x" and sum(r["importance"] for r in ranked) == pytest.approx(1, abs=1e-3)
    metrics = L.fold_metrics(out, "y").first()
    assert metrics["total"] == 200 and metrics["r2"] > 0.5


def test_block_folds_follow_the_key(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    folds = [r["fold"] for r in L.fold_numbers(df, ["k"], 5, blocks=True).orderBy("k").collect()]
    assert folds == sorted(folds) and set(folds) == set(range(5)) and max(np.bincount(folds)) - min(np.bincount(folds)) <= 1


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double")
    table, found = L.ridge_sweep(df, ["id"], ["a", "b", "c"], "y")
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + found["ridge_alpha"] * np.eye(3), z.T @ (y - y.mean()))
    got = {r["feature_name"]: r["ridge_coefficient"] for r in table.collect()}
    assert np.allclose([got[c] for c in "abc"], want, atol=1e-3) and found["ridge_r2"] > 0.9


def test_isolation_forest_flags_the_far_points(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(190, 2)), rng.normal(size=(10, 2)) + 9])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id int, a double, b double")
    runs = [I.find_anomalies(df, ["id"], ["a", "b"], 0.05, trees=40).orderBy("id").collect() for _ in range(2)]
    assert runs[0] == runs[1]
    flagged = {r["id"] for r in runs[0] if r["is_anomaly"]}
    assert len(flagged) == 10 and len(flagged & set(range(190, 200))) >= 9
    assert all(0 < r["anomaly_score"] < 1 for r in runs[0])


def test_style_columns_drop_record_words():
    assert L.style_columns(["wins", "penalties", "rush_td", "MOV", "pass_td"]) == ["rush_td", "pass_td"]


def test_team_dominance_job(tables):
    out = P.team_dominance(FV.team_features(B.team_stats(tables)), trees=3, rules=None)
    drivers = out["team_dominance_drivers"].toPandas()
    assert sorted(drivers["rank"]) == list(range(1, len(drivers) + 1))
    assert out["best_team_pillars"].count() == 4
    assert 0.5 < out["metrics"].first()["metric_value"] <= 1


def test_analyses_publish_their_declared_tables(spark, tables, tmp_path):
    root, views = str(tmp_path), {"team": FV.team_features(B.team_stats(tables))}
    made = {
        "team_dominance": P.team_dominance(views["team"], trees=2, rules=None),
        "team_wins": P.team_wins(views["team"], P.Boost(2, 2, 0.1, 0.8, 1), rules=None),
        "team_profile": P.team_profile(views["team"], rules=None),
    }
    written = [name for job, out in made.items() for name in W.publish(out, root, "r1", job)]
    assert len(written) == 6
    for name in written:
        got = spark.read.parquet(f"{root}/{name}")
        assert got.schema.simpleString() == T.StructType.fromDDL(W.SCHEMAS[name]).simpleString() and got.count() > 0
    W.publish(made["team_profile"], root, "r1", "team_profile")
    log = spark.read.parquet(f"{root}/pipeline_runs")
    assert {r.pipeline_name for r in log.collect()} == set(made) and log.where("pipeline_name = 'team_profile'").count() == 2
    with pytest.raises(ValueError, match="declared"):
        W.publish({"team_optimal_profile": views["team"]}, root, "r2", "team_profile")
    assert len(W.SCHEMAS) == 26


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["ml_gbt_oof", "ml_gbt_two_views", "ml_importance_table", "ml_gbt_classifier", "job_player_ratings", "job_team_wins", "job_team_dominance", "job_driver_positions", "job_pitstop_impact", "job_match_margins"])
def test_registered_fits_ask_for_all_trees(spark, monkeypatch, name):
    from sluicework.catalog import QUERIES

    def folds(df, key, columns, label, trees=200, **more):
        raise Asked(trees)

    def elite(df, columns, label, trees=200, *more):
        raise Asked(trees)

    monkeypatch.setattr(L, "boost_out_of_fold", folds)
    monkeypatch.setattr(L, "boost_classifier", elite)
    with pytest.raises(Asked) as asked:
        QUERIES[name](spark, "/root/testdata/sf0.01")
    assert asked.value.args == (200,)
