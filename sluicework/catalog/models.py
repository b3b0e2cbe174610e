"""Model operators and the fourteen packaged analyses.

Fitted values depend on the optimiser, so fits have no SQL counterpart; scaling,
explanations and metrics do. Everything runs with the defaults of the analyses, boosting fits
with all their trees, on all rows of the tables.
"""

import dataclasses

from pyspark.sql import functions as F

from sluicework.catalog import relations as R
from sluicework.catalog import summaries as M
from sluicework.catalog import views as V
from sluicework.catalog.registry import query
from sluicework.catalog.sql import even, ridge, up, using
from sluicework.functions import scalar as S
from sluicework.operators import isolation as I
from sluicework.operators import learning as L
from sluicework.operators import quality as Q
from sluicework.plans import analyses as P
from sluicework.plans import bindings as B
from sluicework.plans import publish as W
from sluicework.session import cut_lineage, scratch_path


def places(rows):
    """The columns that hold the vector."""
    return [c for c in rows.columns if c not in ("vec_id", "label")]


_SCALED = ["n_orders", "spent", "c_nationkey"]


def _z_sql(columns, where="clustered", key="c_custkey"):
    cells = [f"{up(f'CASE WHEN stddev_pop({c}) OVER () > 0 THEN (CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END', 6)} AS {c}" for c in columns]
    return f"SELECT {key}, {', '.join(cells)} FROM {where}"


@query("ml_scale", sql=f"WITH {M.CLUSTERED} {_z_sql(_SCALED)}")
def ml_scale(t):
    scaled = L.scale(M.clustered_customers(t).select("c_custkey", *_SCALED), _SCALED)
    return scaled.select("c_custkey", *[F.round(c, 6).alias(c) for c in _SCALED])


_STYLE = ["points", "pass_td", "rush_td", "mov", "wins", "ties", "exp_pts_tot", "penalties", "points_diff"]


@query("ml_style_columns", sql=using("team_features", body=_z_sql(["points", "pass_td", "rush_td"], "team_features", "year, team")))
def ml_style_columns(t):
    """Scaled team features without the record columns (``penalties`` holds ``ties``)."""
    kept = L.style_columns(_STYLE)
    scaled = L.scale(V.team_view(t).select("year", "team", *kept), kept)
    return scaled.select("year", "team", *[F.round(c, 6).alias(c) for c in kept])


@query("ml_kmeans_sweep")
def ml_kmeans_sweep(t):
    rows = B.embedding_rows(t)
    _, sweep = L.kmeans_sweep(rows, places(rows), range(3, 7))
    return sweep


@query("ml_kmeans_clusters")
def ml_kmeans_clusters(t):
    """Supplier-season clusters with distance to the own centre."""
    columns = ["points", "pass_td", "penalties", "rush_share"]
    scaled = L.scale(cut_lineage(V.team_view(t)).select("year", "team", *columns), columns)
    model, _ = L.kmeans_sweep(scaled, columns, [3, 4])
    return L.assign_clusters(scaled, model, columns).select("year", "team", "cluster_id", "impact_score")


@query("ml_isolation_forest")
def ml_isolation_forest(t):
    rows = B.embedding_rows(t)
    return I.find_anomalies(rows, ["vec_id"], places(rows), 0.05).select("vec_id", "anomaly_score", "is_anomaly")


@query("ml_isolation_forest_lines")
def ml_isolation_forest_lines(t):
    """Every line item scored on its four amounts."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return I.find_anomalies(t.lineitem.select(*key, *columns), key, columns, 0.05).select(*key, "anomaly_score", "is_anomaly")


_CELLS = "SELECT c_custkey, 'n_orders' AS feature, abs(n_orders - avg(n_orders) OVER ()) AS d, c_nationkey FROM clustered UNION ALL SELECT c_custkey, 'spent', abs(spent - avg(spent) OVER ()), c_nationkey FROM clustered UNION ALL SELECT c_custkey, 'score', abs(score - avg(score) OVER ()), c_nationkey FROM clustered"


@query("ml_anomaly_explain", sql=f"""WITH {M.CLUSTERED}, cells AS ({_CELLS}) SELECT c_custkey, place, feature, {even('d', 3)} AS deviation FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY d DESC, feature) AS INTEGER) AS place FROM cells WHERE c_nationkey = 7) WHERE place <= 2""")
def ml_anomaly_explain(t):
    """Customers of one nation as flagged rows, explained against the whole table."""
    rows = M.clustered_customers(t).withColumn("is_anomaly", S.flag(F.col("c_nationkey") == 7))
    return I.explain_anomalies(rows, ["c_custkey"], ["n_orders", "spent", "score"], 2)


@query("ml_gbt_oof")
def ml_gbt_oof(t):
    """Line prices predicted out of fold from quantity, discount and tax."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out, _ = L.boost_out_of_fold(rows, key, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", **P.Boost().options())
    return out.select(*key, "l_extendedprice", "fold", "prediction", "residual")


@query("ml_gbt_two_views")
def ml_gbt_two_views(t):
    return P.team_wins(V.team_view(t), rules=_TEAM)["team_win_predictions"]


@query("ml_importance_table")
def ml_importance_table(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("y"), "o_totalprice")
    return L.boost_out_of_fold(rows, ["o_orderkey"], ["o_custkey", "m", "y"], "o_totalprice", **P.Boost().options())[1]


_FOLDED = "folded AS (SELECT *, CAST(o_orderkey % 5 AS INTEGER) AS fold FROM predictions)"


@query("ml_cv_metrics", sql=f"""WITH {M.PREDICTIONS}, {_FOLDED}, f AS (SELECT fold, 1 - sum((actual_price - predicted_price) ** 2) / (var_pop(actual_price) * count(*)) AS r2, avg(abs(actual_price - predicted_price)) AS mae FROM folded GROUP BY fold)
  SELECT (SELECT count(*) FROM folded) AS total, {even('avg(r2)', 4)} AS r2, {even('avg(mae)', 4)} AS mae, {even('stddev_pop(r2)', 4)} AS cv_r2_std, {even('(SELECT sqrt(avg(residual * residual)) FROM folded)', 4)} AS rmse,
  {even('(SELECT avg(residual) FROM folded)', 4)} AS residual_mean, {even('(SELECT stddev_pop(residual) FROM folded)', 4)} AS residual_std, {even('(SELECT min(residual) FROM folded)', 4)} AS residual_min, {even('(SELECT max(residual) FROM folded)', 4)} AS residual_max FROM f""")
def ml_cv_metrics(t):
    rows = M.predictions(t).withColumn("fold", (F.col("o_orderkey") % 5).cast("int"))
    return L.fold_metrics(rows, "actual_price", "predicted_price")


@query("ml_report", sql=f"WITH {M.PREDICTIONS}, q AS ({M.QUALITY}) " + " UNION ALL ".join(f"SELECT '{c}' AS metric_name, CAST({c} AS DOUBLE) AS metric_value FROM q" for c in ("total", "r2_approx", "mae", "rmse", "mean_residual")))
def ml_report(t):
    return L.metrics_long(M.A.regression_quality(M.predictions(t), "predicted_price", "actual_price"))


@query("ml_gbt_classifier")
def ml_gbt_classifier(t):
    rows = t.lineitem.select("l_quantity", "l_discount", "l_tax", S.flag(F.col("l_extendedprice") > 60000).alias("is_elite"))
    return L.boost_classifier(rows, ["l_quantity", "l_discount", "l_tax"], "is_elite")[0]


@query("ml_ridge_cv", sql=ridge("lineitem", "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", [0.01, 0.1, 1.0, 10.0, 100.0]))
def ml_ridge_cv(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    table, _ = L.ridge_sweep(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return table


# The packaged analyses, one main table each


def gate(profile, **changes):
    """The quality gate of an analysis, with the limits that the order tables cannot keep replaced."""
    return dataclasses.replace(Q.PROFILES[profile], **changes)


# Suppliers win more often than a team can in a season, and all reach the playoffs.
_TEAM = gate("nfl_team", ranges={}, skip_variance=(*Q.PROFILES["nfl_team"].skip_variance, "is_playoff"))

def _job(name, run, sql=None):
    query(f"job_{name}", sql)(run)


_job("player_clusters", lambda t: P.player_clusters(V.player_view(t), rules=gate("player", max_null_rate=0.6))["player_clusters"])
_job("player_anomalies", lambda t: P.player_anomalies(V.player_view(t), rules=gate("player", max_null_rate=0.6))["player_anomalies"])
_job("player_ratings", lambda t: P.player_ratings(V.player_view(t), rules=gate("player", max_null_rate=0.6))["player_rating_predictions"])
_job("team_archetypes", lambda t: P.team_archetypes(V.team_view(t), rules=_TEAM)["team_archetypes"])
_job("team_wins", lambda t: P.team_wins(V.team_view(t), rules=_TEAM)["team_feature_importances"])
_job("team_profile", lambda t: P.team_profile(V.team_view(t), rules=_TEAM)["team_optimal_profile"])
_job("positional_values", lambda t: P.positional_values(cut_lineage(R.importances(t).withColumn("model_type", F.lit("controllable"))))["positional_value_weights"], R.with_positions("SELECT * FROM weights"))
_job("team_dominance", lambda t: P.team_dominance(V.team_view(t), rules=_TEAM)["team_dominance_drivers"])
_job("driver_positions", lambda t: P.driver_positions(V.driver_view(t), rules=gate("f1_driver", max_null_rate=0.6))["f1_driver_predictions"])
_job("constructor_rankings", lambda t: P.constructor_rankings(V.constructor_view(t))["f1_constructor_rankings"])
_job("pitstop_impact", lambda t: P.pitstop_impact(V.pitstop_view(t))["f1_pitstop_analysis"])
_job("match_margins", lambda t: P.match_margins(V.match_view(t), ("matchId",))["nrl_match_predictions"])
_job("league_rankings", lambda t: P.league_rankings(V.season_view(t), rules=gate("nrl_team", ranges={}))["nrl_team_rankings"])
_job("coaching_insights", lambda t: P.coaching_insights(V.coaching_view(t), R.matches(t), rules=gate("nrl_coaching", ranges={}))["nrl_team_profiles"])


@query("sink_analysis", sql=R.with_positions("SELECT * FROM weights"))
def sink_analysis(t):
    """An analysis published twice under one run: its declared table is there once."""
    root, importances = scratch_path(t.spark, "results"), cut_lineage(R.importances(t).withColumn("model_type", F.lit("controllable")))
    for _ in range(2):
        W.publish(P.positional_values(importances), root, "run-1", "team_player_bridge")
    return t.spark.read.parquet(f"{root}/positional_value_weights")
