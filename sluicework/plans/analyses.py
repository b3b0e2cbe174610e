"""The fourteen packaged analyses as plain functions: feature table in, result tables out.

Each returns ``{table name: DataFrame}``. ``metrics`` tables are (metric_name,
metric_value) rows for the metrics log. Quality gates run first unless ``rules`` is None.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.functions import constants as K
from sluicework.functions.scalar import half_even, steady_mean
from sluicework.operators import aggregates as A
from sluicework.operators import learning as L
from sluicework.operators import scoring as S
from sluicework.operators.isolation import explain_anomalies, find_anomalies
from sluicework.operators.joins import expand_positions
from sluicework.operators.quality import PROFILES, QualityRules, dq_assert, numeric_columns
from sluicework.operators.reshape import stack_frames
from sluicework.operators.skew import rank_rows
from sluicework.session import cut_lineage

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Boost:
    """Settings of a boosted model; the defaults are those of the packaged analyses."""

    trees: int = 200
    depth: int = 5
    rate: float = 0.1
    subsample: float = 0.8
    min_leaf: int = 1

    def options(self) -> dict:
        return dict(trees=self.trees, depth=self.depth, rate=self.rate, subsample=self.subsample, min_leaf=self.min_leaf)


def _gate(df: DataFrame, rules: QualityRules | None) -> DataFrame:
    """Store the feature table once, as every step reads it again, and check it."""
    stored = cut_lineage(df)
    return stored if rules is None else dq_assert(stored, rules, at_once=8)


def _sweep_metrics(sweep: DataFrame) -> DataFrame:
    best = sweep.agg(F.max_by("k", "silhouette").alias("best_k"), F.max("silhouette").alias("best_silhouette"))
    return L.metrics_long(best)


_PLAYER_LABELS = ["player_id", "position", "league"]


def player_clusters(features: DataFrame, ks: Sequence[int] = range(3, 11), starts: int = 10, rules: QualityRules | None = PROFILES["player"]) -> Tables:
    features = _gate(features, rules)
    columns = numeric_columns(features, _PLAYER_LABELS)
    scaled = L.scale(features, columns).select("player_id", *columns)
    model, sweep = L.kmeans_sweep(scaled, columns, ks, starts)
    assigned = L.assign_clusters(scaled, model, columns)
    return {
        "player_clusters": assigned.select("player_id", F.col("cluster_id").cast("long").alias("cluster_id"), "impact_score"),
        "cluster_profile": S.cluster_profile(assigned, "cluster_id", columns),
        "sweep": sweep,
        "metrics": _sweep_metrics(sweep),
    }


def player_anomalies(features: DataFrame, contamination: float = 0.05, trees: int = 200, rules: QualityRules | None = PROFILES["player"]) -> Tables:
    features = _gate(features, rules)
    columns = numeric_columns(features, _PLAYER_LABELS)
    scaled = L.scale(features, columns).select("player_id", *columns)
    scored = find_anomalies(scaled, ["player_id"], columns, contamination, trees)
    return {
        "player_anomalies": scored.select("player_id", "anomaly_score", "is_anomaly"),
        "explanations": explain_anomalies(scored, ["player_id"], columns),
        "metrics": L.metrics_long(A.anomaly_summary(scored)),
    }


def player_ratings(features: DataFrame, boost: Boost = Boost(), rules: QualityRules | None = PROFILES["player"]) -> Tables:
    features = _gate(features, rules)
    columns = numeric_columns(features, [*_PLAYER_LABELS, "rating"])
    rows, importances = L.boost_out_of_fold(
        features, ["player_id"], columns, "rating", blocks=True, **boost.options()
    )
    actual = F.coalesce(F.col("rating"), F.lit(0.0))
    return {
        "player_rating_predictions": rows.select(
            "player_id", F.col("prediction").alias("predicted_rating"), half_even(actual, 4).alias("actual_rating"), "residual"
        ),
        "feature_importances": importances,
        "metrics": L.metrics_long(L.fold_metrics(rows.withColumn("rating", actual), "rating")),
    }


_TEAM_LABELS = ["year", "team", "is_playoff"]


def team_archetypes(features: DataFrame, ks: Sequence[int] = range(3, 9), starts: int = 10, rules: QualityRules | None = PROFILES["nfl_team"]) -> Tables:
    features = _gate(features, rules)
    columns = L.style_columns(numeric_columns(features, _TEAM_LABELS))
    kept = features.select("year", "team", F.col("win_loss_perc").alias("__win"), *columns)
    scaled = L.scale(kept, columns)
    model, sweep = L.kmeans_sweep(scaled, columns, ks, starts)
    assigned = L.assign_clusters(scaled, model, columns)
    labels = S.top_two_labels(assigned, "cluster_id", columns)
    wins = assigned.groupBy("cluster_id").agg(half_even(F.avg(F.coalesce("__win", F.lit(0.0))), 4).alias("avg_win_pct"))
    table = assigned.join(labels, "cluster_id").join(wins, "cluster_id").select(
        "year", "team", F.col("cluster_id").cast("long").alias("archetype_id"), "archetype_label", "avg_win_pct", "impact_score"
    )
    return {
        "team_archetypes": table, "cluster_profile": S.cluster_profile(assigned, "cluster_id", columns),
        "sweep": sweep, "metrics": _sweep_metrics(sweep),
    }


# Columns kept out of the two win models.
_WIN_TARGETS = ["wins", "losses", "ties", "is_playoff", "win_loss_perc"]
_WIN_TAUTOLOGIES = ["points_diff", "mov", "exp_pts_tot", "score_pct", "turnover_pct"]
_WIN_BOOST = Boost(depth=4, rate=0.05, min_leaf=10)


def team_wins(features: DataFrame, boost: Boost = _WIN_BOOST, rules: QualityRules | None = PROFILES["nfl_team"]) -> Tables:
    """Two out-of-fold models of the win share: on all features and on controllable ones."""
    features = _gate(features, rules)
    every = numeric_columns(features, ["year", "team", *_WIN_TARGETS])
    views = {"all_features": every, "controllable": [c for c in every if c not in _WIN_TAUTOLOGIES]}
    predictions, importances, metrics = [], [], []
    for name, columns in views.items():
        rows, table = L.boost_out_of_fold(features, ["year", "team"], columns, "win_loss_perc", **boost.options())
        predictions.append(
            rows.select(
                "year", "team", half_even(F.col("win_loss_perc"), 4).alias("actual_win_pct"),
                F.col("prediction").alias("predicted_win_pct"), "residual", F.lit(name).alias("model_type"),
            )
        )
        importances.append(table.withColumn("model_type", F.lit(name)))
        quality = L.metrics_long(L.fold_metrics(rows, "win_loss_perc"))
        metrics.append(quality.withColumn("metric_name", F.concat(F.lit(f"{name}."), "metric_name")))
    return {
        "team_win_predictions": stack_frames(predictions),
        "team_feature_importances": stack_frames(importances),
        "metrics": stack_frames(metrics),
    }


def team_profile(features: DataFrame, rules: QualityRules | None = PROFILES["nfl_team"]) -> Tables:
    """Quartiles of the best quarter of each season, and ridge weights within it."""
    features = _gate(features, rules)
    target = "win_loss_perc"
    columns = numeric_columns(features, _TEAM_LABELS)
    flagged = S.flag_elite(features, target, season="year")
    profile = S.elite_profile(flagged, columns)
    inputs = [c for c in columns if c != target]
    coefficients, quality = L.ridge_sweep(flagged.where(F.col("is_elite") == 1), ["year", "team"], inputs, target)
    table = profile.join(coefficients, "feature_name", "left").select(
        "feature_name", "elite_p25", "elite_median", "elite_p75", "league_median",
        F.coalesce("ridge_coefficient", F.lit(0.0)).alias("ridge_coefficient"), "gap",
    )
    rows = [(name, float(value)) for name, value in quality.items()]
    return {
        "team_optimal_profile": table,
        "metrics": features.sparkSession.createDataFrame(rows, "metric_name string, metric_value double"),
    }


def positional_values(importances: DataFrame) -> Tables:
    """Controllable feature importances credited to positions."""
    controllable = importances.where(F.col("model_type") == "controllable").select("feature_name", "importance")
    weights = expand_positions(controllable)
    return {
        "positional_value_weights": weights,
        "position_totals": A.position_totals(weights),
        "top_features": A.top_features_per_position(weights),
    }


def team_dominance(features: DataFrame, trees: int = 200, depth: int = 4, rules: QualityRules | None = PROFILES["nfl_team"]) -> Tables:
    """Season scores, all-time ranking, and what sets the best quarter of seasons apart."""
    features = _gate(features, rules)
    columns = numeric_columns(features, ["year", "is_playoff"])
    seasons = S.flag_elite(S.dominance_seasons(features), "dominance_score")
    importances, accuracy = L.boost_classifier(seasons, columns, "is_elite", trees, depth)
    drivers = importances.join(S.elite_advantage(seasons, columns), "feature_name").select(
        "feature_name", "importance", "rank", "elite_mean", "league_mean", "elite_advantage"
    )
    pillars = [f"pillar_{p}" for p in K.PILLARS]
    table = seasons.select(
        "year", "team",
        *[half_even(F.col(c), 4).alias(c) for c in ["dominance_score", *pillars, "win_loss_perc"]],
        F.col("is_elite").cast("long").alias("is_elite"),
    )
    rankings = S.dominance_rankings(seasons)
    best = rankings.where(F.col("rank") == 1).first()["team"]
    return {
        "team_dominance_seasons": table,
        "team_dominance_rankings": rankings,
        "team_dominance_drivers": drivers,
        "best_team_pillars": A.pillar_means(seasons, best, pillars),
        "metrics": features.sparkSession.createDataFrame(
            [("classifier_accuracy", float(accuracy))], "metric_name string, metric_value double"
        ),
    }


def _boosted(features, key, columns, target, boost, predicted, actual, shown):
    rows, importances = L.boost_out_of_fold(features, key, columns, target, **boost.options())
    table = rows.select(*shown, F.col(target).alias(actual), F.col("prediction").alias(predicted), "residual")
    return rows, importances, table


def driver_positions(features: DataFrame, boost: Boost = Boost(), rules: QualityRules | None = PROFILES["f1_driver"]) -> Tables:
    """Finish position of finished entries from grid, qualifying, season and result data."""
    features = _gate(features, rules)
    finished = features.where(F.col("finished") == 1).withColumn("quali_position", F.coalesce("quali_position", "grid"))
    columns = ["grid", "quali_position", "year", "points", "laps", "finished"]
    shown = ["resultId", "year", "race_name", "driver", "driver_name", "constructor", "grid"]
    rows, importances, table = _boosted(
        finished, ["resultId", "driverId"], columns, "finish_position", boost, "predicted_position", "finish_position", shown
    )
    return {
        "f1_driver_predictions": table,
        "f1_driver_feature_importances": importances,
        "top_overperformers": table.orderBy("residual", "resultId").limit(10),
        "metrics": L.metrics_long(L.fold_metrics(rows, "finish_position")),
    }


def _cluster_index(table: DataFrame, norms: Sequence[str], ks: Sequence[int], starts: int, labels: Sequence[str], entity: str):
    """Cluster entities on their scaled metrics, name clusters by score, rank by score."""
    table = table.fillna(0.0, subset=list(norms))
    model, sweep = L.kmeans_sweep(table, norms, ks, starts)
    assigned = L.assign_clusters(table, model, norms).withColumnRenamed("cluster_id", "archetype_id")
    named = assigned.join(S.ranked_labels(assigned, "archetype_id", labels).drop("mean_score"), "archetype_id")
    named = named.withColumn("archetype_id", F.col("archetype_id").cast("long"))
    return rank_rows(named, [F.desc("composite_score"), F.asc(entity)]), sweep


def constructor_index(features: DataFrame) -> DataFrame:
    """All-time constructor means with the composite score and its scaled metrics."""
    totals = features.groupBy("constructor").agg(
        F.min("nationality").alias("nationality"),
        F.avg("points_per_race").alias("mean_points_per_race"),
        F.avg("win_rate").alias("mean_win_rate"),
        F.avg("podium_rate").alias("mean_podium_rate"),
        F.avg("reliability_pct").alias("mean_reliability"),
        F.avg("avg_finish_position").alias("mean_avg_finish"),
        F.sum("wins").alias("total_wins"),
        F.count_distinct("year").alias("seasons_active"),
    )
    peak = A.best_row(features, ["constructor"], "points_per_race", "year", "peak_season", "year")
    return S.composite_index(cut_lineage(totals.join(peak, "constructor", "left")), K.CONSTRUCTOR_WEIGHTS, ["mean_avg_finish"])


def constructor_rankings(features: DataFrame, ks: Sequence[int] = range(3, 6), starts: int = 10, rules: QualityRules | None = PROFILES["f1_constructor"]) -> Tables:
    features = _gate(features, rules)
    norms = [f"norm_{c}" for c in K.CONSTRUCTOR_WEIGHTS]
    ranked, sweep = _cluster_index(constructor_index(features), norms, ks, starts, K.CONSTRUCTOR_LABELS, "constructor")
    return {
        "f1_constructor_rankings": ranked.select(
            "rank", "constructor", "nationality", "composite_score", "mean_win_rate", "mean_podium_rate",
            "mean_points_per_race", "mean_reliability", "mean_avg_finish", "total_wins", "seasons_active",
            "peak_season", "archetype_id", "archetype_label",
        ),
        "f1_constructor_seasons": features.select(
            "year", "constructor", F.col("total_points").cast("long").alias("total_points"), "wins", "podiums",
            "reliability_pct", "avg_finish_position", "points_per_race", "win_rate",
        ),
        "sweep": sweep, "metrics": _sweep_metrics(sweep),
    }


def pitstop_impact(features: DataFrame, boost: Boost = Boost(), rules: QualityRules | None = PROFILES["f1_pitstop"]) -> Tables:
    """Positions gained from pit strategy, and the speed of the pit crews."""
    features = _gate(features, rules)
    entries = A.race_driver_stops(features)
    columns = ["total_stops", "avg_stop_duration", "min_stop_duration", "first_stop_pct", "grid", "year"]
    shown = [
        "raceId", "year", "race_name", "driver", "constructor", "grid", "finish_position",
        "total_stops", "avg_stop_duration", "total_pit_time_ms",
    ]
    rows, importances, table = _boosted(
        cut_lineage(entries.select("driverId", *shown, "positions_gained", *[c for c in columns if c not in shown])), ["raceId", "driverId"], columns, "positions_gained", boost, "predicted_positions_gained", "positions_gained", shown
    )
    crews = A.pit_crew_stats(features)
    return {
        "f1_pitstop_analysis": table.select(
            *shown[:7], "positions_gained", *shown[7:], "predicted_positions_gained", "residual"
        ),
        "f1_pitstop_feature_importances": importances,
        "f1_constructor_pit_stats": crews,
        "fastest_crews": A.fastest_crews(crews),
        "metrics": L.metrics_long(L.fold_metrics(rows, "positions_gained")),
    }


# Inputs of the match margin model.
MATCH_COLUMNS = [
    "home_last5_win_rate", "home_last5_avg_margin", "home_last5_avg_pf", "home_last5_avg_pa",
    "home_season_win_rate", "home_season_home_win_rate",
    "away_last5_win_rate", "away_last5_avg_margin", "away_last5_avg_pf", "away_last5_avg_pa",
    "away_season_win_rate", "h2h_home_win_rate", "form_differential", "season_form_differential", "year",
]


def match_margins(features: DataFrame, key: Sequence[str] = ("match_date", "home_team", "away_team"), boost: Boost = Boost(), rules: QualityRules | None = PROFILES["nrl_match"]) -> Tables:
    """Match margins of teams with form on both sides, and who beats the expectation."""
    features = _gate(features, rules)
    known = features.dropna(subset=["home_last5_win_rate", "away_last5_win_rate"])
    shown = ["match_date", "year", "round", "home_team", "away_team", "home_score", "away_score"]
    rows, importances, table = _boosted(
        known, list(key), MATCH_COLUMNS, "margin", boost, "predicted_margin", "actual_margin", shown
    )
    return {
        "nrl_match_predictions": table.withColumns(
            {"match_date": F.col("match_date").cast("string"), "round": F.col("round").cast("string")}
        ),
        "nrl_match_feature_importances": importances,
        "nrl_team_overperformance": S.team_overperformance(table),
        "metrics": L.metrics_long(L.fold_metrics(rows, "margin")),
    }


def league_index(features: DataFrame) -> DataFrame:
    """All-time team means with composite score, scaled metrics and modern dominance."""
    means = {
        "mean_win_rate": "win_rate", "mean_avg_margin": "avg_margin", "mean_home_win_rate": "home_win_rate",
        "mean_away_win_rate": "away_win_rate", "mean_blowout_rate": "blowout_rate",
        "mean_close_game_win_rate": "close_game_win_rate", "mean_avg_points_for": "avg_points_for",
        "mean_avg_points_against": "avg_points_against",
    }
    totals = features.groupBy("team").agg(
        *[F.avg(c).alias(out) for out, c in means.items()],
        F.sum("wins").alias("total_wins"), F.sum("games_played").alias("total_games"),
        F.count_distinct("year").alias("seasons_active"),
    )
    peak = A.best_row(features, ["team"], "win_rate", "year", "peak_season", "year")
    modern = S.modern_dominance(features).select("team", "modern_dominance")
    wide = totals.withColumn("defensive_strength", F.col("mean_avg_points_against"))
    wide = cut_lineage(wide.join(peak, "team", "left").join(modern, "team", "left"))
    return S.composite_index(wide, K.LEAGUE_WEIGHTS, ["defensive_strength"], S.longevity(wide))


def league_rankings(features: DataFrame, ks: Sequence[int] = range(3, 7), starts: int = 10, rules: QualityRules | None = PROFILES["nrl_team"]) -> Tables:
    features = _gate(features, rules)
    norms = [f"norm_{c}" for c in K.LEAGUE_WEIGHTS]
    ranked, sweep = _cluster_index(league_index(features), norms, ks, starts, K.LEAGUE_LABELS, "team")
    return {
        "nrl_team_rankings": ranked.select(
            "rank", "team", "composite_score", "modern_dominance", "mean_win_rate", "mean_avg_margin",
            "mean_home_win_rate", "mean_away_win_rate", "mean_close_game_win_rate", "mean_blowout_rate",
            "mean_avg_points_for", "mean_avg_points_against", "total_wins", "total_games", "seasons_active",
            "peak_season", "archetype_id", "archetype_label",
        ),
        "nrl_team_seasons": features.select(
            "year", "team", "games_played", "wins", "draws", "losses", "win_rate", "avg_points_for",
            "avg_points_against", "avg_margin", "home_win_rate", "away_win_rate", "blowout_rate",
            "close_game_win_rate", "points_differential",
        ),
        "sweep": sweep, "metrics": _sweep_metrics(sweep),
    }


def tactical_profiles(features: DataFrame) -> DataFrame:
    """All-time mean of the tactical columns per team.

    Nine digits are kept, so that teams with equal seasons tie whatever order their rows
    were added up in; quartile tests on the means then do not depend on partitioning.
    """
    return features.groupBy("team").agg(*[steady_mean(c).alias(c) for c in K.TACTICAL_NAMES])


def coaching_insights(features: DataFrame, matches: DataFrame, ks: Sequence[int] = range(3, 7), starts: int = 10, rules: QualityRules | None = PROFILES["nrl_coaching"]) -> Tables:
    """Playing styles, strengths and weaknesses, rivalries and multi-year trends."""
    features = _gate(features, rules)
    columns = list(K.TACTICAL_NAMES)
    profiles = tactical_profiles(features)
    scaled_names = {c: f"__z_{c}" for c in columns}
    scaled = L.scale(profiles.withColumns({z: F.col(c) for c, z in scaled_names.items()}), list(scaled_names.values()))
    model, sweep = L.kmeans_sweep(scaled, list(scaled_names.values()), ks, starts)
    assigned = L.assign_clusters(scaled, model, list(scaled_names.values())).withColumnRenamed("cluster_id", "style_id")
    styled = assigned.join(S.style_labels(assigned, "style_id"), "style_id")
    judged = S.swot(styled)
    table = judged.select(
        "team", "playing_style", F.col("style_id").cast("long").alias("style_id"), "strengths", "weaknesses",
        *[half_even(F.col(c), 4).alias(c) for c in columns],
    )
    rivalries = A.rivalry_matrix(matches)
    return {
        "nrl_team_profiles": table,
        "nrl_rivalry_matrix": rivalries,
        "nrl_team_trends": S.team_trends(features),
        "style_summary": A.style_summary(table),
        "top_rivalries": rivalries.where(F.col("is_dominant") == 1).orderBy(F.desc("total_matches"), "team", "opponent").limit(10),
        "sweep": sweep, "metrics": _sweep_metrics(sweep),
    }
