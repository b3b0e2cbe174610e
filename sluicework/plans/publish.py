"""Writing the results of a packaged analysis: declared tables and the metrics log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions import constants as K
from sluicework.sources.sinks import log_metrics, save_output

_IMPORTANCES = "feature_name string, importance double, rank long"

# The declared columns of the result tables.
SCHEMAS = {
    "player_clusters": "player_id string, cluster_id long, impact_score double",
    "player_anomalies": "player_id string, anomaly_score double, is_anomaly long",
    "player_rating_predictions": "player_id string, predicted_rating double, actual_rating double, residual double",
    "team_archetypes": "year long, team string, archetype_id long, archetype_label string, avg_win_pct double, impact_score double",
    "team_win_predictions": "year long, team string, actual_win_pct double, predicted_win_pct double, residual double, model_type string",
    "team_feature_importances": f"{_IMPORTANCES}, model_type string",
    "team_optimal_profile": "feature_name string, elite_p25 double, elite_median double, elite_p75 double, league_median double, ridge_coefficient double, gap double",
    "positional_value_weights": "position string, team_feature string, contribution_weight double, team_feature_importance double, positional_value double",
    "team_dominance_seasons": "year long, team string, dominance_score double, pillar_winning double, pillar_offence double, pillar_defence double, pillar_efficiency double, win_loss_perc double, is_elite long",
    "team_dominance_rankings": "rank long, team string, composite_score double, mean_dominance double, peak_dominance double, seasons_top_8 long, total_wins long, total_losses long, avg_win_pct double, avg_points_per_game double, avg_points_opp_per_game double, best_season_year long",
    "team_dominance_drivers": f"{_IMPORTANCES}, elite_mean double, league_mean double, elite_advantage double",
    "f1_constructor_rankings": "rank long, constructor string, nationality string, composite_score double, mean_win_rate double, mean_podium_rate double, mean_points_per_race double, mean_reliability double, mean_avg_finish double, total_wins long, seasons_active long, peak_season long, archetype_id long, archetype_label string",
    "f1_constructor_seasons": "year long, constructor string, total_points long, wins long, podiums long, reliability_pct double, avg_finish_position double, points_per_race double, win_rate double",
    "f1_driver_predictions": "resultId long, year long, race_name string, driver string, driver_name string, constructor string, grid long, finish_position long, predicted_position double, residual double",
    "f1_driver_feature_importances": _IMPORTANCES,
    "f1_pitstop_analysis": "raceId long, year long, race_name string, driver string, constructor string, grid long, finish_position long, positions_gained long, total_stops long, avg_stop_duration double, total_pit_time_ms long, predicted_positions_gained double, residual double",
    "f1_pitstop_feature_importances": _IMPORTANCES,
    "f1_constructor_pit_stats": "constructor string, year long, avg_pit_duration double, min_pit_duration double, total_pit_stops long, avg_positions_gained double",
    "nrl_match_predictions": "match_date string, year long, round string, home_team string, away_team string, home_score long, away_score long, actual_margin long, predicted_margin double, residual double",
    "nrl_match_feature_importances": _IMPORTANCES,
    "nrl_team_overperformance": "team string, avg_overperformance double, total_matches long, overperformance_rank long",
    "nrl_team_profiles": "team string, playing_style string, style_id long, strengths string, weaknesses string, " + ", ".join(f"{c} double" for c in K.TACTICAL_NAMES),
    "nrl_rivalry_matrix": "team string, opponent string, total_matches long, wins long, losses long, win_rate double, avg_margin double, home_win_rate double, is_dominant long",
    "nrl_team_trends": "team string, window_start long, window_end long, seasons_in_window long, avg_win_rate double, avg_margin double, avg_close_game_wr double, avg_bounce_back double, trajectory string",
    "nrl_team_rankings": "rank long, team string, composite_score double, modern_dominance double, mean_win_rate double, mean_avg_margin double, mean_home_win_rate double, mean_away_win_rate double, mean_close_game_win_rate double, mean_blowout_rate double, mean_avg_points_for double, mean_avg_points_against double, total_wins long, total_games long, seasons_active long, peak_season long, archetype_id long, archetype_label string",
    "nrl_team_seasons": "year long, team string, games_played long, wins long, draws long, losses long, win_rate double, avg_points_for double, avg_points_against double, avg_margin double, home_win_rate double, away_win_rate double, blowout_rate double, close_game_win_rate double, points_differential long",
}


def publish(tables: dict[str, DataFrame], root: str, run_id: str, name: str, at: Column | None = None) -> list[str]:
    """Replace the declared result tables of an analysis below ``root`` and log its metrics; returns the tables written.

    Every declared table must have exactly its columns. ``metrics`` goes to
    ``<root>/pipeline_runs``; publishing a run again replaces its rows. Other tables are by-products
    and are not kept.
    """
    written = []
    for table, schema in SCHEMAS.items():
        if table in tables:
            save_output(tables[table], f"{root}/{table}", schema)
            written.append(table)
    if "metrics" in tables:
        log_metrics(tables["metrics"], f"{root}/pipeline_runs", run_id, name, F.current_timestamp() if at is None else at)
    return written
