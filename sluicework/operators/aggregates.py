"""Grouped summaries. Every one is a plain ``groupBy().agg()``: partial aggregation
collapses hot keys before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework.functions.scalar import flag, half_even, safe_divide, share, steady_mean
from sluicework.operators.quality import numeric_columns
from sluicework.operators.reshape import both_sides, to_long
from sluicework.operators.skew import exact_quantiles


def rate_when(hit: Column, among: Column, digits: int = 3) -> Column:
    """Share of rows with ``hit`` among the rows with ``among``; NULL without any."""
    return share(F.count_if(hit & among), F.count_if(among), digits)


def season_rates(results: DataFrame, keys: Sequence[str], min_rows: int = 5) -> DataFrame:
    """Entity-season totals and rates, seasons with at least ``min_rows`` entries.

    Input: keys, raceId, grid, positionOrder, points, finished (0/1).
    """
    won, placed = F.col("positionOrder") == 1, F.col("positionOrder") <= 3
    races = F.count_distinct("raceId")
    return (
        results.groupBy(*keys)
        .agg(
            F.count("*").alias("race_entries"),
            F.sum("points").alias("total_points"),
            F.count_if(won).alias("wins"),
            F.count_if(placed).alias("podiums"),
            F.sum("finished").cast("long").alias("finishes"),
            (F.count("*") - F.sum("finished")).cast("long").alias("retirements"),
            share(F.sum("finished"), F.count("*"), 3).alias("reliability_pct"),
            F.round(F.avg("positionOrder"), 2).alias("avg_finish_position"),
            F.round(F.avg("grid"), 2).alias("avg_grid_position"),
            F.round(F.avg(F.col("grid") - F.col("positionOrder")), 2).alias("avg_positions_gained"),
            share(F.sum("points"), races, 2).alias("points_per_race"),
            share(F.count_if(won), races, 3).alias("win_rate"),
            share(F.count_if(placed), races, 3).alias("podium_rate"),
        )
        .where(F.col("race_entries") >= min_rows)
    )


def home_away_season(sides: DataFrame, min_games: int = 5) -> DataFrame:
    """Team-season record from two-sided match rows: splits, blowouts, close games."""
    home, away = F.col("is_home") == 1, F.col("is_home") == 0
    won, close = F.col("win") == 1, F.abs("margin") <= 6
    return (
        sides.groupBy("team", "year")
        .agg(
            F.count("*").alias("games_played"),
            F.count_if(won).alias("wins"),
            F.sum("draw").alias("draws"),
            F.sum("loss").alias("losses"),
            share(F.sum("win"), F.count("*"), 3).alias("win_rate"),
            F.sum("pf").alias("total_points_for"),
            F.sum("pa").alias("total_points_against"),
            F.round(F.avg("pf"), 2).alias("avg_points_for"),
            F.round(F.avg("pa"), 2).alias("avg_points_against"),
            F.round(F.avg("margin"), 2).alias("avg_margin"),
            F.round(F.stddev_samp("margin"), 2).alias("margin_stddev"),
            F.count_if(home & won).alias("home_wins"),
            F.count_if(home).alias("home_games"),
            rate_when(won, home).alias("home_win_rate"),
            F.count_if(away & won).alias("away_wins"),
            F.count_if(away).alias("away_games"),
            rate_when(won, away).alias("away_win_rate"),
            F.count_if(F.col("margin") >= 13).alias("blowout_wins"),
            share(F.count_if(F.col("margin") >= 13), F.count_if(won), 3).alias("blowout_rate"),
            F.count_if(close).alias("close_games"),
            F.count_if(close & won).alias("close_wins"),
            rate_when(won, close).alias("close_game_win_rate"),
            (F.sum("pf") - F.sum("pa")).alias("points_differential"),
        )
        .where(F.col("games_played") >= min_games)
    )


def tactical_season(sides: DataFrame, min_games: int = 5) -> DataFrame:
    """Team-season tactics from two-sided rows that carry prev_win and prev_loss."""
    home, away = F.col("is_home") == 1, F.col("is_home") == 0
    won, close = F.col("win") == 1, F.abs("margin") <= 6
    early, late = F.col("round").between(1, 8), F.col("round") >= 18

    def raw(among: Column) -> Column:
        return F.coalesce(safe_divide(F.count_if(won & among), F.count_if(among)), F.lit(0.0))

    return (
        sides.groupBy("team", "year")
        .agg(
            F.count("*").alias("games_played"),
            F.count_if(won).alias("wins"),
            share(F.sum("win"), F.count("*"), 3).alias("win_rate"),
            F.round(F.avg("pf"), 2).alias("avg_points_for"),
            F.round(F.avg("pa"), 2).alias("avg_points_against"),
            F.round(F.avg("margin"), 2).alias("avg_margin"),
            F.round(F.stddev_samp("margin"), 2).alias("consistency_score"),
            rate_when(won, home).alias("home_win_rate"),
            rate_when(won, away).alias("away_win_rate"),
            F.round(raw(home) - raw(away), 3).alias("home_dependency"),
            rate_when(won, early).alias("early_season_win_rate"),
            rate_when(won, late).alias("late_season_win_rate"),
            rate_when(won, F.col("prev_loss") == 1).alias("bounce_back_rate"),
            rate_when(won, F.col("prev_win") == 1).alias("streak_maintenance_rate"),
            rate_when(won, close).alias("close_game_win_rate"),
            share(F.count_if(F.col("margin") <= -13), F.count("*"), 3).alias("blowout_loss_rate"),
            share(F.avg("pf"), F.avg("pa"), 3).alias("attack_defense_ratio"),
        )
        .where(F.col("games_played") >= min_games)
    )


def rivalry_matrix(matches: DataFrame) -> DataFrame:
    """Every ordered pair of teams; a draw counts as a loss for both."""
    sides = both_sides(matches, [])
    home = F.col("is_home") == 1
    paired = sides.groupBy("team", "opponent").agg(
        F.count("*").alias("total_matches"),
        F.count_if(F.col("win") == 1).alias("wins"),
        F.bround(F.avg("margin"), 2).alias("avg_margin"),
        F.bround(safe_divide(F.count_if(home & (F.col("win") == 1)), F.count_if(home)), 3).alias("home_win_rate"),
    )
    rated = paired.withColumn("win_rate", F.bround(F.col("wins") / F.col("total_matches"), 3))
    return rated.select(
        "team", "opponent", "total_matches", "wins",
        (F.col("total_matches") - F.col("wins")).alias("losses"),
        "win_rate", "avg_margin", "home_win_rate",
        flag((F.col("win_rate") > 0.6) & (F.col("total_matches") >= 10)).cast("long").alias("is_dominant"),
    )


def race_driver_stops(stops: DataFrame) -> DataFrame:
    """One row per race and driver; race constants by ``min``, the same for all stops."""
    constant = ["year", "race_name", "driver", "constructor", "grid", "finish_position", "positions_gained", "total_laps"]
    grouped = stops.groupBy("raceId", "driverId").agg(
        *[F.min(c).alias(c) for c in constant],
        F.max("stop_number").alias("total_stops"),
        half_even(steady_mean("stop_duration_sec"), 3).alias("avg_stop_duration"),
        F.bround(F.min("stop_duration_sec"), 3).alias("min_stop_duration"),
        F.sum("stop_duration_ms").alias("total_pit_time_ms"),
        F.min("stop_lap").alias("first_stop_lap"),
        F.max("stop_lap").alias("last_stop_lap"),
    )
    return grouped.withColumn("first_stop_pct", F.bround(safe_divide(F.col("first_stop_lap"), F.col("total_laps")), 3))


def pit_crew_stats(stops: DataFrame) -> DataFrame:
    return stops.groupBy("constructor", "year").agg(
        half_even(steady_mean("stop_duration_sec"), 3).alias("avg_pit_duration"),
        F.bround(F.min("stop_duration_sec"), 3).alias("min_pit_duration"),
        F.count("stop_number").alias("total_pit_stops"),
        F.bround(F.avg("positions_gained"), 3).alias("avg_positions_gained"),
    )


def fastest_crews(stats: DataFrame, since: int = 2015, n: int = 10) -> DataFrame:
    recent = stats.where(F.col("year") >= since)
    return recent.orderBy("avg_pit_duration", "constructor", "year").limit(n).select(
        "constructor", "year", "avg_pit_duration", "total_pit_stops"
    )


def best_row(df: DataFrame, keys: Sequence[str], score: str, pick: str, out: str, tie: str) -> DataFrame:
    """``pick`` of the row with the highest score; ties go to the lowest ``tie``."""
    order = F.struct(F.col(score), -F.col(tie))
    return df.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.max_by(F.col(pick), order).alias(out))


def weighted_means(df: DataFrame, keys: Sequence[str], columns: dict[str, str], weight: str) -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*keys).agg(
        *[(F.sum(F.col(c) * w) / F.sum(w)).alias(out) for c, out in columns.items()]
    )


def own_top_quartile(df: DataFrame, key: str, score: str, out: str) -> DataFrame:
    """Per key, rows at or above that key's own 75th percentile."""
    bar = exact_quantiles(df, [score], [0.75], [key]).select(F.col(key).alias("__key"), F.col("q0").alias("__bar"))
    return (
        df.join(bar, df[key] == bar["__key"], "left")
        .groupBy(key)
        .agg(F.count_if(F.col(score) >= F.col("__bar")).alias(out))
    )


def regression_quality(predictions: DataFrame, predicted: str, actual: str, residual: str = "residual") -> DataFrame:
    r = F.col(residual)
    return predictions.agg(
        F.count("*").alias("total"),
        F.round(F.pow(F.corr(predicted, actual), 2), 4).alias("r2_approx"),
        F.round(F.avg(F.abs(r)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(r * r)), 4).alias("rmse"),
        F.round(F.avg(r), 4).alias("mean_residual"),
    )


def anomaly_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_anomaly") == 1).alias("anomaly_count"),
        F.round(F.avg("anomaly_score"), 4).alias("avg_score"),
        F.round(F.max("anomaly_score"), 4).alias("max_score"),
    )


def cluster_averages(rows: DataFrame, cluster: str, skip: Sequence[str] = ()) -> DataFrame:
    """Per cluster: size and the rounded mean of every numeric column, as one map."""
    numbers = numeric_columns(rows, [cluster, *skip])
    pairs = [x for c in numbers for x in (F.lit(f"avg_{c}"), F.round(F.avg(F.col(c).cast("double")), 2))]
    return rows.groupBy(F.col(cluster).alias("cluster_id")).agg(
        F.count("*").alias("record_count"), F.create_map(*pairs).alias("metrics")
    )


def cluster_metrics_long(averages: DataFrame) -> DataFrame:
    return averages.select("cluster_id", "record_count", F.explode("metrics").alias("metric", "value"))


def style_members(profiles: DataFrame) -> DataFrame:
    """Members of each style in name order, one row each: no unbounded list is built."""
    return profiles.select("playing_style", "team").distinct()


def style_summary(profiles: DataFrame) -> DataFrame:
    """Size and joined, sorted member names of each style.

    The names are one cell by definition; :func:`style_members` gives them as rows.
    """
    return profiles.groupBy("playing_style").agg(
        F.count("*").alias("style_count"), F.array_join(F.sort_array(F.collect_list("team")), ", ").alias("teams")
    )


def ledger_rollup(jobs: DataFrame) -> DataFrame:
    """Per table: jobs, rows loaded, bytes, latest update, completion."""
    return jobs.groupBy(F.coalesce("bq_table", "dataset").alias("table_name")).agg(
        F.count("*").alias("job_count"),
        F.sum(F.coalesce("loaded", F.lit(0))).alias("total_loaded"),
        F.sum("file_size_bytes").alias("total_size"),
        F.max("updated_at").alias("latest_date"),
        F.when(
            F.sum("total_records") > 0, F.round(F.sum(F.coalesce("loaded", F.lit(0))) / F.sum("total_records") * 100)
        ).otherwise(0.0).cast("long").alias("completion_pct"),
    )


def score_histogram(scored: DataFrame, score: str, is_flagged: str, buckets: int = 10) -> DataFrame:
    """Fixed-width buckets of a 0..1 score, flagged and unflagged rows apart."""
    bucket = F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1)).cast("long")
    return scored.groupBy(bucket.alias("bucket")).agg(
        F.count_if(F.col(is_flagged) != 1).alias("normal"), F.count_if(F.col(is_flagged) == 1).alias("anomaly")
    )


def position_totals(weights: DataFrame) -> DataFrame:
    return weights.groupBy("position").agg(F.bround(F.sum("positional_value"), 4).alias("total_value"))


def top_features_per_position(weights: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("position").orderBy(F.desc("positional_value"), "team_feature")
    return (
        weights.withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= n)
        .select("position", "place", "team_feature", F.bround("positional_value", 4).alias("value"))
    )


def pillar_means(seasons: DataFrame, team: str, pillars: Sequence[str]) -> DataFrame:
    """Mean of each pillar for one team, the strongest first."""
    mine = seasons.where(F.col("team") == team)
    long = to_long(mine, [], pillars, "pillar", "score")
    means = long.groupBy("pillar").agg(F.bround(F.avg("score"), 4).alias("mean_score"))
    top = Window.orderBy(F.desc("mean_score"), "pillar")  # one row per pillar
    return means.withColumn("is_strongest", flag(F.row_number().over(top) == 1))


def metric_ranges(long: DataFrame, n: int = 6) -> DataFrame:
    """Metrics by spread over the clusters, widest first, with their scale to 100."""
    return (
        long.groupBy("metric")
        .agg(
            (F.max("value") - F.min("value")).alias("spread"),
            F.greatest(F.max(F.abs("value")), F.lit(1.0)).alias("scale"),
        )
        .orderBy(F.desc("spread"), "metric")
        .limit(n)
    )


def metric_radar(long: DataFrame, n: int = 6) -> DataFrame:
    """The widest metrics per cluster, scaled so that the largest magnitude is 100."""
    return long.join(metric_ranges(long, n), "metric").select(
        "metric", "cluster_id", F.floor(F.col("value") / F.col("scale") * 100 + 0.5).cast("long").alias("scaled")
    )


def metric_leaders(long: DataFrame, n: int = 4) -> DataFrame:
    """Metrics with the largest magnitude above 0.01."""
    return (
        long.groupBy("metric")
        .agg(F.max(F.abs("value")).alias("peak"))
        .where(F.col("peak") > 0.01)
        .orderBy(F.desc("peak"), "metric")
        .limit(n)
    )
