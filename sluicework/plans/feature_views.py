"""The feature views: raw tables in, one wide feature table out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.scalar import flag, safe_divide, safe_double, safe_long, share
from sluicework.operators.aggregates import home_away_season, season_rates, tactical_season
from sluicework.operators.joins import head_to_head, join_large, large_parts, star_join
from sluicework.operators.reshape import both_sides
from sluicework.operators.skew import Ordered, ordered_columns
from sluicework.session import cut_lineage


def player_features(profiles: DataFrame, stats: DataFrame) -> DataFrame:
    """Player season numbers from text columns; text that is no number becomes NULL."""
    whole = [
        "appearances", "matches_started", "minutes_played", "goals", "assists", "total_shots",
        "shots_on_target", "yellow_cards", "red_cards", "tackles", "interceptions", "saves",
    ]
    real = ["market_value", "expected_goals", "expected_assists", "rating"]
    typed = profiles.join(stats, "player_id").withColumns(
        {**{f"__d_{c}": safe_double(F.col(c)) for c in [*whole, *real]}, **{f"__l_{c}": safe_long(F.col(c)) for c in whole}}
    )

    def d(c: str) -> Column:
        return F.col(f"__d_{c}")

    shown = [
        "market_value", "appearances", "matches_started", "minutes_played", "goals", "assists",
        "expected_goals", "expected_assists", "rating", "total_shots", "shots_on_target",
        "yellow_cards", "red_cards", "tackles", "interceptions", "saves",
    ]
    per_game = {f"{c}_per_appearance": safe_divide(d(c), d("appearances")) for c in ("goals", "assists", "tackles")}
    return typed.where(F.col("__l_appearances") > 0).select(
        "player_id", "position", "league",
        *[(F.col(f"__l_{c}") if c in whole else d(c)).alias(c) for c in shown],
        *[e.alias(n) for n, e in per_game.items()],
        safe_divide(d("shots_on_target"), d("total_shots")).alias("shot_accuracy"),
        (d("goals") - d("expected_goals")).alias("goals_vs_expected"),
    )


# Derived team ratios, name to (numerator, denominator).
TEAM_RATIOS = {
    "yards_per_game": ("total_yards", "g"),
    "pass_yds_per_game": ("pass_yds", "g"),
    "rush_yds_per_game": ("rush_yds", "g"),
    "points_per_game": ("points", "g"),
    "points_opp_per_game": ("points_opp", "g"),
    "pass_completion_pct": ("pass_cmp", "pass_att"),
    "pass_td_pct": ("pass_td", "pass_att"),
    "interception_pct": ("pass_int", "pass_att"),
    "rush_share": ("rush_yds", "total_yards"),
    "first_down_pass_pct": ("pass_fd", "first_down"),
    "first_down_rush_pct": ("rush_fd", "first_down"),
    "penalty_yds_per_game": ("penalties_yds", "g"),
}


def team_features(stats: DataFrame) -> DataFrame:
    """Team-season table plus per-game and share ratios; ten wins count as playoffs."""
    ratios = {name: safe_divide(F.col(a), F.col(b)) for name, (a, b) in TEAM_RATIOS.items()}
    return stats.withColumns(
        {"ties": F.coalesce("ties", F.lit(0)), **ratios, "is_playoff": flag(F.col("wins") >= 10)}
    )


def _finished(status: Column) -> Column:
    return flag((status == "Finished") | F.startswith(status, F.lit("+")))


def driver_features(
    results: DataFrame, races: DataFrame, circuits: DataFrame, drivers: DataFrame,
    constructors: DataFrame, status: DataFrame, qualifying: DataFrame,
) -> DataFrame:
    """One row per started race entry with its race, driver and qualifying context."""
    # Races take their circuits first, so that the entries are shuffled once for both.
    placed = races.select("raceId", "year", "round", F.col("name").alias("race_name"), "circuitId").join(
        circuits.select("circuitId", F.col("circuitRef").alias("circuit"), F.col("country").alias("circuit_country")), "circuitId"
    )
    # Text that becomes a number does so before it is shuffled.
    started = results.where(F.col("grid") > 0).select(
        "resultId", "raceId", "driverId", "constructorId", "statusId", "grid", "positionOrder", "points", "laps",
        safe_long(F.col("milliseconds")).alias("race_time_ms"), safe_double(F.col("fastestLapSpeed")).alias("fastest_lap_speed"),
        safe_long(F.col("rank")).alias("fastest_lap_rank"),
    )
    # Keys and numbers first, texts last: what an early join adds goes through the shuffles of all later ones.
    wide = star_join(
        started,
        [
            (qualifying.select("raceId", "driverId", F.col("position").alias("quali_position")), ["raceId", "driverId"], "left"),
            (constructors.select("constructorId", F.col("name").alias("constructor")), ["constructorId"], "inner"),
            (
                drivers.select(
                    "driverId", F.col("driverRef").alias("driver"),
                    F.concat("forename", F.lit(" "), "surname").alias("driver_name"),
                    F.col("nationality").alias("driver_nationality"),
                ),
                ["driverId"], "inner",
            ),
            (placed.drop("circuitId"), ["raceId"], "inner"),
            (status.select("statusId", F.col("status").alias("finish_status")), ["statusId"], "inner"),
        ],
    )
    place = F.col("positionOrder")
    return wide.select(
        "resultId", "raceId", "year", "round", "race_name", "circuit", "circuit_country", "driverId",
        "driver", "driver_name", "driver_nationality", "constructorId", "constructor", "grid",
        place.alias("finish_position"), "points", "laps",
        "race_time_ms", "fastest_lap_speed", "fastest_lap_rank",
        "statusId", "finish_status", _finished(F.col("finish_status")).alias("finished"), "quali_position",
        (F.col("grid") - place).alias("positions_gained"),
        flag(place <= 3).alias("podium"),
        flag(place == 1).alias("win"),
    )


def constructor_features(results: DataFrame, races: DataFrame, constructors: DataFrame, status: DataFrame) -> DataFrame:
    """Constructor-season totals and rates, seasons with five entries or more.

    ``constructorId`` is the key of ``constructors``: names are joined to the seasons, not to the entries.
    """
    started = results.where(F.col("grid") > 0).select("raceId", "constructorId", "statusId", "grid", "positionOrder", "points")
    rated = star_join(started, [(status.select("statusId", _finished(F.col("status")).alias("finished")), ["statusId"], "inner")])
    wide = join_large(rated.drop("statusId"), races.select("raceId", "year"), "raceId")
    seasons = season_rates(wide, ["constructorId", "year"])
    named = seasons.join(constructors.select("constructorId", F.col("name").alias("constructor"), "nationality"), "constructorId")
    keys = ["constructorId", "constructor", "nationality", "year"]
    return named.select(*keys, *[c for c in seasons.columns if c not in keys])


def pitstop_features(
    pit_stops: DataFrame, races: DataFrame, circuits: DataFrame, drivers: DataFrame,
    results: DataFrame, constructors: DataFrame,
) -> DataFrame:
    """One row per pit stop of plausible length with race position context."""
    entries = results.where(F.col("laps") > 0).select(
        "raceId", "driverId", "constructorId", "grid", F.col("positionOrder").alias("finish_position"),
        F.col("laps").alias("total_laps"),
    )
    valid = pit_stops.where((F.col("duration") > 0) & (F.col("duration") < 120))
    placed = races.select("raceId", "year", F.col("name").alias("race_name"), "circuitId").join(
        circuits.select("circuitId", F.col("circuitRef").alias("circuit")), "circuitId"
    )
    # Races take their circuits first, and the drivers come last: rows stay cut by driver, so that
    # what groups them by race and driver needs no shuffle more.
    parts = large_parts(valid)
    raced = join_large(join_large(valid, entries, ["raceId", "driverId"], parts), placed.drop("circuitId"), "raceId", parts)
    # Stored, so that their size is known and the stops are not shuffled for a few constructors.
    names = cut_lineage(constructors.select("constructorId", F.col("name").alias("constructor")))
    named = star_join(raced, [(names, ["constructorId"], "inner")])
    wide = join_large(named, drivers.select("driverId", F.col("driverRef").alias("driver")), "driverId", parts)
    return wide.select(
        "raceId", "driverId", F.col("stop").alias("stop_number"), F.col("lap").alias("stop_lap"),
        F.col("duration").alias("stop_duration_sec"), F.col("milliseconds").alias("stop_duration_ms"),
        "year", "race_name", "circuit", "driver", "constructor", "grid", "finish_position",
        (F.col("grid") - F.col("finish_position")).alias("positions_gained"), "total_laps",
        share(F.col("lap"), F.col("total_laps"), 3).alias("stop_race_pct"),
        flag(F.col("stop") == 1).alias("is_first_stop"),
        flag(F.col("duration") < 25).alias("fast_stop"),
        flag(F.col("duration") > 35).alias("slow_stop"),
    )


def league_matches(fixtures: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Played fixtures under the column names the match operators use."""
    return fixtures.where(F.col("HomeScore").isNotNull() & F.col("AwayScore").isNotNull()).select(
        *extra, F.to_date("KickOffTime").alias("match_date"), F.col("Season").alias("year"),
        F.col("Round").alias("round"), F.col("HomeTeam").alias("home_team"), F.col("AwayTeam").alias("away_team"),
        F.col("HomeScore").alias("home_score"), F.col("AwayScore").alias("away_score"), F.col("Venue").alias("venue"),
    )


def team_season_features(fixtures: DataFrame) -> DataFrame:
    return home_away_season(both_sides(league_matches(fixtures), ["year"]))


def coaching_rows(fixtures: DataFrame) -> DataFrame:
    """The rows of :func:`coaching_features` without what came before each match, which adds and drops no row."""
    sides = both_sides(league_matches(fixtures), ["match_date", "year", "round"])
    return tactical_season(sides.withColumns({"prev_win": F.lit(None).cast("int"), "prev_loss": F.lit(None).cast("int")})).select("team", "year")


def match_rows(fixtures: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of :func:`match_features`, one a played match, without the features."""
    return league_matches(fixtures, key).select(*key)


def coaching_features(fixtures: DataFrame, key: Sequence[str] = ("home_team", "away_team")) -> DataFrame:
    """Tactical season profile; ``key`` tells matches of one day apart."""
    sides = both_sides(_keyed(fixtures, key), ["match_date", "year", "round", *_renamed(key)])
    order = [F.asc("match_date"), *[F.asc(k) for k in _renamed(key)]]
    lagged = ordered_columns(
        sides, ["team"], order, [Ordered("lag", "prev_win", "win"), Ordered("lag", "prev_loss", "loss")]
    )
    return tactical_season(lagged)


def _renamed(key: Sequence[str]) -> list[str]:
    return [f"__key_{k}" for k in key]


def _keyed(fixtures: DataFrame, key: Sequence[str]) -> DataFrame:
    extra = [k for k in key if k in fixtures.columns and k not in ("home_team", "away_team")]
    matches = league_matches(fixtures, extra)
    return matches.withColumns({f"__key_{k}": F.col(k) for k in key})


def match_features(fixtures: DataFrame, key: Sequence[str] = ("home_team", "away_team")) -> DataFrame:
    """Form, season and head-to-head features of every match, from earlier matches only.

    ``key`` must name a match uniquely within its day. Both teams' rows come out of one
    scan, run through the two ordered computations on the team, and are put together again
    by match, instead of joining the fixture list twice with the rolling table. They carry
    numbers only: the matches are stored with a number of their own, by which texts come back last.
    """
    keys = _renamed(key)
    matches = cut_lineage(_keyed(fixtures, key).withColumn("__match", F.monotonically_increasing_id()))
    place = ["__match", "match_date", "year", *keys, "team", "is_home"]
    order = [F.asc("match_date"), *[F.asc(k) for k in keys]]
    sides = both_sides(matches, place[:-2]).select(*place, "win", "margin", "pf", "pa")
    last5 = [Ordered("trailing", f"last5_{o}", c, 5) for o, c in (("win_rate", "win"), ("avg_margin", "margin"), ("avg_pf", "pf"), ("avg_pa", "pa"))]
    season = [Ordered("running", "season_win_rate", "win"), Ordered("running", "season_home_win_rate", "__home_win")]
    formed = ordered_columns(sides, ["team"], order, last5).select(
        *place, "win", F.when(F.col("is_home") == 1, F.col("win")).alias("__home_win"), *[s.out for s in last5]
    )
    rolled = ordered_columns(formed, ["team", "year"], order, season)
    wanted = [s.out for s in last5 + season]
    sided = rolled.groupBy("__match").agg(
        *[F.max(F.when(F.col("is_home") == 1, F.col(c))).alias(f"home_{c}") for c in wanted],
        *[F.max(F.when(F.col("is_home") == 0, F.col(c))).alias(f"away_{c}") for c in wanted],
    )
    per_match = matches.drop(*keys).join(sided, "__match")
    joined = head_to_head(matches, per_match)

    def gap(c: str) -> Column:
        return F.round(F.coalesce(F.col(f"home_{c}"), F.lit(0.5)) - F.coalesce(F.col(f"away_{c}"), F.lit(0.5)), 3)

    digits = {"win_rate": 3, "avg_margin": 2, "avg_pf": 2, "avg_pa": 2}
    extra = [k for k in key if k not in ("home_team", "away_team")]
    return joined.select(
        *extra, "match_date", "year", "round", "home_team", "away_team", "home_score", "away_score",
        (F.col("home_score") - F.col("away_score")).alias("margin"), "venue",
        *[F.round(f"home_last5_{c}", n).alias(f"home_last5_{c}") for c, n in digits.items()],
        F.round("home_season_win_rate", 3).alias("home_season_win_rate"),
        F.round("home_season_home_win_rate", 3).alias("home_season_home_win_rate"),
        *[F.round(f"away_last5_{c}", n).alias(f"away_last5_{c}") for c, n in digits.items()],
        F.round("away_season_win_rate", 3).alias("away_season_win_rate"),
        "h2h_total", share(F.col("h2h_home_wins"), F.col("h2h_total"), 3).alias("h2h_home_win_rate"),
        gap("last5_win_rate").alias("form_differential"),
        gap("season_win_rate").alias("season_form_differential"),
    )
