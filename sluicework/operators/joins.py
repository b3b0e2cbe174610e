"""Joins. No side is broadcast by hand: Spark broadcasts a side only while its size is
below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges, with adaptive
skew splitting for hot keys; :func:`join_large` sets the number of partitions by the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicework.functions.constants import POSITION_WEIGHTS, POSITIONS
from sluicework.functions.scalar import half_even
from sluicework.operators.reshape import first_owner


def star_join(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """Join a fact with (dimension, key columns, how) in turn, keeping one copy of each key."""
    for dim, keys, how in dimensions:
        fact = fact.join(dim, list(keys), how)
    return fact


PART_ROWS = 500_000  # rows of a fact table in one partition of a large join


def large_parts(fact: DataFrame) -> int:
    """Partitions of a large join by the counted rows of the fact; 0 for small facts, which are left to the planner."""
    parts = fact.count() // PART_ROWS
    return parts if parts >= 4 else 0


def join_large(fact: DataFrame, dim: DataFrame, key: str | Sequence[str], parts: int | None = None) -> DataFrame:
    """Inner join of two large tables whose partitions do not grow with the fact table.

    A fixed number of shuffle partitions makes every task sort and group more rows as the tables
    grow, and adaptive coalescing goes by compressed bytes. Here both sides are cut by the counted
    rows of the fact, or into ``parts`` where they are known. Small facts are left to the planner,
    which may broadcast.
    """
    keys = [key] if isinstance(key, str) else list(key)
    parts = large_parts(fact) if parts is None else parts
    if not parts:
        return fact.join(dim, keys)
    return fact.repartition(parts, *keys).join(dim.repartition(parts, *keys), keys)


def join_as_text(left: DataFrame, right: DataFrame, key: str, how: str = "left", right_columns: Sequence[str] | None = None) -> DataFrame:
    """Equality on the text of the key, whatever the two key types are."""
    cols = [c for c in (right_columns or right.columns) if c != key]
    r = right.select(F.col(key).cast("string").alias("__rk"), *cols)
    return left.join(r, left[key].cast("string") == r["__rk"], how).drop("__rk")


def join_sources(base: DataFrame, sources: Mapping[str, DataFrame], key: str, how: str) -> DataFrame:
    """Attach the columns of several source tables; the first table with a name wins."""
    owned = first_owner(sources, [*base.columns, key])
    for label, frame in sources.items():
        base = join_as_text(base, frame, key, how, owned[label] or [key])
    return base


def full_join_zero(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join, missing numbers as 0."""
    return left.join(right, list(keys), "full").fillna(0)


def head_to_head(matches: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """Prior meetings of the same two teams, whoever was at home.

    Input: match_date, home_team, away_team, home_score, away_score. Adds h2h_home_wins,
    h2h_away_wins and h2h_total over strictly earlier dates, to the matches or to ``onto``,
    a table derived from them. A pair without history has total 1 and no wins, as the
    reported figures always had it.

    An OR-join on "same or swapped pair" would compare all rows with all rows. Here the
    meetings of a pair are first summed per day (combined map-side), so the running sum
    sees at most one row per pair and calendar day, however many matches a pair has.
    """
    pair = {"__lo": F.least("home_team", "away_team"), "__hi": F.greatest("home_team", "away_team")}
    daily = matches.withColumns(pair).groupBy("__lo", "__hi", "match_date").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("home_score") > F.col("away_score")).alias("hw"),
        F.count_if(F.col("away_score") > F.col("home_score")).alias("aw"),
    )
    before = (
        Window.partitionBy("__lo", "__hi").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    )
    history = daily.select(
        "__lo", "__hi", "match_date",
        F.coalesce(F.sum("hw").over(before), F.lit(0)).alias("h2h_home_wins"),
        F.coalesce(F.sum("aw").over(before), F.lit(0)).alias("h2h_away_wins"),
        F.greatest(F.coalesce(F.sum("n").over(before), F.lit(0)), F.lit(1)).alias("h2h_total"),
    )
    paired = (matches if onto is None else onto).withColumns(pair)
    return paired.join(history, ["__lo", "__hi", "match_date"], "left").drop("__lo", "__hi")


def expand_positions(importances: DataFrame, weights: Mapping[str, Mapping[str, float]] = POSITION_WEIGHTS, positions: Sequence[str] = POSITIONS) -> DataFrame:
    """Feature importances spread over positions; unknown features split evenly.

    Input: feature_name, importance. The weight matrix is a fixed small table, held as
    a map literal, so each feature row expands in place without a join.
    """
    even = round(1.0 / len(positions), 4)

    def as_map(entries: Mapping[str, float]):
        return F.create_map(*[F.lit(x) for p, w in entries.items() for x in (p, float(w))])

    spread = as_map({p: even for p in positions})
    for feature, entries in weights.items():
        spread = F.when(F.col("feature_name") == feature, as_map(entries)).otherwise(spread)
    rows = importances.select("feature_name", "importance", F.explode(spread).alias("position", "weight"))
    return rows.select(
        "position",
        F.col("feature_name").alias("team_feature"),
        half_even(F.col("weight"), 4).alias("contribution_weight"),
        half_even(F.col("importance"), 4).alias("team_feature_importance"),
        half_even(F.col("weight") * F.col("importance"), 6).alias("positional_value"),
    )
