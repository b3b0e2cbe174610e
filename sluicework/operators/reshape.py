"""Row and column reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.functions.scalar import flag


def both_sides(matches: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Two rows per match, one seen from each team, in a single scan.

    Input columns: home_team, away_team, home_score, away_score. Output: ``keep`` plus
    team, opponent, pf, pa, margin, win, draw, loss, is_home.
    """
    played = matches.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())

    def side(us: str, them: str, home: int):
        return F.struct(
            F.col(f"{us}_team").alias("team"),
            F.col(f"{them}_team").alias("opponent"),
            F.col(f"{us}_score").alias("pf"),
            F.col(f"{them}_score").alias("pa"),
            F.lit(home).alias("is_home"),
        )

    sides = played.select(*keep, F.inline(F.array(side("home", "away", 1), side("away", "home", 0))))
    return sides.withColumns(
        {
            "margin": F.col("pf") - F.col("pa"),
            "win": flag(F.col("pf") > F.col("pa")),
            "draw": flag(F.col("pf") == F.col("pa")),
            "loss": flag(F.col("pf") < F.col("pa")),
        }
    )


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (id, column), NULLs kept."""
    cells = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*ids, F.inline(F.array(*cells)))


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns aligned by name, missing ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_owner(frames: Mapping[str, DataFrame], skip: Sequence[str]) -> dict[str, list[str]]:
    """Columns each frame contributes to a wide join: the first frame with a name owns it."""
    seen, owned = set(skip), {}
    for label, frame in frames.items():
        owned[label] = [c for c in frame.columns if c not in seen]
        seen.update(owned[label])
    return owned
