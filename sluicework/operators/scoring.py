"""Scores, indices, rivalry and trend logic on entity tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework.functions import constants as K
from sluicework.functions.scalar import flag, half_even, recency_weight, steady_mean, weighted_sum
from sluicework.operators.aggregates import best_row, own_top_quartile, weighted_means
from sluicework.operators.skew import exact_quantiles, rank_rows
from sluicework.session import cut_lineage


def _one_row(stats: DataFrame) -> Column:
    """A one-row aggregate as a scalar subquery; fields are read from the struct."""
    return stats.select(F.struct(*stats.columns)).scalar()


def min_max(df: DataFrame, columns: Sequence[str], invert: Sequence[str] = (), prefix: str = "norm_") -> DataFrame:
    """Each column on 0..1 over the table; a constant column is 0 before inversion."""
    stats = _one_row(
        df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    )
    made = {}
    for c in columns:
        low, high = stats[f"lo_{c}"], stats[f"hi_{c}"]
        scaled = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0))
        made[f"{prefix}{c}"] = F.lit(1.0) - scaled if c in invert else scaled
    return df.withColumns(made)


def composite_index(
    df: DataFrame, weights: Mapping[str, float], invert: Sequence[str] = (), extra: Column | None = None
) -> DataFrame:
    """Min-max each metric, add them up by weight (plus ``extra``), rounded to 4 places.

    The extremes and the scores both read the entity table, so it should be a stored one.
    """
    scaled = min_max(df, list(weights), invert)
    total = weighted_sum({f"norm_{c}": w for c, w in weights.items()})
    if extra is not None:
        total = total + extra
    return scaled.withColumn("composite_score", half_even(total, 4))


def longevity(df: DataFrame, column: str = "seasons_active", weight: float = K.LONGEVITY_WEIGHT) -> Column:
    stats = _one_row(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    return (F.col(column) - stats["lo"]) / F.greatest(stats["hi"] - stats["lo"], F.lit(1)) * F.lit(weight)


def season_z_scores(df: DataFrame, season: str, columns: Sequence[str]) -> DataFrame:
    """``z_<column>`` within each season by population deviation; NULL counts as 0.

    Season statistics are a grouped aggregate joined back, not a window: one season may
    hold a third of the rows and would otherwise be a single task.
    """
    filled = df.withColumns({f"__f_{c}": F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns})
    stats = filled.groupBy(season).agg(
        *[F.avg(f"__f_{c}").alias(f"__m_{c}") for c in columns],
        *[F.stddev_pop(f"__f_{c}").alias(f"__d_{c}") for c in columns],
    )
    z = {
        f"z_{c}": F.when(
            F.col(f"__d_{c}") > 0, (F.col(f"__f_{c}") - F.col(f"__m_{c}")) / F.col(f"__d_{c}")
        ).otherwise(F.lit(0.0))
        for c in columns
    }
    return filled.join(stats, season).withColumns(z).select(*df.columns, *z)


def dominance_seasons(
    df: DataFrame,
    season: str = "year",
    pillars: Mapping[str, Sequence[tuple[str, int]]] = K.PILLARS,
    weights: Mapping[str, float] = K.PILLAR_WEIGHTS,
) -> DataFrame:
    """Pillar scores (mean signed z-score of their features) and their weighted sum."""
    features = sorted({f for members in pillars.values() for f, _ in members})
    scored = season_z_scores(df, season, features)
    for pillar, members in pillars.items():
        total = F.lit(0.0)
        for feature, sign in members:
            total = total + F.col(f"z_{feature}") * F.lit(float(sign))
        scored = scored.withColumn(f"pillar_{pillar}", total / F.lit(len(members)))
    scored = scored.withColumn("dominance_score", weighted_sum({f"pillar_{p}": w for p, w in weights.items()}))
    return scored.drop(*[f"z_{f}" for f in features])


def dominance_rankings(seasons: DataFrame) -> DataFrame:
    """All-time ranking: 60 % mean dominance, 40 % peak season."""
    seasons = cut_lineage(seasons)
    totals = seasons.groupBy("team").agg(
        F.avg("dominance_score").alias("mean_dominance"),
        F.max("dominance_score").alias("peak_dominance"),
        F.sum("wins").alias("total_wins"),
        F.sum("losses").alias("total_losses"),
        F.avg("win_loss_perc").alias("avg_win_pct"),
        F.avg("points_per_game").alias("avg_points_per_game"),
        F.avg("points_opp_per_game").alias("avg_points_opp_per_game"),
    )
    best = best_row(seasons, ["team"], "dominance_score", "year", "best_season_year", "year")
    top = own_top_quartile(seasons, "team", "dominance_score", "seasons_top_8")
    joined = totals.join(best, "team").join(top, "team")
    scored = joined.withColumn(
        "composite_score", F.col("mean_dominance") * 0.6 + F.col("peak_dominance") * 0.4
    )
    ranked = rank_rows(scored, [F.desc("composite_score"), F.asc("team")])
    rounded = [
        "composite_score", "mean_dominance", "peak_dominance",
        "avg_win_pct", "avg_points_per_game", "avg_points_opp_per_game",
    ]
    ranked = ranked.withColumns({c: half_even(F.col(c), 4) for c in rounded})
    return ranked.select(
        "rank", "team", "composite_score", "mean_dominance", "peak_dominance", "seasons_top_8",
        "total_wins", "total_losses", "avg_win_pct", "avg_points_per_game",
        "avg_points_opp_per_game", "best_season_year",
    )


def flag_elite(df: DataFrame, score: str, out: str = "is_elite", season: str | None = None, share: float = 0.75) -> DataFrame:
    """1 for rows at or above the quantile of ``score``, per season or over the table."""
    if season is None:
        bar = exact_quantiles(df, [score], [share]).select("q0").scalar()
        return df.withColumn(out, flag(F.col(score) >= bar))
    bars = exact_quantiles(df, [score], [share], [season]).select(season, F.col("q0").alias("__bar"))
    return df.join(bars, season, "left").withColumn(out, flag(F.col(score) >= F.col("__bar"))).drop("__bar")


def elite_profile(df: DataFrame, features: Sequence[str], elite: str = "is_elite") -> DataFrame:
    """Elite quartiles against the league median, one row per feature."""
    best = exact_quantiles(df.where(F.col(elite) == 1), features, [0.25, 0.5, 0.75]).select(
        "feature",
        half_even(F.col("q0"), 4).alias("elite_p25"),
        half_even(F.col("q1"), 4).alias("elite_median"),
        half_even(F.col("q2"), 4).alias("elite_p75"),
    )
    league = exact_quantiles(df, features, [0.5]).select("feature", half_even(F.col("q0"), 4).alias("league_median"))
    joined = best.join(league, "feature")
    gap = half_even(F.col("elite_median") - F.col("league_median"), 4)
    return joined.withColumnRenamed("feature", "feature_name").withColumn("gap", gap)


def elite_advantage(df: DataFrame, features: Sequence[str], elite: str = "is_elite") -> DataFrame:
    """Elite mean, league mean and their difference, one row per feature."""
    rows = [
        F.struct(
            F.lit(c).alias("feature_name"),
            half_even(F.avg(F.when(F.col(elite) == 1, F.col(c).cast("double"))), 4).alias("elite_mean"),
            half_even(F.avg(F.col(c).cast("double")), 4).alias("league_mean"),
        )
        for c in features
    ]
    table = df.agg(F.array(*rows).alias("e")).select(F.inline("e"))
    return table.withColumn("elite_advantage", half_even(F.col("elite_mean") - F.col("league_mean"), 4))


def modern_dominance(seasons: DataFrame) -> DataFrame:
    """Recency-weighted win rate and margin per team, and their blend."""
    newest = seasons.agg(F.max("year").alias("y")).scalar()
    weighted = seasons.withColumn("__w", recency_weight(newest - F.col("year")))
    means = weighted_means(
        weighted, ["team"], {"win_rate": "modern_win_rate", "avg_margin": "modern_avg_margin"}, "__w"
    )
    blend = F.col("modern_win_rate") * 0.6 + F.greatest("modern_avg_margin", F.lit(0.0)) / 30 * 0.4
    return means.withColumn("modern_dominance", half_even(blend, 4))


def multi_year_windows(seasons: DataFrame, measures: Mapping[str, tuple[str, int]], span: int = 5, least: int = 3) -> DataFrame:
    """Means over every ``span`` consecutive years present, teams with ``least`` seasons.

    ``measures``: output name to (column, digits). Each season goes to the at most
    ``span`` windows that cover it; the year list has one row per calendar year.
    """
    seasons, by_year = cut_lineage(seasons), Window.orderBy("year")
    years = (
        seasons.select("year").distinct()
        .withColumn("__i", F.row_number().over(by_year) - 1)
        .withColumn("__count", F.count("*").over(Window.partitionBy()))
    )
    first, last = F.greatest(F.col("__i") - (span - 1), F.lit(0)), F.least("__i", F.col("__count") - span)
    placed = seasons.join(
        years.where(first <= last).withColumn("__start", F.explode(F.sequence(first, last))).select("year", "__start"),
        "year",
    )
    grouped = placed.groupBy("team", "__start").agg(
        F.count("*").alias("seasons_in_window"),
        *[half_even(steady_mean(c), digits).alias(out) for out, (c, digits) in measures.items()],
    )
    starts = years.select(F.col("__i").alias("__start"), F.col("year").alias("window_start"))
    ends = years.select((F.col("__i") - (span - 1)).alias("__start"), F.col("year").alias("window_end"))
    return (
        grouped.where(F.col("seasons_in_window") >= least)
        .join(starts, "__start").join(ends, "__start")
        .select("team", "window_start", "window_end", "seasons_in_window", *measures)
    )


def trajectories(windows: DataFrame, measure: str = "avg_win_rate", bound: float = 0.015) -> DataFrame:
    """Slope of a measure over a team's windows in order: improving, declining, stable."""
    nth = F.row_number().over(Window.partitionBy("team").orderBy("window_start")) - 1  # one row per year
    slopes = (
        windows.withColumn("__x", nth)
        .groupBy("team")
        .agg(F.count("*").alias("n_windows"), F.regr_slope(F.col(measure), F.col("__x")).alias("slope"))
    )
    trend = (
        F.when(F.col("n_windows") < 3, "stable")
        .when(F.col("slope") > bound, "improving")
        .when(F.col("slope") < -bound, "declining")
        .otherwise("stable")
    )
    return slopes.withColumn("trajectory", trend)


# Measures of the trend table, (column, digits).
TREND_MEASURES = {
    "avg_win_rate": ("win_rate", 3),
    "avg_margin": ("avg_margin", 2),
    "avg_close_game_wr": ("close_game_win_rate", 3),
    "avg_bounce_back": ("bounce_back_rate", 3),
}


def team_trends(seasons: DataFrame) -> DataFrame:
    windows = cut_lineage(multi_year_windows(seasons, TREND_MEASURES))
    return windows.join(trajectories(windows).select("team", "trajectory"), "team")


def swot(profiles: DataFrame, names: Mapping[str, str] = K.TACTICAL_NAMES, lower: Sequence[str] = K.LOWER_IS_BETTER) -> DataFrame:
    """First three strengths and weaknesses by table quartiles, in column order."""
    columns, profiles = list(names), cut_lineage(profiles)
    quartiles = exact_quantiles(profiles, columns, [0.25, 0.75])
    bars = quartiles.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("q0", "q1")))).alias("m")
    ).scalar()  # one entry per column
    good, bad = [], []
    for c in columns:
        low = F.col(c) <= bars[c]["q0"]
        high = F.col(c) >= bars[c]["q1"]
        plus, minus = (low, high) if c in lower else (high, low)
        good.append(F.when(plus, F.lit(names[c])))
        bad.append(F.when(minus & ~F.coalesce(plus, F.lit(False)), F.lit(names[c])))

    def first_three(marks: list[Column]) -> Column:
        kept = F.slice(F.array_compact(F.array(*marks)), 1, 3)
        return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise("None")

    return profiles.withColumns({"strengths": first_three(good), "weaknesses": first_three(bad)})


def cluster_deviations(rows: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """(cluster, feature): cluster size and mean against the mean of the table.

    One pass sums every column per cluster; only those sums are turned into rows, and the
    table mean adds them up again.
    """
    cells = [
        F.struct(F.lit(c).alias("feature"), F.sum(F.col(c).cast("double")).alias("s"), F.count(c).alias("n"))
        for c in columns
    ]
    sums = rows.groupBy(cluster).agg(F.count("*").alias("size"), F.array(*cells).alias("f")).select(cluster, "size", F.inline("f"))
    overall = sums.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("global_mean"))
    means = sums.withColumn("cluster_mean", F.col("s") / F.col("n")).drop("s", "n")
    return means.join(overall, "feature").withColumn("diff", F.col("cluster_mean") - F.col("global_mean"))


def cluster_profile(rows: DataFrame, cluster: str, columns: Sequence[str], n: int = 5) -> DataFrame:
    """Size, share and the ``n`` most deviating features of each cluster."""
    deviations = cluster_deviations(rows, cluster, columns)
    total = rows.agg(F.count("*").alias("n")).scalar()
    far = Window.partitionBy(cluster).orderBy(F.desc(F.abs("diff")), "feature")  # one row per feature
    return (
        deviations.withColumn("place", F.row_number().over(far))
        .where(F.col("place") <= n)
        .select(
            cluster, "size", half_even(F.lit(100.0) * F.col("size") / total, 1).alias("pct"),
            "place", "feature", half_even(F.col("cluster_mean"), 3).alias("cluster_mean"),
        )
    )


def top_two_labels(rows: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Cluster name: its up to two features furthest above the table mean."""
    deviations = cluster_deviations(rows, cluster, columns)
    above = Window.partitionBy(cluster).orderBy(F.desc("diff"), "feature")
    top = deviations.withColumn("place", F.row_number().over(above)).where(F.col("place") <= 2)
    parts = F.sort_array(F.collect_list(F.when(F.col("diff") > 0, F.struct("place", "feature"))))
    named = top.groupBy(cluster).agg(F.array_join(F.transform(parts, lambda p: p["feature"]), "-").alias("__label"))
    label = F.when(F.col("__label") == "", F.concat(F.lit("cluster_"), F.col(cluster))).otherwise(F.col("__label"))
    return named.select(cluster, label.alias("archetype_label"))


def ranked_labels(rows: DataFrame, cluster: str, labels: Sequence[str], score: str = "composite_score") -> DataFrame:
    """Labels handed out by descending mean score; the last label repeats."""
    means = rows.groupBy(cluster).agg(F.avg(score).alias("mean_score"))
    place = F.row_number().over(Window.orderBy(F.desc("mean_score"), cluster))  # one row per cluster
    names = F.array(*[F.lit(x) for x in labels])
    return means.withColumn("archetype_label", F.element_at(names, F.least(place, F.lit(len(labels)))))


def style_labels(profiles: DataFrame, cluster: str, columns: Sequence[str] = tuple(K.TACTICAL_NAMES)) -> DataFrame:
    """Style name from the most deviating tactical column of each cluster."""
    deviations = cluster_deviations(profiles, cluster, columns)
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature"))
    widest = F.struct(F.abs("diff"), -position)
    top = deviations.groupBy(cluster).agg(
        F.max_by("feature", widest).alias("top"),
        F.max_by("diff", widest).alias("d"),
        F.max(F.when(F.col("feature") == "win_rate", F.col("diff"))).alias("win_diff"),
    )
    up, down = F.col("d") > 0, F.col("d") < 0
    # Style names.
    style = (
        F.when((F.col("top") == "attack_defense_ratio") & up, "high-scoring attackers")
        .when((F.col("top") == "consistency_score") & down, "consistent grinders")
        .when((F.col("top") == "home_dependency") & up, "home specialists")
        .when(F.col("top").isin("bounce_back_rate", "close_game_win_rate") & up, "clutch performers")
        .when((F.col("top") == "late_season_win_rate") & up, "late-season surgers")
        .when(F.col("win_diff") < -0.05, "rebuilding")
        .otherwise("balanced")
    )
    return top.select(cluster, style.alias("playing_style"))


def team_overperformance(predictions: DataFrame, signed: bool = False) -> DataFrame:
    """Mean match residual per team over both roles, lowest first.

    By default the away residual counts with the sign it has from the home side, so the
    figure equals the pooled mean. With ``signed`` the away residual is turned round.
    """
    turn = F.lit(-1.0) if signed else F.lit(1.0)
    sides = F.array(
        F.struct(F.col("home_team").alias("team"), F.col("residual").alias("r")),
        F.struct(F.col("away_team").alias("team"), (F.col("residual") * turn).alias("r")),
    )
    pooled = predictions.select(F.inline(sides)).groupBy("team").agg(
        half_even(steady_mean("r"), 4).alias("avg_overperformance"), F.count("*").alias("total_matches")
    )
    return rank_rows(pooled, [F.asc("avg_overperformance"), F.asc("team")], "overperformance_rank")
