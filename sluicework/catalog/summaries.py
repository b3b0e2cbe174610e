"""Aggregation queries and the score, trend and profile logic built on them."""

from pyspark.sql import functions as F

from sluicework.catalog import relations as R
from sluicework.catalog import views as V
from sluicework.catalog.registry import query
from sluicework.catalog.sql import big, cents, div, even, exact_mean, n_if, up, using
from sluicework.functions import constants as K
from sluicework.functions import scalar as S
from sluicework.operators import aggregates as A
from sluicework.operators import joins as J
from sluicework.operators import ledger as L
from sluicework.operators import scoring as C
from sluicework.operators.learning import impact_score
from sluicework.operators.skew import exact_quantiles
from sluicework.plans import analyses as P
from sluicework.plans import bindings as B
from sluicework.session import cut_lineage


@query("agg_entity_season", sql=f"""SELECT l_custkey, year, count(*) AS race_entries, sum(points) AS total_points, {n_if('place = 1')} AS wins, {n_if('place <= 3')} AS podiums,
  {n_if('fin = 1')} AS finishes, {n_if('fin = 0')} AS retirements, {up(div(n_if('fin = 1'), 'count(*)'), 3)} AS reliability_pct,
  {up('avg(place)', 2)} AS avg_finish_position, {up('avg(grid)', 2)} AS avg_grid_position, {up('avg(grid - place)', 2)} AS avg_positions_gained,
  {up(div('sum(points)', 'count(DISTINCT race)'), 2)} AS points_per_race, {up(div(n_if('place = 1'), 'count(DISTINCT race)'), 3)} AS win_rate,
  {up(div(n_if('place <= 3'), 'count(DISTINCT race)'), 3)} AS podium_rate
FROM (SELECT o_custkey AS l_custkey, year(o_orderdate) AS year, l_orderkey AS race, CAST(l_linenumber AS BIGINT) AS grid, CAST(floor(l_quantity) AS BIGINT) AS place,
  CAST({cents('l_discount')} AS DOUBLE) AS points, CAST(l_returnflag <> 'R' AS INTEGER) AS fin FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
GROUP BY ALL HAVING count(*) >= 5""")
def agg_entity_season(t):
    """Customer-season totals and rates; the entry minimum drops many small groups."""
    li = t.lineitem.select(
        F.col("l_orderkey").alias("raceId"), F.col("l_linenumber").cast("long").alias("grid"),
        B.whole("l_quantity").alias("positionOrder"), B.cents("l_discount").cast("double").alias("points"),
        S.flag(F.col("l_returnflag") != "R").alias("finished"),
    )
    o = t.orders.select(F.col("o_orderkey").alias("raceId"), F.col("o_custkey").alias("l_custkey"), F.year("o_orderdate").cast("long").alias("year"))
    return A.season_rates(J.join_large(li, o, "raceId"), ["l_custkey", "year"])


query("agg_home_away", sql=using("team_season", body="SELECT team, year, games_played, wins, draws, losses, home_win_rate, away_win_rate, blowout_rate, close_game_win_rate, margin_stddev, points_differential FROM team_season"))(
    lambda t: V.season_view(t).select("team", "year", "games_played", "wins", "draws", "losses", "home_win_rate", "away_win_rate", "blowout_rate", "close_game_win_rate", "margin_stddev", "points_differential")
)
query("agg_tactical", sql=using("coaching", body="SELECT team, year, consistency_score, home_dependency, early_season_win_rate, late_season_win_rate, bounce_back_rate, streak_maintenance_rate, blowout_loss_rate, attack_defense_ratio FROM coaching"))(
    lambda t: V.coaching_view(t).select("team", "year", "consistency_score", "home_dependency", "early_season_win_rate", "late_season_win_rate", "bounce_back_rate", "streak_maintenance_rate", "blowout_loss_rate", "attack_defense_ratio")
)


@query("agg_countif", sql=f"""SELECT o_orderpriority, {n_if("o_orderstatus = 'F'")} AS n_f, {n_if('o_totalprice > 250000')} AS n_large,
  {n_if("nullif(o_orderstatus, 'F') = 'O'")} AS n_open FROM orders GROUP BY o_orderpriority""")
def agg_countif(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(
        F.count_if(s == "F").alias("n_f"), F.count_if(F.col("o_totalprice") > 250000).alias("n_large"),
        F.count_if(F.nullif(s, F.lit("F")) == "O").alias("n_open"),
    )


@query("agg_distinct", sql="SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey")
def agg_distinct(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct("l_partkey").alias("n_parts"))


@query("agg_first", sql="SELECT l_suppkey, min(s_name) AS supplier, min(n_name) AS nation, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_suppkey")
def agg_first(t):
    """Group constants: ``min`` gives the same value whichever row comes first."""
    named = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return t.lineitem.join(named, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_suppkey").agg(
        F.min("s_name").alias("supplier"), F.min("n_name").alias("nation"), F.count("*").alias("n")
    )


query("agg_race_driver", sql=using("race_driver", body="SELECT * FROM race_driver"))(lambda t: A.race_driver_stops(V.pitstop_view(t)))

CREWS = f"""SELECT constructor, year, {even(exact_mean('stop_duration_sec'), 3)} AS avg_pit_duration, {even('min(stop_duration_sec)', 3)} AS min_pit_duration,
  count(stop_number) AS total_pit_stops, {even('avg(positions_gained)', 3)} AS avg_positions_gained FROM pit_features GROUP BY constructor, year"""
query("agg_pit_stats", sql=using("pit_features", body=CREWS))(lambda t: A.pit_crew_stats(V.pitstop_view(t)))
query("agg_fastest_crews", sql=using("pit_features", body=f"SELECT constructor, year, avg_pit_duration, total_pit_stops FROM ({CREWS}) WHERE year >= 2000 ORDER BY avg_pit_duration, constructor, year LIMIT 10"))(
    lambda t: A.fastest_crews(A.pit_crew_stats(V.pitstop_view(t)), since=2000)
)


@query("agg_argmax", sql=using("constructor_season", body="SELECT constructor, arg_max(year, points_per_race * 100000 - year) AS peak_season FROM constructor_season GROUP BY constructor"))
def agg_argmax(t):
    return A.best_row(V.constructor_view(t), ["constructor"], "points_per_race", "year", "peak_season", "year")


_Q = ["points", "mov", "rush_share"]


@query("agg_quantile", sql=using("team_features", body=" UNION ALL ".join(
    f"SELECT year, '{c}' AS feature, " + ", ".join(f"{up(f'quantile_cont({c}, {p})', 6)} AS q{i}" for i, p in enumerate((0.25, 0.5, 0.75))) + " FROM team_features GROUP BY year"
    for c in _Q
)))
def agg_quantile(t):
    found = exact_quantiles(cut_lineage(V.team_view(t)), _Q, [0.25, 0.5, 0.75], ["year"])
    return found.select("year", "feature", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(3)])


@query("agg_weighted_mean", sql=using("team_season", body=f"""SELECT team, {up('sum(win_rate * w) / sum(w)', 6)} AS win_rate_now, {up('sum(avg_margin * w) / sum(w)', 6)} AS margin_now
  FROM (SELECT *, exp(-0.07::DOUBLE * (max(year) OVER () - year)) AS w FROM team_season) GROUP BY team"""))
def agg_weighted_mean(t):
    s = cut_lineage(V.season_view(t))
    newest = s.agg(F.max("year").alias("y")).scalar()
    weighted = A.weighted_means(
        s.withColumn("w", S.recency_weight(newest - F.col("year"))), ["team"], {"win_rate": "win_rate_now", "avg_margin": "margin_now"}, "w"
    )
    return weighted.select("team", F.round("win_rate_now", 6).alias("win_rate_now"), F.round("margin_now", 6).alias("margin_now"))


@query("agg_own_top_quartile", sql=using("team_features", body="""SELECT team, count(*) FILTER (WHERE points >= bar) AS seasons_top FROM team_features
  JOIN (SELECT team, quantile_cont(points, 0.75) AS bar FROM team_features GROUP BY team) USING (team) GROUP BY team"""))
def agg_own_top_quartile(t):
    return A.own_top_quartile(cut_lineage(V.team_view(t)), "team", "points", "seasons_top")


RIVALRY = f"""SELECT team, opponent, count(*) AS total_matches, {n_if('win = 1')} AS wins, {n_if('win = 0')} AS losses, {even('sum(win) / count(*)', 3)} AS win_rate,
  {even('avg(margin)', 2)} AS avg_margin, {even(div(n_if('is_home = 1 AND win = 1'), n_if('is_home = 1')), 3)} AS home_win_rate,
  CAST({even('sum(win) / count(*)', 3)} > 0.6 AND count(*) >= 10 AS BIGINT) AS is_dominant FROM sides GROUP BY team, opponent"""
query("agg_rivalry", sql=using("sides", body=RIVALRY))(lambda t: A.rivalry_matrix(R.matches(t)))


def predictions(t):
    """Order prices against the price their line count suggests: a fixed-rule prediction."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum(B.cents("l_extendedprice")) / 100).alias("predicted_price"))
    o = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("actual_price"))
    joined = o.join(lines, "o_orderkey")
    return joined.withColumn("residual", F.round(F.col("predicted_price") - F.col("actual_price"), 2))


PREDICTIONS = f"""predictions AS (SELECT o_orderkey, o_custkey, o_totalprice AS actual_price, predicted_price, {up('predicted_price - o_totalprice', 2)} AS residual
  FROM orders JOIN (SELECT l_orderkey, CAST(sum({cents('l_extendedprice')}) AS DOUBLE) / 100 AS predicted_price FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
QUALITY = f"""SELECT count(*) AS total, {up('power(corr(predicted_price, actual_price), 2)', 4)} AS r2_approx, {up('avg(abs(residual))', 4)} AS mae,
  {up('sqrt(avg(residual * residual))', 4)} AS rmse, {up('avg(residual)', 4)} AS mean_residual FROM predictions"""
query("agg_regression_quality", sql=f"WITH {PREDICTIONS} {QUALITY}")(
    lambda t: A.regression_quality(predictions(t), "predicted_price", "actual_price")
)


def scored_events(t):
    """Events scored by value, errors flagged: input for the anomaly summaries."""
    return t.events.select(
        "event_id", "event_type", "user_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("anomaly_score"),
        S.flag(F.col("event_type") == "error").cast("long").alias("is_anomaly"),
    )


SCORED = "scored AS (SELECT event_id, event_type, user_id, least(value / 100, 1.0::DOUBLE) AS anomaly_score, CAST(event_type = 'error' AS BIGINT) AS is_anomaly FROM events)"
SUMMARY = f"SELECT count(*) AS total, {n_if('is_anomaly = 1')} AS anomaly_count, {up('avg(anomaly_score)', 4)} AS avg_score, {up('max(anomaly_score)', 4)} AS max_score FROM scored"
query("agg_anomaly_summary", sql=f"WITH {SCORED} {SUMMARY}")(lambda t: A.anomaly_summary(scored_events(t)))
query("agg_histogram", sql=f"WITH {SCORED} SELECT CAST(least(floor(anomaly_score * 10), 9) AS BIGINT) AS bucket, {n_if('is_anomaly <> 1')} AS normal, {n_if('is_anomaly = 1')} AS anomaly FROM scored GROUP BY 1")(
    lambda t: A.score_histogram(scored_events(t), "anomaly_score", "is_anomaly")
)


def clustered_customers(t):
    """Customers with their order totals; the market segment stands for a cluster."""
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum(B.whole("o_totalprice")).alias("spent"))
    c = t.customer.withColumn("cluster_id", (F.length("c_mktsegment") - 8).cast("long"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", "cluster_id", "c_name", "c_nationkey", "n_orders", "spent", (B.whole("c_acctbal") % 10000 / 10000).alias("score")
    )


CLUSTERED = """clustered AS (SELECT c_custkey, CAST(length(c_mktsegment) - 8 AS BIGINT) AS cluster_id, c_name, c_nationkey, n_orders, spent, CAST(CAST(floor(c_acctbal) AS BIGINT) % 10000 AS DOUBLE) / 10000 AS score
  FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders, CAST(sum(floor(o_totalprice)) AS BIGINT) AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
METRICS = " UNION ALL ".join(
    f"SELECT cluster_id, count(*) AS record_count, 'avg_{c}' AS metric, {up(f'avg({c})', 2)} AS value FROM clustered GROUP BY cluster_id" for c in ("c_nationkey", "n_orders", "spent")
)


def cluster_metrics(t):
    return A.cluster_metrics_long(A.cluster_averages(clustered_customers(t), "cluster_id", ["c_custkey", "score"]))


query("agg_cluster_summary", sql=f"WITH {CLUSTERED} {METRICS}")(cluster_metrics)


@query("agg_metric_range", sql=f"""WITH {CLUSTERED}, long AS ({METRICS}), top AS (SELECT metric, max(value) - min(value) AS spread, greatest(max(abs(value)), 1.0::DOUBLE) AS scale FROM long GROUP BY metric ORDER BY spread DESC, metric LIMIT 6)
  SELECT metric, cluster_id, CAST(floor(value / scale * 100 + 0.5) AS BIGINT) AS scaled FROM long JOIN top USING (metric)""")
def agg_metric_range(t):
    return A.metric_radar(cluster_metrics(t))


@query("agg_metric_leaders", sql=f"WITH {CLUSTERED}, long AS ({METRICS}) SELECT metric, max(abs(value)) AS peak FROM long GROUP BY metric HAVING max(abs(value)) > 0.01 ORDER BY peak DESC, metric LIMIT 4")
def agg_metric_leaders(t):
    return A.metric_leaders(cluster_metrics(t))


def styled(t):
    """Suppliers by the trading style their nation's region stands for."""
    style = t.nation.select(F.col("n_nationkey"), F.concat(F.lit("style "), F.col("n_regionkey").cast("string")).alias("playing_style"))
    return t.supplier.join(style, F.col("s_nationkey") == F.col("n_nationkey")).select("playing_style", F.col("s_name").alias("team"))


STYLED = "styled AS (SELECT 'style ' || n_regionkey AS playing_style, s_name AS team FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
query("agg_style_summary", sql=f"WITH {STYLED} SELECT playing_style, count(*) AS style_count, string_agg(team, ', ' ORDER BY team) AS teams FROM styled GROUP BY 1")(lambda t: A.style_summary(styled(t)))
query("agg_style_members", sql=f"WITH {STYLED} SELECT DISTINCT playing_style, team FROM styled")(lambda t: A.style_members(styled(t)))
query("agg_ledger_rollup", sql=using("job_events", body=f"""SELECT coalesce(bq_table, dataset) AS table_name, count(*) AS job_count, {big('sum(loaded)')} AS total_loaded, {big('sum(file_size_bytes)')} AS total_size,
  max(updated_at) AS latest_date, CAST(CASE WHEN sum(total_records) > 0 THEN round(sum(loaded) / sum(total_records) * 100) ELSE 0 END AS BIGINT) AS completion_pct
  FROM (SELECT * FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1) GROUP BY 1"""))(
    lambda t: A.ledger_rollup(L.current_jobs(B.job_events(t)))
)
def position_values(importances):
    weights = J.expand_positions(importances)
    return A.top_features_per_position(weights).join(A.position_totals(weights), "position")


query("agg_position_value", sql=R.with_positions(f"""SELECT position, place, team_feature, {even('positional_value', 4)} AS value, total_value FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY position ORDER BY positional_value DESC, team_feature) AS INTEGER) AS place FROM weights)
  JOIN (SELECT position, {even('sum(positional_value)', 4)} AS total_value FROM weights GROUP BY position) USING (position) WHERE place <= 3"""))(
    lambda t: position_values(cut_lineage(R.importances(t)))
)

_PILLARS = [f"pillar_{p}" for p in K.PILLARS]


@query("agg_pillar_means", sql=using("dominance", body="SELECT pillar, mean_score, CAST(row_number() OVER (ORDER BY mean_score DESC, pillar) = 1 AS INTEGER) AS is_strongest FROM (" + " UNION ALL ".join(
    f"SELECT '{p}' AS pillar, {even(f'avg({p})', 4)} AS mean_score FROM dominance WHERE team = 'Supplier#000000003'" for p in _PILLARS
) + ")"))
def agg_pillar_means(t):
    return A.pillar_means(C.dominance_seasons(V.team_view(t)), "Supplier#000000003", _PILLARS)


# Scores, indices and profiles

RANKING = f"""ranking AS (SELECT team, avg(dominance_score) AS mean_d, max(dominance_score) AS peak_d, {big('sum(wins)')} AS total_wins, {big('sum(losses)')} AS total_losses,
  avg(win_loss_perc) AS win_pct, avg(points_per_game) AS ppg, avg(points_opp_per_game) AS opg, arg_max(year, dominance_score) AS best_season_year,
  quantile_cont(dominance_score, 0.75) AS bar FROM dominance GROUP BY team)"""


@query("ml_dominance_pillars", sql=using("dominance", body=f"""SELECT year, team, {even('dominance_score', 4)} AS dominance_score, """ + ", ".join(f"{even(p, 4)} AS {p}" for p in _PILLARS) + " FROM dominance"))
def ml_dominance_pillars(t):
    seasons = C.dominance_seasons(V.team_view(t))
    return seasons.select("year", "team", *[S.half_even(F.col(c), 4).alias(c) for c in ["dominance_score", *_PILLARS]])


@query("ml_dominance_ranking", sql=using("dominance", body="") + f""", {RANKING}
SELECT row_number() OVER (ORDER BY mean_d * 0.6::DOUBLE + peak_d * 0.4::DOUBLE DESC, team) AS rank, team, {even('mean_d * 0.6::DOUBLE + peak_d * 0.4::DOUBLE', 4)} AS composite_score, {even('mean_d', 4)} AS mean_dominance,
  {even('peak_d', 4)} AS peak_dominance, (SELECT count(*) FROM dominance d WHERE d.team = ranking.team AND d.dominance_score >= bar) AS seasons_top_8, total_wins, total_losses, {even('win_pct', 4)} AS avg_win_pct, {even('ppg', 4)} AS avg_points_per_game, {even('opg', 4)} AS avg_points_opp_per_game, best_season_year FROM ranking""")
def ml_dominance_ranking(t):
    return C.dominance_rankings(C.dominance_seasons(V.team_view(t)))


def _norm(c: str, inverted: bool = False) -> str:
    s = f"(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0))"
    return f"(1 - {s})" if inverted else s


_CONSTRUCTORS = """means AS (SELECT constructor, min(nationality) AS nationality, avg(points_per_race) AS mean_points_per_race, avg(win_rate) AS mean_win_rate, avg(podium_rate) AS mean_podium_rate,
  avg(reliability_pct) AS mean_reliability, avg(avg_finish_position) AS mean_avg_finish, CAST(sum(wins) AS BIGINT) AS total_wins, count(DISTINCT year) AS seasons_active FROM constructor_season GROUP BY constructor)"""


@query("ml_composite_index", sql=using("constructor_season", body="") + f", {_CONSTRUCTORS} SELECT constructor, total_wins, seasons_active, {even(' + '.join(_norm(c, c == 'mean_avg_finish') + f' * {w}::DOUBLE' for c, w in K.CONSTRUCTOR_WEIGHTS.items()), 4)} AS composite_score FROM means")
def ml_composite_index(t):
    return P.constructor_index(cut_lineage(V.constructor_view(t))).select("constructor", "total_wins", "seasons_active", "composite_score")


_LEAGUE = f"""means AS (SELECT team, avg(win_rate) AS mean_win_rate, avg(avg_margin) AS mean_avg_margin, avg(away_win_rate) AS mean_away_win_rate, avg(close_game_win_rate) AS mean_close_game_win_rate,
  avg(blowout_rate) AS mean_blowout_rate, avg(avg_points_against) AS defensive_strength, count(DISTINCT year) AS seasons_active FROM team_season GROUP BY team)"""


@query("ml_league_index", sql=using("team_season", body="") + f", {_LEAGUE} SELECT team, seasons_active, {even(' + '.join(_norm(c, c == 'defensive_strength') + f' * {w}::DOUBLE' for c, w in K.LEAGUE_WEIGHTS.items()) + ' + (seasons_active - min(seasons_active) OVER ()) / CAST(greatest(max(seasons_active) OVER () - min(seasons_active) OVER (), 1) AS DOUBLE) * 0.05::DOUBLE', 4)} AS composite_score FROM means")
def ml_league_index(t):
    return P.league_index(cut_lineage(V.season_view(t))).select("team", "seasons_active", "composite_score")


@query("ml_modern_dominance", sql=using("team_season", body=f"""SELECT team, {even('w * 0.6::DOUBLE + greatest(d, 0) / 30 * 0.4::DOUBLE', 4)} AS modern_dominance FROM (SELECT team, sum(win_rate * k) / sum(k) AS w, sum(avg_margin * k) / sum(k) AS d
  FROM (SELECT *, exp(-0.07::DOUBLE * (max(year) OVER () - year)) AS k FROM team_season) GROUP BY team)"""))
def ml_modern_dominance(t):
    return C.modern_dominance(cut_lineage(V.season_view(t))).select("team", "modern_dominance")


def form_predictions(t):
    """Matches predicted by the form gap alone: a fixed-rule margin."""
    f = V.match_view(t).dropna(subset=["home_last5_win_rate", "away_last5_win_rate"])
    predicted = F.round(F.col("form_differential") * 20, 2)
    return f.select("matchId", "home_team", "away_team", F.col("margin").alias("actual_margin"), predicted.alias("predicted_margin"), F.round(predicted - F.col("margin"), 4).alias("residual"))


FORM = f"""form AS (SELECT "matchId", home_team, away_team, margin AS actual_margin, {up('form_differential * 20', 2)} AS predicted_margin, {up(up('form_differential * 20', 2) + ' - margin', 4)} AS residual
  FROM match_features WHERE home_last5_win_rate IS NOT NULL AND away_last5_win_rate IS NOT NULL)"""


def _over(sign: str) -> str:
    return using("match_features", body="") + f""", {FORM} SELECT team, avg_overperformance, total_matches, row_number() OVER (ORDER BY avg_overperformance, team) AS overperformance_rank FROM
  (SELECT team, {even(exact_mean('r'), 4)} AS avg_overperformance, count(*) AS total_matches FROM (SELECT home_team AS team, residual AS r FROM form UNION ALL SELECT away_team, {sign}residual FROM form) GROUP BY team)"""


query("ml_overperformance", sql=_over(""))(lambda t: C.team_overperformance(form_predictions(t)))
query("ml_overperformance_signed", sql=_over("-"))(lambda t: C.team_overperformance(form_predictions(t), signed=True))


def _swot_sql() -> str:
    bars = ", ".join(f"quantile_cont({c}, 0.25) AS l_{c}, quantile_cont({c}, 0.75) AS h_{c}" for c in K.TACTICAL_NAMES)

    def marks(good: bool) -> str:
        cells = []
        for c, name in K.TACTICAL_NAMES.items():
            low, high = f"{c} <= l_{c}", f"{c} >= h_{c}"
            plus, minus = (low, high) if c in K.LOWER_IS_BETTER else (high, low)
            cells.append(f"CASE WHEN {plus} THEN '{name}' END" if good else f"CASE WHEN {minus} AND NOT ({plus}) THEN '{name}' END")
        kept = f"list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL)[1:3]"
        return f"CASE WHEN len({kept}) = 0 THEN 'None' ELSE array_to_string({kept}, ', ') END"

    return using("profiles", body="") + f", bars AS (SELECT {bars} FROM profiles) SELECT team, {marks(True)} AS strengths, {marks(False)} AS weaknesses FROM profiles, bars"


@query("ml_swot", sql=_swot_sql())
def ml_swot(t):
    return C.swot(P.tactical_profiles(V.coaching_view(t))).select("team", "strengths", "weaknesses")


@query("ml_optimal_profile", sql=using("team_features", body="") + ", e AS (SELECT *, win_loss_perc >= quantile_cont(win_loss_perc, 0.75) OVER (PARTITION BY year) AS elite FROM team_features) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature_name, elite_p25, elite_median, elite_p75, league_median, {even('elite_median - league_median', 4)} AS gap FROM (SELECT "
    + ", ".join(f"{even(f'quantile_cont({c}, {p}) FILTER (WHERE elite)', 4)} AS {n}" for p, n in ((0.25, "elite_p25"), (0.5, "elite_median"), (0.75, "elite_p75")))
    + f", {even(f'quantile_cont({c}, 0.5)', 4)} AS league_median FROM e)"
    for c in ("points", "mov", "rush_share", "pass_td")
))
def ml_optimal_profile(t):
    flagged = C.flag_elite(cut_lineage(V.team_view(t)), "win_loss_perc", season="year")
    return C.elite_profile(flagged, ["points", "mov", "rush_share", "pass_td"])


@query("ml_elite_advantage", sql=using("team_features", body="") + ", e AS (SELECT *, points >= (SELECT quantile_cont(points, 0.75) FROM team_features) AS elite FROM team_features) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature_name, elite_mean, league_mean, {even('elite_mean - league_mean', 4)} AS elite_advantage FROM (SELECT {even(f'avg({c}) FILTER (WHERE elite)', 4)} AS elite_mean, {even(f'avg({c})', 4)} AS league_mean FROM e)"
    for c in ("wins", "pass_td", "penalties")
))
def ml_elite_advantage(t):
    return C.elite_advantage(C.flag_elite(cut_lineage(V.team_view(t)), "points"), ["wins", "pass_td", "penalties"])


# Clusters given by a column of the data, so that every step after the fit has an oracle

_EMB = range(0, 64)


def _unnested() -> str:
    return "e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(range(0, 64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


_DEVIATIONS = f"{_unnested()}, dev AS (SELECT label, 'e' || d AS feature, count(*) AS size, avg(x) AS cm, avg(x) - any_value(g) AS diff FROM e JOIN (SELECT d, avg(x) AS g FROM e GROUP BY d) USING (d) GROUP BY label, d)"


@query("ml_cluster_profile", sql=f"""WITH {_DEVIATIONS} SELECT label, size, {even('100.0 * size / (SELECT count(*) FROM embeddings)', 1)} AS pct, place, feature, {even('cm', 3)} AS cluster_mean FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY abs(diff) DESC, feature) AS INTEGER) AS place FROM dev) WHERE place <= 5""")
def ml_cluster_profile(t):
    return C.cluster_profile(B.embedding_rows(t), "label", [f"e{i}" for i in _EMB])


@query("ml_cluster_label_top2", sql=f"""WITH {_DEVIATIONS} SELECT label, coalesce(nullif(string_agg(CASE WHEN diff > 0 THEN feature END, '-' ORDER BY place), ''), 'cluster_' || label) AS archetype_label FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY diff DESC, feature) AS place FROM dev) WHERE place <= 2 GROUP BY label""")
def ml_cluster_label_top2(t):
    return C.top_two_labels(B.embedding_rows(t), "label", [f"e{i}" for i in _EMB])


@query("ml_cluster_assign", sql=f"""WITH {_unnested()}, centre AS (SELECT label, d, avg(x) AS c FROM e GROUP BY label, d)
  SELECT vec_id, label, {even('1 / (1 + sqrt(sum((x - c) * (x - c))))', 4)} AS impact_score FROM e JOIN centre USING (label, d) GROUP BY vec_id, label""")
def ml_cluster_assign(t):
    """Distance of every vector to the centre of its label, as an impact score."""
    rows = t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    parts = rows.select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("c"))
    centres = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "c"))), lambda p: p["c"]).alias("c"))
    return rows.join(centres, "label").select("vec_id", "label", impact_score(F.col("v"), F.col("c")).alias("impact_score"))


@query("ml_cluster_label_ranked", sql=using("constructor_season", body="") + f""", {_CONSTRUCTORS}, c AS (SELECT nationality, mean_win_rate + mean_podium_rate AS composite_score FROM means)
SELECT nationality, {up('avg(composite_score)', 6)} AS mean_score, list_extract(['dominant', 'competitive', 'midfield', 'backmarker', 'occasional'], least(row_number() OVER (ORDER BY avg(composite_score) DESC, nationality), 5)) AS archetype_label FROM c GROUP BY nationality""")
def ml_cluster_label_ranked(t):
    index = P.constructor_index(cut_lineage(V.constructor_view(t))).withColumn("composite_score", F.col("mean_win_rate") + F.col("mean_podium_rate"))
    labels = C.ranked_labels(index, "nationality", K.CONSTRUCTOR_LABELS)
    return labels.withColumn("mean_score", F.round("mean_score", 6))


@query("ml_cluster_label_rules", sql=using("profiles", body="") + ", g AS (SELECT *, CAST(right(team, 1) AS BIGINT) % 5 AS style_id FROM profiles), dev AS (" + " UNION ALL ".join(
    f"SELECT style_id, {i} AS pos, '{c}' AS f, avg({c}) - (SELECT avg({c}) FROM g) AS diff FROM g GROUP BY style_id" for i, c in enumerate(K.TACTICAL_NAMES)
) + """), top AS (SELECT style_id, f, diff, max(CASE WHEN f = 'win_rate' THEN diff END) OVER (PARTITION BY style_id) AS wd, row_number() OVER (PARTITION BY style_id ORDER BY abs(diff) DESC, pos) AS n FROM dev)
SELECT style_id, CASE WHEN f = 'attack_defense_ratio' AND diff > 0 THEN 'high-scoring attackers' WHEN f = 'consistency_score' AND diff < 0 THEN 'consistent grinders'
  WHEN f = 'home_dependency' AND diff > 0 THEN 'home specialists' WHEN f IN ('bounce_back_rate', 'close_game_win_rate') AND diff > 0 THEN 'clutch performers'
  WHEN f = 'late_season_win_rate' AND diff > 0 THEN 'late-season surgers' WHEN wd < -0.05 THEN 'rebuilding' ELSE 'balanced' END AS playing_style FROM top WHERE n = 1""")
def ml_cluster_label_rules(t):
    profiles = cut_lineage(P.tactical_profiles(V.coaching_view(t)))
    return C.style_labels(profiles.withColumn("style_id", F.right("team", F.lit(1)).cast("long") % 5), "style_id")


