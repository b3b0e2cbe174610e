"""Join, window, sort, set and reshape queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluicework.catalog import views as V
from sluicework.catalog.registry import query
from sluicework.catalog.sql import even, exact_mean, up, using
from sluicework.functions import constants as K
from sluicework.functions import scalar as S
from sluicework.operators import joins as J
from sluicework.operators import scoring as C
from sluicework.operators.reshape import both_sides, first_owner, stack_frames, to_long
from sluicework.operators.serving import over_and_under, top_absolute
from sluicework.operators.skew import Ordered, exact_quantiles, ordered_columns, rank_rows
from sluicework.plans import bindings as B
from sluicework.plans.feature_views import league_matches
from sluicework.session import cut_lineage
from sluicework.sources.files import preview


def matches(t):
    return league_matches(B.fixtures(t), ["matchId"])


@query("join_inner_star", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, year(o_orderdate) AS year, s_name, n_name, r_name FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def join_inner_star(t):
    fact = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    dims = [
        (t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("long").alias("year")), ["l_orderkey"], "inner"),
        (t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("n_nationkey")), ["l_suppkey"], "inner"),
        (t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), ["n_nationkey"], "inner"),
        (t.region.select("r_regionkey", "r_name"), ["r_regionkey"], "inner"),
    ]
    return J.star_join(fact, dims).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "year", "s_name", "n_name", "r_name")


@query("join_inner_composite", sql=using("pit_stops", "results", body='SELECT race_id AS "raceId", driver_id AS "driverId", stop, p.ms AS milliseconds, grid, place FROM pit_stops p JOIN results USING (race_id, driver_id)'))
def join_inner_composite(t):
    stops = B.pit_stops(t).select("raceId", "driverId", "stop", "milliseconds")
    entries = B.results(t).select("raceId", "driverId", "grid", F.col("positionOrder").alias("place"))
    return stops.join(entries, ["raceId", "driverId"])


@query("join_left", sql=using("results", "qualifying", body='SELECT result_id AS "resultId", race_id AS "raceId", driver_id AS "driverId", quali FROM results LEFT JOIN qualifying USING (race_id, driver_id)'))
def join_left(t):
    return J.star_join(
        B.results(t).select("resultId", "raceId", "driverId"),
        [(B.qualifying(t).withColumnRenamed("position", "quali"), ["raceId", "driverId"], "left")],
    )


@query("join_self_asof_rolling", sql=using("match_features", body='SELECT "matchId", home_team, away_team, home_last5_win_rate, away_last5_win_rate, form_differential FROM match_features'))
def join_self_asof_rolling(t):
    """Each match with both teams' form before it."""
    return V.match_view(t).select(
        "matchId", "home_team", "away_team", "home_last5_win_rate", "away_last5_win_rate", "form_differential"
    )


@query("join_theta_h2h", sql=using("h2h", body='SELECT match_id AS "matchId", h2h_home_wins, h2h_away_wins, h2h_total FROM h2h'))
def join_theta_h2h(t):
    return J.head_to_head(cut_lineage(matches(t))).select("matchId", "h2h_home_wins", "h2h_away_wins", "h2h_total")


@query("join_cast_keys", sql="SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)")
def join_cast_keys(t):
    people = t.customer.select(F.col("c_custkey").cast("string").alias("o_custkey"), "c_name", "c_mktsegment")
    return J.join_as_text(t.orders.select("o_orderkey", "o_custkey"), people, "o_custkey")


@query("join_outer", sql=using("m", body="""SELECT team, coalesce(h, 0) AS home_matches, coalesce(a, 0) AS away_matches FROM
  (SELECT home_team AS team, count(*) AS h FROM m WHERE home_score >= 40 GROUP BY 1) FULL JOIN
  (SELECT away_team AS team, count(*) AS a FROM m WHERE away_score >= 45 GROUP BY 1) USING (team)"""))
def join_outer(t):
    m = matches(t)
    home = m.where("home_score >= 40").groupBy(F.col("home_team").alias("team")).agg(F.count("*").alias("home_matches"))
    away = m.where("away_score >= 45").groupBy(F.col("away_team").alias("team")).agg(F.count("*").alias("away_matches"))
    return J.full_join_zero(home, away, ["team"])


@query("join_lookup", sql=using("team_features", body=f"""SELECT year, team, win_loss_perc, {up('bar', 9)} AS bar, CAST(win_loss_perc >= bar AS INTEGER) AS is_elite FROM team_features
  JOIN (SELECT year, quantile_cont(win_loss_perc, 0.75) AS bar FROM team_features GROUP BY year) USING (year)"""))
def join_lookup(t):
    teams = cut_lineage(V.team_view(t))
    bars = exact_quantiles(teams, ["win_loss_perc"], [0.75], ["year"]).select("year", F.col("q0").alias("bar"))
    joined = teams.join(bars, "year")
    return joined.select("year", "team", "win_loss_perc", F.round("bar", 9).alias("bar"), S.flag(F.col("win_loss_perc") >= F.col("bar")).alias("is_elite"))


# Team features as rows of importance: their variation over the table.
_IMPORTANT = ["pass_yds_per_game", "interception_pct", "rush_td", "yards_per_game", "turnovers", "penalties", "rush_share", "pass_td"]


def importances(t):
    """Feature importances without a model: spread relative to the mean."""
    long = to_long(V.team_view(t), [], _IMPORTANT, "feature_name", "v")
    return long.groupBy("feature_name").agg(F.round(F.stddev_pop("v") / F.avg("v"), 4).alias("importance"))


def _positions_sql() -> str:
    cells = [
        f"('{f}', '{p}', {w}::DOUBLE)"
        for f in _IMPORTANT
        for p, w in (K.POSITION_WEIGHTS.get(f) or {p: 0.125 for p in K.POSITIONS}).items()
    ]
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature_name, {up(f'stddev_pop({f}) / avg({f})', 4)} AS importance FROM team_features" for f in _IMPORTANT
    )
    return (
        f"imp AS ({rows}), w(feature_name, position, weight) AS (VALUES {', '.join(cells)}), "
        f"weights AS (SELECT position, feature_name AS team_feature, {even('weight', 4)} AS contribution_weight, "
        f"{even('importance', 4)} AS team_feature_importance, {even('weight * importance', 6)} AS positional_value "
        "FROM imp JOIN w USING (feature_name))"
    )


def with_positions(body: str) -> str:
    return using("team_features", body="").rstrip() + ",\n" + _positions_sql() + "\n" + body


@query("join_expand_matrix", sql=with_positions("SELECT * FROM weights"))
def join_expand_matrix(t):
    return J.expand_positions(importances(t))


@query("win_lag", sql=using("lagged", body='SELECT match_id AS "matchId", team, prev_win, prev_loss FROM lagged'))
def win_lag(t):
    sides = both_sides(matches(t), ["matchId", "match_date"]).select("matchId", "match_date", "team", "win", "loss")
    order = [F.asc("match_date"), F.asc("matchId")]
    specs = [Ordered("lag", "prev_win", "win"), Ordered("lag", "prev_loss", "loss")]
    return ordered_columns(sides, ["team"], order, specs).select("matchId", "team", "prev_win", "prev_loss")


@query("win_rolling5", sql=using("rolled", body=f"""SELECT match_id AS "matchId", team, {up('l5w', 6)} AS win5, {up('l5m', 6)} AS margin5, {up('l5f', 6)} AS pf5, {up('l5a', 6)} AS pa5 FROM rolled"""))
def win_rolling5(t):
    sides = both_sides(matches(t), ["matchId", "match_date"]).select("matchId", "match_date", "team", "win", "margin", "pf", "pa")
    order = [F.asc("match_date"), F.asc("matchId")]
    specs = [Ordered("trailing", f"{c}5", c, 5) for c in ("win", "margin", "pf", "pa")]
    rolled = ordered_columns(sides, ["team"], order, specs)
    return rolled.select("matchId", "team", *[F.round(s.out, 6).alias(s.out) for s in specs])


@query("win_season_to_date", sql=using("rolled", body=f"""SELECT match_id AS "matchId", team, {up('sw', 6)} AS season_win_rate, {up('shw', 6)} AS season_home_win_rate FROM rolled"""))
def win_season_to_date(t):
    sides = both_sides(cut_lineage(matches(t)), ["matchId", "match_date", "year"]).withColumn("home_win", F.when(F.col("is_home") == 1, F.col("win")))
    specs = [Ordered("running", "season_win_rate", "win"), Ordered("running", "season_home_win_rate", "home_win")]
    rolled = ordered_columns(sides, ["team", "year"], [F.asc("match_date"), F.asc("matchId")], specs)
    return rolled.select("matchId", "team", *[F.round(s.out, 6).alias(s.out) for s in specs])


@query("win_topk_per_group", sql="""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, place FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS place FROM lineitem) WHERE place <= 10""")
def win_topk_per_group(t):
    """Ten dearest lines per supplier; Spark cuts each map task to ten rows per group."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    ranked = t.lineitem.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 10)
    return ranked.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "place")


@query("win_rank_dense_seq", sql="SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def win_rank_dense_seq(t):
    return rank_rows(t.customer.select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")])


_Z = ["points_per_game", "turnover_pct", "rush_yds_per_att"]


@query("win_zscore_season", sql=using("team_features", body="SELECT year, team, " + ", ".join(
    up(f"CASE WHEN stddev_pop(coalesce({c}, 0)) OVER y > 0 THEN (coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER y) / stddev_pop(coalesce({c}, 0)) OVER y ELSE 0 END", 6) + f" AS z_{c}" for c in _Z
) + " FROM team_features WINDOW y AS (PARTITION BY year)"))
def win_zscore_season(t):
    scored = C.season_z_scores(cut_lineage(V.team_view(t)), "year", _Z)
    return scored.select("year", "team", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in _Z])


@query("win_minmax", sql=using("team_features", body=f"""SELECT year, team, {up('(points - min(points) OVER ()) / CAST(max(points) OVER () - min(points) OVER () AS DOUBLE)', 6)} AS norm_points,
  {up('1 - (points_opp - min(points_opp) OVER ()) / CAST(max(points_opp) OVER () - min(points_opp) OVER () AS DOUBLE)', 6)} AS norm_points_opp, 0::DOUBLE AS norm_constant FROM team_features"""))
def win_minmax(t):
    teams = cut_lineage(V.team_view(t)).withColumn("constant", F.lit(3.0))
    scaled = C.min_max(teams, ["points", "points_opp", "constant"], invert=["points_opp"])
    return scaled.select("year", "team", *[F.round(f"norm_{c}", 6).alias(f"norm_{c}") for c in ("points", "points_opp", "constant")])


@query("win_quartile_flag", sql=using("team_features", body="""SELECT year, team, CAST(points >= quantile_cont(points, 0.75) OVER (PARTITION BY year) AS INTEGER) AS season_elite,
  CAST(points >= (SELECT quantile_cont(points, 0.75) FROM team_features) AS INTEGER) AS table_elite FROM team_features"""))
def win_quartile_flag(t):
    flagged = C.flag_elite(C.flag_elite(cut_lineage(V.team_view(t)), "points", "season_elite", "year"), "points", "table_elite")
    return flagged.select("year", "team", "season_elite", "table_elite")


TREND_SQL = f"""
, years AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM coaching)),
trend AS (
  SELECT team, s.year AS window_start, e.year AS window_end, count(*) AS seasons_in_window, {even(exact_mean('win_rate'), 3)} AS avg_win_rate,
         {even(exact_mean('avg_margin'), 2)} AS avg_margin, {even(exact_mean('close_game_win_rate'), 3)} AS avg_close_game_wr, {even(exact_mean('bounce_back_rate'), 3)} AS avg_bounce_back
  FROM years s JOIN years e ON e.i = s.i + 4 JOIN coaching c ON c.year BETWEEN s.year AND e.year
  GROUP BY ALL HAVING count(*) >= 3)
"""


@query("win_multi_year", sql=using("coaching", body=TREND_SQL + "SELECT * FROM trend"))
def win_multi_year(t):
    return C.multi_year_windows(V.coaching_view(t), C.TREND_MEASURES)


@query("win_trajectory", sql=using("coaching", body=TREND_SQL + f""", slopes AS (SELECT team, count(*) AS n_windows, regr_slope(avg_win_rate, x) AS slope FROM
  (SELECT *, row_number() OVER (PARTITION BY team ORDER BY window_start) - 1 AS x FROM trend) GROUP BY team)
SELECT team, n_windows, {up('slope', 6)} AS slope, CASE WHEN n_windows < 3 THEN 'stable' WHEN slope > 0.015 THEN 'improving' WHEN slope < -0.015 THEN 'declining' ELSE 'stable' END AS trajectory FROM slopes"""))
def win_trajectory(t):
    trend = C.trajectories(C.multi_year_windows(V.coaching_view(t), C.TREND_MEASURES))
    return trend.withColumn("slope", F.round("slope", 6))


@query("sort_multi", sql="SELECT c_mktsegment, c_nationkey, c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_nationkey, c_custkey DESC) AS place FROM customer ORDER BY c_mktsegment DESC, c_nationkey, c_custkey DESC")
def sort_multi(t):
    order = [F.desc("c_mktsegment"), F.asc("c_nationkey"), F.desc("c_custkey")]
    ranked = rank_rows(t.customer.select("c_mktsegment", "c_nationkey", "c_custkey"), order, "place")
    return ranked.orderBy(*order)


@query("topk_abs", sql="SELECT c_custkey, c_acctbal - 5000 AS residual FROM customer ORDER BY abs(c_acctbal - 5000) DESC, c_custkey LIMIT 50")
def topk_abs(t):
    return top_absolute(t.customer.select("c_custkey", (F.col("c_acctbal") - 5000).alias("residual")), "residual", "c_custkey")


@query("topk_signed", sql="""SELECT c_custkey, residual, side, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY side ORDER BY abs(residual) DESC, c_custkey) AS INTEGER) AS place FROM
  (SELECT c_custkey, c_acctbal - 5000 AS residual, CASE WHEN c_acctbal > 5000 THEN 'positive' WHEN c_acctbal < 5000 THEN 'negative' END AS side FROM customer) WHERE side IS NOT NULL) WHERE place <= 15""")
def topk_signed(t):
    return over_and_under(t.customer.select("c_custkey", (F.col("c_acctbal") - 5000).alias("residual")), "c_custkey")


@query("limit_preview", sql="SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100")
def limit_preview(t):
    return preview(t.events.select("event_id", "event_type"), 100, ["event_id"])


@query("union_all_unpivot", sql=using("sides", body='SELECT match_id AS "matchId", team, opponent, pf, pa, margin, win, draw, loss, is_home FROM sides'))
def union_all_unpivot(t):
    return both_sides(matches(t), ["matchId"]).select("matchId", "team", "opponent", "pf", "pa", "margin", "win", "draw", "loss", "is_home")


@query("concat_frames", sql="SELECT o_orderkey AS id, 'order' AS kind, o_totalprice AS amount, NULL::INTEGER AS nation FROM orders UNION ALL SELECT c_custkey, 'customer', c_acctbal, c_nationkey FROM customer")
def concat_frames(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("amount"), F.col("c_nationkey").alias("nation"))
    return stack_frames([a, b])


@query("wide_to_long", sql=using("team_features", body=" UNION ALL ".join(f"SELECT year, team, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM team_features" for c in ("points", "mov", "ties", "rush_share"))))
def wide_to_long(t):
    return to_long(V.team_view(t), ["year", "team"], ["points", "mov", "ties", "rush_share"])


@query("dedup_columns", sql="SELECT o_custkey, o_orderkey, o_totalprice, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def dedup_columns(t):
    """Two sources with a shared column name: the first one keeps it."""
    first = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    second = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", F.lit(0.0).alias("o_totalprice"))
    owned = first_owner({"orders": first, "customer": second}, ["o_custkey"])
    return first.join(second.select("o_custkey", *owned["customer"]), "o_custkey")


