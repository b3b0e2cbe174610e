"""SQL fragments for the oracles: rounding as Spark does it, and the bound tables."""

from __future__ import annotations

from sluicework.functions.constants import TACTICAL_NAMES


def dec(x: str) -> str:
    """The double's shortest decimal text as an exact decimal."""
    return f"CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,20))"


def up(x: str, n: int) -> str:
    """Round half away from zero."""
    return f"CAST(CAST(round({dec(x)}, {n}) AS VARCHAR) AS DOUBLE)"


def even(x: str, n: int) -> str:
    """Round half to even."""
    d = f"{dec(x)} * {10 ** n}"
    f = f"CAST(floor({d}) AS BIGINT)"
    return (
        f"(CASE WHEN {d} - {f} = 0.5 THEN CAST({f} + abs({f} % 2) AS DOUBLE) "
        f"ELSE CAST(round({d}) AS DOUBLE) END / {10 ** n}::DOUBLE)"
    )


def exact_mean(x: str) -> str:
    """Mean from an exact decimal sum, divided once."""
    return f"(CAST(sum(CAST({x} AS DECIMAL(38,12))) AS DOUBLE) / count({x}))"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def n_if(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def cents(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


def whole(c: str) -> str:
    return f"CAST(floor({c}) AS BIGINT)"


def rate(hit: str, among: str, n: int = 3) -> str:
    return up(div(n_if(f"({hit}) AND ({among})"), n_if(among)), n)


TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "results": ((), f"""
        SELECT l_orderkey * 10 + l_linenumber AS result_id, l_orderkey AS race_id, l_partkey AS driver_id,
               l_suppkey AS constructor_id, CAST(l_linenumber - 1 AS BIGINT) AS grid, {whole('l_quantity')} AS place,
               CAST({cents('l_discount')} AS DOUBLE) AS points, l_partkey % 60 AS laps,
               CASE WHEN l_linestatus = 'F' THEN CAST({cents('l_extendedprice')} AS VARCHAR) ELSE '\\N' END AS ms,
               CASE WHEN l_returnflag <> 'R' THEN CAST({cents('l_tax')} AS VARCHAR) || '.5' ELSE '\\N' END AS speed,
               CASE WHEN l_linenumber <= 5 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END AS lap_rank,
               CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS status_id
        FROM lineitem"""),
    "status": ((), """
        SELECT DISTINCT CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS status_id,
               CASE l_returnflag WHEN 'A' THEN 'Finished' WHEN 'N' THEN '+1 Lap' ELSE 'Engine' END AS status
        FROM lineitem"""),
    "races": ((), """
        SELECT o_orderkey AS race_id, year(o_orderdate) AS year, month(o_orderdate) AS round,
               o_orderpriority AS race_name, o_custkey AS circuit_id FROM orders"""),
    "circuits": ((), """
        SELECT c_custkey AS circuit_id, c_name AS circuit, n_name AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "constructors": ((), """
        SELECT s_suppkey AS constructor_id, s_name AS constructor, n_name AS nationality
        FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "drivers": ((), """
        SELECT p_partkey AS driver_id, p_name AS driver, p_brand || ' ' || p_type AS driver_name,
               p_type AS driver_nationality FROM part"""),
    "qualifying": ((), """
        SELECT l_orderkey AS race_id, l_partkey AS driver_id, CAST(min(l_linenumber) AS BIGINT) AS quali
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL"""),
    "pit_stops": ((), f"""
        SELECT l_orderkey AS race_id, l_partkey AS driver_id, CAST(l_linenumber AS BIGINT) AS stop,
               {whole('l_quantity')} AS lap, CAST({cents('l_extendedprice')} % 13000 AS DOUBLE) / 100 AS duration,
               ({cents('l_extendedprice')} % 13000) * 10 AS ms FROM lineitem"""),
    "m": ((), f"""
        SELECT l_orderkey AS match_id, CAST(l_shipdate AS DATE) AS match_date, year(l_shipdate) AS year,
               CAST(floor(dayofyear(l_shipdate) / 14) + 1 AS BIGINT) AS round, h.n_name AS home_team,
               a.n_name AS away_team, {whole('l_quantity')} AS home_score,
               {whole('l_extendedprice')} % 50 AS away_score, s_name AS venue
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey,
                     l_shipdate, l_extendedprice, l_quantity) AS rn FROM lineitem)
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation h ON s_nationkey = h.n_nationkey
        JOIN nation a ON c_nationkey = a.n_nationkey
        WHERE rn = 1 AND h.n_name <> a.n_name"""),
    "sides": (("m",), """
        SELECT *, pf - pa AS margin, CAST(pf > pa AS INTEGER) AS win, CAST(pf = pa AS INTEGER) AS draw,
               CAST(pf < pa AS INTEGER) AS loss
        FROM (SELECT match_id, match_date, year, round, home_team AS team, away_team AS opponent,
                     home_score AS pf, away_score AS pa, 1 AS is_home FROM m
              UNION ALL
              SELECT match_id, match_date, year, round, away_team, home_team, away_score, home_score, 0 FROM m)"""),
    "lagged": (("sides",), """
        SELECT *, lag(win) OVER w AS prev_win, lag(loss) OVER w AS prev_loss FROM sides
        WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id)"""),
    "rolled": (("sides",), """
        SELECT *, avg(win) OVER w5 AS l5w, avg(margin) OVER w5 AS l5m, avg(pf) OVER w5 AS l5f, avg(pa) OVER w5 AS l5a,
               avg(win) OVER s AS sw, avg(CASE WHEN is_home = 1 THEN win END) OVER s AS shw
        FROM sides
        WINDOW w5 AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
               s AS (PARTITION BY team, year ORDER BY match_date, match_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "h2h": (("m",), """
        SELECT match_id, CAST(coalesce(sum(hw) OVER p, 0) AS BIGINT) AS h2h_home_wins,
               CAST(coalesce(sum(aw) OVER p, 0) AS BIGINT) AS h2h_away_wins, greatest(count(*) OVER p, 1) AS h2h_total
        FROM (SELECT *, least(home_team, away_team) AS lo, greatest(home_team, away_team) AS hi,
                     CAST(home_score > away_score AS INTEGER) AS hw, CAST(away_score > home_score AS INTEGER) AS aw FROM m)
        WINDOW p AS (PARTITION BY lo, hi ORDER BY match_date
                     RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"""),
    "match_features": (("m", "rolled", "h2h"), f"""
        SELECT m.match_id AS "matchId", m.match_date, m.year, m.round, home_team, away_team, home_score, away_score,
               home_score - away_score AS margin, venue,
               {up('h.l5w', 3)} AS home_last5_win_rate, {up('h.l5m', 2)} AS home_last5_avg_margin,
               {up('h.l5f', 2)} AS home_last5_avg_pf, {up('h.l5a', 2)} AS home_last5_avg_pa,
               {up('h.sw', 3)} AS home_season_win_rate, {up('h.shw', 3)} AS home_season_home_win_rate,
               {up('a.l5w', 3)} AS away_last5_win_rate, {up('a.l5m', 2)} AS away_last5_avg_margin,
               {up('a.l5f', 2)} AS away_last5_avg_pf, {up('a.l5a', 2)} AS away_last5_avg_pa,
               {up('a.sw', 3)} AS away_season_win_rate, h2h_total,
               {up(div('h2h_home_wins', 'h2h_total'), 3)} AS h2h_home_win_rate,
               {up('coalesce(h.l5w, 0.5) - coalesce(a.l5w, 0.5)', 3)} AS form_differential,
               {up('coalesce(h.sw, 0.5) - coalesce(a.sw, 0.5)', 3)} AS season_form_differential
        FROM m JOIN rolled h ON h.match_id = m.match_id AND h.is_home = 1
        JOIN rolled a ON a.match_id = m.match_id AND a.is_home = 0 JOIN h2h ON h2h.match_id = m.match_id"""),
    "team_season": (("sides",), f"""
        SELECT team, year, count(*) AS games_played, {n_if('win = 1')} AS wins, {big('sum(draw)')} AS draws,
               {big('sum(loss)')} AS losses, {up('sum(win) / count(*)', 3)} AS win_rate,
               {big('sum(pf)')} AS total_points_for, {big('sum(pa)')} AS total_points_against,
               {up('avg(pf)', 2)} AS avg_points_for, {up('avg(pa)', 2)} AS avg_points_against,
               {up('avg(margin)', 2)} AS avg_margin, {up('stddev_samp(margin)', 2)} AS margin_stddev,
               {n_if('is_home = 1 AND win = 1')} AS home_wins, {n_if('is_home = 1')} AS home_games,
               {rate('win = 1', 'is_home = 1')} AS home_win_rate,
               {n_if('is_home = 0 AND win = 1')} AS away_wins, {n_if('is_home = 0')} AS away_games,
               {rate('win = 1', 'is_home = 0')} AS away_win_rate,
               {n_if('margin >= 13')} AS blowout_wins, {rate('margin >= 13', 'win = 1')} AS blowout_rate,
               {n_if('abs(margin) <= 6')} AS close_games, {n_if('abs(margin) <= 6 AND win = 1')} AS close_wins,
               {rate('win = 1', 'abs(margin) <= 6')} AS close_game_win_rate,
               {big('sum(pf) - sum(pa)')} AS points_differential
        FROM sides GROUP BY team, year HAVING count(*) >= 5"""),
    "coaching": (("lagged",), f"""
        SELECT team, year, count(*) AS games_played, {n_if('win = 1')} AS wins, {up('sum(win) / count(*)', 3)} AS win_rate,
               {up('avg(pf)', 2)} AS avg_points_for, {up('avg(pa)', 2)} AS avg_points_against,
               {up('avg(margin)', 2)} AS avg_margin, {up('stddev_samp(margin)', 2)} AS consistency_score,
               {rate('win = 1', 'is_home = 1')} AS home_win_rate, {rate('win = 1', 'is_home = 0')} AS away_win_rate,
               {up('coalesce(' + div(n_if('is_home = 1 AND win = 1'), n_if('is_home = 1')) + ', 0) - coalesce('
                   + div(n_if('is_home = 0 AND win = 1'), n_if('is_home = 0')) + ', 0)', 3)} AS home_dependency,
               {rate('win = 1', 'round BETWEEN 1 AND 8')} AS early_season_win_rate,
               {rate('win = 1', 'round >= 18')} AS late_season_win_rate,
               {rate('win = 1', 'prev_loss = 1')} AS bounce_back_rate,
               {rate('win = 1', 'prev_win = 1')} AS streak_maintenance_rate,
               {rate('win = 1', 'abs(margin) <= 6')} AS close_game_win_rate,
               {up(div(n_if('margin <= -13'), 'count(*)'), 3)} AS blowout_loss_rate,
               {up(div('avg(pf)', 'avg(pa)'), 3)} AS attack_defense_ratio
        FROM lagged GROUP BY team, year HAVING count(*) >= 5"""),
    "profiles": (("coaching",), "SELECT team, " + ", ".join(f"{exact_mean(c)} AS {c}" for c in TACTICAL_NAMES) + " FROM coaching GROUP BY team"),
    "constructor_season": (("results", "races", "constructors", "status"), f"""
        SELECT constructor_id AS "constructorId", constructor, nationality, year, count(*) AS race_entries,
               sum(points) AS total_points, {n_if('place = 1')} AS wins, {n_if('place <= 3')} AS podiums,
               {n_if('fin')} AS finishes, {n_if('NOT fin')} AS retirements,
               {up(div(n_if('fin'), 'count(*)'), 3)} AS reliability_pct, {up('avg(place)', 2)} AS avg_finish_position,
               {up('avg(grid)', 2)} AS avg_grid_position, {up('avg(grid - place)', 2)} AS avg_positions_gained,
               {up(div('sum(points)', 'count(DISTINCT race_id)'), 2)} AS points_per_race,
               {up(div(n_if('place = 1'), 'count(DISTINCT race_id)'), 3)} AS win_rate,
               {up(div(n_if('place <= 3'), 'count(DISTINCT race_id)'), 3)} AS podium_rate
        FROM (SELECT *, status = 'Finished' OR status LIKE '+%' AS fin FROM results JOIN races USING (race_id)
              JOIN constructors USING (constructor_id) JOIN status USING (status_id) WHERE grid > 0)
        GROUP BY ALL HAVING count(*) >= 5"""),
    "driver_features": (("results", "races", "circuits", "drivers", "constructors", "status", "qualifying"), """
        SELECT result_id AS "resultId", race_id AS "raceId", year, round, race_name, circuit, country AS circuit_country,
               driver_id AS "driverId", driver, driver_name, driver_nationality, constructor_id AS "constructorId",
               constructor, grid, place AS finish_position, points, laps, TRY_CAST(ms AS BIGINT) AS race_time_ms,
               TRY_CAST(speed AS DOUBLE) AS fastest_lap_speed, TRY_CAST(lap_rank AS BIGINT) AS fastest_lap_rank,
               status_id AS "statusId", status AS finish_status,
               CAST(status = 'Finished' OR status LIKE '+%' AS INTEGER) AS finished, quali AS quali_position,
               grid - place AS positions_gained, CAST(place <= 3 AS INTEGER) AS podium, CAST(place = 1 AS INTEGER) AS win
        FROM results JOIN races USING (race_id) JOIN circuits USING (circuit_id) JOIN drivers USING (driver_id)
        JOIN constructors USING (constructor_id) JOIN status USING (status_id)
        LEFT JOIN qualifying USING (race_id, driver_id) WHERE grid > 0"""),
    "pit_features": (("results", "races", "circuits", "drivers", "constructors", "pit_stops"), f"""
        SELECT race_id AS "raceId", driver_id AS "driverId", stop AS stop_number, lap AS stop_lap,
               duration AS stop_duration_sec, p.ms AS stop_duration_ms, year, race_name, circuit, driver, constructor,
               grid, place AS finish_position, grid - place AS positions_gained, laps AS total_laps,
               {up(div('lap', 'laps'), 3)} AS stop_race_pct, CAST(stop = 1 AS INTEGER) AS is_first_stop,
               CAST(duration < 25 AS INTEGER) AS fast_stop, CAST(duration > 35 AS INTEGER) AS slow_stop
        FROM pit_stops p JOIN results r USING (race_id, driver_id) JOIN races USING (race_id)
        JOIN circuits USING (circuit_id) JOIN drivers USING (driver_id) JOIN constructors USING (constructor_id)
        WHERE duration > 0 AND duration < 120 AND laps > 0"""),
    "race_driver": (("pit_features",), f"""
        SELECT *, {even(div('first_stop_lap', 'total_laps'), 3)} AS first_stop_pct
        FROM (SELECT "raceId", "driverId", min(year) AS year, min(race_name) AS race_name, min(driver) AS driver,
                     min(constructor) AS constructor, min(grid) AS grid, min(finish_position) AS finish_position,
                     min(positions_gained) AS positions_gained, min(total_laps) AS total_laps,
                     max(stop_number) AS total_stops, {even(exact_mean('stop_duration_sec'), 3)} AS avg_stop_duration,
                     {even('min(stop_duration_sec)', 3)} AS min_stop_duration,
                     {big('sum(stop_duration_ms)')} AS total_pit_time_ms, min(stop_lap) AS first_stop_lap,
                     max(stop_lap) AS last_stop_lap
              FROM pit_features GROUP BY "raceId", "driverId")"""),
    "team_stats": ((), f"""
        SELECT year, s_name AS team, wins, losses, ties, CAST(wins AS DOUBLE) / g AS win_loss_perc, points, points_opp,
               points - points_opp AS points_diff, CAST(points - points_opp AS DOUBLE) / g AS mov, g, total_yards,
               plays_offense, CAST(total_yards AS DOUBLE) / plays_offense AS yds_per_play_offense, turnovers,
               fumbles_lost, first_down, pass_cmp, g AS pass_att, pass_yds, pass_td, pass_int,
               CAST(pass_yds AS DOUBLE) / g AS pass_net_yds_per_att, pass_fd, rush_att, rush_yds, rush_td,
               {div('rush_yds', 'rush_att')} AS rush_yds_per_att, rush_fd, penalties, penalties_yds, pen_fd,
               CAST(scored * 100 AS DOUBLE) / g AS score_pct, CAST(turnovers * 100 AS DOUBLE) / g AS turnover_pct,
               CAST(points - points_opp AS DOUBLE) / g * 2 AS exp_pts_tot
        FROM (SELECT l_suppkey, year(l_shipdate) AS year, {n_if("l_returnflag = 'A'")} AS wins,
                     {n_if("l_returnflag = 'R'")} AS losses,
                     nullif({n_if("l_returnflag = 'N' AND l_linenumber = 7")}, 0) AS ties,
                     {big('sum(floor(l_quantity))')} AS points, {big('sum(l_linenumber * 7)')} AS points_opp,
                     count(*) AS g, {big('sum(' + whole('l_extendedprice') + ')')} AS total_yards,
                     {big('sum(l_linenumber)')} AS plays_offense, {n_if('l_tax >= 0.07::DOUBLE')} AS turnovers,
                     {n_if('l_tax >= 0.08::DOUBLE')} AS fumbles_lost, {n_if('l_quantity > 25')} AS first_down,
                     {n_if("l_returnflag = 'A'")} AS pass_cmp,
                     CAST(coalesce(sum({whole('l_extendedprice')}) FILTER (WHERE l_returnflag = 'A'), 0) AS BIGINT) AS pass_yds,
                     {n_if("l_returnflag = 'A' AND l_quantity > 40")} AS pass_td, {n_if('l_quantity < 5')} AS pass_int,
                     {n_if("l_returnflag = 'A' AND l_quantity > 25")} AS pass_fd, {n_if("l_returnflag = 'R'")} AS rush_att,
                     CAST(coalesce(sum({whole('l_extendedprice')}) FILTER (WHERE l_returnflag = 'R'), 0) AS BIGINT) AS rush_yds,
                     {n_if("l_returnflag = 'R' AND l_quantity > 40")} AS rush_td,
                     {n_if("l_returnflag = 'R' AND l_quantity > 25")} AS rush_fd, {n_if("l_linestatus = 'F'")} AS penalties,
                     CAST(coalesce(sum(l_linenumber) FILTER (WHERE l_linestatus = 'F'), 0) AS BIGINT) AS penalties_yds,
                     {n_if("l_linestatus = 'F' AND l_quantity > 25")} AS pen_fd, {n_if('l_quantity > 20')} AS scored
              FROM lineitem GROUP BY ALL) JOIN supplier ON l_suppkey = s_suppkey"""),
    "team_features": (("team_stats",), f"""
        SELECT * REPLACE (coalesce(ties, 0) AS ties),
               {div('total_yards', 'g')} AS yards_per_game, {div('pass_yds', 'g')} AS pass_yds_per_game,
               {div('rush_yds', 'g')} AS rush_yds_per_game, {div('points', 'g')} AS points_per_game,
               {div('points_opp', 'g')} AS points_opp_per_game, {div('pass_cmp', 'pass_att')} AS pass_completion_pct,
               {div('pass_td', 'pass_att')} AS pass_td_pct, {div('pass_int', 'pass_att')} AS interception_pct,
               {div('rush_yds', 'total_yards')} AS rush_share, {div('pass_fd', 'first_down')} AS first_down_pass_pct,
               {div('rush_fd', 'first_down')} AS first_down_rush_pct, {div('penalties_yds', 'g')} AS penalty_yds_per_game,
               CAST(wins >= 10 AS INTEGER) AS is_playoff
        FROM team_stats"""),
    "player_raw": ((), f"""
        SELECT CAST(c_custkey AS VARCHAR) AS player_id, c_mktsegment AS position, n_name AS league,
               CASE WHEN c_nationkey % 5 = 0 THEN 'n/a' ELSE CAST({cents('c_acctbal')} AS VARCHAR) END AS market_value,
               s.* EXCLUDE (k)
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (
          SELECT o_custkey AS k, count(*) - 1 AS appearances, {n_if("o_orderstatus = 'F'")} AS matches_started,
                 {big('sum(floor(o_totalprice / 1000))')} AS minutes_played,
                 {n_if("o_orderpriority = '1-URGENT'")} AS goals, {n_if("o_orderpriority = '2-HIGH'")} AS assists,
                 count(*) * 0.25::DOUBLE AS expected_goals, count(*) * 0.125::DOUBLE AS expected_assists,
                 CAST({big('sum(' + cents('o_totalprice') + ')')} % 1000 AS DOUBLE) / 100 AS rating,
                 {n_if("o_orderstatus <> 'P'")} AS total_shots, {n_if("o_orderstatus = 'F'")} AS shots_on_target,
                 nullif({n_if("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")}, 0) AS yellow_cards,
                 {n_if("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")} AS red_cards,
                 {n_if("o_orderpriority = '3-MEDIUM'")} AS tackles,
                 {n_if("o_orderpriority = '4-NOT SPECIFIED'")} AS interceptions, {n_if("o_orderpriority = '5-LOW'")} AS saves
          FROM orders GROUP BY o_custkey) s ON k = c_custkey"""),
    "player_features": (("player_raw",), f"""
        SELECT * REPLACE (TRY_CAST(market_value AS DOUBLE) AS market_value),
               {div('goals', 'appearances')} AS goals_per_appearance, {div('assists', 'appearances')} AS assists_per_appearance,
               {div('tackles', 'appearances')} AS tackles_per_appearance, {div('shots_on_target', 'total_shots')} AS shot_accuracy,
               goals - expected_goals AS goals_vs_expected
        FROM player_raw WHERE appearances > 0"""),
    "job_events": ((), f"""
        SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq,
               CASE event_type WHEN 'click' THEN 'UPLOADING' WHEN 'view' THEN 'VALIDATING' WHEN 'signup' THEN 'TRANSFORMING'
                    WHEN 'purchase' THEN 'LOADED' ELSE 'FAILED' END AS status,
               'dataset_' || (user_id % 10) AS dataset,
               CASE WHEN user_id % 10 <> 0 THEN 'table_' || (user_id % 10) END AS bq_table,
               {cents('value')} AS file_size_bytes, ts AS updated_at, {cents('value')} AS total_records,
               CASE WHEN event_type = 'purchase' THEN {cents('value')} ELSE 0 END AS loaded
        FROM events"""),
    "people": ((), """
        SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS row_id, 'User' || c_custkey || '@Example.com' AS email,
               '+1-555-' || substr(d, 4, 3) || '-' || substr(d, 6, 4) AS phone,
               substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6, 4) AS tax_id,
               'Ann ' || c_name AS full_name, (c_custkey % 99 + 1) || ' Main St' AS address,
               '19' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') || '-05-15' AS dob,
               '41111111' || substr(d, 2, 8) AS card_number, '10.' || (c_custkey % 200) || '.3.4' AS ip_addr,
               'c' || c_custkey || '@mail.org' AS contact,
               CASE WHEN c_custkey >= 200 AND c_custkey % 7 = 0 THEN 'many' WHEN c_custkey % 11 = 0 THEN ' NA '
                    ELSE CAST(c_custkey % 50 AS VARCHAR) END AS visits,
               CASE WHEN c_custkey >= 200 AND c_custkey % 13 = 0 THEN '12,5' ELSE (c_custkey % 50) || '.25' END AS balance,
               CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' ELSE '1' END AS active,
               CASE WHEN c_custkey % 5 = 0 THEN 'NULL'
                    ELSE '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END AS joined,
               c_mktsegment AS segment, copy
        FROM (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS d,
                     unnest(CASE WHEN c_custkey % 4 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM customer)"""),
    "dominance": (("team_features",), None),
}


def _z(column: str) -> str:
    d = f"stddev_pop({column}) OVER y"
    return f"(CASE WHEN {d} > 0 THEN (CAST({column} AS DOUBLE) - avg({column}) OVER y) / {d} ELSE 0 END)"


TABLES["dominance"] = (("team_features",), f"""
        SELECT *, pillar_winning * 0.35::DOUBLE + pillar_offence * 0.25::DOUBLE + pillar_defence * 0.25::DOUBLE
                  + pillar_efficiency * 0.15::DOUBLE AS dominance_score
        FROM (SELECT *, {_z('win_loss_perc')} AS pillar_winning,
                ({_z('points_per_game')} + {_z('yards_per_game')} + {_z('pass_completion_pct')} + {_z('rush_yds_per_game')}) / 4
                  AS pillar_offence,
                (-{_z('points_opp_per_game')} + {_z('turnover_pct')}) / 2 AS pillar_defence,
                ({_z('yds_per_play_offense')} + {_z('score_pct')} - {_z('penalty_yds_per_game')}) / 3 AS pillar_efficiency
              FROM team_features WINDOW y AS (PARTITION BY year))""")


def ridge(table: str, key: str, columns: list[str], target: str, alphas: list[float], folds: int = 5) -> str:
    """Coefficients of a three-column ridge fit by Cramer's rule, the alpha by held-out R²."""
    x, y = ["x0", "x1", "x2"], "y"
    names = [*x, y]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    scaled = ", ".join(f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {n}" for c, n in zip(columns, x))
    moments = ["count(*)::DOUBLE AS n", *[f"sum({a}) AS s_{a}" for a in names], *[f"sum({a} * {b}) AS p_{a}_{b}" for a, b in pairs]]
    facts = ["n", *[f"s_{a}" for a in names], *[f"p_{a}_{b}" for a, b in pairs]]

    def cell(i: int, j: int) -> str:
        a, b = x[min(i, j)], x[max(i, j)]
        return f"(p_{a}_{b} - s_{a} * s_{b} / n{' + alpha' if i == j else ''})"

    def det(m: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    inner = [[cell(i, j) for j in range(3)] for i in range(3)]
    right = [f"(p_{a}_y - s_{a} * s_y / n)" for a in x]
    weights = ", ".join(f"{det([[right[i] if j == k else inner[i][j] for j in range(3)] for i in range(3)])} / {det(inner)} AS w{k}" for k in range(3))
    sse = "h.p_y_y - 2 * c * h.s_y + h.n * c * c" + "".join(f" - 2 * w{i} * h.p_{a}_y + 2 * c * w{i} * h.s_{a}" for i, a in enumerate(x))
    sse += "".join(f" + {1 if i == j else 2} * w{i} * w{j} * h.p_{x[i]}_{x[j]}" for i in range(3) for j in range(i, 3))
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature_name, {even(f'w{i}', 4)} AS ridge_coefficient FROM fit" for i, c in enumerate(columns))
    return f"""WITH z AS (SELECT CAST(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {folds} AS INTEGER) AS fold, {scaled}, CAST({target} AS DOUBLE) AS y FROM {table}),
f AS (SELECT fold, {', '.join(moments)} FROM z GROUP BY fold), t AS (SELECT {', '.join(f'sum({c}) AS {c}' for c in facts)} FROM f),
a(alpha) AS (VALUES {', '.join(f'({a}::DOUBLE)' for a in alphas)}),
train AS (SELECT alpha, fold, {', '.join(f't.{c} - f.{c} AS {c}' for c in facts)} FROM f, t, a), w AS (SELECT *, {weights} FROM train),
i AS (SELECT *, (s_y - w0 * s_x0 - w1 * s_x1 - w2 * s_x2) / n AS c FROM w),
r AS (SELECT alpha, avg(1 - ({sse}) / (h.p_y_y - h.s_y * h.s_y / h.n)) AS r2 FROM i JOIN f h ON h.fold = i.fold GROUP BY alpha),
fit AS (SELECT {weights} FROM t, (SELECT alpha FROM r ORDER BY r2 DESC, alpha LIMIT 1)) {rows}"""


def using(*names: str, body: str) -> str:
    """``body`` with the named bound tables, and all they need, as a WITH list."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for dep in TABLES[name][0]:
                need(dep)
            order.append(name)

    for name in names:
        need(name)
    parts = ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in order)
    return f"WITH {parts}\n{body}"
