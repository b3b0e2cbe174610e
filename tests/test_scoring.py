"""Joins, views and scores against brute force on small fixtures."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicework.functions import constants as K
from sluicework.functions import scalar as S
from sluicework.operators import aggregates as A
from sluicework.operators import joins as J
from sluicework.operators import ledger as L
from sluicework.operators import scoring as C
from sluicework.operators import serving as V
from sluicework.operators.reshape import both_sides
from sluicework.plans import bindings as B
from sluicework.plans import feature_views as FV
from sluicework.plans.analyses import constructor_index, tactical_profiles
from sluicework.sources import sinks as Z


@pytest.fixture(scope="module")
def matches(spark):
    rng = np.random.default_rng(3)
    teams, rows = ["a", "b", "c", "d"], []
    for i in range(120):
        h, w = rng.choice(4, 2, replace=False)
        day = dt.date(2020, 1, 1) + dt.timedelta(days=int(i // 2 * 9))
        rows.append((i, day, day.year, int(i % 25), teams[h], teams[w], int(rng.integers(0, 30)), int(rng.integers(0, 30)), "v"))
    ddl = "id long, match_date date, year int, round int, home_team string, away_team string, home_score long, away_score long, venue string"
    return spark.createDataFrame(rows, ddl)


def test_head_to_head_equals_the_pairwise_definition(matches):
    rows = matches.collect()
    got = {r["id"]: (r["h2h_home_wins"], r["h2h_away_wins"], r["h2h_total"]) for r in J.head_to_head(matches).collect()}
    for m in rows:
        prior = [p for p in rows if p.match_date < m.match_date and {p.home_team, p.away_team} == {m.home_team, m.away_team}]
        want = (sum(p.home_score > p.away_score for p in prior), sum(p.away_score > p.home_score for p in prior), max(len(prior), 1))
        assert got[m["id"]] == want


def test_match_features_equal_a_direct_count(spark, matches):
    fixtures = matches.select(
        "id", F.col("match_date").cast("timestamp").alias("KickOffTime"), F.col("year").alias("Season"), F.col("round").alias("Round"),
        F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"), F.col("home_score").alias("HomeScore"),
        F.col("away_score").alias("AwayScore"), F.col("venue").alias("Venue"),
    )
    unplayed = fixtures.limit(1).withColumns({"id": F.lit(999).cast("long"), "HomeScore": F.lit(None).cast("long")})
    rows = sorted(matches.collect(), key=lambda r: (r.match_date, r.id))
    got = {r["id"]: r for r in FV.match_features(fixtures.unionByName(unplayed), ["id"]).collect()}
    assert set(got) == {r.id for r in rows}
    for i, m in enumerate(rows):
        for side, team in (("home", m.home_team), ("away", m.away_team)):
            before = [p for p in rows[:i] if team in (p.home_team, p.away_team)]
            margins = [(p.home_score - p.away_score) * (1 if p.home_team == team else -1) for p in before]
            season = [x > 0 for x, p in zip(margins, before) if p.year == m.year]
            last = margins[-5:]
            assert got[m.id][f"{side}_last5_avg_margin"] == pytest.approx(round(np.mean(last), 2), abs=0.011) if last else got[m.id][f"{side}_last5_avg_margin"] is None
            want = got[m.id][f"{side}_season_win_rate"]
            assert want == pytest.approx(np.mean(season), abs=6e-4) if season else want is None


def test_ordered_computations_of_matches_carry_no_texts(tables, monkeypatch):
    """What they carry is stored and shuffled several times a team's row."""
    carried, ordered = [], FV.ordered_columns
    monkeypatch.setattr(FV, "ordered_columns", lambda df, *rest: carried.append(df.columns) or ordered(df, *rest))
    features = FV.match_features(B.fixtures(tables), ["matchId"])
    assert len(carried) == 2 and not {"venue", "home_team", "away_team", "opponent"} & {c for names in carried for c in names}
    assert features.where(F.col("venue").isNull() | F.col("home_team").isNull()).count() == 0
    assert features.count() == B.fixtures(tables).where("HomeScore IS NOT NULL AND AwayScore IS NOT NULL").count() > 0


def test_counted_rows_are_those_of_the_views(tables, monkeypatch):
    """The quality profiles count rows without the features of the match and coaching views, and read fixtures once."""
    from sluicework.catalog import ingestion as I
    from sluicework.catalog import views as W
    from sluicework.catalog.registry import QUERIES

    assert FV.match_rows(B.fixtures(tables), ["matchId"]).count() == W.match_view(tables).count() > 0
    assert sorted(FV.coaching_rows(B.fixtures(tables)).collect()) == sorted(W.coaching_view(tables).select("team", "year").collect())
    built, fixtures = [], B.fixtures
    monkeypatch.setattr(I.B, "fixtures", lambda t: built.append(1) or fixtures(t))
    report = {r["profile"]: r["observed"] for r in QUERIES["dq_profiles"](tables.spark, tables.folder).collect()}
    assert len(built) == 1 and list(report) == list(I._VIEWS)
    assert all(report[p] == view(tables).count() for p, (_, view) in I._VIEWS.items())


def test_rivalry_counts_draws_as_losses(spark):
    rows = [("a", "b", 5, 5)] * 2 + [("a", "b", 9, 1)] * 9 + [("b", "a", 0, 3)]
    got = {r["team"]: r for r in A.rivalry_matrix(spark.createDataFrame(rows, "home_team string, away_team string, home_score int, away_score int")).collect()}
    assert (got["a"]["total_matches"], got["a"]["wins"], got["a"]["losses"], got["a"]["is_dominant"]) == (12, 10, 2, 1)
    assert got["a"]["home_win_rate"] == 0.818 and got["b"]["home_win_rate"] == 0.0 and got["b"]["losses"] == 12


def test_two_sides(spark, matches):
    assert both_sides(matches, ["id"]).count() == 240


def test_multi_year_windows_and_trend(spark):
    rows = [("up", y, 0.1 * i, 1.0 * i, 0.5, None) for i, y in enumerate([2000, 2001, 2003, 2004, 2005, 2006, 2007])]
    rows += [("short", y, 0.5, 1.0, 0.5, 0.5) for y in (2000, 2001)] + [("flat", y, 0.5, 1.0, 0.5, 0.5) for y in (2003, 2004, 2005)]
    df = spark.createDataFrame(rows, "team string, year int, win_rate double, avg_margin double, close_game_win_rate double, bounce_back_rate double")
    got = C.team_trends(df).orderBy("team", "window_start").collect()
    assert [(r["window_start"], r["window_end"], r["seasons_in_window"]) for r in got if r["team"] == "up"] == [(2000, 2005, 5), (2001, 2006, 5), (2003, 2007, 5)]
    assert {r["team"]: r["trajectory"] for r in got} == {"up": "improving", "flat": "stable"}
    assert [r["avg_win_rate"] for r in got if r["team"] == "up"] == [0.2, 0.3, 0.4]


def test_season_scores(spark):
    features = sorted({f for m in K.PILLARS.values() for f, _ in m})
    rng = np.random.default_rng(5)
    rows = [(y, f"t{i}", 5, 6, *[None if c == "score_pct" and i == 0 else float(rng.normal()) for c in features[:-1]], 1.0) for y in (1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "year int, team string, wins long, losses long, " + ", ".join(f"{c} double" for c in features))
    got = {(r["year"], r["team"]): r for r in C.dominance_seasons(df).collect()}
    pdf = df.toPandas()
    for y in (1, 2):
        p = pdf[pdf.year == y].fillna(0)
        z = {c: (p[c] - p[c].mean()) / p[c].std(ddof=0) if p[c].std(ddof=0) > 0 else p[c] * 0 for c in features}
        want = sum(K.PILLAR_WEIGHTS[k] * sum(z[c] * s for c, s in m) / len(m) for k, m in K.PILLARS.items())
        for team, v in zip(p.team, want):
            assert got[(y, team)]["dominance_score"] == pytest.approx(v)


def test_rankings_of_bound_tables(tables):
    seasons = C.dominance_seasons(FV.team_features(B.team_stats(tables)))
    ranks = C.dominance_rankings(seasons).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, len(ranks) + 1))
    assert all(a["composite_score"] >= b["composite_score"] for a, b in zip(ranks, ranks[1:]))
    pdf = seasons.toPandas()
    for r in ranks:
        s = pdf[pdf.team == r["team"]].dominance_score
        assert r["seasons_top_8"] == int((s >= s.quantile(0.75)).sum())


def test_index_stays_between_zero_and_one(tables):
    view = FV.constructor_features(B.results(tables), B.races(tables), B.constructors(tables), B.status(tables))
    scores = [r["composite_score"] for r in constructor_index(view).collect()]
    assert scores and all(0 <= s <= 1 for s in scores)


def test_swot_and_styles(tables):
    profiles = tactical_profiles(FV.coaching_features(B.fixtures(tables), ["matchId"]))
    judged = C.swot(profiles).collect()
    assert all(r["strengths"] == "None" or len(r["strengths"].split(", ")) <= 3 for r in judged)
    pdf = profiles.toPandas()
    best = pdf.loc[pdf.win_rate.idxmax(), "team"]
    assert next(r for r in judged if r["team"] == best)["strengths"].startswith("Win Rate")


def test_unknown_features_are_split_evenly(spark):
    df = spark.createDataFrame([("rush_td", 0.5), ("new", 0.4)], "feature_name string, importance double")
    rows = J.expand_positions(df).collect()
    assert len([r for r in rows if r["team_feature"] == "new"]) == len(K.POSITIONS)
    assert {r["contribution_weight"] for r in rows if r["team_feature"] == "new"} == {0.125}
    assert {(r["position"], r["positional_value"]) for r in rows if r["team_feature"] == "rush_td"} == {("RB", 0.3), ("QB", 0.075), ("OL", 0.125)}


def test_subjects(spark):
    names = ["nrl_team_seasons", "nrl_fixtures", "NFL_stats", "player_ratings", "sales"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.subject_area(F.col("n")).alias("s"))
    assert dict(df.collect()) == {"nrl_team_seasons": "f1", "nrl_fixtures": "nrl", "NFL_stats": "nfl", "player_ratings": "european-football", "sales": "other"}


def test_json_numbers(spark):
    deep = '{"a": 1, "b": {"c": 2.5, "d": "{5", "e": {"f": true, "x": {"y": {"z": {"q": 7}}}}}, "g": [1], "h": null}'
    table = spark.createDataFrame([(deep,), ("{}",), (None,), ('{"p": "}{\\"{{{"}',)], "t string")
    assert [r[0] for r in table.select(Z.json_depth(F.col("t"))).collect()] == [6, 1, None, 1]
    assert dict(Z.json_metrics(table, "t").collect()) == {"a": 1.0, "b.c": 2.5, "b.e.f": 1.0, "b.e.x.y.z.q": 7.0}


def test_safe_casts(spark):
    df = spark.createDataFrame([("3",), ("3.7",), (" 4 ",), ("x",), ("1e3",), (None,), ("-.5",)], "v string")
    got = df.select(S.safe_long(F.col("v")), S.safe_double(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(3, 3.0), (None, 3.7), (4, 4.0), (None, None), (None, 1000.0), (None, None), (None, -0.5)]


def test_ledger(spark):
    rows = [("j1", 1, "UPLOADING"), ("j1", 2, "VALIDATING"), ("j1", 3, "LOADED"), ("j2", 4, "UPLOADING"), ("j2", 5, "LOADED"), ("j3", 6, "VALIDATING")]
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(j, s, st, at + dt.timedelta(seconds=s), 5, 5) for j, s, st in rows], "job_id string, seq long, status string, updated_at timestamp, total_records long, loaded long")
    allowed = {r["seq"]: r["is_allowed"] for r in L.check_transitions(log).collect()}
    assert allowed == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False}
    again = L.retriggers(log, F.lit("2024-02-01").cast("timestamp")).collect()
    assert [(r["job_id"], r["seq"], r["status"], r["loaded"]) for r in again] == [("j3", 7, "UPLOADING", 0)]
    assert [r["job_id"] for r in L.recent_jobs(log, 2).collect()] == ["j3", "j2"]


def test_read_functions(spark):
    out = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.8), (3, 1, 0.7)], "player_id long, cluster_id int, impact_score double")
    people = spark.createDataFrame([("1", "Ann", "x", 4), ("2", "Bob", "y", 6), ("3", None, "z", 9)], "player_id string, first_name string, club string, goals int")
    view = V.clusters_view(out, {"people": people}, "player_id", n=1)
    sizes = {r["cluster_id"]: (r["record_count"], r["metrics"]["avg_goals"]) for r in view["clusters"].collect()}
    assert sizes == {0: (2, 5.0), 1: (1, 9.0)}
    tops = {r["record_id"]: (r["label"], r["fields"]) for r in view["records"].collect()}
    assert tops == {"1": ("Ann", {"club": "x", "goals": "4"}), "3": ("3", {"club": "z", "goals": "9"})}


def test_curated_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "curated")
    one = spark.createDataFrame([(1, "a")], "id long, v string")
    Z.load_curated(one, path, "b1", "2024-01-01")
    Z.load_curated(spark.createDataFrame([(2, "b", 1.5)], "id long, v string, extra double"), path, "b2", "2024-01-01")
    Z.load_curated(one, path, "b1", "2024-01-01")
    rows = Z.read_curated(spark, path).select("id", "v", "extra").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", None), (2, "b", 1.5)]
    with pytest.raises(ValueError):
        Z.save_output(one, path, "id long, w string")
