"""The eight feature views over the bound tables."""

from sluicework.catalog.registry import query
from sluicework.catalog.sql import using
from sluicework.plans import bindings as B
from sluicework.plans import feature_views as V


def driver_view(t):
    return V.driver_features(
        B.results(t), B.races(t), B.circuits(t), B.drivers(t), B.constructors(t), B.status(t), B.qualifying(t)
    )


def constructor_view(t):
    return V.constructor_features(B.results(t), B.races(t), B.constructors(t), B.status(t))


def pitstop_view(t):
    return V.pitstop_features(B.pit_stops(t), B.races(t), B.circuits(t), B.drivers(t), B.results(t), B.constructors(t))


def match_view(t):
    return V.match_features(B.fixtures(t), ["matchId"])


def coaching_view(t):
    return V.coaching_features(B.fixtures(t), ["matchId"])


@query("view_player_features", sql=using("player_features", body="SELECT * FROM player_features"))
def player_view(t):
    return V.player_features(B.player_profiles(t), B.player_stats(t))


@query("view_team_features", sql=using("team_features", body="SELECT * FROM team_features"))
def team_view(t):
    return V.team_features(B.team_stats(t))


query("view_f1_driver_features", sql=using("driver_features", body="SELECT * FROM driver_features"))(driver_view)
query("view_f1_constructor_features", sql=using("constructor_season", body="SELECT * FROM constructor_season"))(constructor_view)
query("view_f1_pitstop_features", sql=using("pit_features", body="SELECT * FROM pit_features"))(pitstop_view)
query("view_nrl_match_features", sql=using("match_features", body="SELECT * FROM match_features"))(match_view)
query("view_nrl_coaching_features", sql=using("coaching", body="SELECT * FROM coaching"))(coaching_view)


@query("view_nrl_team_features", sql=using("team_season", body="SELECT * FROM team_season"))
def season_view(t):
    return V.team_season_features(B.fixtures(t))
