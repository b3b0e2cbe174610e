"""Registered queries against their SQL on the smallest tables.

A spread of quick ones runs here; ``tools/check_oracles.py`` runs all of them.
"""

from __future__ import annotations

import pytest

from tools.check_oracles import connect, rows_of

import __spark_entry__ as entry

from .conftest import SMALL

NAMES = [
    "agg_entity_season", "view_f1_constructor_features", "view_nrl_match_features", "view_team_features", "join_theta_h2h",
    "win_rolling5", "win_topk_per_group", "agg_quantile", "agg_rivalry", "safe_cast", "json_flatten", "pii_mask",
    "cast_validate", "dedup_exact", "src_csv", "zip_expand", "sink_curated_append", "ml_scale", "ml_dominance_ranking",
    "api_clusters", "ledger_transitions", "st_retention",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toArrow()
    want = con.execute(entry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
