"""Large joins are cut by the rows of the fact, whatever the number of shuffle partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.catalog import summaries
from sluicework.catalog import views as V
from sluicework.operators import aggregates as A
from sluicework.operators import joins as J
from sluicework.plans import analyses as P


def test_partitions_of_a_large_join_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "PART_ROWS", 100)
    fact = spark.range(2000).withColumn("k", F.col("id") % 50)
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = J.join_large(fact, dim, "k")
    assert joined.rdd.getNumPartitions() == 20
    assert joined.agg(F.count("*"), F.sum("v")).first() == (1600, 40 * sum(range(40)) * 2)
    assert J.join_large(fact.limit(300), dim, "k").count() == 240


def test_constructor_seasons_do_not_depend_on_the_partitions(spark, tables, monkeypatch):
    plain = V.constructor_view(tables)
    monkeypatch.setattr(J, "PART_ROWS", 100)
    cut = V.constructor_view(tables)
    assert "REPARTITION_BY_NUM" in cut._jdf.queryExecution().toString()
    assert cut.columns == plain.columns
    rows = sorted(map(tuple, cut.collect()), key=str)
    assert rows and rows == sorted(map(tuple, plain.collect()), key=str)


def test_circuits_are_joined_to_races_and_not_to_entries(spark, tables):
    """Each join of the entries with a large table is one more shuffle of all of them."""
    lines = V.driver_view(tables)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    at = next(i for i, x in enumerate(lines) if "Join Inner, (circuitId" in x)
    below = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
    assert not any("l_linenumber" in x for x in lines[at:below])


def test_pit_stops_take_their_races_with_circuits_and_stay_cut_by_driver(spark, tables, monkeypatch):
    """Stops are shuffled for entries, races and drivers; neither circuits nor the grouping shuffle them again."""
    plain = sorted(map(tuple, A.race_driver_stops(V.pitstop_view(tables)).collect()), key=str)
    monkeypatch.setattr(J, "PART_ROWS", 100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    try:
        view = V.pitstop_view(tables)
        lines = view._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        at = next(i for i, x in enumerate(lines) if "Join Inner, (circuitId" in x)
        below = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
        assert not any("l_linenumber" in x for x in lines[at:below])
        grouped = A.race_driver_stops(view)
        shuffles = grouped._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(raceId")
        assert shuffles == view._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(raceId") > 0
        assert sorted(map(tuple, grouped.collect()), key=str) == plain and plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def same_when_cut(monkeypatch, run):
    """The rows of a query, which must not change when its large join has a partition for 100 rows of the fact."""
    plain = sorted(map(tuple, run().collect()), key=str)
    counted, found = J.large_parts, []
    monkeypatch.setattr(J, "PART_ROWS", 100)
    monkeypatch.setattr(J, "large_parts", lambda fact: found.append(counted(fact)) or found[-1])
    assert sorted(map(tuple, run().collect()), key=str) == plain
    assert found and min(found) > 40  # 6,000 lines
    return plain


def test_ranked_labels_do_not_depend_on_the_partitions(tables, monkeypatch):
    assert same_when_cut(monkeypatch, lambda: summaries.ml_cluster_label_ranked(tables))


def test_composite_index_does_not_depend_on_the_partitions(tables, monkeypatch):
    assert same_when_cut(monkeypatch, lambda: summaries.ml_composite_index(tables))


def test_peak_seasons_do_not_depend_on_the_partitions(tables, monkeypatch):
    assert same_when_cut(monkeypatch, lambda: summaries.agg_argmax(tables))


def test_constructor_rankings_do_not_depend_on_the_partitions(tables, monkeypatch):
    ranked = lambda: P.constructor_rankings(V.constructor_view(tables), ks=[3], starts=1)["f1_constructor_rankings"]
    assert same_when_cut(monkeypatch, ranked)
