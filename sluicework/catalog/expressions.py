"""Projection, filter and scalar expression queries."""

from pyspark.sql import functions as F

from sluicework.catalog.registry import query
from sluicework.catalog.sql import div, even, up, using
from sluicework.functions import constants as K
from sluicework.functions import scalar as S
from sluicework.plans import bindings as B
from sluicework.sources.sinks import json_metrics


@query("select_alias", sql="SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS order_day FROM orders")
def select_alias(t):
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"),
        F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("order_day"),
    )


@query("filter_pred", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity BETWEEN 10 AND 20 AND (l_returnflag = 'R' OR l_discount > 0.05::DOUBLE)")
def filter_pred(t):
    li = t.lineitem
    keep = li.l_shipdate.isNotNull() & li.l_quantity.between(10, 20) & ((li.l_returnflag == "R") | (li.l_discount > 0.05))
    return li.where(keep).select("l_orderkey", "l_linenumber", "l_quantity")


@query("like_prefix", sql="SELECT p_partkey, p_type, CAST(p_type = 'ECONOMY' OR p_type LIKE 'S%' AS INTEGER) AS hit FROM part")
def like_prefix(t):
    hit = (F.col("p_type") == "ECONOMY") | F.startswith("p_type", F.lit("S"))
    return t.part.select("p_partkey", "p_type", S.flag(hit).alias("hit"))


@query("case_flag", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity <= 3 AS INTEGER) AS podium, CAST(l_quantity = 1 AS INTEGER) AS win,
  CASE WHEN l_tax < 0.025::DOUBLE THEN 1 ELSE 0 END AS fast_stop, CASE WHEN l_tax > 0.055::DOUBLE THEN 1 ELSE 0 END AS slow_stop FROM lineitem""")
def case_flag(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.flag(F.col("l_quantity") <= 3).alias("podium"),
        S.flag(F.col("l_quantity") == 1).alias("win"), S.flag(F.col("l_tax") < 0.025).alias("fast_stop"),
        S.flag(F.col("l_tax") > 0.055).alias("slow_stop"),
    )


@query("safe_cast", sql=using("results", body="""SELECT result_id, driver_id, constructor_id, TRY_CAST(ms AS BIGINT) AS ms, TRY_CAST(speed AS DOUBLE) AS speed, TRY_CAST(lap_rank AS BIGINT) AS lap_rank,
  CAST(round(points / 4) AS BIGINT) AS rounded FROM results"""))
def safe_cast(t):
    r = B.results(t)
    return r.select(
        F.col("resultId").alias("result_id"), F.col("driverId").alias("driver_id"), F.col("constructorId").alias("constructor_id"),
        S.safe_long(F.col("milliseconds")).alias("ms"), S.safe_double(F.col("fastestLapSpeed")).alias("speed"),
        S.safe_long(F.col("rank")).alias("lap_rank"), S.double_to_long(F.col("points") / 4).alias("rounded"),
    )


@query("safe_divide", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) / nullif(l_partkey % 60, 0) AS per_lap, CAST(l_quantity AS DOUBLE) / nullif(l_discount, 0) AS per_discount FROM lineitem")
def safe_divide(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.safe_divide(F.col("l_quantity"), F.col("l_partkey") % 60).alias("per_lap"),
        S.safe_divide(F.col("l_quantity"), F.col("l_discount")).alias("per_discount"),
    )


@query("null_fns", sql="""SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, nullif(c_nationkey, 3) AS nation_or_null,
  coalesce(nullif(c_nationkey, 3), -1) AS nation_or_minus, CASE WHEN c_nationkey = 3 THEN 0.5::DOUBLE ELSE c_acctbal END AS form FROM customer""")
def null_fns(t):
    nation = F.nullif("c_nationkey", F.lit(3))
    return t.customer.select(
        "c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"),
        nation.alias("nation_or_null"), F.coalesce(nation, F.lit(-1)).alias("nation_or_minus"),
        F.coalesce(F.when(nation.isNotNull(), F.col("c_acctbal")), F.lit(0.5)).alias("form"),
    )


@query("round_half_up", sql=f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {up('l_extendedprice / 16', 2)} AS r2, {up('l_extendedprice / 16', 3)} AS r3, {up('-l_quantity / 8', 2)} AS neg FROM lineitem")
def round_half_up(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") / 16, 2).alias("r2"),
        F.round(F.col("l_extendedprice") / 16, 3).alias("r3"), F.round(-F.col("l_quantity") / 8, 2).alias("neg"),
    )


@query("round_half_even", sql=f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {even('l_quantity / 8', 2)} AS r2, {even('-l_quantity / 16', 3)} AS neg FROM lineitem")
def round_half_even(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.half_even(F.col("l_quantity") / 8, 2).alias("r2"),
        S.half_even(-F.col("l_quantity") / 16, 3).alias("neg"),
    )


@query("math_fns", sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_quantity - 25) AS distance, {up('power(l_quantity, 2)', 4)} AS square,
  {up('sqrt(l_quantity)', 6)} AS root, {up('exp(-0.07::DOUBLE * (2001 - year(l_shipdate)))', 6)} AS recency,
  {up('1 / (1 + exp(-l_discount))', 6)} AS squashed, greatest(l_quantity - 25, 0) AS clipped FROM lineitem""")
def math_fns(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.abs(q - 25).alias("distance"),
        F.round(F.pow(q, 2), 4).alias("square"), F.round(F.sqrt(q), 6).alias("root"),
        F.round(S.recency_weight(F.lit(2001) - F.year("l_shipdate")), 6).alias("recency"),
        F.round(S.sigmoid(F.col("l_discount")), 6).alias("squashed"), F.greatest(q - 25, F.lit(0.0)).alias("clipped"),
    )


@query("string_fns", sql="""SELECT p_partkey, p_brand || ' ' || p_type AS full_name, lower(p_type) AS kind, contains(lower(p_name), 'ring') AS has_ring,
  regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand_no, array_to_string(list_sort(string_split(p_name, ' ')), '-') AS sorted_words FROM part""")
def string_fns(t):
    return t.part.select(
        "p_partkey", F.concat("p_brand", F.lit(" "), "p_type").alias("full_name"), F.lower("p_type").alias("kind"),
        F.contains(F.lower("p_name"), F.lit("ring")).alias("has_ring"),
        F.regexp_replace("p_brand", "[^0-9]", "").alias("brand_no"),
        F.array_join(F.sort_array(F.split("p_name", " ")), "-").alias("sorted_words"),
    )


@query("date_fns", sql="""SELECT event_id, CAST(ts AS DATE) AS event_day, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d,
  event_type || '/year=' || strftime(ts, '%Y') || '/month=' || strftime(ts, '%m') || '/day=' || strftime(ts, '%d') || '/' || event_id || '/data.csv' AS path FROM events""")
def date_fns(t):
    return t.events.select(
        "event_id", F.to_date("ts").alias("event_day"), F.year("ts").alias("y"), F.month("ts").alias("m"),
        F.dayofmonth("ts").alias("d"),
        S.zone_path(F.col("event_type"), F.col("ts"), F.col("event_id").cast("string"), F.lit("data.csv")).alias("path"),
    )


@query("arith_features", sql=f"""SELECT c_custkey, {up('c_acctbal - 5000', 2)} AS above, {up(div('c_acctbal', 'c_nationkey'), 6)} AS per_nation,
  {up('c_acctbal / 10000', 6)} AS balance_share FROM customer""")
def arith_features(t):
    return t.customer.select(
        "c_custkey", F.round(F.col("c_acctbal") - 5000, 2).alias("above"),
        F.round(S.safe_divide(F.col("c_acctbal"), F.col("c_nationkey")), 6).alias("per_nation"),
        F.round(F.col("c_acctbal") / 10000, 6).alias("balance_share"),
    )


@query("json_flatten", sql="""
SELECT event_id, 'k' AS metric_name, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS metric_value FROM events
UNION ALL SELECT event_id, 'user.id', CAST(user_id AS DOUBLE) FROM events
UNION ALL SELECT event_id, 'user.deep.a.b.c.d', CAST(event_id AS DOUBLE) FROM events
UNION ALL SELECT event_id, 'user.deep.bad', CAST(CAST(event_type = 'error' AS INTEGER) AS DOUBLE) FROM events""")
def json_flatten(t):
    """Metrics nested six deep around the event properties; text and lists drop out."""
    doc = F.concat(
        F.lit('{"user": {"id": '), F.col("user_id").cast("string"), F.lit(', "deep": {"bad": '),
        (F.col("event_type") == "error").cast("string"), F.lit(', "a": {"b": {"c": {"d": '), F.col("event_id").cast("string"),
        F.lit('}}}}, "type": "'), F.col("event_type"), F.lit('", "text_number": "5"}, "list": [1, 2], '), F.expr("substring(props, 2)"),
    )
    return json_metrics(t.events.select("event_id", doc.alias("doc")), "doc", ["event_id"])


def _subject_sql() -> str:
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains(n, {w!r})' for w in words)} THEN '{subject}'" for subject, words in K.SUBJECT_WORDS.items()
    )
    return f"SELECT doc_id, n AS dataset, CASE {arms} ELSE 'other' END AS subject FROM named"


_NAMES = [
    ("en", "NRL_team_seasons"), ("fr", "nfl_stats"), ("de", "all_player_profiles"), ("es", "nrl_fixtures"),
]


@query("literal_rules", sql="WITH named AS (SELECT doc_id, lower(CASE lang " + " ".join(f"WHEN '{l}' THEN '{n}'" for l, n in _NAMES) + " ELSE 'sales_orders' END || '_' || source) AS n FROM documents) " + _subject_sql())
def literal_rules(t):
    name = F.lit("sales_orders")
    for lang, text in reversed(_NAMES):
        name = F.when(F.col("lang") == lang, text).otherwise(name)
    named = t.documents.select("doc_id", F.lower(F.concat(name, F.lit("_"), "source")).alias("dataset"))
    return named.withColumn("subject", S.subject_area(F.col("dataset")))


@query("table_name_sanitise", sql=r"""
SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g'), '^_+', ''), 1, 128) AS plain_name,
  CASE WHEN n = '' THEN 'unnamed_table' WHEN regexp_matches(n, '^[0-9]') THEN substr('t_' || n, 1, 128) ELSE substr(n, 1, 128) END AS batch_name
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(substr(url, 8), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS n FROM pages)""")
def table_name_sanitise(t):
    return t.pages.select(
        "page_id", S.table_name(F.col("url")).alias("plain_name"),
        S.table_name(F.expr("substring(url, 8)"), collapse=True).alias("batch_name"),
    )


