"""The order-and-line-item tables seen as the source tables of the feature views.

Each function derives one source table from the given tables with plain expressions, so
every view and analysis can run on them at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



class Tables:
    """Access to the parquet tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def whole(amount: str) -> Column:
    return F.floor(F.col(amount)).cast("long")


def results(t: Tables) -> DataFrame:
    missing = F.lit("\\N")
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("resultId"),
        F.col("l_orderkey").alias("raceId"),
        F.col("l_partkey").alias("driverId"),
        F.col("l_suppkey").alias("constructorId"),
        (F.col("l_linenumber") - 1).cast("long").alias("grid"),
        whole("l_quantity").alias("positionOrder"),
        cents("l_discount").cast("double").alias("points"),
        (F.col("l_partkey") % 60).alias("laps"),
        F.when(F.col("l_linestatus") == "F", cents("l_extendedprice").cast("string")).otherwise(missing).alias("milliseconds"),
        F.when(F.col("l_returnflag") != "R", F.concat(cents("l_tax").cast("string"), F.lit(".5"))).otherwise(missing).alias("fastestLapSpeed"),
        F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber").cast("string")).otherwise("").alias("rank"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).cast("long").alias("statusId"),
    )


def status(t: Tables) -> DataFrame:
    """The names of the three codes that ``results`` gives; no scan is needed for them."""
    return t.spark.sql("SELECT * FROM VALUES (1L, 'Finished'), (2L, '+1 Lap'), (3L, 'Engine') AS s(statusId, status)")


def races(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("raceId"), F.year("o_orderdate").cast("long").alias("year"),
        F.month("o_orderdate").cast("long").alias("round"), F.col("o_orderpriority").alias("name"),
        F.col("o_custkey").alias("circuitId"),
    )


def circuits(t: Tables) -> DataFrame:
    c, n = t.customer, t.nation
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("circuitId"), F.col("c_name").alias("circuitRef"), F.col("n_name").alias("country")
    )


def drivers(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("driverId"), F.col("p_name").alias("driverRef"), F.col("p_brand").alias("forename"),
        F.col("p_type").alias("surname"), F.col("p_type").alias("nationality"),
    )


def constructors(t: Tables) -> DataFrame:
    s, n = t.supplier, t.nation
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("constructorId"), F.col("s_name").alias("name"), F.col("n_name").alias("nationality")
    )


def qualifying(t: Tables) -> DataFrame:
    return (
        t.lineitem.where(F.col("l_returnflag") != "N")
        .groupBy(F.col("l_orderkey").alias("raceId"), F.col("l_partkey").alias("driverId"))
        .agg(F.min("l_linenumber").cast("long").alias("position"))
    )


def pit_stops(t: Tables) -> DataFrame:
    hundredths = cents("l_extendedprice") % 13000
    return t.lineitem.select(
        F.col("l_orderkey").alias("raceId"), F.col("l_partkey").alias("driverId"),
        F.col("l_linenumber").cast("long").alias("stop"), whole("l_quantity").alias("lap"),
        (hundredths / 100).alias("duration"), (hundredths * 10).alias("milliseconds"),
    )


def fixtures(t: Tables) -> DataFrame:
    """One match per order: its first line's supplier nation at home to the customer's."""
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    first = t.lineitem.groupBy("l_orderkey").agg(F.min(line).alias("l")).select("l_orderkey", "l.*")
    o, c, s = t.orders, t.customer, t.supplier
    home = t.nation.select(F.col("n_nationkey").alias("hk"), F.col("n_name").alias("HomeTeam"))
    away = t.nation.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("AwayTeam"))
    wide = (
        first.join(o, F.col("l_orderkey") == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(s, F.col("l_suppkey") == s.s_suppkey)
        .join(home, s.s_nationkey == F.col("hk"))
        .join(away, c.c_nationkey == F.col("ak"))
        .where(F.col("HomeTeam") != F.col("AwayTeam"))
    )
    return wide.select(
        F.col("l_orderkey").alias("matchId"), F.col("l_shipdate").alias("KickOffTime"),
        F.year("l_shipdate").cast("long").alias("Season"),
        (F.floor(F.dayofyear("l_shipdate") / 14) + 1).cast("long").alias("Round"),
        "HomeTeam", "AwayTeam", F.col("s_name").alias("Venue"),
        whole("l_quantity").alias("HomeScore"), (whole("l_extendedprice") % 50).alias("AwayScore"),
    )


def team_stats(t: Tables) -> DataFrame:
    """Supplier seasons in the shape of a team statistics table."""
    li, s = t.lineitem, t.supplier
    a, r, f = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    q, price, games = F.col("l_quantity"), whole("l_extendedprice"), F.count("*")
    base = li.groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("year")).agg(
        F.count_if(a).alias("wins"),
        F.count_if(r).alias("losses"),
        F.nullif(F.count_if((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7)), F.lit(0)).alias("ties"),
        F.sum(whole("l_quantity")).alias("points"),
        F.sum(F.col("l_linenumber") * 7).alias("points_opp"),
        games.alias("g"),
        F.sum(price).alias("total_yards"),
        F.sum("l_linenumber").alias("plays_offense"),
        F.count_if(F.col("l_tax") >= 0.07).alias("turnovers"),
        F.count_if(F.col("l_tax") >= 0.08).alias("fumbles_lost"),
        F.count_if(q > 25).alias("first_down"),
        F.count_if(a).alias("pass_cmp"),
        games.alias("pass_att"),
        F.coalesce(F.sum(F.when(a, price)), F.lit(0)).alias("pass_yds"),
        F.count_if(a & (q > 40)).alias("pass_td"),
        F.count_if(q < 5).alias("pass_int"),
        F.count_if(a & (q > 25)).alias("pass_fd"),
        F.count_if(r).alias("rush_att"),
        F.coalesce(F.sum(F.when(r, price)), F.lit(0)).alias("rush_yds"),
        F.count_if(r & (q > 40)).alias("rush_td"),
        F.count_if(r & (q > 25)).alias("rush_fd"),
        F.count_if(f).alias("penalties"),
        F.coalesce(F.sum(F.when(f, F.col("l_linenumber"))), F.lit(0)).alias("penalties_yds"),
        F.count_if(f & (q > 25)).alias("pen_fd"),
        F.count_if(q > 20).alias("__scored"),
    )
    per = {
        "points_diff": F.col("points") - F.col("points_opp"),
        "mov": (F.col("points") - F.col("points_opp")) / F.col("g"),
        "win_loss_perc": F.col("wins") / F.col("g"),
        "yds_per_play_offense": F.col("total_yards") / F.col("plays_offense"),
        "pass_net_yds_per_att": F.col("pass_yds") / F.col("pass_att"),
        "rush_yds_per_att": F.try_divide(F.col("rush_yds").cast("double"), F.col("rush_att").cast("double")),
        "score_pct": F.col("__scored") * 100 / F.col("g"),
        "turnover_pct": F.col("turnovers") * 100 / F.col("g"),
        "exp_pts_tot": (F.col("points") - F.col("points_opp")) / F.col("g") * 2,
    }
    named = base.withColumns(per).join(s.select("s_suppkey", F.col("s_name").alias("team")), F.col("l_suppkey") == F.col("s_suppkey"))
    return named.select("year", "team", *TEAM_COLUMNS)


TEAM_COLUMNS = [
    "wins", "losses", "ties", "win_loss_perc", "points", "points_opp", "points_diff", "mov", "g", "total_yards",
    "plays_offense", "yds_per_play_offense", "turnovers", "fumbles_lost", "first_down", "pass_cmp", "pass_att",
    "pass_yds", "pass_td", "pass_int", "pass_net_yds_per_att", "pass_fd", "rush_att", "rush_yds", "rush_td",
    "rush_yds_per_att", "rush_fd", "penalties", "penalties_yds", "pen_fd", "score_pct", "turnover_pct", "exp_pts_tot",
]


def player_profiles(t: Tables) -> DataFrame:
    c, n = t.customer, t.nation
    value = F.when(F.col("c_nationkey") % 5 == 0, "n/a").otherwise(cents("c_acctbal").cast("string"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("player_id"), F.col("c_mktsegment").alias("position"),
        F.col("n_name").alias("league"), value.alias("market_value"),
    )


def player_stats(t: Tables) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")

    def text(c: Column) -> Column:
        return c.cast("string")

    none = F.count_if((s == "P") & (p == "1-URGENT"))
    return t.orders.groupBy(F.col("o_custkey").cast("string").alias("player_id")).agg(
        text(F.count("*") - 1).alias("appearances"),
        text(F.count_if(s == "F")).alias("matches_started"),
        text(F.sum(F.floor(F.col("o_totalprice") / 1000))).alias("minutes_played"),
        text(F.count_if(p == "1-URGENT")).alias("goals"),
        text(F.count_if(p == "2-HIGH")).alias("assists"),
        text(F.count("*") * 0.25).alias("expected_goals"),
        text(F.count("*") * 0.125).alias("expected_assists"),
        text(F.sum(cents("o_totalprice")) % 1000 / 100).alias("rating"),
        text(F.count_if(s != "P")).alias("total_shots"),
        text(F.count_if(s == "F")).alias("shots_on_target"),
        F.when(none == 0, "NULL").otherwise(text(none)).alias("yellow_cards"),
        text(F.count_if((s == "O") & (p == "1-URGENT"))).alias("red_cards"),
        text(F.count_if(p == "3-MEDIUM")).alias("tackles"),
        text(F.count_if(p == "4-NOT SPECIFIED")).alias("interceptions"),
        text(F.count_if(p == "5-LOW")).alias("saves"),
    )


def job_events(t: Tables) -> DataFrame:
    """The event table as an append-only job status log: one job per user."""
    kind = F.col("event_type")
    state = (
        F.when(kind == "click", "UPLOADING").when(kind == "view", "VALIDATING").when(kind == "signup", "TRANSFORMING")
        .when(kind == "purchase", "LOADED").otherwise("FAILED")
    )
    size = cents("value")
    return t.events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), state.alias("status"),
        F.concat(F.lit("dataset_"), (F.col("user_id") % 10).cast("string")).alias("dataset"),
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("table_"), (F.col("user_id") % 10).cast("string"))).alias("bq_table"),
        size.alias("file_size_bytes"), F.col("ts").alias("updated_at"), size.alias("total_records"),
        F.when(kind == "purchase", size).otherwise(0).alias("loaded"),
    )


def raw_people(t: Tables) -> DataFrame:
    """Customers as an untyped upload: personal data, odd nulls, bad cells and copies."""
    c = t.customer
    k, name = F.col("c_custkey"), F.col("c_name")
    digits = F.lpad(k.cast("string"), 9, "0")
    upload = c.select(
        k.cast("string").alias("row_id"),
        F.concat(F.lit("User"), k.cast("string"), F.lit("@Example.com")).alias("email"),
        F.concat(F.lit("+1-555-"), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 6, 4)).alias("phone"),
        F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 2), F.lit("-"), F.substring(digits, 6, 4)).alias("tax_id"),
        F.concat(F.lit("Ann "), name).alias("full_name"),
        F.concat((k % 99 + 1).cast("string"), F.lit(" Main St")).alias("address"),
        F.concat(F.lit("19"), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit("-05-15")).alias("dob"),
        F.concat(F.lit("41111111"), digits.substr(2, 8)).alias("card_number"),
        F.concat(F.lit("10."), (k % 200).cast("string"), F.lit(".3.4")).alias("ip_addr"),
        F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.org")).alias("contact"),
        F.when((k >= 200) & (k % 7 == 0), "many").when(k % 11 == 0, " NA ").otherwise((k % 50).cast("string")).alias("visits"),
        F.when((k >= 200) & (k % 13 == 0), "12,5").otherwise(F.concat((k % 50).cast("string"), F.lit(".25"))).alias("balance"),
        F.when(k % 3 == 0, "yes").when(k % 3 == 1, "No").otherwise("1").alias("active"),
        F.when(k % 5 == 0, "NULL").otherwise(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("joined"),
        F.col("c_mktsegment").alias("segment"),
        F.explode(F.when(k % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return upload


PEOPLE_COLUMNS = [
    "row_id", "email", "phone", "tax_id", "full_name", "address", "dob", "card_number", "ip_addr", "contact",
    "visits", "balance", "active", "joined", "segment",
]


def embedding_rows(t: Tables) -> DataFrame:
    """vec_id, label and the vector as columns e0…; all vectors must have as many places."""
    least, width = t.embeddings.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != width:
        raise ValueError(f"vectors of {least} to {width} places")
    return t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)])
