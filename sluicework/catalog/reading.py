"""Read functions, the job ledger, and the streams."""

import datetime
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from sluicework.catalog import relations as R
from sluicework.catalog import summaries as M
from sluicework.catalog import views as V
from sluicework.catalog.registry import query
from sluicework.catalog.sql import big, cents, even, up, using
from sluicework.operators import aggregates as A
from sluicework.operators import ledger as L
from sluicework.operators import scoring as C
from sluicework.operators import serving as S
from sluicework.plans import bindings as B
from sluicework.session import scratch_path
from sluicework.sources.loads import drop_expired
from sluicework.sources.sinks import load_curated, read_curated
from sluicework.streaming import events as E
from sluicework.streaming import ingest as N


def _sources(t):
    return {
        "customer": t.customer.withColumnRenamed("c_custkey", "id"),
        "orders": t.orders.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.count("*").alias("n_orders")),
    }


def _output(t):
    c = M.clustered_customers(t)
    return c.select(F.col("c_custkey").alias("id"), "cluster_id", F.col("score").alias("impact_score"))


_WIDE = f"WITH {M.CLUSTERED}, wide AS (SELECT c.c_custkey AS id, cluster_id, score, u.c_name, u.c_nationkey, u.c_acctbal, u.c_mktsegment, n_orders FROM clustered c JOIN customer u USING (c_custkey))"


@query("api_clusters", sql=f"""{_WIDE} SELECT cluster_id, CAST(id AS VARCHAR) AS record_id, c_name AS label, {up('score', 4)} AS score, place, c_mktsegment AS segment, CAST(n_orders AS VARCHAR) AS n_orders FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id) AS INTEGER) AS place FROM wide) WHERE place <= 10""")
def api_clusters(t):
    records = S.clusters_view(_output(t), _sources(t), "id")["records"]
    fields = [F.col("fields")["c_mktsegment"].alias("segment"), F.col("fields")["n_orders"].alias("n_orders")]
    return records.select("cluster_id", "record_id", "label", "score", "place", *fields)


@query("api_clusters_summary", sql=f"{_WIDE} " + " UNION ALL ".join(f"SELECT cluster_id, count(*) AS record_count, 'avg_{c}' AS metric, {up(f'avg({c})', 2)} AS value FROM wide GROUP BY cluster_id" for c in ("c_nationkey", "c_acctbal", "n_orders")))
def api_clusters_summary(t):
    return A.cluster_metrics_long(S.clusters_view(_output(t), _sources(t), "id")["clusters"])


@query("api_anomalies", sql=f"WITH {M.SCORED} SELECT CAST(event_id AS VARCHAR) AS record_id, event_type AS label, {up('anomaly_score', 4)} AS anomaly_score, is_anomaly = 1 AS is_anomaly, CAST(user_id AS VARCHAR) AS user_id FROM scored ORDER BY scored.anomaly_score DESC, event_id LIMIT 50")
def api_anomalies(t):
    view = S.anomalies_view(M.scored_events(t), {"events": t.events.select("event_id", "event_type", "user_id")}, "event_id")
    return view["records"].select("record_id", "label", "anomaly_score", "is_anomaly", F.col("fields")["user_id"].alias("user_id"))


query("api_anomalies_summary", sql=f"WITH {M.SCORED} {M.SUMMARY}")(lambda t: S.anomalies_view(M.scored_events(t), {}, "event_id")["summary"])


@query("api_predictions", sql=f"WITH {M.PREDICTIONS} SELECT CAST(p.o_orderkey AS VARCHAR) AS record_id, o_orderstatus AS label, {up('predicted_price', 4)} AS predicted, {up('actual_price', 4)} AS actual, {up('residual', 4)} AS residual FROM predictions p JOIN orders o ON p.o_orderkey = o.o_orderkey ORDER BY abs(p.residual) DESC, p.o_orderkey LIMIT 50")
def api_predictions(t):
    return S.predictions_view(M.predictions(t), {"orders": t.orders}, "o_orderkey")["records"]


query("api_predictions_summary", sql=f"WITH {M.PREDICTIONS} {M.QUALITY}")(lambda t: S.predictions_view(M.predictions(t), {}, "o_orderkey")["summary"])


@query("api_profile", sql=R.with_positions("SELECT * FROM weights ORDER BY position, team_feature, contribution_weight, team_feature_importance, positional_value LIMIT 200"))
def api_profile(t):
    return S.profile_view(R.join_expand_matrix(t))["records"]


@query("api_team_bundle", sql=using("sides", "dominance", body="") + f""", riv AS ({M.RIVALRY}) SELECT 'rivalries' AS part, team, CAST(total_matches AS DOUBLE) AS figure, count(*) AS n FROM riv GROUP BY ALL
  UNION ALL SELECT 'seasons', team, {even('dominance_score', 4)}, 1 FROM dominance""")
def api_team_bundle(t):
    """The ordered result sets of a team page, stacked as (part, team, figure) counts."""
    seasons = C.dominance_seasons(V.team_view(t)).withColumn("dominance_score", F.bround("dominance_score", 4))
    bundle = S.team_bundle({"rivalries": A.rivalry_matrix(R.matches(t)), "seasons": seasons})
    a = bundle["rivalries"].groupBy("team", F.col("total_matches").cast("double").alias("figure")).agg(F.count("*").alias("n"))
    b = bundle["seasons"].select("team", F.col("dominance_score").alias("figure"), F.lit(1).cast("long").alias("n"))
    return a.select(F.lit("rivalries").alias("part"), "team", "figure", "n").unionByName(b.select(F.lit("seasons").alias("part"), "team", "figure", "n"))


@query("label_column", sql="SELECT c_custkey AS id, c_name AS label, 'c_name' AS label_column FROM customer")
def label_column(t):
    name = S.label_column(t.customer, "c_custkey")
    return t.customer.select(F.col("c_custkey").alias("id"), F.col(name).alias("label"), F.lit(name).alias("label_column"))


# Ledger

_CURRENT = "current AS (SELECT * FROM (SELECT *, min(updated_at) OVER (PARTITION BY job_id) AS created_at, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM job_events) WHERE rn = 1)"


@query("ledger_list", sql=using("job_events", body="") + f", {_CURRENT} SELECT job_id, status, dataset, created_at, seq FROM current ORDER BY created_at DESC, job_id LIMIT 100")
def ledger_list(t):
    return L.recent_jobs(B.job_events(t)).select("job_id", "status", "dataset", "created_at", "seq")


@query("ledger_retrigger", sql=using("job_events", body="") + f", {_CURRENT} SELECT job_id, seq + 1 AS seq, 'UPLOADING' AS status, CAST(0 AS BIGINT) AS total_records FROM current WHERE status <> 'LOADED'")
def ledger_retrigger(t):
    return L.retriggers(B.job_events(t), F.current_timestamp()).select("job_id", "seq", "status", "total_records")


_NEXT = {"UPLOADING": "'VALIDATING'", "VALIDATING": "'TRANSFORMING', 'LOADED', 'REJECTED', 'FAILED'", "TRANSFORMING": "'LOADED', 'FAILED'", "REJECTED": "'UPLOADING'", "FAILED": "'UPLOADING'"}


@query("ledger_transitions", sql=using("job_events", body="") + f""" SELECT job_id, seq, status, prev_status, CASE WHEN prev_status IS NULL THEN status = 'UPLOADING' {' '.join(f"WHEN prev_status = '{s}' THEN status IN ({n})" for s, n in _NEXT.items())} ELSE false END AS is_allowed
  FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS prev_status FROM job_events)""")
def ledger_transitions(t):
    return L.check_transitions(B.job_events(t)).select("job_id", "seq", "status", "prev_status", "is_allowed")


@query("st_dead_letter", sql=f"SELECT CAST(user_id AS VARCHAR) AS job_id, 'dataset_' || (user_id % 10) AS dataset, count(*) AS attempts, arg_max('value ' || CAST({cents('value')} AS VARCHAR), event_id) AS last_error, max(event_id) AS last_seq FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 5")
def st_dead_letter(t):
    e = t.events.where(F.col("event_type") == "error").select(
        F.col("user_id").cast("string").alias("job_id"), F.concat(F.lit("dataset_"), (F.col("user_id") % 10).cast("string")).alias("dataset"),
        F.concat(F.lit("value "), B.cents("value").cast("string")).alias("error"), F.col("event_id").alias("seq"),
    )
    return L.dead_letters(e)


@query("st_retention", sql="SELECT event_id, zone, CAST(age AS INTEGER) AS age_days, age > CASE zone WHEN 'bronze' THEN 90 WHEN 'silver' THEN 30 WHEN 'rejected' THEN 14 ELSE 60 END AS expired FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'bronze' WHEN 'view' THEN 'silver' WHEN 'error' THEN 'rejected' ELSE 'staging' END AS zone, date_diff('day', CAST(ts AS DATE), DATE '2024-02-10') AS age FROM events)")
def st_retention(t):
    kind = F.col("event_type")
    zone = F.when(kind == "click", "bronze").when(kind == "view", "silver").when(kind == "error", "rejected").otherwise("staging")
    rows = t.events.select("event_id", zone.alias("zone"), "ts")
    return L.zone_status(rows, F.col("zone"), F.col("ts"), F.lit("2024-02-10").cast("date")).select("event_id", "zone", "age_days", "expired")


# Streams: each runs to the end of what is there and returns what it wrote


@query("st_events_window", sql=f"SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n_events, {big('sum(' + cents('value') + ')')} AS value_cents FROM events GROUP BY ALL")
def st_events_window(t):
    counts = E.windowed_counts(E.read_events(t.spark, t.folder))
    out = scratch_path(t.spark, "windows")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    # Update mode: a window leaves the state once the watermark has passed it.
    stream = counts.writeStream.outputMode("update").option("checkpointLocation", scratch_path(t.spark, "state")).trigger(availableNow=True).foreachBatch(keep).start()
    stream.awaitTermination()
    wall = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    key = ["window_start", "window_end", "event_type"]
    last = t.spark.read.parquet(out).groupBy(*key).agg(F.max_by(F.struct("n_events", "value_cents"), "batch").alias("last"))
    return last.select(*key, "last.*").withColumns(wall)


@query("st_load", sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, DATE '1970-01-01' AS ingest_date, 'batch-0' AS batch_id FROM orders")
def st_load(t):
    """The second stage: a silver table streamed into a curated one."""
    target = scratch_path(t.spark, "curated")
    ddl = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    N.stream_load(t.spark, t.folder, ddl, target, scratch_path(t.spark, "state"), files="orders.parquet").awaitTermination()
    return t.spark.read.parquet(target)


@query("st_load_restarts", sql="SELECT o_orderkey, o_orderstatus, 'batch-' || CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS batch_id FROM orders")
def st_load_restarts(t):
    """A growing silver folder loaded under one checkpoint, then under a new one, then again: every file once."""
    source, target, ddl = scratch_path(t.spark, "silver"), scratch_path(t.spark, "curated"), "o_orderkey long, o_orderstatus string"
    orders = t.orders.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus")
    orders.where("o_orderstatus = 'F'").write.parquet(source)
    N.stream_load(t.spark, source, ddl, target, scratch_path(t.spark, "state")).awaitTermination()
    orders.where("o_orderstatus <> 'F'").write.mode("append").parquet(source)
    for _ in range(2):
        N.stream_load(t.spark, source, ddl, target, scratch_path(t.spark, "state")).awaitTermination()
    return t.spark.read.parquet(target).select("o_orderkey", "o_orderstatus", "batch_id")


@query("st_retention_drop", sql="SELECT event_id, CAST(ts AS DATE) AS ingest_date FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-02-10') <= 14")
def st_retention_drop(t):
    """Events written by day; the days beyond the retention of rejected rows are dropped, the others read."""
    path = scratch_path(t.spark, "days")
    t.events.select("event_id", F.to_date("ts").alias("ingest_date")).write.partitionBy("ingest_date").parquet(path)
    drop_expired(t.spark, path, datetime.date(2024, 2, 10), L.RETENTION_DAYS["rejected"])
    return t.spark.read.schema("event_id long, ingest_date date").parquet(path)


@query("st_ingest_archives", sql="SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(NULL AS VARCHAR) AS segment FROM customer UNION ALL SELECT CAST(c_custkey AS BIGINT), NULL, c_mktsegment FROM customer")
def st_ingest_archives(t):
    """Customers as archives that hold two members of one name with different headers, each a job of its own."""
    root = scratch_path(t.spark, "zones")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        buffer, rows = io.BytesIO(), rows.sort_values("c_custkey")
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("names/people.csv", rows[["c_custkey", "c_name"]].to_csv(index=False))
            z.writestr("markets/people.csv", rows.rename(columns={"c_mktsegment": "segment"})[["segment", "c_custkey"]].to_csv(index=False))
        return pd.DataFrame({"body": [buffer.getvalue()[:-1].decode("latin-1")], "part": [int(rows["part"].iloc[0])]})

    rows = t.customer.select(F.floor(F.col("c_custkey") / 5000).alias("part"), "c_custkey", "c_name", "c_mktsegment")
    packed = rows.groupBy("part").applyInPandas(pack, "body string, part long")
    # An archive without a comment ends with a zero byte, which the text writer puts back.
    raw = F.encode("body", "ISO-8859-1").cast("string")
    packed.select(raw.alias("value"), "part").write.partitionBy("part").option("encoding", "ISO-8859-1").option("lineSep", "\0").text(f"{root}/inbox")
    found = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/inbox").select("path").collect()
    zones = N.Zones(root)
    N.take_files(t.spark, [("uploads", "zip", r.path) for r in found], zones, day="2024-01-01")
    return read_curated(t.spark, zones.curated("people")).select("c_custkey", "c_name", "segment")


@query("st_idempotency", sql="SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS n_orders FROM orders GROUP BY 1")
def st_idempotency(t):
    """A batch loaded three times under one id is there once."""
    target = scratch_path(t.spark, "curated")
    for _ in range(3):
        load_curated(t.orders.select("o_orderkey", "o_orderstatus"), target, "batch-7", "2024-01-01")
    return t.spark.read.parquet(target).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_orders"))


@query("st_ingest", sql="SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_name FROM customer")
def st_ingest(t):
    """Customers as CSV uploads, watched, cleaned and loaded to the curated table."""
    root = scratch_path(t.spark, "zones")
    t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.option("header", True).csv(f"{root}/inbox/customers")
    zones = N.Zones(root)
    N.stream_ingest(t.spark, f"{root}/inbox", zones, f"{root}/state", day="2024-01-01").awaitTermination()
    return t.spark.read.parquet(zones.curated("customers")).select("c_custkey", "c_mktsegment", "c_nationkey", "c_name")


def _machine_sql() -> str:
    allowed = " OR ".join(f"(w.current_status = '{a}' AND o.status IN ({', '.join(repr(b) for b in after)}))" for a, after in L.NEXT_STATES.items() if after)
    return using("job_events", body=f"""SELECT job_id, seq, status, accepted, current_status FROM walk""").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT job_id, seq", f""",
o AS (SELECT job_id, seq, status, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM job_events),
walk AS (SELECT job_id, seq, status, n, status = 'UPLOADING' AS accepted, CASE WHEN status = 'UPLOADING' THEN status END AS current_status FROM o WHERE n = 1
  UNION ALL SELECT job_id, seq, status, n, accepted, CASE WHEN accepted THEN status ELSE before END FROM
    (SELECT o.*, w.current_status AS before, coalesce((w.current_status IS NULL AND o.status = 'UPLOADING') OR {allowed}, false) AS accepted FROM walk w JOIN o ON o.job_id = w.job_id AND o.n = w.n + 1))
SELECT job_id, seq""", 1)


@query("st_state_machine", sql=_machine_sql())
def st_state_machine(t):
    """The event log replayed through the live state machine, every change judged."""
    log = B.job_events(t).select("job_id", "seq", "status")
    path, out = scratch_path(t.spark, "log"), scratch_path(t.spark, "judged")
    log.write.parquet(path)
    changes = t.spark.readStream.schema(log.schema).parquet(path)
    E.guard_stream(changes, out, scratch_path(t.spark, "states"), scratch_path(t.spark, "state")).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


