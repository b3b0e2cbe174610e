"""Stateful streams over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicework.operators.ledger import NEXT_STATES
from sluicework.session import cut_lineage, ship_package


def read_events(spark: SparkSession, folder: str, files: str = "events*.parquet") -> DataFrame:
    """Event files of a folder as a stream; times become instants so that a watermark applies."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and value per type and tumbling window; rows later than ``late`` are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length), "event_type")
        .agg(F.count("*").alias("n_events"), F.sum((F.col("value") * 100).cast("decimal(38,0)")).alias("value_cents"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            "event_type", "n_events", F.col("value_cents").cast("long").alias("value_cents"),
        )
    )


_JUDGED = "job_id string, seq long, status string, accepted boolean, current_status string"
_STATE = "job_id string, status string, seen long"
# What a job can be in before a change: nothing yet, or one of the states.
ENTRIES = [None, *NEXT_STATES]


def open_after(before: str | None, wanted: str) -> bool:
    return wanted == "UPLOADING" if before is None else wanted in NEXT_STATES[before]


def _slices(changes: DataFrame, cuts: int | None) -> DataFrame:
    """(job_id, seq, status, status0, part): changes in order, a job's changes cut into slices by the ranges they fall in; stored."""
    cuts = cuts or int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = changes.repartitionByRange(cuts, "job_id", "seq").withColumn("part", F.spark_partition_id())
    return cut_lineage(dealt)


def _leaving(slices: DataFrame) -> DataFrame:
    """(job_id, part, leaving): for each state a job may enter a slice in, the one it leaves it in, as places in ``ENTRIES``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, seen, done = None, [], [], []
        for batch in batches:
            for job, part, seq, wanted in batch.itertuples(index=False):
                if (job, part) != key:
                    if key is not None:
                        done.append((*key, now))
                    key, now, seen = (job, part), list(range(len(ENTRIES))), [-1] * len(ENTRIES)
                for k, at in enumerate(now):
                    if seq > seen[k] and open_after(ENTRIES[at], wanted):
                        now[k], seen[k] = ENTRIES.index(wanted), seq
            if len(done) > 1000:
                yield pd.DataFrame(done, columns=["job_id", "part", "leaving"])
                done = []
        if key is not None:
            yield pd.DataFrame([*done, (*key, now)], columns=["job_id", "part", "leaving"])

    ordered = slices.select("job_id", "part", "seq", "status", "row").repartition("job_id", "part").sortWithinPartitions("job_id", "part", "seq", "row").drop("row")
    return ordered.mapInPandas(run, "job_id string, part int, leaving array<int>")


def judge_changes(changes: DataFrame, state: DataFrame, cuts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(every change judged, the state of all jobs after it) of one batch.

    ``changes``: job_id, seq, status; ``state``: job_id, status, seen (the last accepted seq). A
    change counts if it may follow the job's state and its number is above the last accepted one.
    A job's changes are judged in order of seq, however many there are: each slice is reduced to
    a map from the state it is entered in to the one it is left in, these maps are chained along
    the job, and then every slice is judged alone. Rows without a job or number are never
    accepted.
    """
    ship_package(changes.sparkSession)
    rows = changes.select("job_id", F.col("seq").cast("long").alias("seq"), "status")
    known = rows.join(state.select("job_id", F.col("status").alias("status0"), F.col("seen").alias("seen0")), "job_id", "left")
    late = F.col("job_id").isNull() | F.col("seq").isNull() | F.coalesce(F.col("seq") <= F.col("seen0"), F.lit(False)) | F.coalesce(F.col("seq") < 0, F.lit(False))
    known = known.withColumn("late", late).withColumn("row", F.monotonically_increasing_id())
    slices = _slices(known.where(~F.col("late")).drop("late", "seen0"), cuts)
    refused = known.where("late").select("job_id", "seq", "status", F.lit(False).alias("accepted"), F.col("status0").alias("current_status"))

    def chain(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        at, entered = ENTRIES.index(parts["status0"].iloc[0]), []
        for part, leaving in parts.sort_values("part")[["part", "leaving"]].itertuples(index=False):
            entered.append((key[0], part, ENTRIES[at]))
            at = leaving[at]
        return pd.DataFrame(entered, columns=["job_id", "part", "entry"])

    first = slices.groupBy("job_id", "part").agg(F.first("status0").alias("status0"))
    entries = _leaving(slices).join(first, ["job_id", "part"]).groupBy("job_id").applyInPandas(chain, "job_id string, part int, entry string")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, status, seen = None, None, -1
        for batch in batches:
            out = []
            for job, part, seq, wanted, entry in batch.itertuples(index=False):
                if (job, part) != key:
                    key, status, seen = (job, part), entry, -1
                accepted = seq > seen and open_after(status, wanted)
                if accepted:
                    status, seen = wanted, seq
                out.append((job, seq, wanted, accepted, status))
            yield pd.DataFrame(out, columns=["job_id", "seq", "status", "accepted", "current_status"])

    placed = slices.join(entries, ["job_id", "part"]).select("job_id", "part", "seq", "status", "entry", "row")
    ordered = placed.repartition("job_id", "part").sortWithinPartitions("job_id", "part", "seq", "row").drop("row")
    judged = cut_lineage(ordered.mapInPandas(judge, _JUDGED).unionByName(refused))
    last = judged.where("accepted").groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seen"))
    return judged, last.unionByName(state.join(last, "job_id", "left_anti"))


def guard_stream(changes: DataFrame, out: str, states: str, checkpoint: str) -> StreamingQuery:
    """Live state machine: every change of a stream is judged into ``out``, one partition for each micro-batch.

    The state after a batch is a table below ``states``; a batch that is run again starts from
    the one before it and replaces what it wrote.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(_STATE).parquet(f"{states}/batch={number - 1}") if number else spark.createDataFrame([], _STATE)
        judged, after = judge_changes(batch, before)
        after.write.mode("overwrite").parquet(f"{states}/batch={number}")
        judged.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
