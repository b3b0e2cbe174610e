"""The job ledger: an append-only table of status events, one row per change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.constants import RETENTION_DAYS, RETRIGGERABLE
from sluicework.operators.skew import Ordered, ordered_columns

# The state each state may follow.
NEXT_STATES = {
    "UPLOADING": ["VALIDATING"],
    "VALIDATING": ["TRANSFORMING", "LOADED", "REJECTED", "FAILED"],
    "TRANSFORMING": ["LOADED", "FAILED"],
    "LOADED": [],
    "REJECTED": ["UPLOADING"],
    "FAILED": ["UPLOADING"],
}


def current_jobs(events: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """Last event of each job plus its first time; one partial aggregate, no window."""
    columns = [c for c in events.columns if c != key]
    latest = F.max_by(F.struct(*columns), F.col(seq))
    grouped = events.groupBy(key).agg(latest.alias("e"), F.min("updated_at").alias("created_at"))
    return grouped.select(key, "e.*", "created_at")


def recent_jobs(events: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` newest jobs."""
    return current_jobs(events).orderBy(F.desc("created_at"), "job_id").limit(n)


def allowed_step(before: Column, after: Column) -> Column:
    """True when ``after`` may follow ``before``; every job starts with UPLOADING."""
    allowed = F.create_map(
        *[x for s, nxt in NEXT_STATES.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in nxt]).cast("array<string>"))]
    )
    return F.when(before.isNull(), after == "UPLOADING").otherwise(
        F.coalesce(F.array_contains(allowed[before], after), F.lit(False))
    )


def check_transitions(events: DataFrame) -> DataFrame:
    """Append prev_status and is_allowed to every event of the log."""
    lagged = ordered_columns(events, ["job_id"], [F.asc("seq")], [Ordered("lag", "prev_status", "status")])
    return lagged.withColumn("is_allowed", allowed_step(F.col("prev_status"), F.col("status")))


def retriggers(events: DataFrame, at: Column, job_ids: Sequence[str] | None = None) -> DataFrame:
    """New UPLOADING events for jobs that may start again; counters go back to zero."""
    jobs = current_jobs(events).where(F.col("status").isin(RETRIGGERABLE))
    if job_ids is not None:
        jobs = jobs.where(F.col("job_id").isin(list(job_ids)))
    reset = {"status": F.lit("UPLOADING"), "seq": F.col("seq") + 1, "updated_at": at}
    for c in ("total_records", "loaded"):
        reset[c] = F.lit(0).cast("long")
    return jobs.withColumns(reset).select(*events.columns)


def dead_letters(failures: DataFrame, attempts: int = 5) -> DataFrame:
    """Jobs that failed ``attempts`` times or more, with their last error."""
    counted = failures.groupBy("job_id", "dataset").agg(
        F.count("*").alias("attempts"), F.max_by("error", "seq").alias("last_error"), F.max("seq").alias("last_seq")
    )
    return counted.where(F.col("attempts") >= attempts)


def zone_status(df: DataFrame, zone: Column, at: Column, today: Column) -> DataFrame:
    """Append age_days and expired by the retention of the row's zone."""
    days = F.create_map(*[F.lit(x) for pair in RETENTION_DAYS.items() for x in pair])
    aged = df.withColumn("age_days", F.date_diff(today, F.to_date(at)))
    return aged.withColumn("expired", F.coalesce(F.col("age_days") > days[zone], F.lit(False)))


def retained(df: DataFrame, zone: str, at: str, today: Column) -> DataFrame:
    """Rows still inside a zone's retention; on a date partition column whole days are pruned."""
    if zone not in RETENTION_DAYS:
        return df
    return df.where(F.col(at) >= F.date_sub(today, RETENTION_DAYS[zone]))
