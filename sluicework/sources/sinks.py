"""Writing zones: staging, curated, silver, rejects, metrics and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.sources.evolution import fit_batch, note_schema, read_evolved

_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def choose_cluster_columns(schema: T.StructType, style: str = "loader", most: int = 4) -> list[str]:
    """Up to four columns to sort files by.

    ``loader``: ids (``id``, ``*_id``) and times go to the front, each before the last,
    then text and numbers. ``batch``: names holding ``id`` or ending ``_key``, then
    times, then the rest; decimals are never chosen.
    """
    front: list[str] = []
    ids: list[str] = []
    times: list[str] = []
    rest: list[str] = []
    for f in schema.fields:
        name, kind = f.name.lower(), f.dataType
        temporal = isinstance(kind, _TEMPORAL)
        plain = isinstance(kind, (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.ByteType))
        if style == "loader":
            if name.startswith(("_partitiontime", "_partitiondate")):
                continue
            if temporal or name == "id" or name.endswith("_id"):
                front.insert(0, f.name)
            elif plain or isinstance(kind, T.DecimalType):
                rest.append(f.name)
        elif plain or temporal:
            if "id" in name or name.endswith("_key"):
                ids.append(f.name)
            elif temporal:
                times.append(f.name)
            else:
                rest.append(f.name)
    return (front + ids + times + rest)[:most]


def cluster_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range-partition and sort so that Parquet min/max statistics can skip row groups.

    Ranges are drawn over all chosen columns, so a hot first column is cut by the next.
    """
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns) if columns else df


def with_counters(df: DataFrame, name: str = "rows_through") -> tuple[DataFrame, Observation]:
    """Count rows and their JSON bytes while they pass; read the result after an action."""
    seen = Observation(name)
    size = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    return df.observe(
        seen, F.count(F.lit(1)).alias("rows_processed"), F.sum(size).alias("bytes_written"),
        F.lit(0).alias("error_count"),
    ), seen


def load_staging(df: DataFrame, path: str) -> None:
    """Replace the staging copy; loading the same batch twice gives the same table."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def load_curated(df: DataFrame, path: str, batch_id: str, ingest_date: Column | str, style: str = "loader") -> None:
    """Add a batch to the curated table, partitioned by day and batch, sorted inside.

    Only the batch's own partitions are replaced, so a replay after a failure cannot add
    the rows twice. New columns are fine, and a batch may widen a column of numbers: the
    schema of each partition is recorded and readers bring them together (:func:`read_curated`).
    Narrower columns are cast to the type the table has; a batch whose type does not go with
    the table's is refused before anything is written.
    """
    day = F.lit(ingest_date) if isinstance(ingest_date, str) else ingest_date
    load_batches(df.withColumns({"__job": F.lit(batch_id), "__day": day}), path, style)


def load_batches(df: DataFrame, path: str, style: str = "loader") -> None:
    """Several batches of one schema in one write: each row names its batch in ``__job`` and its day in ``__day``."""
    keys = {"ingest_date": F.col("__day").cast("date"), "batch_id": F.col("__job")}
    plain = fit_table(df, df.sparkSession, path)
    columns = choose_cluster_columns(plain.drop("__job", "__day").schema, style)
    # The record comes first: one without rows does no harm, rows without one would be read in the wrong types.
    placed = plain.withColumns(keys).drop("__job", "__day")
    note_schema(placed, path)
    (
        cluster_rows(placed, columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_date", "batch_id").parquet(path)
    )


def fit_table(df: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The batch as it can be added to the curated table below ``path``, if there is one already; other columns stay."""
    try:
        table = read_curated(spark, path)
    except AnalysisException:
        return df
    return fit_batch(df, table, path)


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a curated table in common types; a table without schema records has those of its files."""
    found = read_evolved(spark, path)
    return spark.read.option("mergeSchema", "true").parquet(path) if found is None else found


def write_silver(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def reject_records(bad: DataFrame, job_id: str | Column, rejected_at: Column) -> DataFrame:
    """job_id, errors, original_row, rejected_at for each bad row; a job named by ``__job`` keeps that column to be written by."""
    row = [c for c in bad.columns if c not in ("errors", "__job")]
    job = F.lit(job_id) if isinstance(job_id, str) else job_id
    kept = ["__job"] if "__job" in bad.columns else []
    return bad.select(job.alias("job_id"), "errors", F.struct(*row).alias("original_row"), rejected_at.alias("rejected_at"), *kept)


def write_rejects(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def log_metrics(metrics: DataFrame, path: str, run_id: str, name: str, at: Column) -> None:
    """Put (metric_name, metric_value) rows into the metrics log; logging a run again replaces its rows."""
    rows = run_metrics(metrics, run_id, name, at)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "pipeline_name").parquet(path)


def run_metrics(metrics: DataFrame, run_id: str, name: str, at: Column) -> DataFrame:
    return metrics.select(
        F.lit(run_id).alias("run_id"), F.lit(name).alias("pipeline_name"), at.cast("timestamp").alias("timestamp"),
        "metric_name", F.col("metric_value").cast("double").alias("metric_value"),
    )


def json_depth(text: Column) -> Column:
    """How deep the braces of a JSON text nest, strings left out."""
    braces = F.regexp_replace(F.regexp_replace(text, r'"(\\.|[^"\\])*"', ""), "[^{}]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(held: Column, brace: Column) -> Column:
        now = held["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(held["most"], now).alias("most"))

    return F.aggregate(F.split(braces, ""), zero, step, lambda held: held["most"])


def json_metrics(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, metric_name, metric_value) of every nested JSON number, however deep.

    The depth comes from the data first; it decides how many levels the expression opens.
    """
    depth = df.agg(F.max(json_depth(F.col(text)))).first()[0] or 1
    return df.select(*keep, F.inline(json_numbers(F.col(text), depth)))


def json_numbers(text: Column, depth: int) -> Column:
    """Nested JSON numbers as an array of (metric_name, metric_value), dotted names.

    Booleans count as 1 and 0; text, lists and nulls are left out. Objects are opened
    ``depth`` levels deep, one expression per level; :func:`json_metrics` measures it.
    """

    def cells(entries: Column, prefix: Column | None) -> Column:
        def cell(e: Column) -> Column:
            name = e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
            return F.struct(name.alias("name"), e["value"].alias("value"))

        return F.transform(F.map_entries(entries), cell)

    def leaf(c: Column) -> Column:
        kind = F.schema_of_variant(c["value"])
        number = F.when(kind != "STRING", F.try_variant_get(c["value"], "$", "double"))
        return F.struct(c["name"].alias("metric_name"), number.alias("metric_value"))

    level = cells(F.from_json(text, "map<string,variant>"), None)
    found = F.transform(level, leaf)
    for _ in range(depth - 1):
        objects = F.filter(level, lambda c: F.startswith(F.schema_of_variant(c["value"]), F.lit("OBJECT")))
        level = F.flatten(
            F.transform(
                objects, lambda c: cells(F.try_variant_get(c["value"], "$", "map<string,variant>"), c["name"])
            )
        )
        found = F.concat(found, F.transform(level, leaf))
    return F.filter(found, lambda c: c["metric_value"].isNotNull())


def save_output(df: DataFrame, path: str, schema: str) -> None:
    """Replace a result table; its columns must be exactly those declared."""
    declared = T.StructType.fromDDL(schema)
    if df.columns != declared.names:
        raise ValueError(f"columns {df.columns} are not the declared {declared.names}")
    df.select(*[F.col(f.name).cast(f.dataType) for f in declared.fields]).write.mode("overwrite").parquet(path)
