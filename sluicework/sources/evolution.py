"""The schema of a table that grows batch by batch, kept beside it.

``<table>/_schemas`` holds one record (ingest_date, batch_id, schema) for each partition, so
nobody has to open the files to learn their columns. Batches may add columns and widen
numbers; the table is read as a union of its few different schemas, each with its own types,
cast to the widest type of each column.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_schemas"
KEYS = T.StructType().add("ingest_date", "date").add("batch_id", "string")

# For each type the narrower ones whose values it holds. Text takes others over,
# but a table of numbers does not become text.
NARROWER = {
    "smallint": ("tinyint",), "int": ("smallint", "tinyint"), "bigint": ("int", "smallint", "tinyint"),
    "double": ("float", "bigint", "int", "smallint", "tinyint"),
    "string": ("bigint", "int", "double", "boolean", "date", "timestamp"),
}
# Fixed value: up to here a double holds every whole number.
EXACT = 1 << 53


def wider(held: str, new: str) -> str | None:
    """The type of a column that holds ``held`` and receives ``new``; None where they do not go together."""
    if held == new or new in NARROWER.get(held, ()):
        return held
    return new if new != "string" and held in NARROWER.get(new, ()) else None


def note_schema(df: DataFrame, path: str) -> None:
    """Record the types of ``df``, whose rows have the columns ingest_date and batch_id; noting a partition again replaces its record."""
    plain = T.StructType([f for f in df.schema.fields if f.name not in KEYS.names])
    rows = df.select(*KEYS.names).distinct().select(*KEYS.names, F.lit(plain.json()).alias("schema"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS.names).json(f"{path}/{MANIFEST}")


def _notes(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(T.StructType([T.StructField("schema", T.StringType()), *KEYS.fields])).json(f"{path}/{MANIFEST}")
    except AnalysisException:
        return None


def _partition() -> Column:
    return F.concat_ws("/", F.col("ingest_date").cast("string"), "batch_id")


def common_types(schemas: Sequence[T.StructType]) -> dict[str, str]:
    """The widest type of each column, columns in order of their appearance."""
    found: dict[str, str] = {}
    for schema in schemas:
        for f in schema.fields:
            kind = f.dataType.simpleString()
            held = wider(found.get(f.name, kind), kind) or wider(kind, found[f.name])
            if held is None:
                raise ValueError(f"column {f.name} is {kind} in one batch and {found[f.name]} in another")
            found[f.name] = held
    return found


def read_evolved(spark: SparkSession, path: str) -> DataFrame | None:
    """All batches in common types, or None for a table without records.

    The schema most batches have is read with all partitions but the others'; each other
    schema with its own. Choosing partitions costs no look into files. Partitions without a
    record are taken to have the schema of most.
    """
    notes = _notes(spark, path)
    if notes is None:
        return None
    groups = notes.groupBy("schema").agg(F.count("*").alias("n"), F.min(_partition()).alias("first")).orderBy("first").collect()  # a few schemas
    if not groups:
        return None
    schemas = [T.StructType.fromJson(json.loads(g["schema"])) for g in groups]
    types = common_types(schemas)
    most = max(groups, key=lambda g: g["n"])["schema"]
    others: dict[str, list[str]] = {}
    for r in notes.where(F.col("schema") != most).select("schema", _partition().alias("at")).collect() if len(groups) > 1 else []:
        others.setdefault(r["schema"], []).append(r["at"])
    parts = []
    for group, schema in zip(groups, schemas, strict=True):
        rows = spark.read.schema(T.StructType([*schema.fields, *KEYS.fields])).parquet(path)
        if group["schema"] != most:
            rows = rows.where(_partition().isin(others[group["schema"]]))
        elif others:
            rows = rows.where(~_partition().isin([at for held in others.values() for at in held]))
        own = {f.name for f in schema.fields}
        cells = [F.col(f"`{c}`").cast(k).alias(c) if c in own else F.lit(None).cast(k).alias(c) for c, k in types.items()]
        parts.append(rows.select(*cells, *KEYS.names))
    return reduce(DataFrame.unionByName, parts)


def fit_batch(df: DataFrame, table: DataFrame, path: str) -> DataFrame:
    """``df`` as it can be added to ``table``: narrower columns in the table's type, wider numbers as they are.

    A column of another kind, or a whole number that a double cannot hold where one of both
    sides is a double, is refused.
    """
    known = dict(table.dtypes)
    casts, checked = {}, {"batch": [], "table": []}
    for c, kind in df.dtypes:
        held = known.get(c, kind)
        target = wider(held, kind)
        if target is None:
            raise ValueError(f"column {c} is {kind}, the table {path} has {held}; nothing was written")
        if target != kind:
            casts[c] = F.col(f"`{c}`").cast(target)
        if target == "double" and "bigint" in (held, kind) and held != kind:
            checked["batch" if kind == "bigint" else "table"].append(c)
    for side, rows in (("batch", df), ("table", table)):
        beyond = _beyond(rows, checked[side])
        if beyond:
            raise ValueError(f"column {beyond[0]} of the {side} holds whole numbers that a double cannot; nothing was written to {path}")
    return df.withColumns(casts) if casts else df


def _beyond(rows: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    found: Mapping = rows.agg(*[F.max((F.col(f"`{c}`") > EXACT) | (F.col(f"`{c}`") < -EXACT)).alias(c) for c in columns]).first().asDict()
    return [c for c in columns if found[c]]
