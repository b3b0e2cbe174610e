"""Cleaning many uploads in the same Spark jobs, each still by its own header, types and verdict.

Rows of all text files of a micro-batch are one table (file, place, cells). What a file's columns
are called, which of them are personal and which types they have is decided by votes grouped by
(file, column) over the file's first rows; the decisions, one row for each file, are broadcast
and every cell is masked and checked by them, so a large file is not gathered in one task. Files with the same dataset, columns and types are
written together. The number of jobs depends on how many different schemas there are, not on the
number of files.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicework.functions import constants as K
from sluicework.functions.masks import mask
from sluicework.functions.scalar import null_token, strip
from sluicework.operators.cleansing import SPARK_TYPES, pii_by_name, typed_value
from sluicework.session import cut_lineage
from sluicework.sources.files import CONTENT_TYPES, is_json_object, validate_files

HEAD, PEEK = 100, 20
# The table type of each inferred type.
TABLE_TYPES = {"INT64": "bigint", "FLOAT64": "double", "BOOLEAN": "boolean", "TIMESTAMP": "string", "STRING": "string"}
TEXT_FORMATS = ("csv", "json", "ndjson")


@dataclass
class Upload:
    """One file of a batch and what has been decided about it."""

    job: str
    dataset: str
    format: str
    path: str
    day: str
    file: str = ""
    error: str | None = None
    width: int = 0
    columns: list[str] = field(default_factory=list)
    kinds: list[str | None] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    total: int = 0
    valid: int = 0
    rejected: int = 0

    @property
    def masked(self) -> dict[str, str]:
        return {c: k for c, k in zip(self.columns, self.kinds, strict=True) if k}

    @property
    def schema(self) -> dict[str, str]:
        return dict(zip(self.columns, self.types, strict=True))


def plain(path: str) -> str:
    return re.sub("^file:/+", "file:/", path if "://" in path or path.startswith("file:") else f"file:{path}")


def judge_files(spark: SparkSession, uploads: Sequence[Upload]) -> None:
    """Give each upload its file or the error that rejects it; one validation for each format."""
    for fmt in TEXT_FORMATS:
        own = {plain(u.path).rstrip("/"): u for u in uploads if u.format == fmt}
        if not own:
            continue
        for r in validate_files(spark, [u.path for u in own.values()], CONTENT_TYPES[fmt]).select("path", "valid", "error", F.size("columns").alias("width")).collect():
            found = own.get(r.path) or own.get(r.path.rsplit("/", 1)[0])
            if found is not None:
                found.file, found.error, found.width = r.path, None if r.valid else r.error, r.width or 0
        for u in own.values():
            if not u.file:
                u.error = "no such file"


def _file() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file")


_PLACE = ["file", "block", "row"]


def read_cells(spark: SparkSession, uploads: Sequence[Upload]) -> DataFrame:
    """(file, block, row, cells, pairs): CSV records as cells, JSON objects as pairs; one scan of each format."""
    place = [_file(), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    no_cells, no_pairs = F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("map<string,string>").alias("pairs")
    parts = []
    csv = [u.file for u in uploads if u.format == "csv"]
    if csv:
        lines = spark.read.text(csv).select(_file(), "value")
        broken = {r.file for r in lines.where(F.regexp_count("value", F.lit('"')) % 2 == 1).select("file").distinct().collect()}
        # Cells beyond a file's own header are left out, so the widest header sets their number.
        names = [f"c{k}" for k in range(max(u.width for u in uploads if u.format == "csv"))]
        reader = spark.read.option("header", False).option("escape", '"').option("mode", "PERMISSIVE").schema(", ".join(f"{n} string" for n in names))
        for spans in (False, True):
            files = [f for f in csv if (f in broken) == spans]
            if files:
                parts.append(reader.option("multiLine", spans).csv(files).select(*place, F.array(*names).alias("cells"), no_pairs))
    lined = [u.file for u in uploads if u.format == "ndjson"]
    if lined:
        rows = spark.read.text(lined).select(*place, "value").where(is_json_object(F.col("value")))
        parts.append(rows.select(*_PLACE, no_cells, F.from_json("value", "map<string,string>").alias("pairs")))
    whole = [u.file for u in uploads if u.format == "json"]
    if whole:
        rows = spark.read.option("wholetext", True).text(whole).select(*place, strip(F.col("value")).alias("value"))
        listed = F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
        each = rows.select("file", "block", F.posexplode(F.from_json(listed, "array<map<string,string>>")).alias("row", "pairs"))
        parts.append(each.select("file", "block", F.col("row").cast("long").alias("row"), no_cells, "pairs"))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return cut_lineage(made)


def safe_names(cells: Sequence[str | None]) -> list[str]:
    """Column names of a CSV header: empty ones by their place, repeated ones with it, the rest as they are."""
    lower = [(c or "").lower() for c in cells]
    return [f"_c{k}" if not c else f"{c}{k}" if lower.count(c.lower()) > 1 else c for k, c in enumerate(cells)]


def name_columns(rows: DataFrame, uploads: Sequence[Upload]) -> DataFrame:
    """Give each upload its columns; returns (file, block, row, cells) with the cells in their order, headers left out."""
    spark = rows.sparkSession
    by_file = {u.file: u for u in uploads}
    place = F.struct("block", "row")
    headers = rows.where("cells is not null").groupBy("file").agg(F.min(F.struct("block", "row", "cells")).alias("first"))
    for r in headers.select("file", "first.cells").collect():
        by_file[r.file].columns = safe_names(r.cells[: by_file[r.file].width])
    keys = rows.where("pairs is not null").select("file", place.alias("place"), F.posexplode(F.map_keys("pairs")).alias("at", "key"))
    named: dict[str, list] = {}
    for r in keys.groupBy("file", "key").agg(F.min(F.struct("at")).alias("at")).collect():
        named.setdefault(r.file, []).append((r["at"]["at"], r.key))
    for file, found in named.items():
        u = by_file[file]
        u.columns = [k for _, k in sorted(found)] if u.format == "ndjson" else sorted(k for _, k in found)
    plan = spark.createDataFrame([(u.file, u.columns) for u in uploads], "file string, columns array<string>")
    first = headers.select("file", F.struct("first.block", "first.row").alias("header"))
    joined = rows.join(F.broadcast(plan), "file").join(F.broadcast(first), "file", "left").where(F.col("header").isNull() | (place != F.col("header")))
    by_name = F.transform("columns", lambda c: F.col("pairs")[c])
    own = F.when(F.col("pairs").isNotNull(), by_name).otherwise(F.slice("cells", F.lit(1), F.size("columns")))
    return cut_lineage(joined.select("file", "block", "row", own.alias("cells")))


def _masked(value: Column, kind: Column) -> Column:
    out = value
    for k in (*K.PII_NAMES,):
        out = F.when(kind == k, mask(value, k)).otherwise(out)
    return out


def decide_columns(rows: DataFrame, uploads: Sequence[Upload]) -> None:
    """Personal columns from the first 20 rows of each file, types from the masked first 100."""
    spark = rows.sparkSession
    by_file = {u.file: u for u in uploads}
    order = Window.partitionBy("file").orderBy("block", "row")
    head = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= HEAD)
    cells = cut_lineage(head.select("file", "nth", F.posexplode("cells").alias("at", "value")))
    filled = F.when(strip(F.col("value")) != "", F.col("value"))
    rates = [F.avg(filled.rlike(p).cast("int")).alias(k) for k, p in K.PII_VALUES.items()]
    for u in uploads:
        named = pii_by_name(u.columns)
        u.kinds, u.types = [named.get(c) for c in u.columns], ["STRING"] * len(u.columns)
    for r in cells.where(F.col("nth") <= PEEK).groupBy("file", "at").agg(*rates).collect():
        u, hits = by_file[r.file], [k for k in K.PII_VALUES if (r[k] or 0) >= 0.5]
        if u.kinds[r["at"]] is None and hits:
            u.kinds[r["at"]] = hits[0]
    kinds = [(u.file, k, kind) for u in uploads for k, kind in enumerate(u.kinds)]
    if not kinds:
        return
    hidden = cells.join(F.broadcast(spark.createDataFrame(kinds, "file string, at int, kind string")), ["file", "at"])
    text = strip(null_token(_masked(F.col("value"), F.col("kind"))))
    hidden = hidden.select("file", "at", text.alias("text"))

    def every(pattern: str) -> Column:
        return F.bool_and(F.col("text").rlike(pattern))

    patterns = (("BOOLEAN", K.BOOL_PATTERN), ("INT64", K.INT_PATTERN), ("FLOAT64", K.FLOAT_PATTERN), ("TIMESTAMP", K.TIMESTAMP_PATTERN))
    chosen = F.when(F.count("text") == 0, "STRING")
    for kind, pattern in patterns:
        chosen = chosen.when(every(pattern), kind)
    for r in hidden.groupBy("file", "at").agg(chosen.otherwise("STRING").alias("kind")).collect():
        by_file[r.file].types[r["at"]] = r.kind


def check_cells(rows: DataFrame, uploads: Sequence[Upload]) -> DataFrame:
    """(file, cells, errors): masked cells without copies, judged by their own file's types; counts go to the uploads."""
    spark = rows.sparkSession
    by_file = {u.file: u for u in uploads}
    plan = spark.createDataFrame(
        [(u.file, u.columns, u.kinds, u.types) for u in uploads], "file string, columns array<string>, kinds array<string>, types array<string>"
    )
    for u in uploads:
        u.valid = u.rejected = 0
    for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect():
        by_file[r.file].total = r.n
    masked = F.transform("cells", lambda c, i: F.coalesce(_masked(c, F.col("kinds")[i]), F.lit("")))
    single = rows.join(F.broadcast(plan), "file").select("file", masked.alias("cells")).distinct()

    def error(c: Column, i: Column) -> Column:
        text, kind = strip(c), F.col("types")[i]
        fits = F.lit(True)
        for k in SPARK_TYPES:
            if k != "STRING":
                fits = F.when(kind == k, typed_value(text, k).isNotNull()).otherwise(fits)
        message = F.concat(F.col("columns")[i], F.lit(": expected "), kind, F.lit(', got "'), text, F.lit('"'))
        return F.when(~text.isin(K.NULL_TOKENS) & ~fits, message)

    checked = cut_lineage(single.join(F.broadcast(plan), "file").select("file", "cells", F.array_compact(F.transform("cells", error)).alias("errors")))
    bad = F.size("errors") > 0
    for r in checked.groupBy("file").agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("rejected")).collect():
        by_file[r.file].valid, by_file[r.file].rejected = r.valid, r.rejected
    return checked


def same_schema(uploads: Sequence[Upload]) -> list[list[Upload]]:
    """The uploads in groups of one dataset, equal columns and equal types, each group and its members by path."""
    groups: dict[tuple, list[Upload]] = {}
    for u in sorted(uploads, key=lambda u: (u.dataset, u.path)):
        groups.setdefault((u.dataset, tuple(u.columns), tuple(u.types)), []).append(u)
    return list(groups.values())


def rows_of(checked: DataFrame, group: Sequence[Upload], good: bool, extra: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of a group as columns, typed if they are good, with ``__job`` and ``__day`` (and errors if not)."""
    spark = checked.sparkSession
    names = spark.createDataFrame([(u.file, u.job, u.day) for u in group], "file string, __job string, __day string")
    size = F.size("errors")
    own = checked.where(size == 0 if good else size > 0).join(F.broadcast(names), "file")
    cells = []
    for k, (c, kind) in enumerate(group[0].schema.items()):
        value = F.col("cells")[k]
        if good:
            text = strip(value)
            value = typed_value(F.when(~text.isin(K.NULL_TOKENS), text), kind).cast(SPARK_TYPES[kind])
        cells.append(value.alias(c))
    return own.select(*cells, "__job", "__day", *([] if good else ["errors"]))
