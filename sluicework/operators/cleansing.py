"""Row cleansing: null tokens, type inference, casts with rejects, duplicates, masking."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions import constants as K
from sluicework.functions.masks import mask
from sluicework.functions.scalar import null_token, strip

SPARK_TYPES = {"INT64": "long", "FLOAT64": "double", "BOOLEAN": "boolean", "TIMESTAMP": "string", "STRING": "string"}


def standardise_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = df.columns if columns is None else columns
    return df.withColumns({c: null_token(F.col(c)) for c in columns})


def _first_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def infer_types(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], n: int = 100) -> DataFrame:
    """One row per column with its inferred type, from the first ``n`` rows in order."""
    sample = _first_rows(df, order_by, n).select(*[null_token(F.col(c)).alias(c) for c in columns])
    entries = []
    for i, c in enumerate(columns):
        text = strip(F.col(c))

        def every(pattern: str, text: Column = text) -> Column:
            return F.bool_and(text.rlike(pattern))

        kind = (
            F.when(F.count(c) == 0, "STRING")
            .when(every(K.BOOL_PATTERN), "BOOLEAN")
            .when(every(K.INT_PATTERN), "INT64")
            .when(every(K.FLOAT_PATTERN), "FLOAT64")
            .when(every(K.TIMESTAMP_PATTERN), "TIMESTAMP")
            .otherwise("STRING")
        )
        entries.append(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), kind.alias("inferred_type")))
    return sample.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def schema_of(types: DataFrame) -> dict[str, str]:
    """The inferred types as a mapping: one entry per column, so always small."""
    return {r["column_name"]: r["inferred_type"] for r in types.orderBy("ordinal").collect()}


def preview_types(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The coarser preview rules: number, boolean, date, string, or null without values."""
    sample = _first_rows(df, order_by, n).select(*columns)
    # Preview type to table type.
    table_types = {"number": "FLOAT64", "boolean": "BOOL", "date": "TIMESTAMP", "string": "STRING", "null": "STRING"}
    entries = []
    for i, c in enumerate(columns):
        text = F.col(c)
        known = F.when((text != "") & (F.lower(text) != "null"), text)
        kind = (
            F.when(F.count(known) == 0, "null")
            .when(F.bool_and(known.rlike(K.FLOAT_PATTERN)), "number")
            .when(F.bool_and(F.lower(known).isin("true", "false")), "boolean")
            .when(F.bool_and(known.rlike(K.TIMESTAMP_PATTERN)), "date")
            .otherwise("string")
        )
        entries.append(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("source_column"), kind.alias("preview_type")))
    rows = sample.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    lookup = F.create_map(*[F.lit(x) for pair in table_types.items() for x in pair])
    return rows.select(
        "ordinal",
        "source_column",
        "preview_type",
        F.regexp_replace("source_column", "[^a-zA-Z0-9_]", "_").alias("name"),
        lookup[F.col("preview_type")].alias("type"),
        F.lit("NULLABLE").alias("mode"),
    )


def typed_value(text: Column, kind: str) -> Column:
    """The typed value of trimmed text, NULL where the text does not fit."""
    if kind == "INT64":
        return F.when(text.rlike(K.INT_PATTERN), text.try_cast("long"))
    if kind == "FLOAT64":
        return F.when(text.rlike(K.FLOAT_PATTERN), text.try_cast("double"))
    if kind == "BOOLEAN":
        word = F.lower(text)
        return F.when(word.isin(K.TRUE_WORDS), True).when(word.isin(K.FALSE_WORDS), False)
    if kind == "TIMESTAMP":
        return F.when(text.rlike(K.TIMESTAMP_PATTERN), text)
    return text


def _typed_rows(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Append the trimmed text ``__t_c``, the typed value ``__v_c`` and ``__errors``.

    Text and value are columns of their own, so each pattern is tested once per cell.
    """
    texts = {}
    for c in schema:
        text = strip(F.col(c))
        texts[f"__t_{c}"] = F.when(text.isin(K.NULL_TOKENS), F.lit(None)).otherwise(text)
    typed = df.withColumns(texts).withColumns({f"__v_{c}": typed_value(F.col(f"__t_{c}"), k) for c, k in schema.items()})
    messages = [
        F.when(
            F.col(f"__t_{c}").isNotNull() & F.col(f"__v_{c}").isNull(),
            F.concat(F.lit(f'{c}: expected {kind}, got "'), F.col(f"__t_{c}"), F.lit('"')),
        )
        for c, kind in schema.items()
        if kind != "STRING"
    ]
    errors = F.array_compact(F.array(*messages)) if messages else F.array().cast("array<string>")
    return typed.withColumn("__errors", errors)


def check_rows(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Append ``__errors``, one message per column whose text does not fit its type."""
    return _typed_rows(df, schema).select(*df.columns, "__errors")


def cast_rows(df: DataFrame, schema: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(typed good rows, bad rows as they came with an ``errors`` list)."""
    typed = _typed_rows(df, schema)
    extra = [c for c in df.columns if c not in schema]
    values = [F.col(f"__v_{c}").cast(SPARK_TYPES[kind]).alias(c) for c, kind in schema.items()]
    good = typed.where(F.size("__errors") == 0).select(*values, *extra)
    bad = typed.where(F.size("__errors") > 0).select(*df.columns, F.col("__errors").alias("errors"))
    return good, bad


def dedup_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One copy of each row; NULL and empty text count as the same value.

    ``distinct`` removes copies on the map side first, so a row with billions of
    copies still crosses the shuffle only once per task.
    """
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).distinct()


def pii_by_name(columns: Sequence[str]) -> dict[str, str]:
    """Kind per column whose name holds a marker as a whole word (``_`` joins words)."""
    found = {}
    for c in columns:
        for kind, names in K.PII_NAMES.items():
            if re.search(r"\b(" + "|".join(names) + r")\b", c, re.IGNORECASE | re.ASCII):
                found[c] = kind
                break
    return found


def pii_value_rates(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], n: int = 20) -> DataFrame:
    """Share of non-blank values among the first ``n`` rows that match each pattern."""
    sample = _first_rows(df, order_by, n)
    entries = []
    for i, c in enumerate(columns):
        filled = F.when(strip(F.col(c)) != "", F.col(c))
        for j, (kind, pattern) in enumerate(K.PII_VALUES.items()):
            rate = F.avg(filled.rlike(pattern).cast("int"))
            entries.append(
                F.struct(
                    F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                    F.lit(j).alias("priority"), F.lit(kind).alias("kind"), rate.alias("match_rate"),
                )
            )
    return sample.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def detect_pii(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> dict[str, str]:
    """Kind per personal column: by name, else by the first pattern half the values match."""
    named = pii_by_name(columns)
    rest = [c for c in columns if c not in named]
    valued: dict[str, str] = {}
    if rest:
        hits = pii_value_rates(df, rest, order_by).where("match_rate >= 0.5").orderBy("ordinal", "priority")
        for r in hits.collect():  # at most four rows per column
            valued.setdefault(r["column_name"], r["kind"])
    return {c: named.get(c) or valued[c] for c in columns if c in named or c in valued}


def mask_pii(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: mask(F.col(c).cast("string"), kind) for c, kind in kinds.items()}) if kinds else df


def pii_report(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Masked cells per personal column of the unmasked rows; blanks-only cells count."""
    if not kinds:
        return df.sparkSession.createDataFrame([], "column_name string, kind string, masked_cells long")
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(kind).alias("kind"),
            F.count_if(F.col(c).isNotNull() & (F.col(c) != "")).alias("masked_cells"),
        )
        for c, kind in kinds.items()
    ]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def file_outcomes(checked: DataFrame, file: str) -> DataFrame:
    """Good and bad rows per file; a file without a good row is rejected as a whole."""
    counts = checked.groupBy(file).agg(
        F.count_if(F.size("__errors") == 0).alias("valid"), F.count_if(F.size("__errors") > 0).alias("rejected")
    )
    return counts.withColumn("status", F.when(F.col("valid") == 0, "REJECTED").otherwise("TRANSFORMING"))
