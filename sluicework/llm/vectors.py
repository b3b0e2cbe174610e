"""Reading vectors for the operators that compare them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id: long, vector: array<double>) of the rows that can be compared.

    Left out are rows without an id or vector, with null or non-finite components, with another
    number of components than most rows have and, unless ``zero``, those of length zero.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad)
    if not zero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == F.lit(common.n if common else 0))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """The rows of a list column as one matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def packed(df: DataFrame, change, kind: str) -> DataFrame:
    """(id, data: binary): each vector as ``change`` makes it, as numbers of type ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = np.ascontiguousarray(change(matrix(batch.column(1), batch.num_rows)).astype(kind))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in made], pa.binary())], ["id", "data"])

    return df.select("id", "vector").mapInArrow(run, "id long, data binary")


def unpacked(column, kind: str) -> np.ndarray:
    """The matrix that a sequence of packed vectors holds."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
