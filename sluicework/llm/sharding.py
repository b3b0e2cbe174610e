"""Shards of near-equal bytes by histogram sort.

Rows are ordered by key. To find the keys where shards begin, the bytes below a set of probe
keys are counted exactly in every partition and added up; each wanted splitter keeps the two
probes around it, and new probes are laid between them until the counts are within tolerance
or no key is left in between. A key that many rows share is cut by the rows' places in the
same way. Only then are the rows exchanged, once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sluicework.session import cut_lineage

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def bytes_below(rows: DataFrame, key: str, size: str, probes: list[int]) -> list[int]:
    """The exact sum of ``size`` over the rows whose key is below each of the ascending probes."""
    edges = np.array(probes, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            place = np.searchsorted(edges, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(held, place, batch.column(1).to_numpy(zero_copy_only=False))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used])], ["bin", "bytes"])

    found = rows.select(F.col(key).cast("long"), F.col(size).cast("long")).mapInArrow(count, "bin int, bytes long")
    held = np.zeros(len(edges) + 1, np.int64)
    for r in found.groupBy("bin").agg(F.sum("bytes").alias("bytes")).collect():
        held[r.bin] = r.bytes
    return np.cumsum(held)[:-1].tolist()


def split_keys(rows: DataFrame, key: str, size: str, targets: list[int], probes: int = 48, tolerance: int = 0) -> list[tuple[int, int]]:
    """For each wanted number of bytes the largest key with no more bytes below it, and these bytes.

    With a tolerance a key whose bytes are within it of the wanted number ends the search.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    around = [(low, 0, high + 1) for _ in targets]
    while True:
        asked = set()
        for want, (a, below, b) in zip(targets, around, strict=True):
            if b - a > 1 and want - below > tolerance:
                asked |= {a + max(1, (b - a) * k // (probes + 1)) for k in range(1, probes + 1)}
        if not asked:
            return [(a, below) for a, below, _ in around]
        asked = sorted(asked)
        counts = bytes_below(rows, key, size, asked)
        for i, (want, (a, below, b)) in enumerate(zip(targets, around, strict=True)):
            first, stop = bisect_right(asked, a), bisect_left(asked, b)
            at = bisect_right(counts, want, first, stop)  # counts grow with the probes
            if at > first:
                a, below = asked[at - 1], counts[at - 1]
            around[i] = a, below, asked[at] if at < stop else b


def shard_by_bytes(docs: DataFrame, shards: int = 24, key: str = "doc_id", size: str = "size", rows_per_task: int = 1_000_000, tolerance: int = 0) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: consecutive ranges of keys that hold near-equal sums of ``size``.

    A row lies in the shard where the bytes before it fall, so sizes differ by at most one row
    at either end (and twice the tolerance). Each shard is made of several ranges when it has
    more than ``rows_per_task`` rows; slots number a shard's rows from 0 by key. Null keys come
    first, null sizes count as 0. Shards may be empty when rows are few. Columns named ``shard``
    or ``slot`` are replaced; names that begin with ``__`` are reserved.
    """
    keys = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    held = cut_lineage(
        docs.withColumns({"__key": keys, "__size": F.coalesce(F.col(size).cast("long"), F.lit(0)), "__place": F.monotonically_increasing_id()})
    )
    total, count = held.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    if not count:
        return held.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(1, -(-count // (shards * rows_per_task)))
    cuts = shards * ranges
    # Range i begins at the first row with at least total * i / cuts bytes before it.
    targets = [-(-total * i // cuts) for i in range(1, cuts)]
    borders = _borders(held, targets, tolerance)
    edges = np.array([k for k, _ in borders], np.int64), np.array([p for _, p in borders], np.int64)

    @pandas_udf("int")
    def range_of(key: pd.Series, place: pd.Series) -> pd.Series:
        k, p = key.to_numpy(np.int64), place.to_numpy(np.int64)
        first, last = np.searchsorted(edges[0], k, "left"), np.searchsorted(edges[0], k, "right")
        out = first.copy()
        for i in np.flatnonzero(first < last):
            out[i] += np.searchsorted(edges[1][first[i] : last[i]], p[i], "right")
        return pd.Series(out.astype(np.int32))

    dealt = held.withColumn("__range", range_of("__key", "__place"))
    slots = dealt.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__shard", F.expr(f"__range div {ranges}").cast("int"))
    before = Window.partitionBy("__shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__key", "__place")).cast("long") - 1
    placed = dealt.withColumn("__own", own).join(slots, "__range")
    return placed.select(*[dealt[c] for c in kept], F.col("__shard").alias("shard"), (F.col("__base") + F.col("__own")).alias("slot"))


def _borders(held: DataFrame, targets: list[int], tolerance: int) -> list[tuple[int, int]]:
    """For each wanted number of bytes the (key, place) from which rows have at least that many before them."""
    found = split_keys(held, "__key", "__size", targets, tolerance=tolerance)
    asked = sorted({k for k, _ in found})
    known = {
        r["__key"]: (r.n, r.size, r.place)
        for r in held.where(F.col("__key").isin(asked)).groupBy("__key").agg(F.count("*").alias("n"), F.sum("__size").alias("size"), F.min("__place").alias("place")).collect()
    }
    borders = []
    for want, (key, below) in zip(targets, found, strict=True):
        if want - below <= tolerance or key not in known:
            borders.append((key, -1))
        elif known[key][0] == 1 or known[key][1] <= want - below:
            borders.append((key, HIGHEST))
        else:
            # Rows of one key are cut by their place: the first with enough bytes before it.
            same = held.where(F.col("__key") == key)
            (place, less), = split_keys(same, "__place", "__size", [want - below], tolerance=tolerance)
            borders.append((key, place if want - below - less <= tolerance else place + 1))
    return borders


def map_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``: the UTF-8 bytes of the text (none for a null) plus 8."""
    return docs.withColumn("size", F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8)
