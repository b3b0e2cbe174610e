"""Near-duplicate vectors by sorted projection passes.

In each pass a vector is hashed by the signs of random projections, concatenated to one key.
Rows are sorted by key, each is compared to a bounded window of its successors, and pairs that
reach the cosine are linked. The links of all passes make components. A window cannot hold a
large group, so the pairs inside a component are then compared completely, tile by tile.
The more vectors, the more leading signs two neighbours must share to stay within the window,
so the number of passes grows with the number of vectors to keep the recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import numbered, task_count
from sluicework.llm.graph import components
from sluicework.llm.vectors import packed, unpacked, vectors
from sluicework.session import cut_lineage

PASSES, WINDOW, BITS = 12, 64, 48
RECALL = 0.99
TILE = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spanning(hit: np.ndarray) -> np.ndarray:
    """For a block of n rows against their n + w successors (column j is row j, j >= n come after): the smallest member of each one's group."""
    n, m = hit.shape
    least = np.arange(m)
    if not hit.any():
        return least
    while True:
        of_rows = np.minimum(least[:n], np.where(hit, least[None, :], m).min(axis=1))
        of_cols = np.minimum(least, np.where(hit, of_rows[:, None], m).min(axis=0))
        of_cols[:n] = np.minimum(of_cols[:n], of_rows)
        of_cols = of_cols[of_cols]
        if (of_cols == least).all():
            return least
        least = of_cols


def window_links(ids: np.ndarray, x: np.ndarray, least: float, window: int, block: int = 256) -> np.ndarray:
    """(n, 2) ids that join what rows within ``window`` places of each other and at least that cosine join."""
    found = [np.empty((0, 2), np.int64)]
    for at in range(0, len(ids), block):
        n, end = min(block, len(ids) - at), min(len(ids), at + block + window)
        gap = np.arange(end - at)[None, :] - np.arange(n)[:, None]
        hit = (x[at : at + n] @ x[at:end].T >= least) & (gap > 0) & (gap <= window)
        tops = spanning(hit)
        moved = np.flatnonzero(tops != np.arange(len(tops)))
        found.append(np.stack((ids[at + moved], ids[at + tops[moved]]), axis=1))
    return np.concatenate(found)


def pass_count(total: int, least: float = 0.9, window: int = WINDOW) -> int:
    """Passes, ``PASSES`` at least, that bring an isolated pair at cosine ``least`` together with probability ``RECALL``.

    Of ``total`` evenly spread vectors about a window share log2(total / window) leading signs;
    a pair agrees in each sign with probability 1 - angle / pi.
    """
    met = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** math.log2(max(1.0, total / window))
    if met <= 0 or met >= 1:
        return PASSES
    return max(PASSES, math.ceil(math.log(1 - RECALL) / math.log1p(-met)))


def directions_of(number: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The projections of one pass, and the weights that make a key of their signs."""
    return np.random.default_rng(1000 + number).normal(size=(size, BITS)), 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)


def projection_pass(rows: DataFrame, number: int, size: int, least: float, window: int) -> DataFrame:
    """Links (a, b) of one pass over ``rows`` (id, data)."""
    directions, weights = directions_of(number, size)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signs = unpacked(batch.column(1).to_pylist(), "<f8") @ directions > 0
                yield pa.RecordBatch.from_arrays([pa.array(signs @ weights), batch.column(0), batch.column(1)], ["key", "id", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, data, first = np.empty(0, np.int64), [], True

        def border(number: int, ids: np.ndarray, data: list) -> pa.RecordBatch:
            n = len(ids)
            return _links([None] * n, [None] * n, [number] * n, ids.tolist(), data)

        for batch in batches:
            ids = np.concatenate((ids, batch.column(1).to_numpy(zero_copy_only=False)))
            data = data + batch.column(2).to_pylist()
            if not len(ids):
                continue
            if first:
                yield border(part, ids[:window], data[:window])
                first = False
            links = window_links(ids, unpacked(data, "<f8"), least, window)
            yield _links(links[:, 0], links[:, 1], [None] * len(links), [None] * len(links), [None] * len(links))
            ids, data = ids[-window:], data[-window:]
        if len(ids):
            yield border(part + 1, ids, data)

    def across(part: pd.DataFrame) -> pd.DataFrame:
        """Rows at one border of two ranges, brought into the order of their keys again."""
        x = unpacked(part["data"].tolist(), "<f8")
        order = np.lexsort((part["id"].to_numpy(), (x @ directions > 0) @ weights))
        links = window_links(part["id"].to_numpy(np.int64)[order], x[order], least, window)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    ordered = rows.mapInArrow(keyed, "key long, id long, data binary").repartitionByRange(task_count(rows), "key", "id").sortWithinPartitions("key", "id")
    made = cut_lineage(ordered.mapInArrow(compare, "a long, b long, border int, id long, data binary"))
    borders = made.where("border is not null").select("border", "id", "data").groupBy("border").applyInPandas(across, "a long, b long")
    return made.where("a is not null").select("a", "b").unionByName(borders)


def _links(a, b, border, ids, data) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((a, b, border, ids, data), types, strict=True)], ["a", "b", "border", "id", "data"])


def count_links(members: DataFrame, least: float) -> DataFrame:
    """``members`` (id, data, copies, component) to (id, links): the summed copies of the others within the cosine.

    A component is cut into tiles of ``TILE`` members, and each pair of tiles is one piece of
    work; components of one tile share pieces.
    """
    rows = numbered(members, ["id"], ["component"], "place").withColumn("tile", F.expr(f"cast(place div {TILE} as int)"))
    tiles = rows.groupBy("component").agg((F.max("tile") + 1).alias("tiles"))
    both = rows.join(tiles, "component").withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    both = both.select(
        "component", "id", "data", "copies", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
        F.when(F.col("tiles") > 1, F.xxhash64("component", F.least("tile", "other"), F.greatest("tile", "other"))).otherwise(F.pmod(F.xxhash64("component"), F.lit(256))).alias("piece"),
    )

    def piece(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), own in part.groupby(["component", "i", "j"], sort=False):
            x, copies, ids, tile = unpacked(own["data"].tolist(), "<f8"), own["copies"].to_numpy(), own["id"].to_numpy(), own["tile"].to_numpy()
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            if i != j:
                near &= tile[:, None] != tile[None, :]
            out.append(pd.DataFrame({"id": ids, "links": near @ copies}))
        return pd.concat(out)

    return both.groupBy("piece").applyInPandas(piece, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; without ``passes``, ``pass_count`` of the different vectors.

    Equal vectors are compared once and linked to each other. Rows that cannot be compared (see
    ``vectors``) have no link and are their own component.
    """
    content = (F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    valid = vectors(df, id_col, vector_col, zero=False).select("id", "vector", *content)
    placed = cut_lineage(valid.select("id", "h1", "h2"))
    classes = valid.groupBy("h1", "h2").agg(F.min_by("vector", "id").alias("vector"), F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = cut_lineage(classes)
    # Rows may share an id, so classes have a number of their own.
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()))
    reps = cut_lineage(packed(classes.select(F.col("class").alias("id"), "vector"), _unit, "<f8"))
    sample = reps.first()
    everything = df.select(F.col(id_col).cast("long").alias("vec_id"))
    if sample is None:
        alone = F.col("vec_id")
        return everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone.alias("component_id"), F.lit(True).alias("kept"))
    links = None
    for number in range(passes or pass_count(reps.count(), least, window)):
        found = cut_lineage(projection_pass(reps, number, len(sample.data) // 8, least, window))
        links = found if links is None else links.unionByName(found)
    groups = components(links).withColumnsRenamed({"node": "class"})
    grouped = classes.join(groups, "class").join(reps.withColumnRenamed("id", "class"), "class")
    counted = count_links(grouped.select(F.col("class").alias("id"), "data", "copies", "component"), least)
    named = groups.join(classes.select("class", "id"), "class").groupBy("component").agg(F.min("id").alias("top"))
    known = classes.join(groups, "class", "left").join(named, "component", "left").join(counted.withColumnRenamed("id", "class"), "class", "left")
    known = cut_lineage(known.select("h1", "h2", F.coalesce("top", "id").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    compared = placed.join(known, ["h1", "h2"]).select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("top").alias("component_id"))
    left_out = _left_out(df, id_col, vector_col, len(sample.data) // 8)
    return compared.unionByName(left_out).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _left_out(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """The rows that ``vectors`` leaves out, each its own component."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0) | (F.size("v") != size)
    rows = rows.where(F.col("vec_id").isNull() | F.col("v").isNull() | F.coalesce(bad, F.lit(True)))
    return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
