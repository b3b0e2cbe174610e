"""Exact top-k by inner product without random access.

The candidates of a shard are held as one sorted list for each component. For a query the
lists are read from the end that favours it, some rows at a time. A candidate's score lies
between what has been read of it plus the least and plus the most that the unread lists can
still give. Reading stops when no candidate outside a few finalists can reach the k-th lower
bound; the finalists' scores are then resolved. Shards see blocks of queries, and the best of
all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicework.llm.vectors import packed, unpacked, vectors

SHARD_ROWS, QUERY_ROWS = 8192, 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1
STEPS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1)


class SortedLists:
    """One list for each component of ``x`` (rows, components), whole numbers in exact arithmetic."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(x))[:, None], axis=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, id, score) of the k best of each query but itself, ties to the smaller id."""
        n, found = len(self.ids), []
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        left = np.arange(len(queries))
        sums = np.zeros((n, len(queries)), self.x.dtype)
        own = self.ids[:, None] == query_ids[None, :]
        read = 0
        for step in STEPS:
            depth = max(read, int(np.ceil(n * step)))
            for j in range(self.x.shape[1]):
                high, low = self.order[n - depth : n - read, j], self.order[read:depth, j]
                sums[high] += self.x[high, j, None] * up[left, j]
                sums[low] += self.x[low, j, None] * down[left, j]
            read = depth
            lower, upper = self._bounds(sums, up[left], down[left], read)
            lower[own], upper[own] = -np.inf, -np.inf
            if n > k:
                bar = np.partition(lower, n - k, axis=0)[n - k]
            else:
                bar = np.full(len(left), -np.inf)
            open_ = (upper >= bar) & (upper > -np.inf)
            many = open_.sum(axis=0)
            done = (many <= 4 * k) | (read == n)
            for c in np.flatnonzero(done):
                found += self._resolve(np.flatnonzero(open_[:, c]), query_ids[left[c]], queries[left[c]], k)
            keep = ~done
            left, sums, own = left[keep], np.ascontiguousarray(sums[:, keep]), own[:, keep]
            if not len(left):
                break
        return found

    def _bounds(self, sums: np.ndarray, up: np.ndarray, down: np.ndarray, read: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        if read == n:
            return sums.astype(float), sums.astype(float)
        kind = self.x.dtype
        from_top, from_end = (self.rank < n - read).astype(kind), (self.rank >= read).astype(kind)
        top, end = self.values[n - read], self.values[read - 1]
        lower = sums + from_top @ (up * self.values[0]).T + from_end @ (down * self.values[-1]).T
        upper = sums + from_top @ (up * top).T + from_end @ (down * end).T
        return lower.astype(float), upper.astype(float)

    def _resolve(self, rows: np.ndarray, query_id, query: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        scores = self.x[rows] @ query
        best = sorted(zip([-int(s) for s in scores], self.ids[rows].tolist(), strict=True))[:k]
        return [(int(query_id), i, max(LEAST, min(MOST, -s))) for s, i in best]


def exact_type(x: np.ndarray, queries: np.ndarray):
    """Doubles while every sum of products is a whole number they hold exactly, else Python integers."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * x.shape[1]
    return np.float64 if most < 1 << 52 else object


def search(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k best other rows.

    Components become ``floor(scale * x)``, the score is the integer inner product. Rows with the
    query's id are never its candidates. Vectors that cannot be compared (see ``vectors``) take
    no part; zero vectors do. Components are held to 63 bits and scores to 64.
    """
    def whole(x: np.ndarray) -> np.ndarray:
        return np.floor(scale * x).clip(-(2.0**62), 2.0**62)

    rows = packed(vectors(df, id_col, vector_col, zero=True), whole, "<i8")
    total, asked = rows.select("id").agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    shards, blocks = max(1, -(-total // SHARD_ROWS)), max(1, -(-asked // QUERY_ROWS))
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    given = rows.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.where(F.col("id") % every == 0).withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def answer(given: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(given) and len(queries):
            x, q = unpacked(given["data"].tolist(), "<i8"), unpacked(queries["data"].tolist(), "<i8")
            kind = exact_type(x, q)
            found = SortedLists(given["id"].to_numpy(), x.astype(kind)).search(queries["id"].to_numpy(), q.astype(kind), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    best = given.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(answer, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
