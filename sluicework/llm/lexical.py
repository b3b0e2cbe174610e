"""Ranked lexical search over impact vectors in norm buckets.

A document is a vector with one impact for each term of the query block, an item a vector of
term weights. Vectors are ordered by length, longest first, and cut into buckets. For a query
whose k-th best score so far is t, a bucket goes when the product of the lengths (Cauchy and
Schwarz) or the sum of the bucket's greatest impacts cannot reach t. Inside a bucket the
coordinates that can add most are summed until the rest cannot reach t alone; a vector whose
sum and bound on the rest (the smaller of both bounds again) stay below t goes, too. What is
left is scored anew in whole numbers.

The longest sixteenth is searched first; its k-th scores are the bounds the rest starts from.
Items are read in blocks of a bounded number of items and terms, and each block is met by all
documents, so what a task holds does not grow with either table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicework.llm.common import map_arrow, task_count
from sluicework.session import cut_lineage

BUCKET_ROWS, BUCKET_ENTRIES = 4096, 1 << 21
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 16
# Letters, digits and all that is not ASCII belong to terms, only A-Z change case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order; none for null."""
    return text.translate(FOLD).split() if text else []


@dataclass
class Block:
    """Some items as vectors over the terms they hold, the terms by number."""

    ids: list[int]
    counts: list[Counter]

    def __post_init__(self):
        self.place = {t: k for k, t in enumerate(sorted({t for c in self.counts for t in c}))}

    def queries(self, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, values) of each item, without terms of weight 0."""
        made = []
        for c in self.counts:
            at = np.array(sorted(self.place[t] for t in c), np.int64)
            values = np.array([c[t] for t in sorted(c)], np.int64) * weight[at]
            made.append((at[values > 0], values[values > 0]))
        return made


def blocks(items: DataFrame, id_col: str, text_col: str, most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """The items in order of their ids. An id's different texts are one item, equal rows count once; rows without an id are left out."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    held: dict[int, Counter] = {}
    seen: set[bytes] = set()
    for row in rows.where("id is not null").distinct().orderBy("id").toLocalIterator():
        if row.id not in held and (len(held) >= most_items or len(seen) >= most_terms):
            yield Block(list(held), list(held.values()))
            held, seen = {}, set()
        own = held.setdefault(row.id, Counter())
        own.update(terms(row.text))
        seen.update(own)
    if held:
        yield Block(list(held), list(held.values()))


def count_terms(docs: DataFrame, block: Block, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs): every document's number of terms, and how often it holds which terms of the block."""
    place = block.place

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, found, often = [], [], []
        for text in batch.column(1):
            all_of = terms(text.as_py())
            counts = Counter(all_of)
            known = counts.keys() & place.keys()
            at = np.fromiter((place[t] for t in known), np.int32, len(known))
            tf = np.fromiter((counts[t] for t in known), np.int32, len(known))
            order = np.argsort(at)
            sizes.append(len(all_of))
            found.append(at[order].tobytes())
            often.append(tf[order].tobytes())
        made = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(often, pa.binary())]
        return pa.RecordBatch.from_arrays(made, ["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_arrow(rows, run, "id long, n long, terms binary, tfs binary")


def statistics(counted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, documents that hold each term of the block)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.column(0).to_numpy()
        at = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32)
        sums = np.concatenate((np.bincount(at, minlength=size), [(n > 0).sum(), n.sum()]))
        kept = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(sums[kept], pa.int64())], ["term", "n"])

    total = np.zeros(size + 2, np.int64)
    for row in map_arrow(counted.select("n", "terms"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[row.term] = row.n
    return int(total[size]), int(total[size + 1]), total[:size]


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)


def impact_vectors(counted: DataFrame, documents: int, total: int) -> DataFrame:
    """(id, terms, impacts, norm) of the documents with an id and a term of the block."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made, norms = [], []
        for n, tfs in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            tf = np.frombuffer(tfs, np.int32).astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * documents // total))
            made.append(impact.astype(np.int32).tobytes())
            norms.append(float(np.sqrt(np.square(impact.astype(np.float64)).sum())))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary()), pa.array(norms, pa.float64())], ["id", "terms", "impacts", "norm"])

    return map_arrow(counted.where("id is not null and length(terms) > 0"), run, "id long, terms binary, impacts binary, norm double")


class Bucket:
    """Impact vectors of similar length, by vector and by term."""

    def __init__(self, ids: np.ndarray, found: list[bytes], impacts: list[bytes], norms: np.ndarray, size: int):
        self.ids, self.norms, self.longest = ids, norms, float(norms.max())
        self.terms = np.frombuffer(b"".join(found), np.int32)
        self.values = np.frombuffer(b"".join(impacts), np.int32).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found])))
        rows = np.repeat(np.arange(len(ids)), np.diff(self.starts))
        order = np.argsort(self.terms, kind="stable")
        self.rows, self.sorted = rows[order], self.values[order]
        self.lists = np.concatenate(([0], np.cumsum(np.bincount(self.terms, minlength=size))))
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, self.terms, self.values)

    def candidates(self, at: np.ndarray, values: np.ndarray, least: int) -> np.ndarray:
        """The vectors that may score ``least`` (at least 1) or more; all that do are among them."""
        length = float(np.sqrt(np.square(values.astype(np.float64)).sum()))
        gains = values * self.most[at]
        if length * self.longest * (1 + 1e-9) < least or gains.sum() < least:
            return np.empty(0, np.int64)
        order = np.argsort(-gains, kind="stable")
        at, values, gains = at[order], values[order], gains[order]
        rest = gains.sum() - np.cumsum(gains)
        focus = int(np.argmax(rest < least)) + 1
        sums, squares = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for t, q in zip(at[:focus].tolist(), values[:focus].tolist(), strict=True):
            held = slice(self.lists[t], self.lists[t + 1])
            sums[self.rows[held]] += q * self.sorted[held]
            squares[self.rows[held]] += np.square(self.sorted[held].astype(np.float64))
        tail = float(np.sqrt(np.square(values[focus:].astype(np.float64)).sum()))
        beyond = tail * np.sqrt(np.maximum(np.square(self.norms) * (1 + 1e-9) - squares, 0)) * (1 + 1e-9)
        return np.flatnonzero((sums > 0) & (sums + np.minimum(beyond, float(rest[focus - 1])) >= least))

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """The exact products of these vectors with a query given at every term."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        begins = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(begins - self.starts[rows], sizes)
        return np.add.reduceat(dense[self.terms[at]] * self.values[at], begins)


class Best:
    """The k best (score, id) of a query so far, equal scores by ascending id; ``least`` is what others have to reach."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        reached = scores >= self.least
        scores, ids = np.concatenate((self.scores, scores[reached])), np.concatenate((self.ids, ids[reached]))
        top = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[top], ids[top]
        if len(top) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def search_vectors(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, least: list[int]) -> DataFrame:
    """(query, id, score): the best of each part of the vectors, among them all of the k best of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, x) for x in least]
        dense = np.zeros(size, np.int64)
        for batch in batches:
            entries = np.array([len(t) // 4 for t in batch.column(1).to_pylist()])
            at = 0
            while at < batch.num_rows:
                upto = at + max(1, int(np.searchsorted(np.cumsum(entries[at : at + BUCKET_ROWS]), BUCKET_ENTRIES, side="right")))
                piece, at = batch.slice(at, upto - at), upto
                bucket = Bucket(piece.column(0).to_numpy(), piece.column(1).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_numpy(), size)
                for (found, values), top in zip(queries, best, strict=True):
                    rows = bucket.candidates(found, values, top.least) if len(found) else found
                    if len(rows):
                        dense[found] = values
                        top.add(bucket.scores(rows, dense), bucket.ids[rows])
                        dense[found] = 0
        for q, top in enumerate(best):
            if len(top.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.ids), q, np.int32)), pa.array(top.ids), pa.array(top.scores)], ["query", "id", "score"])

    # Copies are equally long; the row's place tells them apart, so that they are dealt over several parts.
    order = [F.desc("norm"), F.col("__row")]
    placed = vectors.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(task_count(vectors), *order)
    return placed.sortWithinPartitions(*order).select("id", "terms", "impacts", "norm").mapInArrow(run, "query int, id long, score long")


def search(
    items: DataFrame, docs: DataFrame, k: int = 10, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text",
    block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Every row of ``docs`` is a document of its own, repeated rows included. One without an id
    counts in the statistics and is not ranked; null and empty texts have no terms. Items
    without terms, or whose terms are nowhere, have no rows. Scores are 64-bit sums.
    """
    spark = docs.sparkSession
    made = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items, item_col, item_text, block_items, block_terms):
        counted = cut_lineage(count_terms(docs, block, id_col, text_col))
        size = len(block.place)
        documents, total, holding = statistics(counted, size)
        if not total:
            continue
        queries = block.queries(weights(documents, holding))
        vectors = cut_lineage(impact_vectors(counted, documents, total))
        cut = vectors.approxQuantile("norm", [15 / 16], 0.005)
        if not cut:
            continue
        first = cut_lineage(search_vectors(vectors.where(F.col("norm") >= cut[0]), queries, size, k, [0] * len(queries)))
        bounds = dict(_best(first, k).where(F.col("rank") == k).select("query", "score").collect())
        rest = search_vectors(vectors.where(F.col("norm") < cut[0]), queries, size, k, [bounds.get(q, 0) for q in range(len(queries))])
        names = spark.createDataFrame(list(enumerate(block.ids)), "query int, item_id long")
        found = cut_lineage(_best(first.unionByName(rest), k))
        made = made.unionByName(found.join(names, "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    return made


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
s AS (SELECT count(*) AS nn, sum(len(terms)) AS ll FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)) AS impact FROM t, s),
x AS (SELECT item_id, doc_id, CAST(sum(c * w * impact) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN i USING (term) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
