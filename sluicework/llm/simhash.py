"""Near-duplicate documents by SimHash fingerprints, searched with vantage-point trees.

A fingerprint is 64 bits; two link when at most ``radius`` bits differ. The distinct
fingerprints are split over shards by a vantage-point tree: at each node those within ``mu``
bits of a vantage point go left, the others right. By the triangle inequality a right point
can link to a left one only when it lies within ``mu + radius``, so just those visit the left
shard as well; visitors travel down both sides while the bounds allow it. Every link is then
met inside some shard, where the same recursion goes on to small blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import map_arrow
from sluicework.llm.graph import components
from sluicework.session import cut_lineage

SEED = 42
SHARD_ROWS = 8_192
SAMPLE_ROWS = 65_536
BLOCK = 256


def shingles(text: str | None, words: int = 3) -> list[bytes]:
    """Runs of ``words`` words, ASCII lower-cased, space-joined, repeats included; all words when there are fewer."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined] if found else []
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(pieces: list[bytes]) -> int:
    """64 bits, each set when set in over half of the hashes; 0 without pieces."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(pieces), 4096):
        hashes = np.array([xxhash.xxh64_intdigest(p, SEED) for p in pieces[at : at + 4096]], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(pieces)).view(">u8")[0]) if pieces else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; a null or blank text has 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(shingles(t.as_py(), words)) for t in batch.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "id long, fp long")


class ShardTree:
    """The upper levels of a vantage-point tree, fitted on a bounded sample; routes fingerprints to shards."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int, seed: int = 7):
        self.radius, self.nodes, self.shards = radius, [], 0
        self._rng = np.random.default_rng(seed)
        self.root = self._grow(sample, shards)
        del self._rng

    def _grow(self, points: np.ndarray, shards: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        split = _vantage(points, self._rng) if shards > 1 and len(points) >= 16 else None
        if split is None:
            self.nodes[at] = (self.shards,)
            self.shards += 1
            return at
        point, mu, near = split
        self.nodes[at] = (point, mu, self._grow(points[near], shards // 2), self._grow(points[~near], shards - shards // 2))
        return at

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(shard, points, at home?) groups; each point is at home in one shard and may visit others."""
        waiting = [(self.root, points, points[:0])]
        while waiting:
            at, home, away = waiting.pop()
            node = self.nodes[at]
            if len(node) == 1:
                yield node[0], home, True
                yield node[0], away, False
                continue
            point, mu, left, right = node
            (lh, la), (rh, ra) = _split(home, away, point, mu, self.radius)
            waiting += [(left, lh, la), (right, rh, ra)]


def _distance(points: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(point)).astype(np.int16)


def _vantage(points: np.ndarray, rng) -> tuple | None:
    """A point and a distance that cut the points into two parts of at least a quarter, the fewest near the cut."""
    best = None
    for point in points[rng.integers(0, len(points), 4)]:
        d = _distance(points, point)
        counts = np.bincount(d, minlength=70)
        below = np.cumsum(counts)
        for mu in np.flatnonzero((below >= len(points) / 4) & (below <= len(points) * 3 / 4)).tolist():
            cost = counts[max(0, mu - 1) : mu + 3].sum() + abs(below[mu] - len(points) / 2) / 2
            if best is None or cost < best[0]:
                best = (cost, point, mu, d <= mu)
    return best and best[1:]


def _split(home: np.ndarray, away: np.ndarray, point, mu: int, radius: int) -> tuple:
    d, e = _distance(home, point), _distance(away, point)
    near = d <= mu
    left = home[near], np.concatenate((away[e <= mu + radius], home[~near & (d <= mu + radius)]))
    return left, (home[~near], away[e > mu - radius])


def block_links(home: np.ndarray, away: np.ndarray, radius: int, rng) -> Iterator[np.ndarray]:
    """Links that join whatever links within ``home`` or between ``home`` and ``away`` join, as (n, 2) arrays.

    Of a dense block only links to each column's first partner are given, so a group of k
    points gives far fewer than k * k rows and the same components.
    """
    waiting = [(home, away)]
    while waiting:
        home, away = waiting.pop()
        if len(home) == 0:
            continue
        split = _vantage(home, rng) if len(home) > BLOCK else None
        if split:
            waiting += _split(home, away, split[0], split[1], radius)
            continue
        for at in range(0, len(home), BLOCK):
            rows, cols = home[at : at + BLOCK], np.concatenate((home[at:], away))
            for c in range(0, len(cols), 65_536):
                part = cols[c : c + 65_536]
                hit = np.bitwise_count(rows[:, None] ^ part[None, :]) <= radius
                col = np.flatnonzero(hit.any(axis=0))
                if not len(col):
                    continue
                first = hit[:, col].argmax(axis=0)
                yield np.stack((rows[first], part[col]), axis=1)
                r, k = np.nonzero(hit[:, col])
                pairs = np.unique(first[k] * len(rows) + r)
                yield np.stack((rows[pairs // len(rows)], rows[pairs % len(rows)]), axis=1)


def spanning_links(home: np.ndarray, away: np.ndarray, radius: int) -> pd.DataFrame:
    """At most one link for each point of a shard, joining what its links join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for links in block_links(np.sort(home), np.sort(away), radius, np.random.default_rng(len(home))):
        links = links[links[:, 0] != links[:, 1]]
        for a, b in links.tolist():
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.uint64, len(parent))
    tops = np.fromiter((root(x) for x in parent), np.uint64, len(parent))
    return pd.DataFrame({"a": nodes.view(np.int64), "b": tops.view(np.int64)})


def link_fingerprints(points: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``points`` (fp, distinct) to links (a, b) that connect exactly the fingerprints within ``radius`` bits.

    The tree is fitted on at most about ``sample_rows`` fingerprints; every fingerprint is
    indexed. A shard is one group of eight-byte values.
    """
    total = points.count()
    shards = max(1, min(-(-total // shard_rows), sample_rows // 16))
    picked = points
    if total > sample_rows:
        share = int((1 << 30) * sample_rows / total)
        picked = points.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < share)
    sample = np.sort(np.array([r.fp for r in picked.limit(2 * sample_rows).collect()], np.int64).view(np.uint64))
    tree = ShardTree(sample, shards, radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for shard, part, at_home in tree.route(values):
                if len(part):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), shard, np.int32)), pa.array(part.view(np.int64)), pa.array(np.full(len(part), at_home))],
                        ["shard", "fp", "home"],
                    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["fp"].to_numpy(np.int64).view(np.uint64)
        home = rows["home"].to_numpy(bool)
        return spanning_links(values[home], values[~home], radius)

    routed = points.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``prints`` (id, fp) to (id, fp, component): the smallest id reachable by links, the own one included.

    Equal fingerprints are one point of the search and share a component. Rows whose id is
    null are kept with a null component unless others share it; repeated ids stay repeated.
    """
    points = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    groups = components(link_fingerprints(points, radius)).withColumnsRenamed({"node": "fp", "component": "root"})
    placed = points.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tops = placed.groupBy("root").agg(F.min("least").alias("component"))
    labels = cut_lineage(placed.join(tops, "root").select("fp", "component"))
    return prints.join(labels, "fp").select("id", "fp", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each group of linked fingerprints: the one with the smallest id.

    Repeated rows of that id are reduced to one where their texts are equal (by two 64-bit
    hashes); rows without an id cannot be named and all stay.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words))
    found = near_duplicates(prints, radius).where("id = component").select(F.col("id").alias("__keep")).distinct()
    kept = docs.join(found, docs[id_col].cast("long") == F.col("__keep"), "left_semi")
    hashes = {f"__hash{k}": F.xxhash64(F.lit(k), F.col(text_col)) for k in (0, 1)}
    kept = kept.withColumns(hashes).dropDuplicates([id_col, *hashes]).drop(*hashes)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
