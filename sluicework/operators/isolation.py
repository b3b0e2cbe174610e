"""Isolation forest: trees grown in parallel tasks, all rows scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.functions.scalar import half_even, sigmoid
from sluicework.operators.skew import exact_quantiles
from sluicework.session import cut_lineage

_NODES = "tree int, node int, feature int, threshold double, depth double"


def _expected_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(tree: int, points: np.ndarray, seed: int) -> list[tuple]:
    """Random splits until single points or the depth limit; children of i: 2i+1, 2i+2."""
    rng = np.random.default_rng(seed + tree)
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes, open_ = [], [(0, 0, points)]
    while open_:
        node, depth, rows = open_.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(splittable) == 0:
            nodes.append((tree, node, -1, 0.0, depth + _expected_depth(len(rows))))
            continue
        feature = int(rng.choice(splittable))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = rows[:, feature] <= cut
        nodes.append((tree, node, feature, cut, 0.0))
        open_ += [(2 * node + 1, depth + 1, rows[left]), (2 * node + 2, depth + 1, rows[~left])]
    return nodes


def grow_forest(
    df: DataFrame, total: int, key: Sequence[str], columns: Sequence[str], trees: int = 200, sample: int = 256, seed: int = 42
) -> DataFrame:
    """Node table of the forest over a table of ``total`` rows, at most ``trees * (2 * sample - 1)`` rows.

    Each tree learns from ``sample`` random rows of the whole table, which is what the
    method asks for: a hash of tree and key draws about four times as many, and those with
    the lowest hashes are taken. A row is copied only for the trees that draw it.
    """
    steps = 1 << 62
    share = min(steps, 4 * sample * steps // max(1, total) + 1)

    def hashed(tree):
        return F.pmod(F.xxhash64(F.lit(seed), tree, *key), F.lit(steps))

    numbers = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: hashed(tree) < F.lit(share))
    drawn = df.select(*key, *columns, F.explode(numbers).alias("tree")).withColumn("__draw", hashed(F.col("tree")))
    draw = Window.partitionBy("tree").orderBy("__draw", *key)
    drawn = drawn.withColumn("__nth", F.row_number().over(draw)).where(F.col("__nth") <= sample)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__nth")
        nodes = _grow(int(rows["tree"].iloc[0]), rows[list(columns)].to_numpy(float), seed)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "depth"])

    return drawn.select("tree", "__nth", *columns).groupBy("tree").applyInPandas(build, _NODES)


def _dense(nodes: pd.DataFrame, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = int(nodes["node"].max()) + 1
    feature = np.full((trees, width), -1, dtype=np.int32)
    threshold, depth = np.zeros((trees, width)), np.zeros((trees, width))
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    feature[at], threshold[at], depth[at] = nodes["feature"], nodes["threshold"], nodes["depth"]
    return feature, threshold, depth


def isolation_scores(df: DataFrame, key: Sequence[str], columns: Sequence[str], trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """Append ``raw_score`` in (0, 1); higher is easier to isolate."""
    total = df.count()
    rows = min(sample, total)
    nodes = grow_forest(df, total, key, columns, trees, sample, seed).toPandas()  # bounded by trees * sample
    forest = df.sparkSession.sparkContext.broadcast(_dense(nodes, trees))
    norm = _expected_depth(rows) or 1.0
    schema = T.StructType([*df.schema.fields, T.StructField("raw_score", T.DoubleType())])
    names = list(columns)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feature, threshold, depth = forest.value
        for batch in batches:
            x = batch[names].to_numpy(float)
            total = np.zeros(len(x))
            for t in range(len(feature)):
                at = np.zeros(len(x), dtype=np.int64)
                moving = np.arange(len(x))
                while len(moving):
                    moving = moving[feature[t, at[moving]] >= 0]
                    here = at[moving]
                    right = x[moving, feature[t, here]] > threshold[t, here]
                    at[moving] = 2 * here + 1 + right
                total += depth[t, at]
            yield batch.assign(raw_score=np.exp2(-(total / len(feature)) / norm))

    return df.mapInPandas(score, schema)


def find_anomalies(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], contamination: float = 0.05,
    trees: int = 200, sample: int = 256, seed: int = 42,
) -> DataFrame:
    """Append anomaly_score (0..1) and is_anomaly for the ``contamination`` most isolated."""
    scored = cut_lineage(isolation_scores(df, key, columns, trees, sample, seed))
    bar = exact_quantiles(scored.select((-F.col("raw_score")).alias("s")), ["s"], [contamination]).select("q0").scalar()
    decision = -F.col("raw_score") - bar
    return scored.withColumns(
        {
            "anomaly_score": half_even(sigmoid(decision), 4),
            "is_anomaly": F.when(decision < 0, 1).otherwise(0).cast("long"),
        }
    ).drop("raw_score")


def explain_anomalies(scored: DataFrame, key: Sequence[str], columns: Sequence[str], n: int = 3) -> DataFrame:
    """The ``n`` features of each flagged row furthest from the table mean."""
    means = scored.agg(*[F.avg(c).alias(c) for c in columns])
    mean = means.select(F.struct(*columns)).scalar()
    cells = F.array(
        *[F.struct((-F.abs(F.col(c) - mean[c])).alias("d"), F.lit(c).alias("feature")) for c in columns]
    )
    first = F.slice(F.sort_array(cells), 1, n)
    return scored.where(F.col("is_anomaly") == 1).select(
        *key, F.posexplode(first).alias("pos", "cell")
    ).select(*key, (F.col("pos") + 1).alias("place"), "cell.feature", half_even(-F.col("cell.d"), 3).alias("deviation"))
