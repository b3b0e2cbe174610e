"""k-means: the fits of all numbers of clusters and all starts move in the same Spark jobs.

Equal points are one weighted point. The points are held as blocks of an RDD; one job chooses the
next centre of every fit that still lacks one, and one job moves the centres of every fit that has
not come to rest. The driver sees sums by centre, whose size depends on the settings only.

Starts are k-means++: a point becomes the next centre with a chance in proportion to its weight
and its squared distance to the centres there are. Every point draws an exponential number over
this product, and the smallest wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.session import cut_lineage, ship_package

CELLS, BLOCK = 1 << 18, 1 << 12


@dataclass(frozen=True)
class Centres:
    """A fitted clustering."""

    points: np.ndarray

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.points)


@dataclass
class Fit:
    k: int
    start: int
    centres: np.ndarray
    cost: float = 0.0


@dataclass
class Block:
    number: tuple[int, int]
    x: np.ndarray
    weight: np.ndarray


def _blocks(df: DataFrame, columns: Sequence[str]) -> RDD:
    names = [f"x{i}" for i in range(len(columns))]
    cells = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    points = cut_lineage(cells.groupBy(*names).agg(F.count("*").cast("double").alias("weight")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(at, BLOCK).columns], axis=1).astype(np.float64)
                if not np.isfinite(x).all():
                    raise ValueError("clustering needs finite numbers")
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([x.tobytes()], pa.binary())], ["part", "number", "cells"])
                number += 1

    number = points.count()
    if not number:
        raise ValueError("no rows to cluster")
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, -(-number * len(columns) // CELLS))
    dealt = points.repartition(tasks, *names).sortWithinPartitions(*names).mapInArrow(pack, "part long, number long, cells binary")
    width = len(columns) + 1

    def unpack(row) -> Block:
        x = np.frombuffer(row["cells"]).reshape(-1, width)
        return Block((row["part"], row["number"]), np.ascontiguousarray(x[:, :-1]), np.ascontiguousarray(x[:, -1]))

    return dealt.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def _stack(fits: Sequence[Fit]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """All centres as one matrix, and the rows of each fit."""
    ends = np.cumsum([len(f.centres) for f in fits]).tolist()
    return np.concatenate([f.centres for f in fits]), list(zip([0, *ends[:-1]], ends, strict=True))


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres; what rounding leaves of nothing is 0."""
    far = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :]
    found = far - 2 * (x @ centres.T)
    return np.where(found > 1e-13 * far, found, 0.0)


def _next_centres(blocks: RDD, fits: Sequence[Fit], step: int, seed: int) -> list[tuple[float, np.ndarray | None]]:
    """For each fit the smallest draw and its point; infinite where every point is a centre."""
    stack, bounds = _stack(fits)

    def run(held: Iterable[Block]) -> Iterator[list[tuple[float, np.ndarray | None]]]:
        best: list[tuple[float, np.ndarray | None]] = [(np.inf, None)] * len(fits)
        for block in held:
            gaps = squared_distances(block.x, stack) if len(stack) else None
            for f, (fit, (a, b)) in enumerate(zip(fits, bounds, strict=True)):
                chance = block.weight * (gaps[:, a:b].min(axis=1) if b > a else 1.0)
                draw = np.random.default_rng((seed + fit.start, fit.k, step, *block.number)).exponential(size=len(chance))
                race = np.divide(draw, chance, out=np.full(len(draw), np.inf), where=chance > 0)
                at = int(race.argmin())
                if race[at] < best[f][0]:
                    best[f] = (float(race[at]), block.x[at].copy())
        yield best

    return blocks.mapPartitions(run).reduce(lambda left, right: [a if a[0] <= b[0] else b for a, b in zip(left, right, strict=True)])


def _sums(blocks: RDD, fits: Sequence[Fit]) -> list[tuple[np.ndarray, float]]:
    """For each fit the sums by centre (coordinates, squared length, weight) of its nearest points, and the cost."""
    stack, bounds = _stack(fits)

    def run(held: Iterable[Block]) -> Iterator[np.ndarray]:
        total, width = None, stack.shape[1]
        for block in held:
            gaps, rows = squared_distances(block.x, stack), np.arange(len(block.x))
            own = np.zeros_like(gaps)
            for a, b in bounds:
                own[rows, a + gaps[:, a:b].argmin(axis=1)] = block.weight
            wide = np.column_stack((block.x, (block.x * block.x).sum(axis=1), np.ones(len(rows))))
            added = np.column_stack((own.T @ wide, (own * gaps).sum(axis=0)))
            total = added if total is None else total + added
        yield np.zeros((len(stack), width + 3)) if total is None else total

    total = blocks.mapPartitions(run).reduce(np.add)
    return [(total[a:b, :-1], float(total[a:b, -1].sum())) for a, b in bounds]


def _silhouettes(blocks: RDD, fits: Sequence[Fit], sums: Sequence[np.ndarray]) -> list[float]:
    """The mean silhouette in squared distances, which follows from the sums by cluster; -1 for a single cluster."""
    stack, bounds = _stack(fits)

    def run(held: Iterable[Block]) -> Iterator[np.ndarray]:
        total = np.zeros((len(fits), 2))
        for block in held:
            gaps, rows, square = squared_distances(block.x, stack), np.arange(len(block.x)), (block.x * block.x).sum(axis=1)
            for f, ((a, b), cluster) in enumerate(zip(bounds, sums, strict=True)):
                label, size = gaps[:, a:b].argmin(axis=1), cluster[:, -1]
                there = np.maximum(size, 1.0)
                mean = square[:, None] + (cluster[:, -2] / there)[None, :] - 2 * (block.x @ (cluster[:, :-2] / there[:, None]).T)
                mean[:, size == 0] = np.inf
                n = size[label]
                inner = mean[rows, label] * n / np.maximum(n - 1, 1)
                mean[rows, label] = np.inf
                outer = mean.min(axis=1)
                top = np.maximum(inner, outer)
                judged = (n > 1) & (top > 0) & np.isfinite(top)
                one = np.divide(outer - inner, top, out=np.zeros(len(rows)), where=judged)
                total[f] += (block.weight * one).sum(), block.weight.sum()
        yield total

    several = [(c[:, -1] > 0).sum() > 1 for c in sums]
    total = blocks.mapPartitions(run).reduce(np.add)
    return [float(t[0] / t[1]) if many else -1.0 for t, many in zip(total, several, strict=True)]


def sweep(df: DataFrame, columns: Sequence[str], ks: Sequence[int], starts: int, seed: int, rounds: int = 300, rest: float = 1e-4) -> list[tuple[int, Centres, float, float]]:
    """Per k the cheapest of ``starts`` fits: (k, centres, silhouette, cost).

    A fit rests when no centre moved by more than ``rest``, and ends after ``rounds`` moves. A centre
    without points stays. A table with fewer different points than k has as many centres as points.
    """
    ship_package(df.sparkSession)
    blocks = _blocks(df, columns)
    try:
        fits = [Fit(k, s, np.zeros((0, len(columns)))) for k in ks for s in range(starts)]
        for step in range(max(ks)):
            open_ = [f for f in fits if f.k > step and len(f.centres) == step]
            if not open_:
                break
            for fit, (draw, point) in zip(open_, _next_centres(blocks, open_, step, seed), strict=True):
                if point is not None:
                    fit.centres = np.vstack((fit.centres, point))
        moving = fits
        for _ in range(rounds):
            still = []
            for fit, (sums, _cost) in zip(moving, _sums(blocks, moving), strict=True):
                size = sums[:, -1:]
                moved = np.where(size > 0, sums[:, :-2] / np.maximum(size, 1.0), fit.centres)
                if ((moved - fit.centres) ** 2).sum(axis=1).max() > rest * rest:
                    still.append(fit)
                fit.centres = moved
            moving = still
            if not moving:
                break
        final = _sums(blocks, fits)
        for fit, (_sums_of, cost) in zip(fits, final, strict=True):
            fit.cost = cost
        best = [min((i for i, f in enumerate(fits) if f.k == k), key=lambda i: fits[i].cost) for k in ks]
        shape = _silhouettes(blocks, [fits[i] for i in best], [final[i][0] for i in best])
        return [(fits[i].k, Centres(fits[i].centres), s, fits[i].cost) for i, s in zip(best, shape, strict=True)]
    finally:
        blocks.unpersist()
