"""Histogram boosting: many fits grow in the same Spark jobs.

Every feature is cut at quantiles into at most ``bins`` bins once. Rows whose bins are all equal
are one *cell*: they stay together in every tree, so a level works on cells. The rows of a cell in one
fold are one *unit*, and those of a unit with equal targets one *entry*, from which a tree draws its
share by their number. The rows are range-partitioned by their bins, so that equal ones meet, and held
as blocks. One level of one tree of *all* fits (the folds of a cross-validation and the fit on all
rows) is one job: each block adds up its residuals by (fit, node, feature, bin), the sums of a fit meet
in one task that picks the splits, and the driver sees the trees only.

A fit starts from the mean of its target (or the log odds of its label). Each tree is grown on
the residuals of a fresh share of the rows; splits maximise ``n_l * n_r / n * (mean_l - mean_r)^2``,
a leaf adds ``rate`` times its mean residual (for labels, one Newton step).

A fit is hundreds of short jobs, one after the other, so the blocks are held as an RDD of arrays:
a level then costs little more than the start of its tasks, and a small table is one block in one
task. The running predictions of a block are kept with it, cached from tree to tree. They follow from
the trees alone: every ``STORE`` trees they are worked out anew from all trees so far, so that no chain
of steps grows long and nothing is written for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sluicework.session import cut_lineage, ship_package

SMALL, BLOCK, STORE = 1 << 16, 1 << 21, 50
PIECE = 1 << 15  # cells or rows whose arrays fit a core's cache


@dataclass(frozen=True)
class Settings:
    trees: int = 200
    depth: int = 5
    rate: float = 0.1
    subsample: float = 0.8
    min_leaf: int = 1
    bins: int = 64
    logistic: bool = False
    seed: int = 42


@dataclass
class Tree:
    """A complete binary tree in level order: node k has the children 2k + 1 and 2k + 2.

    ``feature`` is -1 where a node is a leaf; rows with a bin above ``cut`` go to the right.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n), np.zeros(n))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node each row (a column of ``bins``) has reached after ``levels`` levels; a leaf keeps its rows."""
        deep = len(self.feature) > 255
        return np.concatenate([
            (self._followed if deep else self._marked)(bins[:, k : k + PIECE], levels) for k in range(0, max(1, bins.shape[1]), PIECE)
        ])

    def _marked(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Places in a tree of few nodes: the rows of each node as marks of one byte, which need no lookup."""
        n = bins.shape[1]
        at, right = np.zeros(n, np.uint8), np.empty(n, bool)
        inside = {0: np.ones(n, bool)}
        last = min(levels, (len(self.feature) + 1).bit_length() - 2)
        for level in range(last):
            split = {k: m for k, m in inside.items() if self.feature[k] >= 0}
            if not split:
                break
            inside, turned = {}, np.zeros(n, bool)
            stays = len(split) < 1 << level
            moved = np.zeros(n, bool) if stays else None
            for k, own in split.items():
                np.greater(bins[self.feature[k]], self.cut[k], out=right)
                np.logical_and(right, own, out=right)
                np.logical_or(turned, right, out=turned)
                if stays:
                    np.logical_or(moved, own, out=moved)
                if level + 1 < last:
                    inside[2 * k + 1] = own ^ right
                    inside[2 * k + 2] = right.copy()
            # Node k has the children 2k + 1 and 2k + 2.
            if stays:
                at += at * moved.view(np.uint8) + moved.view(np.uint8)
            else:
                at += at + np.uint8(1)
            at += turned.view(np.uint8)
        return at.astype(np.int64)

    def _followed(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Places in a tree of any size, row by row."""
        n = bins.shape[1]
        at, rows, flat = np.zeros(n, np.int64), np.arange(n), np.ascontiguousarray(bins).reshape(-1)
        feature = np.maximum(self.feature, 0).astype(np.int64) * n
        step = np.where(self.feature >= 0, np.arange(len(self.feature)) + 1, 0)
        for _ in range(levels):
            moves = step.take(at)
            if not moves.any():
                break
            right = flat.take(feature.take(at) + rows) > self.cut.take(at)
            at += moves + (right & (moves > 0))
        return at


@dataclass
class Fit:
    """A boosted model: ``base + rate * sum of leaf values``, a margin (log odds) if ``logistic``."""

    cuts: list[np.ndarray]
    base: float
    rate: float
    logistic: bool
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Rows of values as columns of bins."""
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)]).astype(np.uint8)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k in range(0, len(x), PIECE):
            bins, own = self.binned(x[k : k + PIECE]), total[k : k + PIECE]
            for tree in self.trees:
                own += (self.rate * tree.value).take(tree.places(bins, 64))
        return total

    def importances(self) -> np.ndarray:
        """The mean over trees of each feature's share of the tree's gain; adds up to 1, or to 0 without a split."""
        total = np.zeros(len(self.cuts))
        for tree in self.trees:
            own = np.bincount(tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0], len(self.cuts))
            total += own / own.sum() if own.sum() > 0 else 0
        return total / total.sum() if total.sum() > 0 else total


def quantile_cuts(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """For each column the values between its bins: up to ``bins - 1`` quantiles, without equal ones and the largest."""
    shares = [k / bins for k in range(1, bins)]
    found = df.approxQuantile(list(columns), [*shares, 1.0], 1 / (16 * bins))
    return [np.unique([v for v in q if v < q[-1]]) if q else np.empty(0) for q in found]


def _blocks(df: DataFrame, columns: Sequence[str], target: str, fold: str, cuts: list[np.ndarray], number: int) -> DataFrame:
    """The binned rows in the order of their bins, stored as ``number`` blocks of packed arrays.

    ``bins`` has a column for each cell, ``cell`` and ``fold`` an entry for each (cell, fold) that
    occurs, ``start`` the first row of each; ``target`` holds the rows.
    """
    binner, width = Fit(cuts, 0.0, 0.0, False), len(cuts) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1)
            packed = np.vstack([binner.binned(x), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)[None]])
            bins = pa.Array.from_buffers(pa.binary(width), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(packed.T).tobytes())])
            yield pa.RecordBatch.from_arrays([bins.cast(pa.binary()), batch.column(0)], ["bins", "target"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        keys = np.concatenate([np.frombuffer(b.column(0).cast(pa.binary(width)).buffers()[1], np.uint8)[b.column(0).offset * width :][: b.num_rows * width].reshape(-1, width) for b in held])
        y = np.concatenate([b.column(1).to_numpy() for b in held])
        words = np.zeros((len(keys), -(-width // 8) * 8), np.uint8)
        words[:, :width] = keys
        order = np.lexsort((y, *words.view(">u8").astype(np.uint64).T[::-1]))
        keys, y = keys[order], y[order]
        bins, folds = keys[:, :-1], keys[:, -1]
        other = np.concatenate(([True], (bins[1:] != bins[:-1]).any(axis=1)))
        start = np.flatnonzero(other | np.concatenate(([True], folds[1:] != folds[:-1])))
        cell = (np.cumsum(other) - 1)[start]
        cells = [np.ascontiguousarray(bins[other].T), cell.astype(np.int32), folds[start], start.astype(np.int32), y]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()]), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], ["block", "bins", "cell", "fold", "start", "target"]
        )

    rows = df.select(F.col(target).cast("double"), F.col(fold).cast("int"), *[F.col(c).cast("double") for c in columns])
    keyed = rows.mapInArrow(cut, "bins binary, target double")
    if number > 1:
        # Stored, since finding the ranges reads them too. Rows equal in bins, fold and target are alike; the tie only lets the ranges cut them.
        tie = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(1023)
        keyed = cut_lineage(keyed).repartitionByRange(number, "bins", "target", tie)
    else:
        keyed = keyed.coalesce(1)
    return cut_lineage(keyed.mapInArrow(pack, "block long, bins binary, cell binary, fold binary, start binary, target binary"))


def _least(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


@dataclass
class Block:
    """Cells as columns of ``bins``, and the units of each fold k from ``edge[k]`` to ``edge[k + 1]``.

    Unit u lies in the cell ``cell[u]`` and has the entries from ``start[u]``; ``start`` is None where
    each unit has one. An entry is the ``rows`` of a unit that have one ``target``; ``place`` is its
    place in the order of the bins, in which the rows are drawn.
    """

    number: int
    bins: np.ndarray
    cell: np.ndarray
    edge: np.ndarray
    start: np.ndarray | None
    rows: np.ndarray
    target: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, row, features: int) -> Block:
        bins = np.frombuffer(row["bins"], np.uint8).reshape(features, -1)
        cell, fold, start = (np.frombuffer(row[c], t) for c, t in (("cell", np.int32), ("fold", np.uint8), ("start", np.int32)))
        target = np.frombuffer(row["target"])
        first = np.concatenate(([True], target[1:] != target[:-1]))
        first[start] = True
        entry = np.flatnonzero(first)
        rows, target = np.diff(entry, append=len(target)), target[entry]
        begin = np.searchsorted(entry, start)
        size = np.diff(begin, append=len(entry))
        order = np.argsort(fold, kind="stable")
        starts = np.cumsum(size[order]) - size[order]
        moved = np.repeat(begin[order] - starts, size[order]) + np.arange(len(entry))
        edge, single = np.searchsorted(fold[order], np.arange(257)), len(entry) == len(start)
        return cls(row["block"], bins, cell[order], edge, None if single else starts.astype(np.int32), _least(rows[moved]), target[moved], moved.astype(np.int32))


@dataclass
class State:
    """A block with what every fit predicts for its cells so far, and the rows that grow the present tree.

    ``drawn`` is the number of these rows by unit and ``summed`` the sum of their targets, ``count``
    and ``total`` the same by cell.
    """

    block: Block
    margin: np.ndarray
    drawn: np.ndarray
    summed: np.ndarray
    count: np.ndarray
    total: np.ndarray

    @classmethod
    def begin(cls, block: Block, base: np.ndarray, settings: Settings, trees: Sequence[list[Tree]] = ()) -> State:
        """The state after the trees of all fits so far, drawn for the next."""
        state = cls(block, np.repeat(base[:, None], block.bins.shape[1], axis=1), *[np.zeros(0)] * 4)
        for grown in trees:
            state._move(grown, settings)
        return state.drawing(len(trees), settings)

    def drawing(self, number: int, settings: Settings) -> State:
        """With the share of the rows that grows the tree of this number."""
        own, cells = self.block, self.block.bins.shape[1]
        drawn = own.rows.astype(np.int64)
        if settings.subsample < 1:
            rng, many = np.random.default_rng((settings.seed, number, own.number)), np.flatnonzero(own.rows > 1)
            kept = (rng.random(len(drawn)) < settings.subsample)[own.place].astype(np.int64)
            kept[many] = rng.binomial(drawn[many], settings.subsample)
            drawn = kept
        elif len(self.drawn):
            return self
        summed = drawn * own.target
        if own.start is not None:
            drawn, summed = np.add.reduceat(drawn, own.start), np.add.reduceat(summed, own.start)
        count, total = np.bincount(own.cell, drawn, cells).astype(np.int64), np.bincount(own.cell, summed, cells)
        return replace(self, drawn=_least(drawn), summed=summed, count=_least(count), total=total)

    def _move(self, trees: list[Tree], settings: Settings) -> None:
        for own, tree in zip(self.margin, trees, strict=True):
            own += (settings.rate * tree.value).take(tree.places(self.block.bins, settings.depth))

    def grown(self, trees: list[Tree], number: int, settings: Settings) -> State:
        """After the trees, drawn for the tree of this number: a cell's margin moves in every fit."""
        moved = replace(self, margin=self.margin.copy())
        moved._move(trees, settings)
        return moved.drawing(number, settings)

    def without(self, fold: int, low: int, high: int, spot: np.ndarray, n: np.ndarray, summed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The drawn rows and their sum of the cells from ``low`` to ``high``, less those of a fold; ``spot`` is a cell's place among them."""
        first, last = self.block.edge[fold], self.block.edge[fold + 1]
        a, b = first + np.searchsorted(self.block.cell[first:last], (low, high))
        own = a + np.flatnonzero(self.drawn[a:b])
        at = spot[self.block.cell[own] - low]
        n, summed = n.copy(), summed.copy()
        n[at] -= self.drawn[own]
        summed[at] -= self.summed[own]
        return n, summed


def partial_sums(blocks: Iterable[State], trees: list[Tree], level: int, settings: Settings, features: int, folds: int) -> np.ndarray:
    """Sums (fit, node of the level, feature, bin, statistic) over the rows of some blocks that grow this tree.

    The statistics are the residuals, the rows and, for labels, the curvature. Residuals and rows
    are the two parts of one complex number, so that one pass adds both up.
    """
    fits, nodes, bins_of, logistic = len(trees), 1 << level, settings.bins, settings.logistic
    # Rows that stopped at a leaf go to one node more.
    total = np.zeros((fits, features, (nodes + 1) * bins_of), complex)
    curves = np.zeros(total.shape if logistic else (0,))
    for state in blocks:
        for low in range(0, len(state.count), PIECE):
            high = min(low + PIECE, len(state.count))
            shown = state.count[low:high] > 0
            at, spot = np.flatnonzero(shown), np.cumsum(shown) - 1
            bins = state.block.bins[:, low:high]
            if len(at) < high - low:
                bins = bins.take(at, axis=1)
            everything = state.count[low:high][at].astype(np.float64), state.total[low:high][at]
            for m, tree in enumerate(trees):
                n, summed = state.without(m, low, high, spot, *everything) if m < folds else everything
                place = tree.places(bins, level) - (nodes - 1)
                place[place < 0] = nodes
                place *= bins_of
                margin = state.margin[m, low:high][at]
                if logistic:
                    margin = 1 / (1 + np.exp(-margin))
                    curve = n * margin * (1 - margin)
                weight = np.empty(len(at), complex)
                weight.real, weight.imag = summed - n * margin, n
                for f in range(features):
                    key = place + bins[f]
                    np.add.at(total[m, f], key, weight)
                    if logistic:
                        np.add.at(curves[m, f], key, curve)
    parts = [total.real, total.imag, *([curves] if logistic else [])]
    return np.stack(parts, axis=-1).reshape(fits, features, nodes + 1, bins_of, -1)[:, :, :nodes].transpose(0, 2, 1, 3, 4)


def _level(state: RDD, trees: list[Tree], level: int, settings: Settings, features: int, folds: int) -> list[Tree]:
    """The trees with the splits of one level; the sums of a fit meet in one task, in the order of the parts."""

    def sums(part: int, blocks: Iterator[State]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        for m, own in enumerate(partial_sums(blocks, trees, level, settings, features, folds)):
            yield m, (part, own)

    def choose(items: Iterator[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[tuple[int, Tree]]:
        held: dict[int, list] = {}
        for m, own in items:
            held.setdefault(m, []).append(own)
        for m, parts in held.items():
            whole = sum(own for _, own in sorted(parts, key=lambda p: p[0]))
            choose_splits(trees[m], whole, level, settings)
            yield m, trees[m]

    made = state.mapPartitionsWithIndex(sums)
    if state.getNumPartitions() > 1:
        made = made.partitionBy(len(trees), lambda m: m)
    return [tree for _, tree in sorted(made.mapPartitions(choose).collect(), key=lambda p: p[0])]


def choose_splits(tree: Tree, sums: np.ndarray, level: int, settings: Settings) -> None:
    """Give the nodes of a level their best split, and their children their values, from the sums of one fit.

    Ties go to the first feature and the lowest cut.
    """
    first = (1 << level) - 1
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    n_l, n_r = left[..., 1], right[..., 1]
    fits = (n_l >= settings.min_leaf) & (n_r >= settings.min_leaf) & (n_l > 0) & (n_r > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = left[..., 0] / n_l - right[..., 0] / n_r
        gain = np.where(fits, n_l * n_r / (n_l + n_r) * gap * gap, -1.0)
    if level == 0:
        tree.value[0] = _leaf(whole[0, 0, 0], settings.logistic)
    for k in range(len(gain)):
        best = int(np.argmax(gain[k]))
        f, cut = divmod(best, gain.shape[2])
        if gain[k, f, cut] > 1e-12 * max(1.0, abs(whole[k, f, 0, 0])):
            node = first + k
            tree.feature[node], tree.cut[node], tree.gain[node] = f, cut, gain[k, f, cut]
            tree.value[2 * node + 1] = _leaf(left[k, f, cut], settings.logistic)
            tree.value[2 * node + 2] = _leaf(right[k, f, cut], settings.logistic)


def _leaf(sums: np.ndarray, logistic: bool) -> float:
    under = sums[2] if logistic else sums[1]
    return float(sums[0] / under) if under > 1e-150 else 0.0


def fit_folds(df: DataFrame, columns: Sequence[str], target: str, fold: str, folds: int, settings: Settings) -> list[Fit]:
    """``folds`` fits, each without the rows of its fold, and one on all rows.

    Columns, target (0 or 1 if logistic) and fold must not be null. A fit without rows predicts 0.
    """
    ship_package(df.sparkSession)
    context = df.sparkSession.sparkContext
    sums = {r["fold"]: (r["n"], r["y"]) for r in df.groupBy(F.col(fold).cast("int").alias("fold")).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("double")).alias("y")).collect()}
    base = []
    for m in range(folds + 1):
        kept = [v for k, v in sums.items() if k != m or m == folds]
        n, y = sum(v[0] for v in kept), sum(v[1] for v in kept)
        mean = y / n if n else 0.0
        if settings.logistic:
            mean = min(max(mean, 1e-9), 1 - 1e-9)
            mean = float(np.log(mean / (1 - mean)))
        base.append(mean)
    cuts = quantile_cuts(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns, settings.bins)
    fits = [Fit(cuts, b, settings.rate, settings.logistic) for b in base]
    start = np.array(base)
    rows, features = sum(v[0] for v in sums.values()), len(columns)
    tasks = max(1, min(context.defaultParallelism, -(-rows // SMALL)))
    number = max(tasks, -(-rows // BLOCK))
    blocks = _blocks(df, columns, target, fold, cuts, number).rdd.map(lambda row: (row["block"], Block.of(row, features)))
    placed = blocks.partitionBy(tasks, lambda block: block).values()
    state = placed.map(lambda block: State.begin(block, start, settings)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    older, grown = None, []
    try:
        for number in range(1, settings.trees + 1):
            trees = [Tree.empty(settings.depth) for _ in fits]
            for level in range(settings.depth):
                trees = _level(state, trees, level, settings, features, folds)
                if older is not None:  # the new state has been worked out by now
                    older.unpersist()
                    older = None
            grown.append(trees)
            if number < settings.trees:
                if number % STORE:
                    after = state.map(lambda s, t=trees, n=number: s.grown(t, n, settings))
                else:
                    after = placed.map(lambda block, t=list(grown): State.begin(block, start, settings, t))
                older, state = state, after.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    finally:
        state.unpersist()
        if older is not None:
            older.unpersist()
    return [replace(fit, trees=list(own)) for fit, own in zip(fits, zip(*grown, strict=True), strict=True)] if grown else fits


def predict(df: DataFrame, columns: Sequence[str], fits: Sequence[Fit], model: str, name: str = "prediction") -> DataFrame:
    """``df`` with each row's prediction by the fit whose number is in the column ``model``: a value, or the margin of a label.

    Only ``columns`` and ``model`` go to the Python workers; some batches are predicted together.
    """
    ship_package(df.sparkSession)

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        held: list[tuple[pd.Series, ...]] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b[0]) for b in held) >= 4 * PIECE:
                yield margins(held)
                held = []
        if held:
            yield margins(held)

    def margins(held: list[tuple[pd.Series, ...]]) -> pd.Series:
        which, *x = (np.concatenate([b[k].to_numpy() for b in held]) for k in range(len(columns) + 1))
        out = np.zeros(len(which))
        for m in np.unique(which):
            rows = np.flatnonzero(which == m)
            out[rows] = fits[m].margins(np.stack([c[rows] for c in x], axis=1).astype(np.float64))
        return pd.Series(out)

    return df.withColumn(name, run(F.col(model), *[F.col(c) for c in columns]))
