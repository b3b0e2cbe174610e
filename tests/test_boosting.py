"""Boosting held against plain numpy, and against Spark ML on a table of its own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicework.operators import boosting as B


def plain_tree(bins, gradient, curve, settings, sampled):
    """Greedy depth-first growth, split by split: node -> (feature, cut, gain), node -> value."""
    splits, values = {}, {}

    def value(rows):
        under = curve[rows].sum() if curve is not None else len(rows)
        return gradient[rows].sum() / under if under > 1e-150 else 0.0

    def grow(node, rows, depth):
        values[node] = value(rows)
        best = (1e-12 * max(1.0, abs(gradient[rows].sum())), None, None)
        if depth == settings.depth:
            return
        for f in range(len(bins)):
            for cut in range(settings.bins):
                right = bins[f, rows] > cut
                n_l, n_r = int((~right).sum()), int(right.sum())
                if min(n_l, n_r) < max(1, settings.min_leaf):
                    continue
                gap = gradient[rows][~right].mean() - gradient[rows][right].mean()
                gain = n_l * n_r / len(rows) * gap * gap
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, f, cut)
        if best[1] is not None:
            splits[node] = best
            right = bins[best[1], rows] > best[2]
            grow(2 * node + 1, rows[~right], depth + 1)
            grow(2 * node + 2, rows[right], depth + 1)

    grow(0, np.flatnonzero(sampled), 0)
    return splits, values


def plain_margin(bins, splits, values):
    out = np.zeros(bins.shape[1])
    for i in range(bins.shape[1]):
        node = 0
        while node in splits:
            node = 2 * node + 1 + int(bins[splits[node][1], i] > splits[node][2])
        out[i] = values[node]
    return out


def data_of(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n), np.zeros(n), rng.random(n) * 10], axis=1)
    y = 3 * x[:, 0] + (x[:, 1] == 2) * 5 - np.sin(x[:, 3]) + rng.normal(size=n) * 0.3
    return x, y, rng.integers(0, 3, n)


def table_of(spark, x, y, fold):
    rows = [(*map(float, r), float(t), int(f)) for r, t, f in zip(x, y, fold, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int")


@pytest.mark.parametrize("logistic", [False, True])
def test_fits_equal_plain_growth(spark, logistic):
    x, y, fold = data_of()
    y = (y > 1).astype(float) if logistic else y
    settings = B.Settings(trees=4, depth=3, subsample=1.0, min_leaf=5, bins=16, logistic=logistic)
    fits = B.fit_folds(table_of(spark, x, y, fold).repartition(5), list("abcd"), "y", "fold", 3, settings)
    for m, fit in enumerate(fits):
        bins, kept = fit.binned(x), fold != m
        mean = y[kept].mean()
        margin = np.full(len(y), np.log(mean / (1 - mean)) if logistic else mean)
        gains = np.zeros(4)
        for tree in fit.trees:
            p = 1 / (1 + np.exp(-margin))
            gradient, curve = (y - p, p * (1 - p)) if logistic else (y - margin, None)
            splits, values = plain_tree(bins, gradient, curve, settings, kept)
            assert {k: (f, c) for k, (_, f, c) in splits.items()} == {int(k): (tree.feature[k], tree.cut[k]) for k in np.flatnonzero(tree.feature >= 0)}
            margin = margin + settings.rate * plain_margin(bins, splits, values)
            own = np.zeros(4)
            for g, f, _ in splits.values():
                own[f] += g
            gains += own / own.sum()
        assert np.allclose(fit.margins(x), margin)
        assert np.allclose(fit.importances(), gains / gains.sum()) and fit.importances()[2] == 0


def test_a_share_of_the_rows_grows_each_tree(spark):
    x, y, fold = data_of(3000)
    rows = table_of(spark, x, y, fold)
    one, two = (B.fit_folds(rows, list("abcd"), "y", "fold", 0, B.Settings(trees=3, depth=2, subsample=0.5, seed=s))[0] for s in (1, 2))
    assert not np.allclose(one.margins(x), two.margins(x))
    assert np.corrcoef(one.margins(x), two.margins(x))[0, 1] > 0.97


def test_stored_and_cached_states_agree(spark, monkeypatch):
    x, y, fold = data_of(500)
    rows, settings = table_of(spark, x, y, fold).coalesce(1), B.Settings(trees=5, depth=2)
    want = B.fit_folds(rows, list("abcd"), "y", "fold", 3, settings)
    monkeypatch.setattr(B, "STORE", 2)
    got = B.fit_folds(rows, list("abcd"), "y", "fold", 3, settings)
    assert all(np.allclose(a.margins(x), b.margins(x)) for a, b in zip(got, want, strict=True))


def test_predictions_name_their_model(spark):
    x, y, fold = data_of(200)
    rows = table_of(spark, x, y, fold)
    fits = B.fit_folds(rows, list("abcd"), "y", "fold", 3, B.Settings(trees=2, depth=2))
    got = B.predict(rows, list("abcd"), fits, "fold").toPandas()
    for m in range(3):
        own = got[got.fold == m]
        assert np.allclose(own.prediction, fits[m].margins(own[list("abcd")].to_numpy()))
    assert B.predict(rows.where("y is null"), list("abcd"), fits, "fold").count() == 0


def test_tables_without_rows_or_spread(spark):
    empty = table_of(spark, *(v[:0] for v in data_of()))
    fits = B.fit_folds(empty, list("abcd"), "y", "fold", 2, B.Settings(trees=2, depth=2, subsample=1.0))
    assert [f.margins(np.zeros((1, 4)))[0] for f in fits] == [0, 0, 0]
    x, y, fold = data_of(50)
    flat = B.fit_folds(table_of(spark, x * 0, y, fold * 0), list("abcd"), "y", "fold", 2, B.Settings(trees=2, depth=2, subsample=1.0))
    assert flat[0].base == 0 and flat[2].margins(x * 0)[0] == pytest.approx(y.mean()) and flat[2].importances().sum() == 0


def test_held_out_error_is_that_of_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x, y, _ = data_of(3000, seed=8)
    fold = (np.arange(3000) % 4 == 0).astype(int)
    rows = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(table_of(spark, x, y, 1 - fold)).repartition(4).persist()
    model = GBTRegressor(featuresCol="features", labelCol="y", maxIter=40, maxDepth=4, stepSize=0.2, maxBins=64, seed=1).fit(rows.where("fold = 1"))
    theirs = model.transform(rows.where("fold = 0")).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    fit = B.fit_folds(rows, list("abcd"), "y", "fold", 1, B.Settings(trees=40, depth=4, rate=0.2, subsample=1.0))[0]
    held = fold == 1
    ours = float(np.sqrt(np.mean((fit.margins(x[held]) - y[held]) ** 2)))
    rows.unpersist()
    assert ours <= 1.01 * theirs


def test_equal_rows_are_one_cell_and_blocks_add_up(spark, monkeypatch):
    x, y, fold = data_of(60)
    x, y, fold = np.tile(x, (30, 1)), np.concatenate([y + k % 3 for k in range(30)]), np.tile(fold, 30)
    rows, settings = table_of(spark, x, y, fold), B.Settings(trees=3, depth=3, subsample=1.0, bins=16)
    want = B.fit_folds(rows, list("abcd"), "y", "fold", 3, settings)
    packed = B._blocks(rows, list("abcd"), "y", "fold", want[0].cuts, 1).first()
    assert len(packed["target"]) == 8 * 1800 and len(packed["bins"]) == 4 * len(np.unique(want[0].binned(x), axis=1).T)
    monkeypatch.setattr(B, "SMALL", 300)
    monkeypatch.setattr(B, "BLOCK", 200)
    got = B.fit_folds(rows, list("abcd"), "y", "fold", 3, settings)
    assert all(np.allclose(a.margins(x), b.margins(x)) for a, b in zip(got, want, strict=True))
    drawn = B.fit_folds(rows, list("abcd"), "y", "fold", 3, B.Settings(trees=3, depth=3, subsample=0.8, bins=16))
    assert np.corrcoef(drawn[3].margins(x), want[3].margins(x))[0, 1] > 0.99


def test_the_driver_sees_trees_only(spark, monkeypatch):
    import pickle

    from pyspark import RDD

    seen, plain = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: (seen.append(found := plain(rdd)), found)[1])
    x, y, fold = data_of(2000)
    B.fit_folds(table_of(spark, x, y, fold).repartition(8), list("abcd"), "y", "fold", 3, B.Settings(trees=2, depth=5))
    assert sum(len(pickle.dumps(found)) for found in seen) < 200_000
