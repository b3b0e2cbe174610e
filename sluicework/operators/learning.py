"""Model operators: scaling, clustering sweeps, boosting, ridge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.functions import constants as K
from sluicework.functions.scalar import half_even
from sluicework.operators import boosting as B
from sluicework.operators import clustering as C
from sluicework.operators.skew import rank_rows
from sluicework.session import cut_lineage

FEATURES = "features"


def scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL as 0, then z-scores by population deviation; constant columns become 0.

    The means and deviations come from one aggregate: two numbers per column.
    """
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    stats = filled.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"d_{c}") for c in columns]
    ).first()
    scaled = {}
    for c in columns:
        mean, spread = stats[f"m_{c}"], stats[f"d_{c}"]
        scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(spread) if spread else F.lit(0.0)
    return filled.withColumns(scaled)


def style_columns(columns: Sequence[str], words: Sequence[str] = K.RECORD_WORDS) -> list[str]:
    """Columns whose name holds none of the record words."""
    return [c for c in columns if not any(w in c.lower() for w in words)]


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES).transform(df)


def kmeans_sweep(df: DataFrame, columns: Sequence[str], ks: Sequence[int], starts: int = 10, seed: int = 42):
    """(model, sweep rows): per k the cheapest of ``starts`` fits, best silhouette wins.

    The silhouette is the squared-distance form, linear in the rows; the pairwise form
    would compare all rows with all rows. All fits move together, see
    :mod:`sluicework.operators.clustering`.
    """
    found = C.sweep(df, columns, list(ks), starts, seed)
    rows = [(k, round(silhouette, 4), round(cost, 2)) for k, _, silhouette, cost in found]
    best = max(found, key=lambda f: f[2])
    return best[1], df.sparkSession.createDataFrame(rows, "k int, silhouette double, inertia double")


def assign_clusters(df: DataFrame, model, columns: Sequence[str]) -> DataFrame:
    """Append cluster_id and impact_score = 1 / (1 + distance to the own centre)."""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = assemble(df, columns).withColumn("__point", vector_to_array(FEATURES))
    near = placed.withColumn("__gaps", F.transform(centres, lambda c: squared_gap(F.col("__point"), c)))
    labelled = near.withColumn("cluster_id", (F.array_position("__gaps", F.array_min("__gaps")) - 1).cast("int"))
    own = F.element_at(centres, F.col("cluster_id") + 1)
    return labelled.withColumn("impact_score", impact_score(F.col("__point"), own)).drop(FEATURES, "__point", "__gaps")


def squared_gap(point, centre):
    gaps = F.zip_with(point, centre, lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def impact_score(point, centre):
    distance = F.sqrt(squared_gap(point, centre))
    return half_even(F.lit(1.0) / (F.lit(1.0) + distance), 4)


def fold_numbers(df: DataFrame, key: Sequence[str], folds: int = 5, blocks: bool = False) -> DataFrame:
    """Append ``fold``: by a digest of the key as text, or as consecutive blocks of the key order."""
    if not blocks:
        digest = F.substring(F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in key])), 1, 8)
        return df.withColumn("fold", (F.conv(digest, 16, 10).cast("long") % folds).cast("int"))
    ranked = rank_rows(df, [F.asc(k) for k in key], "__rank")
    total = df.agg(F.count("*").alias("n")).scalar()
    return ranked.withColumn("fold", F.floor((F.col("__rank") - 1) * folds / total).cast("int")).drop("__rank")


def _inputs(df: DataFrame, columns: Sequence[str], target: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the model columns and the target as doubles, null as 0, under names of their own."""
    names = [f"__x{k}" for k in range(len(columns))]
    cells = {n: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for n, c in zip(names, columns, strict=True)}
    return df.withColumns({**cells, "__y": F.coalesce(F.col(target).cast("double"), F.lit(0.0))}), names


def boost_out_of_fold(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    target: str,
    folds: int = 5,
    blocks: bool = False,
    trees: int = 200,
    depth: int = 5,
    rate: float = 0.1,
    subsample: float = 0.8,
    min_leaf: int = 1,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(rows with fold, prediction and residual, ranked importances).

    Each row is predicted by the model of the folds it is not in. residual = prediction
    minus actual. Importances come from a fit on all rows. All models grow together, see
    :mod:`sluicework.operators.boosting`. ``df`` is worked out twice, for the fits and for the rows:
    store it before if that costs much.
    """
    filled, names = _inputs(df, columns, target)
    folded = fold_numbers(filled, key, folds, blocks)
    # Only what the fits read several times is stored; the returned rows are worked out from df again.
    data = cut_lineage(folded.select(*names, "__y", "fold"))
    settings = B.Settings(trees, depth, rate, subsample, min_leaf, seed=seed)
    fits = B.fit_folds(data, names, "__y", "fold", folds, settings)
    rows = B.predict(folded, names, fits, "fold").withColumns(
        {
            "residual": half_even(F.col("prediction") - F.col("__y"), 4),
            "prediction": half_even(F.col("prediction"), 4),
        }
    )
    return rows.drop(*names, "__y"), importance_table(df, columns, fits[-1].importances())


def importance_table(df: DataFrame, columns: Sequence[str], values, digits: int = 4) -> DataFrame:
    """feature_name, importance, rank: one row per model column."""
    ranked = sorted(zip(columns, [round(float(v), digits) for v in values]), key=lambda p: -p[1])
    rows = [(c, v, i) for i, (c, v) in enumerate(ranked, start=1)]
    return df.sparkSession.createDataFrame(rows, "feature_name string, importance double, rank long")


def fold_metrics(rows: DataFrame, target: str, predicted: str = "prediction") -> DataFrame:
    """Cross-validation quality as one row of named metrics."""
    y, p = F.col(target).cast("double"), F.col(predicted)
    folds = rows.groupBy("fold").agg(
        (F.lit(1.0) - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count("*"))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
    )
    pooled = rows.agg(
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
        F.avg("residual").alias("residual_mean"),
        F.stddev_pop("residual").alias("residual_std"),
        F.min("residual").alias("residual_min"),
        F.max("residual").alias("residual_max"),
        F.count("*").alias("total"),
    )
    quality = folds.agg(F.avg("r2").alias("r2"), F.avg("mae").alias("mae"), F.stddev_pop("r2").alias("cv_r2_std"))
    one = pooled.select(F.struct("*")).scalar()
    out = quality.withColumns({c: one[c] for c in pooled.columns})
    return out.select("total", *[half_even(F.col(c), 4).alias(c) for c in out.columns if c != "total"])


def metrics_long(metrics: DataFrame) -> DataFrame:
    """A one-row metric table as (metric_name, metric_value) rows."""
    cells = [F.struct(F.lit(c).alias("metric_name"), F.col(c).cast("double").alias("metric_value")) for c in metrics.columns]
    return metrics.select(F.inline(F.array(*cells)))


def boost_classifier(df: DataFrame, columns: Sequence[str], label: str, trees: int = 200, depth: int = 4, rate: float = 0.1, seed: int = 42):
    """(ranked importances, training accuracy) of a two-class boosted model."""
    filled, names = _inputs(df, columns, label)
    data = cut_lineage(filled.select(*names, "__y", F.lit(0).alias("__model")))
    settings = B.Settings(trees, depth, rate, subsample=1.0, logistic=True, seed=seed)
    fits = B.fit_folds(data, names, "__y", "__model", 0, settings)
    hit = F.avg(((F.col("prediction") > 0).cast("double") == F.col("__y")).cast("double"))
    accuracy = B.predict(data, names, fits, "__model").agg(hit.alias("a")).first()["a"]
    return importance_table(df, columns, fits[0].importances(), 6), round(accuracy, 4)


def ridge_sweep(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    target: str,
    alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0),
    folds: int = 5,
) -> tuple[DataFrame, Mapping[str, float]]:
    """(feature_name, ridge_coefficient rows, {alpha, r2}): the alpha with the best mean
    held-out R² over key-hashed folds, refitted on all rows.

    One pass sums the products of the columns and the target in each fold; every fit and
    every score follows from these small matrices. The penalty is on the summed squared
    error, the intercept has none.
    """
    names = [*columns, "__y"]
    scaled = scale(df, columns).withColumn("__y", F.coalesce(F.col(target).cast("double"), F.lit(0.0)))
    data = fold_numbers(scaled, key, folds)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = data.groupBy("fold").agg(
        F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs],
    )
    moments = []
    for r in sorted(sums.collect(), key=lambda r: r["fold"]):  # one row per fold
        m = np.zeros((len(names) + 1, len(names) + 1))
        m[0, 0] = r["n"]
        m[0, 1:] = m[1:, 0] = [r[f"s{i}"] for i in range(len(names))]
        for i, j in pairs:
            m[i + 1, j + 1] = m[j + 1, i + 1] = r[f"p{i}_{j}"]
        moments.append(m)
    if not moments:
        raise ValueError("no rows to fit")
    whole = sum(moments)
    scores = {a: float(np.mean([_r2(m, _ridge(whole - m, a)) for m in moments])) for a in alphas}
    alpha = max(alphas, key=lambda a: scores[a])
    weights = _ridge(whole, alpha)
    rows = [(c, round(float(w), 4)) for c, w in zip(columns, weights[1:])]
    table = df.sparkSession.createDataFrame(rows, "feature_name string, ridge_coefficient double")
    return table, {"ridge_alpha": alpha, "ridge_r2": round(_r2(whole, weights), 4)}


def _ridge(m: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and weights from the moments of (1, columns, target)."""
    n, means = m[0, 0], m[0] / m[0, 0]
    centred = m - n * np.outer(means, means)
    inner = centred[1:-1, 1:-1] + alpha * np.eye(len(m) - 2)
    weights = np.linalg.solve(inner, centred[1:-1, -1])
    return np.concatenate(([means[-1] - means[1:-1] @ weights], weights))


def _r2(m: np.ndarray, weights: np.ndarray) -> float:
    """R² of the weights on rows with these moments."""
    with_target = np.append(-weights, 1.0)
    spread = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    return 1.0 - float(with_target @ m @ with_target) / spread if spread > 0 else 0.0
