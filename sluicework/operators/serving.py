"""Read functions over result tables: summaries, top lists and bundles as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from sluicework.operators.aggregates import anomaly_summary, cluster_averages, regression_quality
from sluicework.operators.joins import join_sources


def label_column(df: DataFrame, key: str, skip: Sequence[str] = ()) -> str | None:
    """First text column whose name holds ``name``, else the first text column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name != key and f.name not in skip]
    return next((c for c in texts if "name" in c), texts[0] if texts else None)


def _label(df: DataFrame, key: str, skip: Sequence[str]) -> tuple[Column, str | None]:
    name = label_column(df, key, skip)
    own = F.col(key).cast("string")
    return (F.coalesce(F.nullif(F.col(name), F.lit("")), own) if name else own), name


def _fields(df: DataFrame, skip: Sequence[str]) -> Column:
    """All remaining text and number columns as one name-to-text map without NULLs."""
    names = [
        f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, (StringType, NumericType))
    ]
    if not names:
        return F.create_map().cast("map<string,string>")
    entries = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names]))
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def clusters_view(
    output: DataFrame, sources: Mapping[str, DataFrame], key: str, cluster: str = "cluster_id",
    score: str = "impact_score", n: int = 10,
) -> dict[str, DataFrame]:
    """Cluster summary over all source numbers, and the ``n`` best records per cluster."""
    wide = join_sources(output.select(key, cluster, score), sources, key, "inner")
    own = [key, cluster, score]
    best = Window.partitionBy(cluster).orderBy(F.desc(score), key)
    label, name = _label(wide, key, own)
    top = wide.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
    records = top.select(
        F.col(cluster).alias("cluster_id"), F.col(key).cast("string").alias("record_id"), label.alias("label"),
        F.round(score, 4).alias("score"), "place", _fields(wide, [*own, name]).alias("fields"),
    )
    return {"clusters": cluster_averages(wide, cluster, [key, score]), "records": records}


def anomalies_view(output: DataFrame, sources: Mapping[str, DataFrame], key: str, n: int = 50) -> dict[str, DataFrame]:
    """Score summary and the ``n`` highest scores with their source fields.

    The top rows are cut out first, so the joins see ``n`` rows and not the table.
    """
    own = [key, "anomaly_score", "is_anomaly"]
    top = output.select(*own).orderBy(F.desc("anomaly_score"), key).limit(n)
    wide = join_sources(top, sources, key, "left")
    label, name = _label(wide, key, own)
    records = wide.select(
        F.col(key).cast("string").alias("record_id"), label.alias("label"),
        F.round("anomaly_score", 4).alias("anomaly_score"), (F.col("is_anomaly") == 1).alias("is_anomaly"),
        _fields(wide, [*own, name]).alias("fields"),
    )
    return {"summary": anomaly_summary(output), "records": records}


def predictions_view(
    output: DataFrame, sources: Mapping[str, DataFrame], key: str, predicted: str | None = None,
    actual: str | None = None, n: int = 50,
) -> dict[str, DataFrame]:
    """Fit quality and the ``n`` largest absolute residuals.

    ``predicted`` and ``actual`` default to the first columns with those prefixes.
    """
    predicted = predicted or next(c for c in output.columns if c.startswith("predicted_"))
    actual = actual or next(c for c in output.columns if c.startswith("actual_"))
    own = [key, predicted, actual, "residual"]
    top = top_absolute(output.select(*own), "residual", key, n)
    wide = join_sources(top, sources, key, "left")
    label, _ = _label(wide, key, own)
    position = [F.col("position")] if "position" in wide.columns else []
    records = wide.select(
        F.col(key).cast("string").alias("record_id"), label.alias("label"), *position,
        F.round(predicted, 4).alias("predicted"), F.round(actual, 4).alias("actual"),
        F.round("residual", 4).alias("residual"),
    )
    return {"summary": regression_quality(output, predicted, actual), "records": records}


def top_absolute(df: DataFrame, column: str, key: str, n: int = 50) -> DataFrame:
    return df.orderBy(F.desc(F.abs(column)), key).limit(n)


def over_and_under(predictions: DataFrame, key: str, n: int = 15) -> DataFrame:
    """The ``n`` largest residuals of either sign, named by sign, each side ranked."""
    side = F.when(F.col("residual") > 0, "positive").when(F.col("residual") < 0, "negative")
    ranked = predictions.withColumn("side", side).where(F.col("side").isNotNull())
    far = Window.partitionBy("side").orderBy(F.desc(F.abs("residual")), key)
    return ranked.withColumn("place", F.row_number().over(far)).where(F.col("place") <= n)


def profile_view(output: DataFrame, n: int = 200) -> dict[str, DataFrame]:
    """Column list and the first ``n`` rows by the first column, then the others."""
    kinds = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(output.schema.fields)]
    columns = output.sparkSession.createDataFrame(kinds, "ordinal int, name string, type string")
    return {"columns": columns, "records": output.orderBy(*output.columns).limit(n)}


def team_bundle(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The result sets of a team page, each in its order."""
    # Order of each result set, ``-`` for descending.
    orders = {
        "rankings": ["rank"],
        "seasons": ["-year", "-dominance_score", "-win_rate", "team"],
        "drivers": ["rank"],
        "profiles": ["team"],
        "rivalries": ["-total_matches", "team", "opponent"],
        "trends": ["team", "window_start"],
    }
    bundle = {}
    for name, table in tables.items():
        known = [o for o in orders[name] if o.lstrip("-") in table.columns]
        bundle[name] = table.orderBy(*[F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in known])
    return bundle
