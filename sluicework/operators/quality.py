"""Data-quality gates: all checks of a table in one pass, violations as rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


@dataclass(frozen=True)
class QualityRules:
    min_rows: int = 50
    max_null_rate: float = 0.5
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    key: tuple[str, ...] = ()
    skip_variance: tuple[str, ...] = ()


def player_rules(min_rows: int = 50) -> QualityRules:
    return QualityRules(min_rows, 0.5, {"rating": (0, 10)}, ("player_id",), ("player_id", "position", "league"))


def team_rules(min_rows: int = 100, most: int = 17) -> QualityRules:
    ranges = {"wins": (0, most), "losses": (0, most), "win_loss_perc": (0, 1)}
    return QualityRules(min_rows, 0.5, ranges, ("year", "team"), ("year", "team"))


# Thresholds per packaged analysis.
PROFILES = {
    "player": player_rules(),
    "nfl_team": team_rules(),
    "f1_constructor": team_rules(50),
    "f1_driver": team_rules(1000),
    "f1_pitstop": team_rules(500),
    "nrl_team": team_rules(50, 30),
    "nrl_coaching": team_rules(50, 30),
    "nrl_match": team_rules(500),
}


def _text(value: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    """A column name quoted for SQL."""
    return "`" + column.replace("`", "``") + "`"


def _check(check: str, column: str | None, observed: str, threshold: float, violated: str) -> str:
    """One report row as an SQL struct; text keeps wide tables from costing thousands of calls."""
    name = "CAST(NULL AS STRING)" if column is None else _text(column)
    return (
        f"named_struct('check_name', '{check}', 'column_name', {name}, 'observed', {observed}, "
        f"'threshold', {float(threshold)}D, 'violated', coalesce({violated}, false))"
    )


def _measured(df: DataFrame, rules: QualityRules, columns: Sequence[str], numeric: Sequence[str], whole: bool) -> DataFrame:
    """The report rows of some columns, and those of the whole table, out of one aggregate."""
    checks = []
    if whole:
        rows = "CAST(count(*) AS DOUBLE)"
        checks.append(_check("min_rows", None, rows, rules.min_rows, f"{rows} < {rules.min_rows}"))
    for c in columns:
        rate = f"avg(CAST({_name(c)} IS NULL AS DOUBLE))"
        checks.append(_check("all_null", c, rate, 1.0, f"{rate} = 1"))
        checks.append(_check("null_rate", c, rate, rules.max_null_rate, f"{rate} > {rules.max_null_rate} AND {rate} < 1"))
    for c, (low, high) in rules.ranges.items():
        if c in columns:
            value = f"try_cast({_name(c)} AS DOUBLE)"
            out = f"CAST(count_if({value} < {low} OR {value} > {high}) AS DOUBLE)"
            checks.append(_check("range", c, out, 0.0, f"{out} > 0"))
    for c in numeric:
        if c in columns:
            spread = f"stddev_samp(CAST({_name(c)} AS DOUBLE))"
            checks.append(_check("zero_variance", c, spread, 0.0, f"{spread} = 0"))
    return df.agg(F.expr(f"array({', '.join(checks)})").alias("e")).select(F.inline("e"))


def dq_report(df: DataFrame, rules: QualityRules, at_once: int = 0) -> DataFrame:
    """One row per check: check, column_name, observed, threshold, violated.

    A single aggregate measures everything but key duplicates, which need one grouped
    count (combined map-side). ``at_once`` limits the columns of an aggregate, for tables that
    are stored: a wide one is compiled to a method that Java does not speed up.
    """
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in rules.skip_variance
    ]
    step = at_once or max(1, len(df.columns))
    report = _measured(df, rules, df.columns[:step], numeric, True)
    for k in range(step, len(df.columns), step):
        report = report.unionByName(_measured(df, rules, df.columns[k : k + step], numeric, False))
    if rules.key and set(rules.key) <= set(df.columns):
        copies = df.groupBy(*rules.key).agg((F.count("*") - 1).alias("extra"))
        total = "coalesce(CAST(sum(extra) AS DOUBLE), 0D)"
        entry = _check("duplicate_key", ",".join(rules.key), total, 0.0, f"{total} > 0")
        report = report.unionByName(copies.agg(F.expr(f"array({entry})").alias("e")).select(F.inline("e")))
    return report


def dq_assert(df: DataFrame, rules: QualityRules, at_once: int = 0) -> DataFrame:
    """Return ``df`` unchanged, or fail with every violation at once."""
    bad = dq_report(df, rules, at_once).where("violated").collect()  # a few rows per column
    if bad:
        lines = [f"{r['check_name']} {r['column_name'] or ''}: {r['observed']} (limit {r['threshold']})" for r in bad]
        raise ValueError("data validation failed:\n" + "\n".join(lines))
    return df


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]
