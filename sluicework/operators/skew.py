"""Ordered computations that stay correct and parallel when one key owns most rows.

A window ``PARTITION BY key ORDER BY t`` sends every row of a key to one task. Here rows are
range-partitioned by (key, order), every piece gets a slice number, windows run inside the
slices and the few rows before them, and what the earlier slices of the same key add up to is joined in. It is done this
way at every size. Sums are exact (whole numbers, or decimals of twelve places), so they do
not depend on where the slices are cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework.session import cut_lineage

SLICE = "__slice"
PLACE = "__place"
SLICE_ROWS = 500_000  # rows of a slice, as tables grow
_WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Ordered:
    """One ordered output column.

    kind: ``lag`` (previous value), ``trailing`` (mean of the ``rows`` rows before),
    ``running`` (mean of all rows before), ``cumulative`` (sum up to and including the
    row) or ``position`` (1-based row number).
    """

    kind: str
    out: str
    source: str | None = None
    rows: int = 0


def slice_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, int]:
    """Range-partition by (keys, order), store each row's slice number and its place, and count the slices.

    Slice numbers follow the order, so for one key all rows of a lower slice precede
    those of a higher slice. Ranges are drawn over keys and order together, so a hot key
    is cut into many slices. Inside a slice the rows of a key have places in a row, in order.
    The input is stored first, because finding the ranges reads it
    too; storing the ranges pins the numbers for every later use.
    """
    stored = cut_lineage(df)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored.count() // SLICE_ROWS, 2)
    by = [*[F.col(k) for k in keys], *order]
    ranged = stored.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return cut_lineage(ranged.withColumns({SLICE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()})), parts


def exact(df: DataFrame, column: str) -> Column:
    """A column as a number whose sums do not depend on the order of addition."""
    kind = dict(df.dtypes)[column]
    if kind in _WHOLE:
        return F.col(column).cast("long")
    return F.col(column).cast("decimal(38,12)")


def _attach(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, NULL keys matching NULL keys."""
    renamed = right.withColumnsRenamed({n: f"__r{i}" for i, n in enumerate(names)})
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & F.col(n).eqNullSafe(F.col(f"__r{i}"))
    return left.join(renamed, same, how).drop(*[f"__r{i}" for i in range(len(names))])


def ordered_columns(df: DataFrame, keys: Sequence[str], order: Sequence[Column], specs: Sequence[Ordered]) -> DataFrame:
    """Append the ordered columns; ``order`` must place the rows of a key uniquely.

    A slice borrows the last few rows of the key before it, so that lags and trailing means are
    plain windows; borrowed rows are dropped again and count in no sum.
    """
    keys, order, specs = list(keys), list(order), list(specs)
    sliced, parts = slice_by_order(df, keys, order)
    group = [*keys, SLICE]
    reach = max([1 if s.kind == "lag" else s.rows for s in specs if s.kind in ("lag", "trailing")], default=0)
    recent = sorted({s.source for s in specs if s.kind in ("lag", "trailing")})
    totals = sorted({s.source for s in specs if s.kind in ("running", "cumulative")})

    # One row per (key, slice): first place, size and sums, stored so that its size is known to the joins.
    facts = [F.count("*").alias("__n"), F.min(PLACE).alias("__first")]
    for i, c in enumerate(totals):
        facts += [F.sum(exact(df, c)).alias(f"__s{i}"), F.count(c).alias(f"__c{i}")]
    slices = cut_lineage(sliced.groupBy(*group).agg(*facts))

    # What all earlier slices of the key add up to: at most one row per slice and key.
    along = Window.partitionBy(*keys).orderBy(SLICE) if keys else Window.orderBy(SLICE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"__first": F.col("__first"), "__n0": F.coalesce(F.sum("__n").over(earlier), F.lit(0))}
    for i, _ in enumerate(totals):
        carry[f"__s0{i}"] = F.sum(f"__s{i}").over(earlier)
        carry[f"__c0{i}"] = F.coalesce(F.sum(f"__c{i}").over(earlier), F.lit(0))
    carried = slices.select(*group, *[c.alias(n) for n, c in carry.items()])

    rows = sliced.withColumn("__own", F.lit(True))
    if reach:
        rows = rows.unionByName(_borrowed(sliced, slices, keys, reach, recent), allowMissingColumns=True)
    local = Window.partitionBy(*group).orderBy(PLACE)
    here = local.rowsBetween(Window.unboundedPreceding, -1)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    own = {c: F.when(F.col("__own"), exact(df, c)) for c in totals}
    made = {}
    for s in specs:
        if s.kind == "lag":
            made[s.out] = F.lag(s.source).over(local)
        elif s.kind == "trailing":
            made[s.out] = F.avg(F.col(s.source).cast("double")).over(local.rowsBetween(-s.rows, -1))
        elif s.kind in ("running", "cumulative"):
            span = here if s.kind == "running" else upto
            made[f"__sum_{s.out}"] = F.sum(own[s.source]).over(span)
            made[f"__rows_{s.out}"] = F.count(own[s.source]).over(span)
        elif s.kind != "position":
            raise ValueError(f"unknown ordered column kind {s.kind!r}")
    if made:
        rows = rows.repartition(parts, *group).withColumns(made).where("__own")
    if all(s.kind in ("lag", "trailing") for s in specs):
        return rows.select(*df.columns, *[s.out for s in specs])

    joined = _attach(rows, carried, group)
    added = {}
    for s in specs:
        if s.kind == "position":
            added[s.out] = (F.col(PLACE) - F.col("__first") + 1 + F.col("__n0")).cast("long")
        elif s.kind in ("running", "cumulative"):
            i = totals.index(s.source)
            total = F.coalesce(F.col(f"__sum_{s.out}"), F.lit(0)) + F.coalesce(F.col(f"__s0{i}"), F.lit(0))
            n = F.col(f"__rows_{s.out}") + F.col(f"__c0{i}")
            if s.kind == "running":
                added[s.out] = F.when(n > 0, total.cast("double") / n)
            else:
                added[s.out] = F.when(n > 0, total if dict(df.dtypes)[s.source] in _WHOLE else total.cast("double"))
    return joined.withColumns(added).select(*df.columns, *[s.out for s in specs])


def _borrowed(sliced: DataFrame, slices: DataFrame, keys: Sequence[str], reach: int, columns: Sequence[str]) -> DataFrame:
    """The ``reach`` rows before each (key, slice) of the same key, as rows of that slice with ``__own`` false.

    The slice before may hold fewer than ``reach`` rows of the key, so up to ``reach`` slices back are asked.
    """
    along = Window.partitionBy(*keys).orderBy(SLICE) if keys else Window.orderBy(SLICE)
    held = slices.select(*keys, SLICE, "__first", "__n")
    asked = F.filter(
        F.array(*[
            F.struct(
                F.lead(SLICE, i).over(along).alias("__to"),
                # Rows of the key between this slice and the one that asks.
                F.coalesce(F.sum("__n").over(along.rowsBetween(1, i - 1)) if i > 1 else F.lit(0), F.lit(0)).alias("__between"),
            )
            for i in range(1, reach + 1)
        ]),
        lambda a: a["__to"].isNotNull() & (a["__between"] < reach),
    )
    ends = held.withColumn("__asked", asked).where(F.size("__asked") > 0)
    named = [*keys, SLICE]
    lent = _attach(sliced.select(*named, PLACE, *[c for c in columns if c not in keys]), ends, named, "inner")
    from_end = F.col("__first") + F.col("__n") - F.col(PLACE)
    near = lent.where(from_end <= reach).withColumn("__to", F.explode(F.filter("__asked", lambda a: a["__between"] + from_end <= reach)))
    return near.select(*keys, F.col("__to")["__to"].alias(SLICE), PLACE, *[c for c in columns if c not in keys], F.lit(False).alias("__own"))


def rank_rows(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1..n over the whole table; ``order`` must end in a unique key."""
    return ordered_columns(df, [], order, [Ordered("position", out)])


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles, NULLs left out: one row per (keys, feature).

    Output columns: keys, ``feature`` and ``q0``, ``q1``, … in the order asked for; a group
    without a value has NULLs. Different values are counted first, then placed in slices, so
    that no task holds the values of a group.
    """
    keys = list(keys)
    long = df.select(
        *keys,
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("__v")) for c in columns])),
    )
    group = [*keys, "feature"]
    counted = cut_lineage(long.groupBy(*group, "__v").agg(F.count("*").alias("__m")))
    sizes = counted.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__m"))), F.lit(0)).alias("__size"))
    placed = ordered_columns(counted.where(F.col("__v").isNotNull()), group, [F.col("__v")], [Ordered("cumulative", "__hi", "__m")])
    placed = _attach(placed, sizes, group)
    first, last = F.col("__hi") - F.col("__m"), F.col("__hi") - 1
    picks = []
    for i, p in enumerate(probabilities):
        spot = (F.col("__size") - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(spot)), ("up", F.ceil(spot))):
            picks.append(F.max(F.when((at >= first) & (at <= last), F.col("__v"))).alias(f"__{tag}{i}"))
    found = _attach(sizes, placed.groupBy(*group).agg(*picks), group)
    results = []
    for i, p in enumerate(probabilities):
        spot = (F.col("__size") - 1) * F.lit(float(p))
        share, low, up = spot - F.floor(spot), F.col(f"__lo{i}"), F.col(f"__up{i}")
        results.append(F.when(low == up, low).otherwise(low * (1 - share) + up * share).alias(f"q{i}"))
    return found.select(*group, *results)
