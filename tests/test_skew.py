"""Ordered columns against plain Python, also when one key owns most rows and for doubles with NULLs."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicework.operators import skew
from sluicework.operators.skew import Ordered, exact_quantiles, ordered_columns, rank_rows

SPECS = [
    Ordered("lag", "prev", "v"),
    Ordered("trailing", "last5", "v", 5),
    Ordered("trailing", "last2", "w", 2),
    Ordered("running", "before", "v"),
    Ordered("running", "before_w", "w"),
    Ordered("cumulative", "total", "v"),
    Ordered("cumulative", "total_w", "w"),
    Ordered("position", "nth"),
]


def made(seed, n):
    rng = np.random.default_rng(seed)
    return [
        (
            None if i % 97 == 0 else ("hot" if i % 3 else f"k{i % 40}"), i, int(rng.integers(0, 9)),
            None if i % 4 == 0 or i % 40 == 3 else round(float(rng.normal(0, 1000)), 6),
        )
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def rows():
    return made(1, 900)


@pytest.fixture(scope="module")
def hot(spark, rows):
    """One key with most of the rows, some small keys, keys without a value, and NULLs."""
    return spark.createDataFrame(rows, "k string, i int, v int, w double").repartition(5)


def plain(rows):
    """The columns of SPECS, sums as fractions of the decimals that the numbers stand for."""
    out, groups = [], {}
    for k, i, v, w in sorted(rows, key=lambda r: r[1]):
        seen = groups.setdefault(k, [])
        vs, ws = [s[0] for s in seen], [s[1] for s in seen]

        def mean(xs):
            xs = [Fraction(repr(x)) if isinstance(x, float) else Fraction(x) for x in xs if x is not None]
            return float(sum(xs)) / len(xs) if xs else None

        def upto(xs, x):
            xs = [Fraction(repr(y)) if isinstance(y, float) else y for y in [*xs, x] if y is not None]
            return sum(xs) if xs else None

        total_w = upto(ws, w)
        recent = [x for x in ws[-2:] if x is not None]
        out.append((k, i, v, w, vs[-1] if vs else None, mean(vs[-5:]), sum(recent, 0.0) / len(recent) if recent else None, mean(vs), mean(ws), upto(vs, v), None if total_w is None else float(total_w), len(seen) + 1))
        seen.append((v, w))
    return sorted(out, key=str)


def test_ordered_columns_equal_plain_python_exactly(hot, rows):
    got = ordered_columns(hot, ["k"], [F.col("i")], SPECS)
    assert got.columns == ["k", "i", "v", "w", *[s.out for s in SPECS]]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_result_does_not_depend_on_where_slices_are_cut(spark, hot):
    def run(parts):
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            return sorted((tuple(r) for r in ordered_columns(hot, ["k"], [F.col("i")], SPECS).collect()), key=str)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)

    assert run("2") == run("23")


def test_slices_follow_the_rows_and_borrow_what_comes_before(spark, hot, rows, monkeypatch):
    """Slices of fewer rows than the window reaches back; nothing is gathered into arrays row by row."""
    monkeypatch.setattr(skew, "SLICE_ROWS", 3)
    sliced, parts = skew.slice_by_order(hot, ["k"], [F.col("i")])
    assert parts == 300 and sliced.select(skew.SLICE).distinct().count() > 200
    specs = [s for s in SPECS if s.kind in ("lag", "trailing")]
    got = ordered_columns(hot, ["k"], [F.col("i")], specs)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = sorted((r[:7] for r in plain(rows)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_global_rank(hot, rows):
    got = rank_rows(hot, [F.desc("v"), F.asc("i")]).collect()
    assert [r.i for r in sorted(got, key=lambda r: r["rank"])] == [r[1] for r in sorted(rows, key=lambda r: (-r[2], r[1]))]
    assert sorted(r["rank"] for r in got) == list(range(1, 901))


def test_quantiles_against_numpy_and_groups_without_values(hot, rows):
    got = {(r.k, r.feature): r for r in exact_quantiles(hot, ["v", "w"], [0.25, 0.5, 0.75, 0.05], ["k"]).collect()}
    keys = {r[0] for r in rows}
    assert set(got) == {(k, c) for k in keys for c in "vw"}
    empty = 0
    for (k, c), r in got.items():
        values = [x["vw".index(c) + 2] for x in rows if x[0] == k and x["vw".index(c) + 2] is not None]
        if values:
            assert np.allclose([r[f"q{i}"] for i in range(4)], np.quantile(values, [0.25, 0.5, 0.75, 0.05]))
        else:
            empty += 1
            assert [r[f"q{i}"] for i in range(4)] == [None] * 4
    assert empty


def test_quantiles_of_the_whole_table(hot, rows):
    got = {r.feature: r.q0 for r in exact_quantiles(hot, ["v", "w"], [0.3]).collect()}
    assert np.isclose(got["w"], np.quantile([r[3] for r in rows if r[3] is not None], 0.3)) and np.isclose(got["v"], np.quantile([r[2] for r in rows], 0.3))
