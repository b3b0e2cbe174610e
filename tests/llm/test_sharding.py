from __future__ import annotations

import random

import pytest

from sluicework.llm import sharding as S


def plain(rows, shards):
    """(key, size) rows to (shard, slot, key) by the bytes before each, keys in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    total, before, slots, out = sum(r[1] or 0 for r in rows), 0, {}, []
    for key, size in rows:
        shard = min(shards - 1, shards * before // total) if total else 0
        out.append((shard, slots.setdefault(shard, 0), key))
        slots[shard] += 1
        before += size or 0
    return out


@pytest.mark.parametrize("rows_per_task", [1_000_000, 40])
def test_equals_plain(spark, rows_per_task):
    draw = random.Random(4)
    rows = [(k * 1000 - 7, draw.choice([1, 5, 300])) for k in range(3000)]
    table = spark.createDataFrame([(k, n, "a", 1) for k, n in rows], "doc_id long, size long, shard2 string, part int").repartition(6)
    got = S.shard_by_bytes(table, 24, rows_per_task=rows_per_task).collect()
    assert sorted((r.shard, r.slot, r.doc_id) for r in got) == sorted(plain(rows, 24))


def test_one_key_with_a_third_of_the_rows_is_cut(spark):
    rows = [(5, 10)] * 1000 + [(k, 10) for k in range(100, 2100)]
    table = spark.createDataFrame(rows, "doc_id long, size long").repartition(4)
    got = S.shard_by_bytes(table, 24).collect()
    assert sorted((r.shard, r.slot, r.doc_id) for r in got) == sorted(plain(rows, 24))


def test_nulls_negative_keys_and_few_rows(spark):
    rows = [(None, 3), (-9, None), (-(1 << 62), 8), ((1 << 63) - 1, 8), (None, 5)]
    got = S.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, size long"), 4).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((a, b) for a, b, _ in plain(rows, 4))


def test_empty_and_zero(spark):
    empty = S.shard_by_bytes(spark.createDataFrame([], "doc_id long, size long"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "shard", "slot"]
    got = S.shard_by_bytes(spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, size long")).collect()
    assert sorted(r.slot for r in got) == [0, 1] or len({r.shard for r in got}) == 2


def test_tolerance_bounds_the_difference(spark):
    draw = random.Random(8)
    rows = [(draw.randrange(1 << 40), draw.randrange(1, 500)) for _ in range(5000)]
    total = sum(n for _, n in rows)
    slack = total // 24 // 50
    got = S.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, size long"), 24, tolerance=slack).collect()
    held = {}
    for r in got:
        held[r.shard] = held.get(r.shard, 0) + r.size
    assert len(held) == 24 and max(held.values()) - min(held.values()) <= 2 * (500 + 2 * slack)


def test_clashing_names_are_replaced(spark):
    rows = [(i, 10, 99, "old", i * 2) for i in range(30)]
    got = S.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, size long, shard long, SLOT string, bytes long"), 3)
    assert got.columns == ["doc_id", "size", "bytes", "shard", "slot"]
    assert sorted((r.doc_id, r.bytes, r.shard, r.slot) for r in got.collect()) == [(i, i * 2, i // 10, i % 10) for i in range(30)]
    assert S.shard_by_bytes(got.where("doc_id < 0")).columns == got.columns


def test_text_sizes(spark, docs_of):
    got = {r.doc_id: r["size"] for r in S.map_sizes(docs_of([(1, "é"), (2, None), (3, ""), (4, "x" * 9000)])).collect()}
    assert got == {1: 10, 2: 8, 3: 8, 4: 9008}
