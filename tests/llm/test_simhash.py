from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluicework.llm import simhash as H
from sluicework.llm.graph import components
from sluicework.llm.queries import QUERIES

from .conftest import SMALL


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    parent = {i: i for i, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= 2:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in prints}


ODD = ["", None, " \n\t", "one", "one two", "One TWO three", "one two three", "Ärger ÄRGER one two", "a\x0bb\x0cc\x1cd\x85e f", "x y z " * 4000, "ß \x00 q"]


def test_fingerprint_equals_plain(small_docs):
    for text in ODD + [r.text for r in small_docs.limit(40).collect()]:
        assert H.fingerprint(H.shingles(text)) == plain_fingerprint(text)


def test_hash_is_that_of_the_engine(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_query_equals_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_simhash_near_dedup"](spark, SMALL).collect()}
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain_components(prints)
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{p:016x}", want[i]) for i, p in prints}


@pytest.mark.parametrize("spread", [2, 6, 30])
def test_tree_finds_what_brute_force_finds(spark, spread):
    draw = random.Random(spread)
    centres = [draw.getrandbits(64) for _ in range(40)]
    points = set()
    for _ in range(3000):
        x = draw.choice(centres)
        for _ in range(draw.randrange(spread)):
            x ^= 1 << draw.randrange(64)
        points.add(x)
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(sorted(points, key=lambda x: hash((x, 3))))]
    table = spark.createDataFrame([(x,) for _, x in signed], "fp long").repartition(5)
    for rows in (100, 100_000):
        found = {r.node: r.component for r in components(H.link_fingerprints(table, 2, shard_rows=rows)).collect()}
        values = np.array([x for _, x in signed], np.int64).view(np.uint64)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
        label = np.arange(len(values))
        while True:
            then = np.where(near, label[None, :], len(values)).min(axis=1)
            if (then == label).all():
                break
            label = then
        groups = {}
        for k, (_, x) in enumerate(signed):
            groups.setdefault(label[k], []).append(x)
        want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
        assert found == want


def test_routing_reaches_every_link():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    values = np.unique(np.concatenate((values, values ^ np.uint64(3), values ^ np.uint64(1 << 40))))
    tree = H.ShardTree(values[::3], 16, 2)
    met, homes = set(), 0
    shards = {}
    for shard, part, home in tree.route(values):
        shards.setdefault(shard, {})[home] = part
        homes += len(part) * home
    assert homes == len(values) and tree.shards > 4
    for s in shards.values():
        for a, b in np.argwhere(np.bitwise_count(s[True][:, None] ^ np.concatenate((s[True], s[False]))[None, :]) <= 2):
            met.add(frozenset((int(s[True][a]), int(np.concatenate((s[True], s[False]))[b]))))
    for a, b in np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2):
        assert frozenset((int(values[a]), int(values[b]))) in met


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(1000, 1300)]
    hub = [(5, i) for i in range(2000, 3000)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path + hub + [(7, 7), (5, 2000)], "a long, b long")).collect()}
    assert found == {i: 1000 for i in range(1000, 1301)} | {i: 5 for i in [5, *range(2000, 3000)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_keeps_one_of_each_group_and_all_columns(docs_of):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    docs = docs_of([(5, base), (3, base), (9, base.upper()), (1, "something else entirely is written in this text"), (1, "something else entirely is written in this text"), (2, None), (4, ""), (None, base)])
    kept = H.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, base), (1, "something else entirely is written in this text"), (2, None), (None, base)], key=str)
    assert H.deduplicate(docs_of([])).count() == 0
