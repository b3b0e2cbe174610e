from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from sluicework.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(items, docs, k):
    held = [(d, plain_terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(t for _, ts in held for t in set(ts))
    rows = set()
    for item, text in items:
        found = []
        for doc, ts in held:
            if doc is None or not ts:
                continue
            tf, m, score = Counter(ts), 100 - 75 + (75 * len(ts) * n_docs) // total, 0
            for t in plain_terms(text):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, doc))
        rows |= {(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])}
    return rows


ODD_DOCS = [
    (1, None), (2, ""), (3, "... !!"), (None, "alpha beta gamma rareword"), (4, "Alpha beta İstanbul istanbul ÉCLAIR éclair 🙂x"), (5, "x" * 5000 + " alpha"),
    (6, "alpha " * 30_000 + "beta"), (7, "alpha beta"), (8, "alpha beta"), (8, "alpha beta"), (9, "alpha-beta_gamma\x00delta\x85eta theta"), (-3, "alpha beta"),
]
ODD_ITEMS = [(1, "Alpha beta beta"), (2, None), (3, ""), (4, "nowhere nothing"), (5, "éclair 🙂x delta ISTANBUL"), (1, "Alpha beta beta"), (None, "alpha"), (6, "rareword " * 500)]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "item_id long, text string, score long, rank double")


def test_odd_rows(spark, docs_of):
    got = rows_of(L.search(items_of(spark, ODD_ITEMS), docs_of(ODD_DOCS), 4))
    want = plain_search([i for k, i in enumerate(ODD_ITEMS) if k not in (5, 6)], ODD_DOCS, 4)
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize(("block_items", "block_terms"), [(1024, 1 << 16), (15, 1 << 16), (1024, 60)])
def test_equals_brute_force_in_any_blocks(spark, small_docs, block_items, block_terms):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = rows_of(L.search(items, small_docs, 10, block_items=block_items, block_terms=block_terms))
    want = plain_search([tuple(r) for r in items.select("item_id", "text").collect()], [(r.doc_id, r.text) for r in small_docs.collect()], 10)
    assert set(got) == want and len(got) == len(want)


def test_an_id_with_two_texts_is_one_item(spark, docs_of):
    got = set(rows_of(L.search(items_of(spark, [(1, "alpha"), (1, "beta")]), docs_of(ODD_DOCS))))
    assert got == plain_search([(1, "alpha beta")], ODD_DOCS, 10)


def test_empty_tables(spark, docs_of):
    assert L.search(items_of(spark, []), docs_of(ODD_DOCS)).count() == 0
    assert L.search(items_of(spark, ODD_ITEMS), docs_of([])).count() == 0
    assert L.search(items_of(spark, ODD_ITEMS), docs_of([(None, "alpha"), (1, "")])).count() == 0


def test_candidates_lose_nothing_and_prune():
    rng = np.random.default_rng(7)
    size, pruned = 60, 0
    found, impacts, norms = [], [], []
    for _ in range(300):
        at = np.sort(rng.choice(size, rng.integers(1, 30), replace=False)).astype(np.int32)
        values = rng.integers(1, 10 ** rng.integers(1, 6), len(at)).astype(np.int32)
        found.append(at.tobytes())
        impacts.append(values.tobytes())
        norms.append(float(np.sqrt(np.square(values.astype(float)).sum())))
    bucket = L.Bucket(np.arange(300), found, impacts, np.array(norms), size)
    for _ in range(200):
        at = np.sort(rng.choice(size, rng.integers(1, 12), replace=False))
        values = rng.integers(1, 3000, len(at))
        dense = np.zeros(size, np.int64)
        dense[at] = values
        exact = bucket.scores(np.arange(300), dense)
        for least in (1, int(np.sort(exact)[-10]) or 1, int(exact.max()), int(exact.max()) + 1):
            rows = set(bucket.candidates(at, values, least).tolist())
            assert set(np.flatnonzero(exact >= least).tolist()) <= rows
            pruned += 300 - len(rows)
    assert pruned > 0.5 * 300 * 800
