from __future__ import annotations

import numpy as np
import pytest

from sluicework.llm import passes as P
from sluicework.llm import topk as K
from sluicework.llm.queries import QUERIES

from .conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector int, component string"


@pytest.fixture(scope="module")
def vectors_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], SCHEMA).repartition(3)

    return make


def clusters(seed=0, groups=30, most=120, dims=16, noise=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for size in rng.integers(1, most, groups):
        centre = rng.normal(size=dims)
        rows += (centre + noise * np.linalg.norm(centre) / np.sqrt(dims) * rng.normal(size=(size, dims)) * rng.uniform(0.2, 12)).astype(np.float32).tolist()
    order = rng.permutation(len(rows))
    return [(int(i) * 3 + 1, rows[i]) for i in order]


def near(rows, least=0.9):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    return hit


def test_links_against_brute_force(vectors_of):
    rows = clusters() + [(10_001, clusters()[0][1]), (10_002, clusters()[0][1])]
    hit, ids = near(rows), np.array([i for i, _ in rows])
    got = {r.vec_id: r for r in P.near_duplicates(vectors_of(rows)).collect()}
    assert sorted(got) == sorted(ids.tolist())
    found = sum(got[i].n_links for i in ids.tolist())
    assert 0.95 * hit.sum() <= found <= hit.sum()
    for k, i in enumerate(ids.tolist()):
        assert got[i].n_links <= hit[k].sum() and got[i].kept == (got[i].component_id == i)
    whole = np.arange(len(ids))
    while True:
        then = np.minimum(whole, np.where(hit, whole[None, :], len(ids)).min(axis=1))
        if (then == whole).all():
            break
        whole = then
    tops = {k: ids[whole == k].min() for k in set(whole.tolist())}
    assert np.mean([got[i].component_id == tops[w] for i, w in zip(ids.tolist(), whole.tolist(), strict=True)]) >= 0.95


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    hit = near(rows)
    got = {r.vec_id: r.n_links for r in QUERIES["op6_projection_passes"](spark, SMALL).collect()}
    assert len(got) == len(rows) and 0.9 * hit.sum() <= sum(got.values()) <= hit.sum()


def test_a_group_larger_than_a_tile_is_counted_whole(vectors_of, monkeypatch):
    monkeypatch.setattr(P, "TILE", 16)
    rows = [(i, v) for i, (_, v) in enumerate(clusters(3, 2, 100, noise=0.01))]
    hit = near(rows)
    got = {r.vec_id: r.n_links for r in P.near_duplicates(vectors_of(rows)).collect()}
    assert got == {i: int(hit[i].sum()) for i, _ in rows}


def test_passes_keep_the_recall_of_isolated_pairs():
    """Planted pairs at a cosine just over the threshold among 200,000 vectors, with the keys of the passes."""
    rng = np.random.default_rng(0)
    x, k, c = rng.normal(size=(200_000, 64)), 500, 0.9001
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(k, 64))
    side -= (side * x[:k]).sum(axis=1, keepdims=True) * x[:k]
    x[k : 2 * k] = c * x[:k] + (1 - c * c) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    found = np.zeros(k, bool)
    for number in range(P.pass_count(len(x), 0.9, P.WINDOW)):
        directions, weights = P.directions_of(number, 64)
        place = np.argsort(np.argsort((x @ directions > 0) @ weights, kind="stable"))
        found |= np.abs(place[:k] - place[k : 2 * k]) <= P.WINDOW
    assert found.mean() >= 0.97


ODD = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [2.0, 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0]), (11, [0.0, 5.0])]


def test_vectors_that_cannot_be_compared(vectors_of):
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in P.near_duplicates(vectors_of(ODD)).collect()), key=str)
    want = [(1, 2, 1, True), (7, 2, 1, False), (11, 2, 1, False), (11, 0, 11, True), (None, 0, None, True)] + [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 8, 9)]
    assert got == sorted(want, key=str)
    assert P.near_duplicates(vectors_of([])).count() == 0


def plain_topk(rows, k=10, every=100):
    held = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows]
    out = []
    for q, a in held:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in held if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [100, 8192])
def test_topk_equals_brute_force(vectors_of, monkeypatch, shard_rows):
    monkeypatch.setattr(K, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(K, "QUERY_ROWS", 3)
    rows = [(i * 5, v) for i, (_, v) in enumerate(clusters(2, 12, 90))]
    rows += [(1_000_001 + j, rows[0][1]) for j in range(15)]
    assert sorted(tuple(r) for r in K.search(vectors_of(rows)).collect()) == plain_topk(rows)


def test_topk_with_odd_vectors(vectors_of):
    rows = [(100 * i if i else i, v) for i, v in ODD[:9]] + [(0, [1.0, 1.0])]
    kept = [(i, v) for i, v in rows if v and len(v) == 2 and all(c is not None and np.isfinite(c) for c in v)]
    assert sorted(tuple(r) for r in K.search(vectors_of(rows)).collect()) == plain_topk(kept)
    assert K.search(vectors_of([])).count() == 0
    huge = [(0, [3e30, 1.0]), (1, [2e30, 1.0]), (2, [-2e12, 1.0])]
    assert [(r.vec_id, r.score) for r in K.search(vectors_of(huge)).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_lists_stop_early_and_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 300, (4000, 8)).astype(int)
    x[:40] *= 12
    ids = rng.permutation(4000).astype(np.int64)
    lists = K.SortedLists(ids, x.astype(float))
    found = lists.search(ids[:5], x[:5].astype(float), 10)
    for q in range(5):
        want = sorted((-int(s), int(i)) for s, i in zip(x @ x[q], ids, strict=True) if i != ids[q])[:10]
        assert sorted((-s, i) for a, i, s in found if a == ids[q]) == want
