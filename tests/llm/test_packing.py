from __future__ import annotations

import itertools
import random

from sluicework.llm import packing as P


def test_buckets_equal_brute_force():
    draw = random.Random(0)
    for _ in range(300):
        held = {draw.randrange(1, 20): draw.randrange(1, 9) for _ in range(draw.randrange(1, 9))}
        k = draw.randrange(1, 5)

        def padding(ends, held=held):
            return sum(n * (min(e for e in ends if e >= length) - length) for length, n in held.items())

        best = min(padding(c) for m in range(1, min(k, len(held)) + 1) for c in itertools.combinations(sorted(held), m) if c[-1] == max(held))
        got = P.choose_buckets(held, k)
        assert padding(got) == best and len(got) == min(k, len(held)) and got == sorted(got)
    assert P.choose_buckets({}, 3) == [] and P.choose_buckets({4: 0}, 3) == []


def plain_pack(rows, most, buckets, budget):
    cut = []
    for doc, n in rows:
        n = max(0, n or 0)
        cut += [(doc, s, s * most, min(most, n - s * most)) for s in range(max(1, -(-n // most)))]
    held = {}
    for c in cut:
        if c[3]:
            held[c[3]] = held.get(c[3], 0) + 1
    ends, places, out = P.choose_buckets(held, buckets), {}, []
    for doc, s, start, n in sorted(cut, key=lambda c: (c[0] is not None, c[0] or 0, c[1])):
        if not n:
            out.append((doc, s, start, n, None, None, None, None))
            continue
        b = next(i for i, e in enumerate(ends) if e >= n)
        place = places.setdefault(b, 0)
        places[b] += 1
        rows_in = max(1, budget // ends[b])
        out.append((doc, s, start, n, b, ends[b], place // rows_in, place % rows_in))
    return out


def test_equals_plain(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([1, 7, 7, 7, draw.randrange(1, 300)])) for i in range(2000)] + [(3000, None), (3001, 0), (None, 5), (3002, 10_000)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, len long, bucket int, start string").repartition(5)
    got = [tuple(r) for r in P.pack(table, "len", 64, 5, 512).collect()]
    assert sorted(got, key=str) == sorted(plain_pack(rows, 64, 5, 512), key=str)


def test_no_token_is_lost_and_no_batch_exceeds_the_budget(spark):
    rows = [(i, 1 + i * 37 % 500) for i in range(500)] + [(7, 8)] * 400
    got = P.pack(spark.createDataFrame(rows, "doc_id long, len long"), "len", 100, 4, 1000).collect()
    assert sum(r.n_tokens for r in got) == sum(n for _, n in rows)
    used = {}
    for r in got:
        assert r.n_tokens <= r.bucket_tokens
        used[r.bucket, r.batch] = used.get((r.bucket, r.batch), 0) + r.bucket_tokens
    assert max(used.values()) <= 1000


def test_empty_table_and_words(spark, docs_of):
    assert P.pack(spark.createDataFrame([], "doc_id long, len long"), "len").count() == 0
    docs = docs_of([(1, "a b c"), (2, None), (3, ""), (4, " \n a "), (5, "w " * 9000)])
    got = {r.doc_id: r.n for r in docs.select("doc_id", P.word_tokens().alias("n")).collect()}
    assert got == {1: 3, 2: 1, 3: 1, 4: 2, 5: 9001}
