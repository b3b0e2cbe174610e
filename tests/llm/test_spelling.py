from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest

from sluicework.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if n >= 2 and len(w) >= 7}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {a: [b for b in counts if one_apart(a, b)] for a in counts}
    form = {}
    for a, found in near.items():
        best = min(found, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= 10 * counts[a] else None
    rows = set()
    for a in counts:
        root = a
        while form[root] is not None:
            root = form[root]
        rows.add((a, form[a], root, counts[a], len(near[a]), counts.get(form[a])))
    return rows


ODD = [
    (1, None), (2, ""), (3, "1234 ..."), (None, "Éclairage éclairage nullids nullids"), (4, "ÿÿÿÿÿÿÿ × ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷ ÿÿÿÿÿÿÿ"),
    (5, "abcdefgh " * 3 + "abcdefg " * 40 + "bcdefgh abcdefh abcdefgh"), (5, "abcdefgh " * 3 + "abcdefg " * 40),
    (6, "zbcdefg zbcdefg " + "abcdefx " * 500 + "abcdegh " * 40 + "gfedcba gfedcba"), (7, "x" * 30_000 + " " + "longword " * 20_000), (8, "ABCDEFGİ abcdefgı"),
    (9, "relation relations relational relation relations " * 9 + "relatoin relatoin relaton relaton relationn relationn"),
]


def test_words_and_variants_of_odd_texts(spark, docs_of):
    docs = docs_of(ODD)
    got = {r.word: r.n for r in S.words(docs).collect()}
    assert got == plain_words(ODD)
    assert {tuple(r) for r in S.variants(S.words(docs)).collect()} == plain_variants(got)


@pytest.mark.parametrize(("parts", "hot"), [(3, 1), (4, 128), (5, 1)])
def test_pairs_equal_brute_force(spark, small_docs, parts, hot):
    kept = S.words(small_docs).orderBy("word").limit(900).collect() + [("aabbccd", 9), ("abbccd", 1), ("aabbccdd", 3), ("ab", 2), ("a", 2), ("b", 2), ("ba", 2), ("", 5), ("a🙂", 2), ("🙂", 2)]
    counts = {w: n for w, n in kept}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in S.near_pairs(vocabulary, parts, hot).collect()]
    want = {(a, counts[a], b, counts[b]) for a in counts for b in counts if a < b and one_apart(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_roots_follow_long_chains(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb", "bbbbbbb"]
    counts = {w: 2 * 10**k for k, w in enumerate(chain)}
    got = {tuple(r) for r in S.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == plain_variants(counts)
    assert {r[2] for r in got} == {"bbbbbbb"}


def test_empty_tables_and_ratio(spark, docs_of):
    assert S.variants(S.words(docs_of([]))).count() == 0
    with pytest.raises(ValueError, match="circle"):
        S.variants(S.words(docs_of([])), ratio=1)
