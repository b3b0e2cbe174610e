from __future__ import annotations

import pytest

import corpus_pipeline
from sluicework.llm import findings, langid

from .conftest import SMALL
from .test_findings import plain_base
from .test_packing import plain_pack
from .test_simhash import plain_components, plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input and the stored result of every stage, with rows added that stages have to deal with."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    base = docs.first()
    extra = [
        (10_001, None, None, "s", 0), (10_002, "", "en", "s", 0), (10_003, "12 34", "en", "s", 5), (10_004, base.text, base.lang, "s", base.n_chars),
        (10_005, "".join(c.lower() if c.isascii() else c for c in base.text), base.lang, "t", base.n_chars), (10_006, "the and of " * 20_000, "en", "s", 220_000), (10_006, "the and of " * 20_000, "en", "s", 220_000),
        (10_007, "the token = \"0cab398dc11d1a2a11dc6572c8df8bd228c864f3\" of and the", "en", "s", 66), (None, "the and of that", "en", "s", 15),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        stage(spark, found[-1], SMALL).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def rows_of(df):
    return {(r.doc_id, r.text) for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert [s.columns for s in steps[:-1]] == [COLUMNS] * (len(steps) - 1)


def test_language_stage(steps):
    net = langid.train(steps[0])
    rows = list(rows_of(steps[0]))
    want = {k for k, p in zip(rows, net.predict([t for _, t in rows]), strict=True) if p[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE}
    assert rows_of(steps[1]) == want
    assert {k[0] for k in rows_of(steps[0]) - want} == {10_001, 10_002, 10_003}


def test_near_dedup_stage(steps):
    before = rows_of(steps[1])
    top = plain_components([(i, plain_fingerprint(t)) for i, t in before if i is not None])
    assert rows_of(steps[2]) == {(i, t) for i, t in before if i is None or top[i] == i}
    assert steps[2].count() == len(rows_of(steps[2]))
    assert not {10_004, 10_005} & {i for i, _ in rows_of(steps[2])}


def test_secret_stage(steps):
    judge = findings.train(steps[2])
    want = {(r.doc_id, findings.redacted(r.text, findings.spans(r.text, judge))) for r in steps[2].collect()}
    got = {(r.doc_id, r.text): r.n_chars for r in steps[3].collect()}
    assert set(got) == want
    assert not any(plain_base(t) for _, t in got)
    assert all(n == len(t) for (i, t), n in got.items() if i == 10_007)
    untouched = {(r.doc_id, r.text) for r in steps[2].collect() if not plain_base(r.text)}
    assert len(untouched & set(got)) >= 0.98 * len(untouched)


def test_packing_stage(steps):
    rows = [(r.doc_id, len(r.text.encode().split()) + 1) for r in steps[3].collect()]
    got = [tuple(r) for r in steps[4].collect()]
    assert sorted(got, key=str) == sorted(plain_pack(rows, 2048, 8, 65_536), key=str)


def test_run_applies_all_stages(spark):
    made = corpus_pipeline.run(spark, SMALL)
    assert made.columns == ["doc_id", "sequence", "start", "n_tokens", "bucket", "bucket_tokens", "batch", "slot"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert 0 < made.select("doc_id").distinct().count() < docs.count()
