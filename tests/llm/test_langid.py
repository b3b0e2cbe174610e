from __future__ import annotations

import zlib

import numpy as np
import pytest

from sluicework.llm import langid as L
from sluicework.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORDS = {"aa": "bal gob rab lab", "zz": "źrit frix żwox xim"}


@pytest.fixture(scope="module")
def predicted(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return truth, QUERIES["op3_language_id"](spark, SF).collect()


def test_held_out_accuracy(predicted):
    truth, got = predicted
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in held)
    assert len(held) > 150 and right / len(held) >= 0.97


def test_every_document_once_with_its_fold(predicted):
    truth, got = predicted
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "fr", "de", "es", "und"} for r in got)


def test_gradient_through_time():
    rng = np.random.default_rng(0)
    net = L.Tagger.fresh(["a", "b", "c"], hidden=4)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    x, y, step = rng.integers(97, 110, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1]), 1e-4
    _, grads = net._gradients(x, y)
    for k, w in net.w.items():
        for at in zip(*np.unravel_index(np.argsort(-np.abs(grads[k]), axis=None)[:3], w.shape), strict=True):
            was = w[at]
            w[at] = was + step
            above = net._gradients(x, y)[0]
            w[at] = was - step
            below = net._gradients(x, y)[0]
            w[at] = was
            assert (above - below) / 2 / step == pytest.approx(grads[k][at], rel=2e-3, abs=1e-6)


def test_pooled_probabilities_equal_reading_every_byte():
    net = L.Tagger.fresh(["a", "b", "c"])
    text = "Grüße an ALLE, " + "ab" * 40 + " x1y ½ ok"
    sums, n = np.zeros(3), 0
    for run in L.RUNS.findall(text.lower()):
        for piece, vote in zip(*L.sequences(run), strict=True):
            probs = net.label(np.frombuffer(piece, np.uint8)[None, :])[0]
            sums += probs[vote].sum(axis=0)
            n += vote.sum()
    assert n == sum(len(c.encode()) for c in text.lower() if c.isalpha())
    (lang, score), (longer, _), none = net.predict([text, text * 50, None])
    assert lang == "abc"[int(sums.argmax())] and score == pytest.approx(sums.max() / n, abs=1e-3)
    assert longer == lang and none == ("und", 0.0)


def test_no_letter_is_undetermined():
    net = L.Tagger.fresh(["a", "b"])
    assert net.predict([None, "", "  \n", "12 ½ — !?", "_ __"]) == [("und", 0.0)] * 5 and net.predict([]) == []


def test_training_uses_no_held_out_row_and_no_row_without_label(spark, docs_of):
    rows = [(i, WORDS["aa" if i % 2 else "zz"], "aa" if i % 2 else "zz") for i in range(200)]
    lie = [(i, WORDS["aa" if i % 2 else "zz"], "zz" if i % 2 else "aa") if zlib.crc32(str(i).encode()) % 4 == 2 else (i, t, lang) for i, t, lang in rows]
    extra = [(None, "bal gob", "held"), (1001, None, "aa"), (1002, "bal", None), (1003, "", "zz")]
    first, second = L.train(docs_of(rows + extra), steps=60), L.train(docs_of(lie + extra), steps=60)
    assert first.languages == ["aa", "zz"] == second.languages
    assert all(np.array_equal(first.w[k], second.w[k]) for k in first.w)
    got = {r.id: r.lang_pred for r in L.identify(docs_of(rows + extra), first).collect()}
    assert all(got[i] == lang for i, _, lang in rows) and got[1001] == "und" and got[1003] == "und"


def test_empty_table_and_unlabelled_table(docs_of):
    net = L.train(docs_of([]))
    assert net.languages == [] and L.identify(docs_of([]), net).count() == 0
    net = L.train(docs_of([(1, "text")]))
    assert [r.lang_pred for r in L.identify(docs_of([(1, "text")]), net).collect()] == ["und"]


def test_filter_keeps_columns_and_clean_rows(docs_of):
    net = L.train(docs_of([(i, WORDS["aa" if i % 2 else "zz"], "aa" if i % 2 else "zz") for i in range(200)]), steps=60)
    docs = docs_of([(1, "bal gob"), (1, "bal gob"), (2, None), (3, "123"), (4, "żwox xim " * 3000), (None, "rab")])
    kept = L.keep_identified(docs, net)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "1", "4", "None"]
