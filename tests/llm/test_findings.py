from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from sluicework.llm import findings as S
from sluicework.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
HEX40 = "0cab398dc11d1a2a11dc6572c8df8bd228c864f3"


def plain_base(text):
    """The contract's patterns on code points."""
    found = []
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found += [(m.start(), m.end(), "assign") for m in assign.finditer(text or "") if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


ODD = [
    None, "", " ", "é password = 'abcdef' ü", "PassWord:abcde", "token = \"" + HEX40 + "\"", "api_key=secret=abcdefgh", "AKIAAKIA" + "A" * 12, "AKIA" + "B" * 15,
    "AKIA" + "B" * 16 + "é" + "AKIA" + "C" * 20, "f" * 24 + " " + "f" * 23, "ſecret=abcdef Key", "token" + " " * 5000 + "= abcdefg", "secret: a.b.c.d.e", "apikey=" + "Z" * 9000,
    "passwd\"  :  \"x-y_z+/=\"", HEX40 * 300,
]


@pytest.fixture(scope="module")
def judge(spark):
    return S.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_query_against_the_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_secret_scan"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = plain_base(texts[r.doc_id])
        kinds = [k for _, _, k in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        listed = r.spans.split(",") if r.spans else []
        assert [s for s in listed if not s.startswith("model:")] == [s for s in joined(base).split(",") if s]


def test_odd_texts_equal_plain_patterns(judge):
    for text in ODD:
        found = S.spans(text, judge)
        assert [s for s in found if s[2] != "model"] == plain_base(text), text and text[:40]
        assert found == sorted(found, key=S._order)


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = S.Judge.fresh()
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    x, y = rng.integers(0, 97, (6, S.WIDTH)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    grads, step = net._gradients(x, y), 1e-4

    def loss():
        out = net._forward(x)[-1]
        return float((np.log1p(np.exp(out)) - y * out).mean())

    for k, w in net.w.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), w.shape)
        was = w[at]
        w[at] = was + step
        above = loss()
        w[at] = was - step
        below = loss()
        w[at] = was
        assert (above - below) / 2 / step == pytest.approx(grads[k][at], rel=2e-2, abs=1e-5)


def test_recall_on_new_labelled_findings(judge):
    """Values of no base kind, after words the patterns do not know, against long plain words."""
    rng = np.random.default_rng(5)
    hits = [judge.scores(d := b"use " + v + b" for the login", [(4, 4 + len(v))])[0] >= judge.threshold for v in (S._sample_value(rng, int(n)) for n in rng.integers(24, 60, 300))]
    words = ["thatthhahaorandthe", "Bundesverfassungsgericht", "internationalization", "unglaublichkeiten-und", "constitutionnellement", "responsabilidades"]
    false = [judge.scores(f"Then {w} again".encode(), [(5, 5 + len(w.encode()))])[0] >= judge.threshold for w in words]
    assert np.mean(hits) >= 0.9 and np.mean(false) <= 0.2


def test_clean_documents_are_left_alone(spark, judge):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    clean = [r.text for r in rows if not plain_base(r.text)]
    marked = sum(bool(S.spans(t, judge)) for t in clean)
    assert marked / len(clean) <= 0.02


def test_redaction(docs_of, judge):
    docs = docs_of([(1, f"é token = \"{HEX40}\" ü"), (1, "plain"), (2, None), (3, ""), (None, "AKIA" + "B" * 16)])
    got = S.redact(docs, judge, size_col="n_chars")
    assert got.columns == docs.columns
    rows = sorted(((str(r.doc_id), r.text, r.n_chars) for r in got.collect()), key=str)
    assert ("1", "é [SECRET]\" ü", 13) in rows and ("None", "[SECRET]", 8) in rows and ("2", None, None) in rows and ("1", "plain", 5) in rows
    assert S.redacted("abcdefgh", [(1, 4, "assign"), (2, 6, "hex")]) == "a[SECRET]gh"


def test_tables_without_rows_or_findings(docs_of):
    net = S.train(docs_of([]))
    assert S.scan(docs_of([]), net).count() == 0
    net = S.train(docs_of([(1, "no finding here"), (2, None)]))
    assert S.scan(docs_of([(1, None)]), net).first().spans == []


def test_documents_beyond_the_sample_move_the_network(spark, docs_of):
    """Every other document changes; the few sampled ones are the same in both tables."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    drawn = {r.doc_id for r in docs_of(rows).where(f"pmod(xxhash64(doc_id, 31), 1073741824) < {(20 << 30) // 300 + 1}").collect()}
    other = [(d, t if d in drawn else f"{t} 7:{HEX40}") for d, t in rows]
    one, two = (S.train(docs_of(table), sample_docs=20) for table in (rows, other))
    assert 0 < len(drawn) < 100 and not np.allclose(one.w["last"], two.w["last"], atol=1e-7)
