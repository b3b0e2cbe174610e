from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sluicework.llm import flatfile as T
from sluicework.llm.queries import vocabulary
from sluicework.session import scratch_path

PATH = vocabulary("word_bpe_49k.json")
ODD = [
    None, "", " ", "a\x0bb\x0cc\x1cd\x85e f g", "<|endoftext|>x <|startoftext|>", "don't CAN'T I'll", "ΑΣ Σ ς", "é ́x", "İstanbul",
    "日本 🙂", "\x00a", "# ## a#b", "x" * 3000, "word " * 3000,
    "<|EndOfText|> b", "A <|STARTOFTEXT|>", "a<|endoftext|>B, c.", "1. a1. é. ). ,. . , a.b c.\u00a0d",
    "x». y». é. a.b. c,, d., It's. A.\nB,\n c.\td.", "end.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_files_hold_what_the_library_gives(spark, docs_of, small_docs, library):
    rows = [(1000 + i, t) for i, t in enumerate(ODD)] + [(r.doc_id, r.text) for r in small_docs.limit(60).collect()] + [(-5, "a"), (-5, "b"), (None, "c")]
    folder = scratch_path(spark, "flat")
    dtype = T.write(docs_of(rows).repartition(7), PATH, 2, folder)
    assert dtype == "<u2"
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read(spark, folder, dtype).collect())
    assert [g[1] for g in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    texts, start = {}, 0
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    tokens = T.FlatTokens(folder, dtype)
    assert len(tokens) == len(rows)
    for k, (at, doc, n, crc) in enumerate(got):
        ids = tokens[k].tolist()
        wanted = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts[doc]]
        assert ids in wanted and at == start and n == len(ids)
        assert crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += n
    offsets = b""
    base = folder.removeprefix("file:")
    for part in sorted(os.listdir(f"{base}/offsets"), key=lambda p: int(p.split("=")[1]) if "=" in p else -1):
        if "=" in part:
            for f in sorted(x for x in os.listdir(f"{base}/offsets/{part}") if x.startswith("part-")):
                offsets += open(f"{base}/offsets/{part}/{f}", "rb").read()
    assert np.frombuffer(offsets, "<i8").tolist() == [g[0] for g in got]


def test_any_end_id_and_wide_ids(spark, docs_of):
    folder = scratch_path(spark, "flat")
    dtype = T.write(docs_of([(1, "a b"), (2, None)]), PATH, 70_010, folder)
    assert dtype == "<u4"
    assert T.FlatTokens(folder, dtype)[1].tolist() == [70_010]
    assert sorted((r.doc_id, r.start) for r in T.read(spark, folder, dtype).collect()) == [(1, 0), (2, 3)]


def test_empty_table(spark, docs_of):
    assert T.round_trip(docs_of([]), PATH, 2).count() == 0


def test_memory_of_one_call_is_that_of_a_small_group(small_docs):
    import tracemalloc

    texts = [(r.text or "").encode() for r in small_docs.collect()]
    texts = texts * (14_000_000 // sum(map(len, texts)) + 1)
    tokenizer = T.Tokenizer(PATH, "<u2")
    tokenizer.encode(texts)
    tracemalloc.start()
    tokenizer.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
