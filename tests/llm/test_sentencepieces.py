from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from sluicework.llm import sentencepieces as S
from sluicework.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb\n\n c", "▁", "a▁b", "▁ ▁", "日本語 テスト 🙂🙂", "<s> </s> <unk> <0x0A>", "\x00a\x00", "\t\t x\t",
    "é́", "a" * 3000, "  \n  x", "\r\n", "<|x|>  ▁▁\n▁", "\x1c\x85  a", "x" + " " * 70 + "y", "ﬁ ½ ① ｆｕｌｌ　ｗ",
]


def model(rules: str | None = None, squeeze: int = 0) -> bytes:
    """The public model, with the normalisation rules of the library put in when named."""
    with open(PATH, "rb") as file:
        data = file.read()
    if rules is None:
        return data
    held = dict(S._fields(dict(S._fields(sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto()))[3]))[2]

    def sized(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    body = b"\x12" + sized(len(held)) + held + b"\x18\x01\x20" + bytes([squeeze]) + b"\x28\x01"
    return data + b"\x1a" + sized(len(body)) + body


@pytest.mark.parametrize(("rules", "squeeze"), [(None, 0), ("nmt_nfkc", 0), ("nmt_nfkc", 1)])
def test_ids_and_text_equal_the_library(small_docs, rules, squeeze):
    data = model(rules, squeeze)
    own, library = S.Encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ODD + [r.text for r in small_docs.limit(60).collect()]:
        ids, starts, ends = own.encode(text)
        assert ids.tolist() == library.encode(text, add_eos=True), text[:60]
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())
        assert len(ids) == len(starts) == len(ends) and (starts <= ends).all()


def test_spans_equal_the_library(small_docs):
    own, library = S.Encoder(model()), sentencepiece.SentencePieceProcessor(model_proto=model())
    for text in ODD + [r.text for r in small_docs.limit(30).collect()]:
        _, starts, ends = own.encode(text, end=False)
        pieces = library.encode(text, return_type="proto").pieces
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in pieces], text[:60]


def test_spans_cover_replaced_characters():
    own = S.Encoder(model("nmt_nfkc"))
    text = "ﬁ½"
    _, starts, ends = own.encode(text, end=False)
    assert starts.min() == 0 and ends.max() == len(text.encode())
    assert own.normalise(text)[0] == "▁fi1⁄2"


def test_decoding_any_ids_equals_the_library():
    own, library, draw = S.Encoder(model()), sentencepiece.SentencePieceProcessor(model_proto=model()), random.Random(1)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.randrange(3)]) for _ in range(draw.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_encode_and_decode_tables(docs_of):
    docs = docs_of([(1, "Ab  c\n"), (1, "Ab  c\n"), (2, None), (None, "é"), (4, ""), (5, "word " * 5000)])
    made = S.encode(docs, PATH)
    back = {(r.id, r.text) for r in S.decode(made, PATH).collect()}
    assert back == {(1, "Ab  c\n"), (2, ""), (None, "é"), (4, ""), (5, "word " * 5000)}
    assert made.count() == 6 and made.where("id = 2").first().ids == [2]


def test_digests(docs_of):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate([*ODD, None])]
    got = {r.doc_id: r for r in S.digests(docs_of(rows), PATH).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert got[i].n_bytes == len((text or "").encode())
    assert S.digests(docs_of([]), PATH).count() == 0
