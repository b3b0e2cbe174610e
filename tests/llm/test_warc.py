from __future__ import annotations

import base64
import hashlib
import io

import pytest

from sluicework.llm import warc as W
from sluicework.session import scratch_path

ODD = [
    (1, "http://a/", "x"), (2, "http://b/", None), (3, "http://c/", ""), (4, None, "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (5, "http://d/é z\r\nq\t%", "é🙂\x00\r\n\r\n"),
    (6, "u" * 5000, "y" * 300_000), (7, "http://g/", "x"), (8, "http://h/", "x"), (8, "http://h/", "x"), (None, "http://n/", "x"), (None, None, None), (9, "", "z"), (-4, "http://i/", "x"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain(rows, least=0):
    kept = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            kept[html or ""] = max(page, kept.get(html or "", page))
    for page, _, html in rows:
        top = kept.get(html or "", page)
        again = page is not None and page != top
        yield page, len((html or "").encode()), digest(html), "revisit" if again else "response", top if again else None


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, "p") for r in rows], "page_id long, url string, html string, id long, digest string, size long, payload string")


def made(spark, rows, **how):
    folder = scratch_path(spark, "warc")
    W.write(pages_of(spark, rows).repartition(3), folder, **how)
    return folder


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize(("least", "whole", "file_records"), [(0, False, 50_000), (0, True, 2), (2, False, 1)])
def test_round_trip(spark, least, whole, file_records):
    folder = made(spark, ODD, least_bytes=least, file_records=file_records)
    got = W.read(spark, folder, W.index(spark, folder, whole), whole).collect()
    fields = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key)
    assert fields == sorted(plain(ODD, least), key=key)
    payloads = sorted((r.page_id or 0, bytes(r.payload)) for r in got if r.record_type == "response")
    assert payloads == sorted((r[0] or 0, (r[2] or "").encode()) for r, p in zip(ODD, plain(ODD, least), strict=True) if p[3] == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    urls = {r.page_id: r.url for r in got if r.page_id in (4, 5, 6, 9)}
    assert urls == {4: None, 5: "http://d/é%20z%0D%0Aq%09%", 6: "u" * 5000, 9: ""}


def test_index_names_every_record(spark):
    folder = made(spark, ODD, file_records=4)
    rows = W.index(spark, folder).collect()
    files = {}
    for r in rows:
        files.setdefault(r.path, []).append(r)
    assert len(files) > 3
    for path, held in files.items():
        data = open(path.removeprefix("file:"), "rb").read()
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [0, *[r.offset + r.length for r in held][:-1]] and held[-1].offset + held[-1].length == len(data)
        for r in held:
            page, url, kind, refers, _, sha, _ = W.record(data[r.offset : r.offset + r.length])
            assert (page, url, kind, refers, sha) == (r.page_id, r.url, r.record_type, r.refers_to, r.digest)


def test_selected_records_are_read_in_ranges(spark):
    rows = [(k, f"http://a/{k}", f"{k} " * 500) for k in range(60)]
    folder = scratch_path(spark, "warc")
    W.write(pages_of(spark, rows).coalesce(1), folder)
    index = W.index(spark, folder)
    chosen = index.where("page_id % 10 < 2 or page_id = 35")
    assert W.ranges(index, 0).count() == 1
    assert W.ranges(chosen, 0).count() == 7 and W.ranges(chosen, 1 << 20).count() == 1
    assert W.ranges(index, 0, most=4096).count() > 10
    for gap, most in ((0, 1 << 23), (1 << 20, 1 << 23), (0, 4096)):
        got = W.read(spark, folder, chosen.unionByName(chosen), gap=gap, most=most).collect()
        assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(k, f"{k} " * 500) for k in range(60) if k % 10 < 2 or k == 35]


def test_broken_archives_and_payloads_are_refused(spark):
    folder = made(spark, [(1, "http://a/", "text")])
    path = next(r.path for r in W.index(spark, folder).collect())
    data = open(path.removeprefix("file:"), "rb").read()
    assert len(list(W.headers(io.BytesIO(data), len(data)))) == 1
    for bad in (data[:-3], b"x" + data, data[:40]):
        with pytest.raises(ValueError, match="record"):
            list(W.headers(io.BytesIO(bad), len(bad)))
    with pytest.raises(ValueError, match="digest"):
        W.record(data.replace(b"text\r\n\r\n", b"tent\r\n\r\n"))


def test_empty_table(spark):
    folder = made(spark, [])
    assert W.read(spark, folder, W.index(spark, folder)).count() == 0
