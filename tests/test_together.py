"""Many files cleaned in common jobs give what each gives alone."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sluicework.sources.sinks import read_curated
from sluicework.streaming import ingest as N
from sluicework.streaming.together import Upload, rows_of, safe_names

FILES = {
    "crew/a.csv": "id,email,joined,score\n" + "".join(f"{i},m{i}@ship.org,2024-01-{i % 28 + 1:02},{i}\n" for i in range(1, 140)) + "7,x@ship.org,2024-01-01,high\n",
    "crew/b.csv": 'score,id,remark\n2.5,900,"two\nlines, one cell"\n3.5,901,"say ""hi"""\n3.5,901,"say ""hi"""\n\n,902,\n4,903\n5,904,x,too,many\n',
    "crew/c.csv": "id,score\n" + "".join(f"n{i},{i}\n" for i in range(3)),
    "crew/d.csv": "id,score\n1000,90071992547409931\n",
    "odd/names.csv": "a,A,,b b,\n1,2,3,4,5\n",
    "odd/empty.csv": "a,b\n",
    "odd/open.csv": 'a,b\n"1,2\n',
    "odd/all_bad.csv": "v\n" + "".join(f"{i}\n" for i in range(100)) + "x\n",
    "odd/one.json": '{"k": 1, "deep": {"x": ["p", "q"]}, "flag": true, "n": null}',
    "odd/many.json": '[{"z": "1", "a": 2.50}, {"a": 1e3, "late": "x"}]',
    "odd/scalar.json": "5",
    "odd/lines.ndjson": '{"k": 1, "t": "a"}\nnot json\n{"t": "b", "u": {"v": 1}}\n\n[1]\n{"k": "NA"}\n',
    "odd/none.ndjson": "nothing\n",
    "flags/x.csv": "on\n1\n0\nyes\n",
    "flags/y.csv": "on\n5\n6\n",
}


def put(root, files):
    uploads = []
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        uploads.append((name.split("/")[0], name.rsplit(".", 1)[1], f"file:{path}"))
    return uploads


def outcome(spark, root):
    """Everything a run leaves behind, with the names of its own folder taken out."""
    zones, found = N.Zones(str(root / "zones")), {}
    log = spark.read.parquet(zones.jobs).orderBy("seq").collect()
    name = {r.job_id: r.path.rsplit("/", 1)[1] for r in log}
    for r in log:
        stats = (r.total_records, r.valid, r.rejected, r.duplicates_removed, r.loaded, r.schema, r.masked)
        found.setdefault(name[r.job_id], []).append((r.status, (r.error or "").replace(str(root), ""), stats))
    tables = {}
    for dataset in ("crew", "odd", "flags"):
        rows = read_curated(spark, zones.curated(dataset))
        tables[dataset] = (sorted(rows.dtypes), sorted(str(sorted({**r.asDict(), "batch_id": name[r.batch_id]}.items(), key=str)) for r in rows.collect()))
    silver = {(d, name[p.name.split("=")[1]]): spark.read.parquet(str(p)).dtypes for d in ("crew", "odd") for p in (root / "zones/silver" / d).glob("__job=*")}
    rejects = [json.loads(r.value) for r in spark.read.option("recursiveFileLookup", "true").text(zones.rejected("crew")).collect()]
    failed = sorted((name[r.job_id], r.attempt, r.error.replace(str(root), "")) for r in spark.read.parquet(zones.failures).collect())
    return found, tables, silver, sorted((name[r["job_id"]], r["errors"], str(r["original_row"])) for r in rejects), failed


def test_together_equals_one_by_one(spark, tmp_path, monkeypatch):
    runs = []
    for how in ("together", "alone"):
        root = tmp_path / how
        uploads = put(root / "in", FILES)
        if how == "alone":
            monkeypatch.setattr(N, "run_together", lambda spark, zones, uploads, known, load: {u.job for u in uploads})
        N.take_files(spark, uploads, N.Zones(str(root / "zones")), day="2024-03-01")
        runs.append(outcome(spark, root))
    for a, b in zip(*runs, strict=True):
        assert a == b
    log, tables, _, rejects, failed = runs[0]
    assert [s for s, _, _ in log["a.csv"]] == ["UPLOADING", "VALIDATING", "TRANSFORMING", "LOADED"]
    assert [s for s, _, _ in log["c.csv"]][-1] == "FAILED" and [s for s, _, _ in log["d.csv"]][-1] == "LOADED"
    assert dict(tables["crew"][0])["score"] == "double" and len(rejects) == 1 and rejects[0][0] == "a.csv"
    assert {f[0] for f in failed} == {"c.csv", "empty.csv", "open.csv", "scalar.json", "none.ndjson", "y.csv"}


@pytest.mark.parametrize("load", [True, False])
def test_jobs_do_not_grow_with_the_files(spark, tmp_path, load):
    def jobs(n):
        root = tmp_path / f"{n}-{load}"
        uploads = put(root / "in", {f"crew/{i:03}.csv": f"id,note\n{i},n{i}\n{i + 1000},m\n" for i in range(n)})
        scheduler = spark.sparkContext._jsc.sc().dagScheduler()
        before = scheduler.numTotalJobs()
        N.take_files(spark, uploads, N.Zones(str(root / "zones")), load=load, day="2024-03-01")
        used = scheduler.numTotalJobs() - before
        if load:
            assert read_curated(spark, N.Zones(str(root / "zones")).curated("crew")).agg(F.count_distinct("batch_id"), F.count("*")).first() == (n, 2 * n)
        return used

    assert jobs(12) <= jobs(3) + 3


def pack(root, n):
    """n archives, each with one member of the same name; their uploads."""
    root.mkdir(parents=True)
    for i in range(n):
        with zipfile.ZipFile(root / f"{i:03}.zip", "w") as z:
            z.writestr("in/crew.csv", f"id,note\n{i},n{i}\n{i + 1000},m\n")
    return [("bags", "zip", f"file:{root}/{i:03}.zip") for i in range(n)]


def test_jobs_do_not_grow_with_the_archives(spark, tmp_path):
    def jobs(n):
        root = tmp_path / str(n)
        uploads, zones = pack(root / "in", n), N.Zones(str(root / "zones"))
        scheduler = spark.sparkContext._jsc.sc().dagScheduler()
        before = scheduler.numTotalJobs()
        N.take_files(spark, uploads, zones, day="2024-03-01")
        used = scheduler.numTotalJobs() - before
        assert read_curated(spark, zones.curated("crew")).agg(F.count_distinct("batch_id"), F.count("*")).first() == (n, 2 * n)
        return used

    assert jobs(12) <= jobs(3) + 3


def test_an_archive_that_cannot_be_read_fails_alone(spark, tmp_path):
    uploads, zones = pack(tmp_path / "in", 3), N.Zones(str(tmp_path / "zones"))
    (tmp_path / "in" / "001.zip").write_bytes(b"PK no archive")
    with zipfile.ZipFile(tmp_path / "in" / "bare.zip", "w") as z:
        z.writestr("notes.txt", "x")
    uploads += [("other", f, p) for _, f, p in uploads[:1]] + [("other", "zip", f"file:{tmp_path}/in/bare.zip")]
    for _ in range(2):  # a replay changes nothing
        N.take_files(spark, uploads, zones, day="2024-03-01")
    last = {(r.dataset, r.path[-7:]): r.status for r in spark.read.parquet(zones.jobs).orderBy("seq").collect() if r.format == "zip"}
    assert last == {("bags", "000.zip"): "LOADED", ("bags", "001.zip"): "FAILED", ("bags", "002.zip"): "LOADED", ("other", "000.zip"): "LOADED", ("other", "are.zip"): "REJECTED"}
    rows = read_curated(spark, zones.curated("crew"))
    assert sorted(r.id for r in rows.collect()) == [0, 0, 2, 1000, 1000, 1002]


def test_header_names():
    assert safe_names(["a", None, "A", "b", ""]) == ["a0", "_c1", "A2", "b", "_c4"]


def test_rows_of_one_large_file_stay_spread_over_tasks(spark):
    """A shuffled join on the file would gather all its rows in one task."""
    u = Upload("j", "d", "csv", "p", "2024-01-01", file="f", columns=["a", "b"], kinds=[None, None], types=["INT64", "STRING"])
    cells = F.array(F.col("id").cast("string"), F.lit("x"))
    checked = spark.range(0, 4000, 1, 4).select(F.lit("f").alias("file"), cells.alias("cells"), F.array().cast("array<string>").alias("errors"))
    rows = rows_of(checked, [u], True)
    assert rows.select(F.spark_partition_id()).distinct().count() == 4
    assert rows.agg(F.sum("a"), F.count("b")).first() == (4000 * 3999 // 2, 4000)
