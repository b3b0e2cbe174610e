"""Streams: arrival of files, replays, broken files, and the live state machine."""

from __future__ import annotations

import datetime
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sluicework.operators.ledger import check_transitions, current_jobs, retained, retriggers
from sluicework.session import ship_package
from sluicework.sources.archives import member_pieces
from sluicework.sources.loads import Loads, drop_expired
from sluicework.sources.sinks import load_curated, read_curated
from sluicework.streaming import events as E
from sluicework.streaming import ingest as N


def states(spark, zones):
    """dataset/file name to its states in order."""
    found = {}
    for r in spark.read.parquet(zones.jobs).orderBy("seq").collect():
        found.setdefault(f"{r.dataset}/{r.path.rsplit('/', 1)[-1]}", []).append(r.status)
    return found


def test_every_file_is_its_own_job(spark, tmp_path):
    inbox, zones = tmp_path / "inbox", N.Zones(str(tmp_path / "zones"))
    for folder in ("people", "broken"):
        (inbox / folder).mkdir(parents=True)
    (inbox / "people" / "a.csv").write_text("id,note,email,n\n1,x,a@x.org,5\n2,y,b@x.org,6\n2,y,b@x.org,6\n" + "".join(f"{i},z,c{i}@x.org,{i}\n" for i in range(10, 110)) + "7,w,z@x.org,many\n")
    (inbox / "people" / "b.csv").write_text("email,n,note,id\nq@y.org,1,first,500\nr@y.org,2,second,501\n")
    (inbox / "people" / "c.csv").write_text("id,note,email,n\n" + "".join(f"{i},x,d{i}@x.org,n/{i}\n" for i in range(3)))
    (inbox / "broken" / "b.csv").write_text('id,v\n"1,2\n')
    (inbox / "broken" / "c.parquet").write_bytes(b"PAR1" + bytes(50))
    with zipfile.ZipFile(inbox / "broken" / "more.zip", "w") as z:
        z.writestr("in/Extra Rows.csv", "k,v\n1,a\n2,b")
        z.writestr("lines.ndjson", '{"k": 1}\n{"k": 2}\n')
        z.writestr("notes.txt", "x")
        spark.range(7).coalesce(1).write.parquet(str(tmp_path / "pq"))
        z.write(next((tmp_path / "pq").glob("*.parquet")), "cube.parquet")
    with zipfile.ZipFile(inbox / "broken" / "none.zip", "w") as z:
        z.writestr("notes.txt", "x")

    def run(state="state", day="2024-01-01"):
        N.stream_ingest(spark, str(inbox), zones, str(tmp_path / state), day=day).awaitTermination()

    run()
    rows = read_curated(spark, zones.curated("people"))
    assert rows.where("id >= 500").select("id", "note", "n").orderBy("id").collect() == [(500, "first", 1), (501, "second", 2)]
    assert rows.count() == 102 + 2 and dict(rows.dtypes)["id"] == "bigint"
    assert rows.where(F.col("email").endswith("@masked.invalid")).count() == rows.count()
    rejected = [r.value for r in spark.read.option("recursiveFileLookup", "true").text(zones.rejected("people")).collect()]
    assert rejected and not any("@x.org" in r or "@y.org" in r for r in rejected)
    got = states(spark, zones)
    loaded = ["UPLOADING", "VALIDATING", "TRANSFORMING", "LOADED"]
    assert got["people/a.csv"] == got["people/b.csv"] == loaded
    assert got["broken/b.csv"] == ["UPLOADING", "VALIDATING", "REJECTED"] == got["broken/none.zip"]
    assert got["broken/c.parquet"] == ["UPLOADING", "VALIDATING", "FAILED"]
    assert got["people/c.csv"] == ["UPLOADING", "VALIDATING", "TRANSFORMING", "FAILED"]  # text where the table has numbers
    assert got["broken/more.zip"] == ["UPLOADING", "VALIDATING", "LOADED"]
    for name, n in (("extra_rows", 2), ("lines", 2), ("cube", 7)):
        assert read_curated(spark, zones.curated(name)).count() == n
    log = spark.read.parquet(zones.jobs)
    assert check_transitions(log).where("not is_allowed").count() == 0
    jobs = {r.path.rsplit("/", 1)[-1]: r for r in current_jobs(log).where("dataset = 'people'").collect()}
    assert jobs["a.csv"].duplicates_removed == 1 and jobs["a.csv"].rejected == 1 and jobs["a.csv"].loaded == 102
    assert json.loads(jobs["b.csv"].masked) == {"email": "email"} and json.loads(jobs["b.csv"].schema)["id"] == "INT64"
    assert spark.read.parquet(zones.failures).count() == 4

    before = log.count(), rows.count()
    run()  # nothing new
    run("other-state", "2024-02-02")  # a new checkpoint on another day sees all files again
    assert (spark.read.parquet(zones.jobs).count(), read_curated(spark, zones.curated("people")).count()) == before
    assert spark.read.parquet(zones.failures).count() == 4

    # Set back after the file was mended: the next run picks it up.
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "good"))
    (inbox / "broken" / "c.parquet").write_bytes(next((tmp_path / "good").glob("*.parquet")).read_bytes())
    failed = log.where("status = 'FAILED' and dataset = 'broken'").first().job_id
    retriggers(spark.read.parquet(zones.jobs), F.current_timestamp(), [failed]).write.mode("append").parquet(zones.jobs)
    assert N.resume(spark, zones) == 1
    assert states(spark, zones)["broken/c.parquet"][3:] == loaded and read_curated(spark, zones.curated("broken")).count() == 4


def test_a_batch_that_does_not_fit_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    load_curated(spark.createDataFrame([(1, 2.5)], "n long, w double"), path, "b1", "2024-01-01")
    load_curated(spark.createDataFrame([(2, 7)], "n int, w long"), path, "b2", "2024-01-01")
    for kind, value in (("string", "x"), ("boolean", True)):
        with pytest.raises(ValueError, match="nothing was written"):
            load_curated(spark.createDataFrame([(value,)], f"n {kind}"), path, "b3", "2024-01-01")
    assert sorted((r.n, r.w) for r in read_curated(spark, path).collect()) == [(1, 2.5), (2, 7.0)]


def test_columns_widen_and_are_added(spark, tmp_path):
    path = str(tmp_path / "t")
    load_curated(spark.createDataFrame([(1, "a", 2**53)], "n int, `s x` string, big long"), path, "b1", "2024-01-01")
    load_curated(spark.createDataFrame([(2**40, 5)], "n long, big int"), path, "b2", "2024-01-01")
    load_curated(spark.createDataFrame([(1.5, True, None)], "n double, flag boolean, big long"), path, "b1", "2024-01-02")
    load_curated(spark.createDataFrame([(7,)], "n int"), path, "b4", "2024-01-03")
    rows = read_curated(spark, path)
    assert rows.dtypes == [("n", "double"), ("s x", "string"), ("big", "bigint"), ("flag", "boolean"), ("ingest_date", "date"), ("batch_id", "string")]
    want = {(1.0, "a", 2**53, None), (2.0**40, None, 5, None), (1.5, None, None, True), (7.0, None, None, None)}
    assert {tuple(r)[:4] for r in rows.collect()} == want and rows.count() == 4
    load_curated(spark.createDataFrame([(3,)], "n long"), path, "b1", "2024-01-02")
    assert {r.n for r in read_curated(spark, path).collect()} == {1.0, 2.0**40, 3.0, 7.0}


@pytest.mark.parametrize(("first", "second"), [("long", "double"), ("double", "long")])
def test_whole_numbers_beyond_a_double_are_not_widened(spark, tmp_path, first, second):
    path, value = str(tmp_path / "t"), {"long": 2**53 + 1, "double": 0.5}
    load_curated(spark.createDataFrame([(value[first],)], f"n {first}"), path, "b1", "2024-01-01")
    with pytest.raises(ValueError, match="a double cannot; nothing was written"):
        load_curated(spark.createDataFrame([(value[second],)], f"n {second}"), path, "b2", "2024-01-01")
    assert [r.n for r in read_curated(spark, path).collect()] == [value[first]]


def test_tables_without_schema_records_are_read_from_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "b1", "x")], "n long, batch_id string, ingest_date string").write.partitionBy("ingest_date", "batch_id").parquet(path)
    assert read_curated(spark, path).count() == 1


def test_members_of_one_name_stay_apart(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a/x.csv", "id,name\n1,tug\n2,ferry\n")
        z.writestr("b/x.csv", "city,email,flag\nRiga,a@quay.org,1\nKiel,b@quay.org,0")
        z.writestr("b/y.csv", "")
    zones = N.Zones(str(tmp_path / "zones"))
    N.take_files(spark, [("port", "zip", f"file:{tmp_path}/two.zip")], zones, day="2024-01-01")
    jobs = [r for r in current_jobs(spark.read.parquet(zones.jobs)).collect() if r.dataset == "x"]
    assert sorted(r.schema for r in jobs) == ['{"city": "STRING", "email": "STRING", "flag": "BOOLEAN"}', '{"id": "INT64", "name": "STRING"}']
    assert sorted(r.masked for r in jobs) == ['{"email": "email"}', "{}"] and {r.status for r in jobs} == {"LOADED"}
    rows = read_curated(spark, zones.curated("x")).collect()
    assert sorted((r.id, r.name) for r in rows if r.id) == [(1, "tug"), (2, "ferry")]
    assert sorted((r.city, r.flag) for r in rows if r.city) == [("Kiel", False), ("Riga", True)]
    assert all(r.email.endswith("@masked.invalid") for r in rows if r.city)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pieces_make_up_the_member(spark, tmp_path, piece):
    bodies = {"d/a.csv": b"x\ny\n" * 50 + b"z", "e.json": bytes(range(256)) * 40, "f.ndjson": b"\n", ".g.csv": b"no", "h.txt": b"no", "i.csv": b""}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in bodies.items():
            z.writestr(name, body)
    ship_package(spark)
    got = {}
    for r in member_pieces(spark, [f"file:{tmp_path}/a.zip"], piece).orderBy("number", "piece").collect():
        got[r.member] = got.get(r.member, b"") + bytes(r.content) + bytes([r.ending])
    assert got == {k: v for k, v in bodies.items() if k in ("d/a.csv", "e.json", "f.ndjson")}


def test_each_file_is_loaded_once_whatever_the_checkpoint(spark, tmp_path):
    source, target, ddl = str(tmp_path / "silver"), str(tmp_path / "t"), "k long"

    def add(*keys):
        spark.createDataFrame([(k,) for k in keys], ddl).coalesce(1).write.mode("append").parquet(source)

    def load(state):
        N.stream_load(spark, source, ddl, target, str(tmp_path / state)).awaitTermination()
        return sorted((r.k, r.batch_id) for r in read_curated(spark, target).collect())

    add(1, 2)
    assert load("a") == [(1, "batch-0"), (2, "batch-0")]
    add(3)
    assert load("b") == [(1, "batch-0"), (2, "batch-0"), (3, "batch-1")] == load("c")
    add(4)
    want = [(1, "batch-0"), (2, "batch-0"), (3, "batch-1"), (4, "batch-3")]
    assert load("a") == want
    # A stream that wrote rows and broke off before it said so: its partition goes, its files are loaded by the next.
    add(5)
    broken = Loads(spark, target)
    name = broken.begin("gone", 0)
    broken.intend(name, "gone", 0, spark.read.parquet(source).where("k = 5").select(F.col("_metadata.file_path").alias("__file")))
    load_curated(spark.createDataFrame([(5,), (5,)], ddl), target, name, "1970-01-01")
    assert [k for k, _ in load("d")] == [1, 2, 3, 4, 5]
    # A batch replayed by its own stream replaces its partition.
    again = Loads(spark, target)
    run = spark.read.parquet(again.path).where("name = 'batch-1' and run is not null").first()
    assert again.begin(run.run, run.number) == "batch-1"


def test_expired_days_are_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-20')) AS ingest_date, 1 AS x").write.partitionBy("ingest_date").parquet(path)
    (tmp_path / "t" / "ingest_date=other").mkdir()
    told = drop_expired(spark, path, datetime.date(2024, 1, 20), 14).collect()
    assert len(told) == 20 and sum(r.dropped for r in told) == 5
    left = sorted(p.name for p in (tmp_path / "t").glob("ingest_date=*"))
    assert left[0] == "ingest_date=2024-01-06" and len(left) == 16
    assert drop_expired(spark, str(tmp_path / "none"), datetime.date(2024, 1, 20), 14).count() == 0


def test_a_file_without_a_data_row_is_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v\n")
    record = N.ingest_file(spark, str(tmp_path / "a.csv"), "csv", "d", "j1", N.Zones(str(tmp_path / "z")))
    assert record["status"] == "REJECTED" and "empty" in record["error"]


def plain_walk(changes, state):
    """Judge changes one after the other."""
    now, out = dict(state), []
    for job, seq, wanted in sorted(changes, key=lambda c: (c[0], c[1])):
        status, seen = now.get(job, (None, -1))
        accepted = seq > seen and E.open_after(status, wanted)
        if accepted:
            now[job] = wanted, seq
        out.append((job, seq, wanted, accepted, now.get(job, (None, -1))[0]))
    return sorted(out, key=str), now


@pytest.mark.parametrize("cuts", [1, 6])
def test_hot_jobs_are_judged_in_slices(spark, cuts):
    """Half of all changes belong to one job; slices of it are judged apart and give what one walk gives."""
    draw = random.Random(4)
    likely = ["UPLOADING", "VALIDATING", "TRANSFORMING", "FAILED", "REJECTED"]
    changes = [("hot" if draw.random() < 0.5 else f"j{draw.randrange(40)}", i, draw.choice(likely if i % 50 else ["LOADED"])) for i in range(1500)]
    changes = [c if c[0] != "hot" or c[2] != "LOADED" else (c[0], c[1], "FAILED") for c in changes]
    state = {"hot": ("VALIDATING", 40), "j1": ("LOADED", 5), "gone": ("FAILED", 9)}
    made = spark.createDataFrame(changes, "job_id string, seq long, status string").repartition(5)
    held = spark.createDataFrame([(k, *v) for k, v in state.items()], "job_id string, status string, seen long")
    judged, after = E.judge_changes(made, held, cuts)
    want, now = plain_walk(changes, state)
    assert sorted((tuple(r) for r in judged.collect()), key=str) == want
    assert {r.job_id: (r.status, r.seen) for r in after.collect()} == now
    assert sum(w[3] for w in want if w[0] == "hot") > 50


def test_changes_without_a_job_or_number_are_refused(spark):
    rows = [(None, 1, "UPLOADING"), ("j", None, "UPLOADING"), ("j", -5, "UPLOADING"), ("j", 2, None), ("j", 3, "UPLOADING"), ("j", 3, "VALIDATING"), ("j", 3, "UPLOADING")]
    state = spark.createDataFrame([], "job_id string, status string, seen long")
    judged, after = E.judge_changes(spark.createDataFrame(rows, "job_id string, seq long, status string"), state)
    got = [tuple(r) for r in judged.collect()]
    assert len(got) == 7 and sum(r[3] for r in got) == 1
    assert [tuple(r) for r in after.collect()] == [("j", "UPLOADING", 3)]
    assert E.judge_changes(judged.where("seq > 99").select("job_id", "seq", "status"), state)[0].count() == 0


def test_state_machine_accepts_only_expected_changes(spark, tmp_path):
    steps = [("j", 1, "VALIDATING"), ("j", 2, "UPLOADING"), ("j", 3, "VALIDATING"), ("j", 4, "VALIDATING"), ("j", 5, "LOADED"), ("k", 6, "UPLOADING")]
    path = str(tmp_path / "log")
    spark.createDataFrame(steps, "job_id string, seq long, status string").coalesce(1).write.parquet(path)

    def run():
        changes = spark.readStream.schema("job_id string, seq long, status string").parquet(path)
        E.guard_stream(changes, str(tmp_path / "out"), str(tmp_path / "states"), str(tmp_path / "state")).awaitTermination()

    run()
    judged = {r["seq"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert judged == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}
    # The state is kept: a redelivery of an old change is not accepted again.
    spark.createDataFrame([("k", 6, "UPLOADING"), ("k", 7, "VALIDATING")], "job_id string, seq long, status string").write.mode("append").parquet(path)
    run()
    rows = [(r["seq"], r["accepted"]) for r in spark.read.parquet(str(tmp_path / "out")).where("job_id = 'k'").orderBy("seq", F.desc("accepted")).collect()]
    assert rows == [(6, True), (6, False), (7, True)]


def test_windows_add_up(spark, tables, tmp_path):
    counts = E.windowed_counts(E.read_events(spark, tables.folder))
    stream = counts.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("w").agg(F.sum("n_events").alias("n")).first()["n"] == tables.events.count()


def test_retention(spark):
    df = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-03-01')) AS day")
    today = F.lit("2024-03-01").cast("date")
    assert retained(df, "rejected", "day", today).count() == 15
    assert retained(df, "gold", "day", today).count() == df.count()
