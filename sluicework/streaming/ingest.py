"""From arriving files to silver and curated tables, in batches or as a stream."""

from __future__ import annotations

import hashlib
import json
import re
import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicework.functions.scalar import dataset_name
from sluicework.operators.cleansing import check_rows, cast_rows, dedup_rows, detect_pii, infer_types, mask_pii, schema_of
from sluicework.session import scratch_path, ship_package
from sluicework.sources.archives import member_pieces
from sluicework.sources.evolution import wider
from sluicework.sources.files import CONTENT_TYPES, list_files, read_raw, validate_files
from sluicework.sources.loads import Loads
from sluicework.sources.sinks import (
    load_batches, load_curated, load_staging, read_curated, reject_records, write_rejects, write_silver,
)
from sluicework.streaming.together import (
    TABLE_TYPES, TEXT_FORMATS, Upload, check_cells, decide_columns, judge_files, name_columns, read_cells, rows_of, same_schema,
)


@dataclass(frozen=True)
class Zones:
    """Root folders of the zones, all on storage every executor can reach."""

    root: str

    def silver(self, dataset: str, job: str | None = None) -> str:
        return f"{self.root}/silver/{dataset}" + (f"/__job={job}" if job else "")

    def rejected(self, dataset: str, job: str | None = None) -> str:
        return f"{self.root}/rejected/{dataset}" + (f"/__job={job}" if job else "")

    def staging(self, dataset: str) -> str:
        return f"{self.root}/staging/{dataset}"

    def curated(self, dataset: str) -> str:
        return f"{self.root}/curated/{dataset}"

    @property
    def expanded(self) -> str:
        return f"{self.root}/expanded"

    @property
    def jobs(self) -> str:
        return f"{self.root}/audit/jobs"

    @property
    def failures(self) -> str:
        return f"{self.root}/audit/failures"


_POSITION = "__position"
_LOG_LOCK, _EXPANDED_LOCK = threading.Lock(), threading.Lock()


@dataclass(frozen=True)
class Cleaned:
    """Result of one batch of rows: both outputs, what was inferred, and the counts."""

    good: DataFrame
    bad: DataFrame
    schema: Mapping[str, str]
    pii: Mapping[str, str]
    stats: Mapping[str, int]


def fit_known(inferred: Mapping[str, str], known: Mapping[str, str]) -> dict[str, str]:
    """Inferred types, widened to those a table already has.

    A batch of zeros and ones alone looks BOOLEAN, whole numbers alone look INT64; in a
    column known as INT64, FLOAT64 or STRING they are read as such.
    """
    # Known column type to the inferred types that fit into it.
    wider = {"bigint": ("INT64", ["BOOLEAN"]), "double": ("FLOAT64", ["BOOLEAN", "INT64"]), "string": ("STRING", ["BOOLEAN", "INT64", "FLOAT64"])}
    fitted = {}
    for c, kind in inferred.items():
        target, fits = wider.get(known.get(c, ""), (kind, []))
        fitted[c] = target if kind in fits else kind
    return fitted


def clean_rows(
    raw: DataFrame, columns: Sequence[str], order_by: Sequence[str], known: Mapping[str, str] | None = None
) -> Cleaned:
    """Mask, infer, remove copies, cast: the order matters, masking sees the raw text.

    The checked rows are written once to the shared folder; good rows, bad rows and
    counts all read that table, so the copies are removed in a single shuffle.
    """
    spark = raw.sparkSession
    # Detection and inference look at the first rows only: one scan fetches them for both.
    head = spark.createDataFrame(raw.orderBy(*order_by).limit(100).collect(), raw.schema)
    pii = detect_pii(head, columns, order_by)
    # A file may come as one task, and masks cost more than the shuffle that deals its rows out.
    masked = mask_pii(raw.repartition(*order_by), pii)
    schema = fit_known(schema_of(infer_types(mask_pii(head, pii), columns, order_by)), known or {})
    total = Observation()
    counted = masked.observe(total, F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "checked")
    check_rows(dedup_rows(counted, columns), schema).write.parquet(path)
    checked = spark.read.parquet(path)
    good, _ = cast_rows(checked.where(F.size("__errors") == 0).select(*columns), schema)
    bad = checked.where(F.size("__errors") > 0).withColumnRenamed("__errors", "errors")
    sizes = checked.agg(
        F.count_if(F.size("__errors") == 0).alias("valid"), F.count_if(F.size("__errors") > 0).alias("rejected")
    ).first()
    stats = batch_stats(total.get["n"], sizes["valid"], sizes["rejected"])
    return Cleaned(good, bad, schema, pii, stats)


def batch_stats(total: int, valid: int, rejected: int) -> dict[str, int]:
    return {
        "total_records": total, "valid": valid, "rejected": rejected,
        "duplicates_removed": total - valid - rejected, "loaded": 0,
    }


def ingest_file(spark: SparkSession, path: str, fmt: str, dataset: str, job_id: str, zones: Zones, content_type: str | None = None) -> dict[str, object]:
    """Validate and clean one upload into silver; returns the job record.

    Types, personal columns and the verdict come from this file alone. A broken file, or one
    without a single good row, is rejected as a whole. Rows are sampled in file order.
    """
    record: dict[str, object] = {"job_id": job_id, "dataset": dataset, "path": path, "format": fmt}
    if fmt not in ("parquet", "avro") or path.lower().endswith(f".{fmt}"):  # unpacked members have no such name: their reader judges them
        checked = validate_files(spark, [path], content_type).select("valid", "error").first()
        if checked is None or not checked["valid"]:
            return {**record, "status": "REJECTED", "error": checked["error"] if checked else "no such file"}
    if fmt in ("parquet", "avro"):
        write_silver(read_raw(spark, [path], fmt), zones.silver(dataset, job_id))
        return {**record, "status": "TRANSFORMING", "error": None}
    raw = read_raw(spark, [path], fmt)
    columns = raw.columns
    cleaned = clean_rows(raw.withColumn(_POSITION, F.monotonically_increasing_id()), columns, [_POSITION], known_types(spark, zones.curated(dataset)))
    record |= {**cleaned.stats, "schema": json.dumps(cleaned.schema), "masked": json.dumps(cleaned.pii)}
    if cleaned.stats["valid"] == 0:
        return {**record, "status": "REJECTED", "error": f"none of the {cleaned.stats['rejected']} records fits the types"}
    if cleaned.stats["rejected"]:
        write_rejects(reject_records(cleaned.bad, job_id, F.current_timestamp()), zones.rejected(dataset, job_id))
    write_silver(cleaned.good, zones.silver(dataset, job_id))
    return {**record, "status": "TRANSFORMING", "error": None}


def known_types(spark: SparkSession, path: str) -> dict[str, str]:
    """Column types of a table that may not exist yet."""
    try:
        return dict(read_curated(spark, path).dtypes)
    except AnalysisException:
        return {}


def record_failures(spark: SparkSession, zones: Zones, failures: Sequence[tuple[str, int, str, str, str]]) -> None:
    """One row (job_id, attempt, dataset, error, path) for each failed attempt; writing an attempt again changes nothing."""
    if not failures:
        return
    rows = spark.createDataFrame(list(failures), "job_id string, attempt long, dataset string, error string, path string")
    rows = rows.withColumn("seq", F.unix_micros(F.current_timestamp()))
    with _LOG_LOCK:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id", "attempt").parquet(zones.failures)


def load_batch(spark: SparkSession, dataset: str, job_id: str, zones: Zones, day: str) -> int:
    """Silver to staging (replaced) to curated (own partition replaced); returns the rows."""
    silver = spark.read.parquet(zones.silver(dataset, job_id))
    load_staging(silver, zones.staging(dataset))
    staged = spark.read.parquet(zones.staging(dataset))
    load_curated(staged, zones.curated(dataset), job_id, day)
    return staged.count()


_JOB = (
    "job_id string, dataset string, path string, format string, status string, error string, total_records long, valid long, "
    "rejected long, duplicates_removed long, loaded long, schema string, masked string"
)


def job_name(dataset: str, path: str) -> str:
    """The id of an upload's job: the same file has the same job, whenever and wherever it is seen."""
    return f"{dataset}-{hashlib.sha256(re.sub('^file:/+', 'file:/', path).encode()).hexdigest()[:20]}"


def _log(spark: SparkSession, zones: Zones, records: Sequence[Mapping[str, object]]) -> None:
    if not records:
        return
    names = [c.split()[0] for c in _JOB.split(", ")]
    rows = [(*[r.get(n) for n in names], i) for i, r in enumerate(records)]
    stamped = spark.createDataFrame(rows, f"{_JOB}, step long").withColumn("updated_at", F.current_timestamp())
    # Records of one call share a time: their order tells them apart.
    with _LOG_LOCK:  # two appends to one folder at a time would clear each other's pending files
        stamped.withColumn("seq", F.unix_micros("updated_at") + F.col("step")).drop("step").write.mode("append").parquet(zones.jobs)


def _known_jobs(spark: SparkSession, zones: Zones, ids: Sequence[str] | None = None) -> dict[str, dict]:
    """The named jobs (all that wait in UPLOADING by default): last record, day of arrival, attempts so far."""
    try:
        log = spark.read.schema(f"{_JOB}, updated_at timestamp, seq long").parquet(zones.jobs)
    except AnalysisException:
        return {}
    log = log.where(F.col("job_id").isin(list(ids))) if ids is not None else log
    last = F.max_by(F.struct("dataset", "path", "format", "status"), "seq").alias("last")
    jobs = log.groupBy("job_id").agg(
        last, F.to_date(F.min("updated_at")).cast("string").alias("day"), F.count_if(F.col("status") == "UPLOADING").alias("attempts")
    )
    jobs = jobs.where("last.status = 'UPLOADING'") if ids is None else jobs
    return {r.job_id: {**r["last"].asDict(), "day": r.day, "attempts": r.attempts} for r in jobs.collect()}  # the files of a batch


def take_files(spark: SparkSession, uploads: Sequence[tuple[str, str, str]], zones: Zones, load: bool = True, day: str | None = None, again: bool = False) -> None:
    """Run each upload (dataset, format, path) as its own job.

    A job is logged as UPLOADING before anything else; that entry fixes the day of its curated
    partition. Jobs that ended before are left alone, so a replay, on another day or with a new
    checkpoint, changes nothing; ``again`` runs jobs that wait in UPLOADING. A file that raises
    is FAILED, and the others go on. Text files are cleaned together (:func:`run_together`), in
    order of their path, since each adapts to the table the earlier ones leave; ZIP files are
    unpacked together (:func:`open_together`), and other files run one by one, datasets side by side.
    """
    known = _known_jobs(spark, zones, [job_name(d, p) for d, _, p in uploads])
    fresh = sorted({(d, f, p) for d, f, p in uploads if job_name(d, p) not in known})
    _log(spark, zones, [{"job_id": job_name(d, p), "dataset": d, "path": p, "format": f, "status": "UPLOADING"} for d, f, p in fresh])
    waiting = [u for u in uploads if again or job_name(u[0], u[2]) not in known or known[job_name(u[0], u[2])]["status"] not in ENDED]
    known |= _known_jobs(spark, zones, [job_name(d, p) for d, _, p in fresh]) if fresh else {}
    taken = sorted(set(waiting), key=lambda u: (u[0], u[2]))
    texts = [Upload(job_name(d, p), d, f, p, day or known[job_name(d, p)]["day"]) for d, f, p in taken if f in TEXT_FORMATS]
    alone = run_together(spark, zones, texts, known, load)
    children, shut = open_together(spark, zones, [u for u in taken if u[1] == "zip"], known)
    by_dataset: dict[str, list] = {}
    for d, f, p in taken:
        if f not in (*TEXT_FORMATS, "zip") or job_name(d, p) in alone | shut:
            by_dataset.setdefault(d, []).append((f, p))

    def run(dataset: str) -> None:
        for fmt, path in by_dataset[dataset]:
            job = job_name(dataset, path)
            found = known[job]
            children.extend(_run_job(spark, zones, job, dataset, fmt, path, load, day or found["day"], found))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(run, by_dataset))
    if children:
        take_files(spark, children, zones, load, day)


def run_together(spark: SparkSession, zones: Zones, uploads: Sequence[Upload], known: Mapping[str, Mapping], load: bool) -> set[str]:
    """Validate, clean and load text files in common jobs and log their states; returns the jobs to be run alone.

    Those are the jobs of a group that raised: one by one, only the file at fault will fail.
    """
    if not uploads:
        return set()
    records: dict[str, list[dict[str, object]]] = {}
    for u in uploads:
        about = {"job_id": u.job, "dataset": u.dataset, "path": u.path, "format": u.format}
        records[u.job] = [{**about, "status": "VALIDATING"}] if known[u.job]["status"] == "UPLOADING" else []

    def end(u: Upload, status: str, error: str | None = None, loaded: int = 0) -> None:
        record: dict[str, object] = {"job_id": u.job, "dataset": u.dataset, "path": u.path, "format": u.format, "status": status, "error": error}
        if u.columns and status != "FAILED":
            stats = {**batch_stats(u.total, u.valid, u.rejected), "loaded": loaded}
            record |= {**stats, "schema": json.dumps(u.schema), "masked": json.dumps(u.masked)}
        records[u.job].append(record)

    alone: set[str] = set()
    try:
        judge_files(spark, uploads)
        sound = [u for u in uploads if u.error is None]
        for u in uploads:
            if u.error is not None:
                end(u, "REJECTED", u.error)
        checked, refused = _check_together(spark, zones, sound, load) if sound else (None, {})
    except Exception:  # noqa: BLE001  a file that cannot be read is found by running each alone
        return {u.job for u in uploads}
    for u in sound:
        if u.valid == 0:
            end(u, "REJECTED", f"none of the {u.rejected} records fits the types")

    def write(group: list[Upload]) -> None:
        dataset, jobs = group[0].dataset, [u for u in group if u.job not in refused]
        try:
            if any(u.rejected for u in group):
                bad = reject_records(rows_of(checked, group, False).drop("__day"), F.col("__job"), F.current_timestamp())
                _by_job(bad).json(zones.rejected(dataset))
            good = rows_of(checked, group, True)
            _by_job(good.drop("__day")).option("compression", "snappy").parquet(zones.silver(dataset))
            if load and jobs:
                load_staging(rows_of(checked, jobs, True), zones.staging(dataset))
                load_batches(spark.read.parquet(zones.staging(dataset)), zones.curated(dataset))
        except Exception:  # noqa: BLE001  one of the group's files is at fault
            alone.update(u.job for u in group)
            return
        for u in group:
            end(u, "TRANSFORMING")
            if load:
                end(u, "FAILED", refused[u.job]) if u.job in refused else end(u, "LOADED", None, u.valid)

    by_dataset: dict[str, list[list[Upload]]] = {}
    for group in same_schema([u for u in sound if u.valid]):
        by_dataset.setdefault(group[0].dataset, []).append(group)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda groups: [write(g) for g in groups], by_dataset.values()))
    done = [u for u in uploads if u.job not in alone]
    failed = [(u.job, known[u.job]["attempts"], u.dataset, str(records[u.job][-1]["error"]), u.path) for u in done if records[u.job][-1]["status"] in ("REJECTED", "FAILED")]
    record_failures(spark, zones, failed)
    _log(spark, zones, [r for u in done for r in records[u.job]])
    return alone


def _by_job(df: DataFrame) -> DataFrameWriter:
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__job")


def _check_together(spark: SparkSession, zones: Zones, uploads: Sequence[Upload], load: bool) -> tuple[DataFrame, dict[str, str]]:
    """(checked rows, jobs the table will not take with the reason); the uploads know their columns, types and counts.

    Types are fitted to the table as the files before leave it. A file that turns out to have no
    good row leaves nothing, so the fit is repeated without it where that changes a type.
    """
    rows = name_columns(read_cells(spark, uploads), uploads)
    decide_columns(rows, uploads)
    inferred = {u.job: u.schema for u in uploads}
    tables = {d: known_types(spark, zones.curated(d)) for d in {u.dataset for u in uploads}}
    checked, empty = None, set()
    while True:
        refused, held = {}, {d: dict(t) for d, t in tables.items()}
        before = [u.types for u in uploads]
        for u in sorted(uploads, key=lambda u: (u.dataset, u.path)):
            table = held[u.dataset]
            u.types = list(fit_known(inferred[u.job], table).values())
            if u.job in empty or not load:
                continue
            kinds = {c: TABLE_TYPES[k] for c, k in u.schema.items()}
            wrong = [c for c, k in kinds.items() if wider(table.get(c, k), k) is None]
            if wrong:
                refused[u.job] = f"column {wrong[0]} is {kinds[wrong[0]]}, the table {zones.curated(u.dataset)} has {table[wrong[0]]}; nothing was written"
            else:
                table.update({c: wider(table.get(c, k), k) for c, k in kinds.items()})
        if checked is not None and before == [u.types for u in uploads]:
            return checked, refused
        checked = check_cells(rows, uploads)
        empty = {u.job for u in uploads if u.valid == 0}
        if not empty:
            return checked, refused


def _unpacked(about: Mapping[str, object], inside: Sequence) -> dict[str, object]:
    """The last record of an archive's job."""
    return {**about, "status": "LOADED", "loaded": 0} if inside else {**about, "status": "REJECTED", "error": "the archive holds no supported file"}


def open_together(spark: SparkSession, zones: Zones, archives: Sequence[tuple[str, str, str]], known: Mapping[str, Mapping]) -> tuple[list[tuple[str, str, str]], set[str]]:
    """Unpack ZIP uploads in common jobs and log their states; returns the uploads inside and the jobs to be run alone.

    As in :func:`run_together`, those are the jobs of a group that raised.
    """
    by_job = {job_name(d, p): (d, f, p) for d, f, p in archives}
    if not by_job:
        return [], set()
    try:
        found = unpack_archives(spark, {job: p for job, (_, _, p) in by_job.items()}, zones.expanded)
    except Exception:  # noqa: BLE001  an archive that cannot be read is found by opening each alone
        return [], set(by_job)
    records, failed = [], []
    for job, (d, f, p) in by_job.items():
        about = {"job_id": job, "dataset": d, "path": p, "format": f}
        ended = _unpacked(about, found[job])
        records += [{**about, "status": "VALIDATING"}] if known[job]["status"] == "UPLOADING" else []
        records.append(ended)
        if ended["status"] == "REJECTED":
            failed.append((job, known[job]["attempts"], d, str(ended["error"]), p))
    record_failures(spark, zones, failed)
    _log(spark, zones, records)
    return [u for inside in found.values() for u in inside], set()


# The states that end a job.
ENDED = ("LOADED", "REJECTED", "FAILED")


def _run_job(spark: SparkSession, zones: Zones, job: str, dataset: str, fmt: str, path: str, load: bool, day: str, found: Mapping) -> list[tuple[str, str, str]]:
    """One job from VALIDATING to its end; the uploads an archive holds are returned."""
    about = {"job_id": job, "dataset": dataset, "path": path, "format": fmt}
    records: list[dict[str, object]] = [{**about, "status": "VALIDATING"}] if found["status"] == "UPLOADING" else []
    inside: list[tuple[str, str, str]] = []
    try:
        if fmt == "zip":
            inside = unpack_archives(spark, {job: path}, zones.expanded)[job]
            ended = _unpacked(about, inside)
        else:
            ended = ingest_file(spark, path, fmt, dataset, job, zones, CONTENT_TYPES.get(fmt))
            if load and ended["status"] == "TRANSFORMING":
                records.append(ended)
                ended = {**ended, "status": "LOADED", "loaded": load_batch(spark, dataset, job, zones, day)}
    except Exception as error:  # noqa: BLE001  whatever went wrong belongs to this job alone
        ended = {**about, "status": "FAILED", "error": str(error)[:2000]}
    records.append(ended)
    if ended["status"] in ("REJECTED", "FAILED"):
        record_failures(spark, zones, [(job, found["attempts"], dataset, str(ended["error"]), path)])
    _log(spark, zones, records)
    return inside


def unpack_archives(spark: SparkSession, archives: Mapping[str, str], folder: str, prefix: str = "") -> dict[str, list[tuple[str, str, str]]]:
    """Write the members of archives (job to path) to the shared folder, byte for byte; returns each job's members as uploads.

    Each member has a folder of its own, named by its job and by its place and full path in the
    archive. Its pieces are written in order by Spark's text writer, which closes each with the
    member's last byte: one write for each different last byte, whatever the number of archives.
    ``prefix`` goes before the dataset names.
    """
    ship_package(spark)
    owners = {hashlib.md5(job.encode()).hexdigest(): job for job in archives}
    jobs = spark.createDataFrame([(archives[job], key) for key, job in owners.items()], "archive string, job string")
    held = member_pieces(spark, sorted(set(archives.values()))).join(F.broadcast(jobs), "archive")
    name = F.element_at(F.split("member", "/"), -1)
    held = held.withColumns({
        "dataset": F.concat(F.lit(prefix), dataset_name(name)), "fmt": F.lower(F.element_at(F.split("member", r"\."), -1)),
        "file": F.md5(F.concat_ws(":", F.col("number").cast("string"), "member")),
    })
    keys = ["job", "dataset", "fmt", "file"]
    # Only names are kept of this first read.
    members = held.select("ending", *keys).distinct().collect()
    found: dict[str, list[tuple[str, str, str]]] = {job: [] for job in archives}
    for ending in sorted({r.ending for r in members}):  # at most 256
        target = f"{folder}/ending={ending}"
        part = held.where(F.col("ending") == ending).select(F.col("content").cast("string").alias("value"), *keys, "piece")
        # A member is one partition of the source, so its pieces stay together and only have to keep their order.
        writer = part.sortWithinPartitions(*keys, "piece").drop("piece").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
        with _EXPANDED_LOCK:  # as for the log: archives opened alone, side by side, write to one folder
            writer.option("encoding", "ISO-8859-1").option("lineSep", bytes([ending]).decode("latin-1")).text(target)
        for r in members:
            if r.ending == ending:
                found[owners[r.job]].append((r.dataset, r.fmt, f"{target}/job={r.job}/dataset={r.dataset}/fmt={r.fmt}/file={r.file}"))
    return found


def resume(spark: SparkSession, zones: Zones, load: bool = True, day: str | None = None) -> int:
    """Run the jobs that wait in UPLOADING, such as those set back by ``retriggers``; returns their number."""
    waiting = _known_jobs(spark, zones)
    take_files(spark, [(j["dataset"], j["format"], j["path"]) for j in waiting.values()], zones, load, day, again=True)
    return len(waiting)


def stream_ingest(
    spark: SparkSession, inbox: str, zones: Zones, checkpoint: str, files_per_batch: int = 1000, load: bool = True,
    day: str | None = None,
) -> StreamingQuery:
    """Watch a folder ``<inbox>/<dataset>/…`` and take every new file once, each as its own job.

    The stream carries file names only. Jobs that were set back to UPLOADING run first.
    """
    resume(spark, zones, load, day)
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrivals = (
        spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(inbox)
    )
    dataset = F.split(F.split("path", f"{inbox.rstrip('/').rsplit('/', 1)[-1]}/")[1], "/")[0]
    named = arrivals.select("path", dataset.alias("dataset"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("fmt"))

    def take(batch: DataFrame, number: int) -> None:
        take_files(spark, [(r.dataset, r.fmt, r.path) for r in batch.collect()], zones, load, day)  # at most files_per_batch names

    return (
        named.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
    )


def stream_load(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df, day: str = "1970-01-01", files: str = "*.parquet",
) -> StreamingQuery:
    """Second stage: new silver files go to a curated table, one partition per batch, each file once.

    What has been loaded is known from a ledger beside the table, not from the checkpoint: a
    replayed batch replaces its partition, and a stream with a new checkpoint, which sees all
    files again, takes only those that no finished batch holds. Partitions of batches that
    never finished are dropped. One stream loads a table at a time.
    """
    incoming = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(source)
    named = incoming.select("*", F.col("_metadata.file_path").alias("__file"))
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def take(batch: DataFrame, number: int) -> None:
        loads = Loads(batch.sparkSession, target)
        name = loads.begin(run, number)
        fresh = batch.join(loads.finished_files(name), "__file", "left_anti")
        loads.intend(name, run, number, fresh.select("__file").distinct())
        load_curated(transform(fresh.drop("__file")), target, name, day)
        loads.finish(name)

    return named.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()


def file_jobs(spark: SparkSession, inbox: str) -> DataFrame:
    """The files of a folder as new jobs with the dataset name taken from the file."""
    return list_files(spark, inbox).select("path", "file_name", "length", dataset_name(F.col("file_name")).alias("dataset"))
