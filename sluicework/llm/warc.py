"""WARC archives: written by Spark, indexed, and read by coalesced byte ranges.

``write`` makes one record for each page. Of equal payloads one is kept as a response, the
others become revisits that refer to it and have an HTTP header but no payload. A WARC record
ends with two line ends, so Spark's text writer with that separator writes archives into any
store it reaches, and a lost executor leaves nothing half-written. Archives are not compressed,
as a compressed file can not be entered at an offset.

``index`` walks the records' headers without reading their payloads and gives offset, length,
URL and digest of each. ``read`` takes any selection of that index, joins neighbouring records
of an archive to ranges, and reads each range at once, in the order of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicework.session import cut_lineage

# The alphabet of RFC 4648, the revisit profile and line ends of the WARC format.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"

SALTS = 16
INDEX = "path string, offset long, length long, url string, digest string, record_type string, page_id long, refers_to long"
RECORD = "path string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string's UTF-8 bytes in bare upper-case base32: five hexadecimal digits are four signs."""
    digits = F.sha1(payload.cast("binary"))
    signs = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(digits, at + 1, 5), 16, 10).cast("int")
        signs += [F.substring(F.lit(ALPHABET), F.shiftright(value, by).bitwiseAND(31) + 1, F.lit(1)) for by in (15, 10, 5, 0)]
    return F.concat(*signs)


def write(
    pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z", file_records: int = 50_000,
) -> None:
    """Archives of at most ``file_records`` records below ``folder``.

    A null html is an empty payload. Among equal payloads of at least ``least_bytes`` bytes the
    rows with the largest id are responses (several if that id is repeated) and all others
    revisit it; rows without an id are always responses that nothing refers to. Control
    characters and blanks in a URL are percent-encoded; a record without a URL has no such field.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload"))
    same = rows.where((F.col("size") >= least_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("kept"))
    # Stored, so that Spark knows its size before it decides whether the payloads have to move.
    same = cut_lineage(same.where("n > 1").select("digest", "kept"))
    same = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.join(same, ["digest", "salt"], "left").withColumn("revisit", F.coalesce(F.col("kept") != F.col("id"), F.lit(False)))
    rows.select(_record(date).alias("value")).write.option("lineSep", END * 2).option("maxRecordsPerFile", file_records).text(f"{folder}/archives")


def _record(date: str) -> Column:
    def field(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(END))

    def name_of(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))

    blank = r"[\x00-\x20\x7f]"
    coded = F.transform(F.split("url", ""), lambda c: F.when(c.rlike(blank), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c))
    url = F.when(F.col("url").rlike(blank), F.array_join(coded, "")).otherwise(F.col("url"))
    revisit = F.col("revisit")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}"), field("Content-Type", "text/html; charset=utf-8"), field("Content-Length", F.col("size").cast("string")), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", name_of(F.col("id"))),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(field("WARC-Target-URI", url)),
        field("WARC-Date", date),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(field("WARC-Refers-To", name_of(F.col("kept"))), field("WARC-Profile", PROFILE))).otherwise(F.lit("")),
        field("Content-Type", "application/http; msgtype=response"),
        field("Content-Length", length.cast("string")),
        F.lit(END), http, F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(END)
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return None if number in ("", "none") else int(number)


def _opened(path: str):
    """An archive as a file that can be entered anywhere."""
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    system, inner = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inner)


def _archives(spark: SparkSession, folder: str, content: bool) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{folder}/archives")
    return found.select("path", "length", F.col("content") if content else F.lit(None).cast("binary").alias("content"))


def reachable(spark: SparkSession, folder: str) -> bool:
    """Whether the archives can be opened at an offset; from any other store an archive comes whole, as one cell."""
    first = _archives(spark, folder, False).select("path").first()
    if first is None or first.path.startswith("file:"):
        return True
    try:
        _opened(first.path).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def headers(file, size: int) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, fields) of each record of an archive; payloads are passed over."""
    at = 0
    while at < size:
        file.seek(at)
        head = file.read(2048)
        while (stop := head.find(b"\r\n\r\n")) < 0:
            more = file.read(len(head))
            if not more:
                raise ValueError(f"the record at {at} has no end of header")
            head += more
        if not head.startswith(b"WARC/1."):
            raise ValueError(f"no record begins at {at}")
        fields = _headers(head[:stop])
        length = stop + 4 + int(fields["content-length"]) + 4
        if at + length > size:
            raise ValueError(f"the record at {at} is cut off")
        yield at, length, fields
        at += length


def index(spark: SparkSession, folder: str, whole: bool | None = None) -> DataFrame:
    """One row for each record of the archives below ``folder``, written to ``folder``/index and read from there.

    ``whole``: read archives as one cell each instead of opening them; by default only where
    they cannot be opened.
    """
    whole = not reachable(spark, folder) if whole is None else whole
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with io.BytesIO(content) if whole else _opened(path) as file:
                    rows: list[tuple] = []
                    for at, length, fields in headers(file, size):
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((path, at, length, fields.get("warc-target-uri"), digest, fields["warc-type"], _page(fields["warc-record-id"]), _page(fields.get("warc-refers-to"))))
                        if len(rows) == 4096:
                            yield _batch(rows, names, INDEX)
                            rows = []
                    if rows:
                        yield _batch(rows, names, INDEX)

    _archives(spark, folder, whole).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [KINDS[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def ranges(selected: DataFrame, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """(path, begin, end, records): selected records of an archive whose distance is at most ``gap`` bytes are read together.

    A range ends at the next multiple of ``most``, so it holds at most that and one record.
    """
    at = Window.partitionBy("path").orderBy("offset")
    end = F.col("offset") + F.col("length")
    before = F.lag(end).over(at)
    apart = before.isNull() | (F.col("offset") - before > gap) | (F.floor(F.col("offset") / most) != F.floor(F.lag("offset").over(at) / most))
    cut = selected.select("path", "offset", "length", F.when(apart, 1).otherwise(0).alias("new"))
    cut = cut.withColumn("range", F.sum("new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("path", "range").agg(
        F.min("offset").alias("begin"), F.max(end).alias("end"), F.sort_array(F.collect_set(F.struct("offset", "length"))).alias("records")
    ).drop("range")


def record(data: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of one record.

    A response's payload is held against its digest. A revisit has no payload; its size and
    digest are those of the payload it stands for.
    """
    stop = data.index(b"\r\n\r\n")
    fields = _headers(data[:stop])
    block = data[stop + 4 : stop + 4 + int(fields["content-length"])]
    http_stop = block.index(b"\r\n\r\n")
    size = int(_headers(block[:http_stop])["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    if fields["warc-type"] == "response":
        payload = block[http_stop + 4 :]
        size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} has the digest {own}, not {digest}")
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _page(fields.get("warc-refers-to")), size, digest, payload


def read(spark: SparkSession, folder: str, selected: DataFrame, whole: bool | None = None, gap: int = 1 << 16, most: int = 1 << 23, task_bytes: int = 1 << 26) -> DataFrame:
    """The records of ``selected``, rows of the index, with their payloads; a row selected twice comes once.

    Ranges are dealt over the session's number of shuffle partitions, or one for each
    ``task_bytes`` of selected records: what is read decides, not the small rows that ask for it.
    """
    whole = not reachable(spark, folder) if whole is None else whole
    names = [c.split()[0] for c in RECORD.split(", ")]
    if whole:
        asked = selected.groupBy("path").agg(F.sort_array(F.collect_set(F.struct("offset", "length"))).alias("records"))
        asked = asked.join(_archives(spark, folder, True).select("path", F.lit(0).cast("long").alias("begin"), F.col("length").alias("end"), "content"), "path")
    else:
        total = selected.agg(F.sum("length")).first()[0] or 0
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
        asked = ranges(selected, gap, most).repartition(tasks, "path", "begin").withColumn("content", F.lit(None).cast("binary"))
    asked = asked.select("path", "begin", "end", "records", "content").sortWithinPartitions("path", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, file = None, None
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    path, begin, end, records, data = (c[k].as_py() for c in batch.columns)
                    if not whole:
                        if path != open_path:
                            if file:
                                file.close()
                            open_path, file = path, _opened(path)
                        file.seek(begin)
                        data = file.read(end - begin)
                    for at in range(0, len(records), 256):
                        rows = []
                        for r in records[at : at + 256]:
                            start = r["offset"] - begin
                            rows.append((path, r["offset"], *record(data[start : start + r["length"]])))
                        yield _batch(rows, names, RECORD)
        finally:
            if file:
                file.close()

    return asked.mapInArrow(run, RECORD)


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, upper(sha1(payload)) AS hex, max(page_id) OVER (PARTITION BY payload) AS kept FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: list_reduce(list_transform(range(5), lambda j: instr('0123456789ABCDEF', hex[5 * i + j + 1]) - 1), lambda a, b: 16 * a + b)) AS fives FROM h),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((fives[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1]), '') AS payload_digest FROM v)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM d"""
