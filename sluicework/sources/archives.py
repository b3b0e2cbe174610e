"""ZIP archives as a data source: one partition for each member, read in pieces.

The driver reads an archive's central directory only. A member is known by its place and full
path in the archive, so members of equal name stay apart, and neither an archive nor a member
is ever held as a whole. Every row is a piece that ends before the member's closing byte, so
that Spark's text writer can write the pieces of a member with that byte as the separator.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluicework.sources.files import CONTENT_TYPES

PIECE = 1 << 20
COLUMNS = "archive string, number int, member string, ending int, piece long, content binary"


def opened(path: str):
    """A file that can be entered anywhere, in a mounted folder or a store that Arrow knows."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    system, inner = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inner)


def supported(info: zipfile.ZipInfo) -> bool:
    """A visible member of a format that can be loaded; members without a byte are left out."""
    name = info.filename.rsplit("/", 1)[-1]
    return not info.is_dir() and not name.startswith((".", "__")) and name.rsplit(".", 1)[-1].lower() in CONTENT_TYPES and info.file_size > 0


@dataclass
class Member(InputPartition):
    archive: str
    number: int


def pieces(archive: zipfile.ZipFile, info: zipfile.ZipInfo, size: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(closing byte, piece without it) of a member: the pieces joined by that byte, and closed by it, are the member.

    The member is read twice, first for its last byte. A piece grows beyond ``size`` only
    while that byte does not occur.
    """
    with archive.open(info) as stream:
        last = b""
        while part := stream.read(size):
            last = part[-1:]
    with archive.open(info) as stream:
        held = b""
        while part := stream.read(size):
            held += part
            if len(held) > size:
                stop = held.rfind(last, 0, len(held) - 1)
                if stop >= 0:
                    yield last[0], held[:stop]
                    held = held[stop + 1 :]
        yield last[0], held[:-1]


class MembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.size = json.loads(options["archives"]), int(options.get("piece", PIECE))

    def partitions(self) -> list[Member]:
        found = []
        for path in self.paths:
            with opened(path) as file, zipfile.ZipFile(file) as archive:
                found += [Member(path, k) for k, info in enumerate(archive.infolist()) if supported(info)]
        return found or [Member("", -1)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        with opened(partition.archive) as file, zipfile.ZipFile(file) as archive:
            info = archive.infolist()[partition.number]
            for k, (ending, content) in enumerate(pieces(archive, info, self.size)):
                cells = [partition.archive, partition.number, info.filename, ending, k, content]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return MembersReader(self.options)


def member_pieces(spark: SparkSession, archives: list[str], piece: int = PIECE) -> DataFrame:
    """(archive, number, member, ending, piece, content) of all supported members, one task for each member."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("archives", json.dumps(archives)).option("piece", str(piece)).load()
