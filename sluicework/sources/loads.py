"""Which files a curated table already holds, and dropping partitions that should not stay."""

from __future__ import annotations

import datetime
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "name string, run string, number long, state string, __file string, seq long"


class Loads:
    """A ledger of batches beside a table, in ``<table>/_loads``.

    A batch is INTENDED with its files before its rows are written and DONE after that; one
    found INTENDED by another batch was left by a stream that ended in between, and is DROPPED.
    """

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table, self.path = spark, table, f"{table}/_loads"

    def _entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(ENTRY).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], ENTRY)

    def _states(self) -> DataFrame:
        return self._entries().groupBy("name").agg(
            F.max_by("state", "seq").alias("state"), F.max("run").alias("run"), F.max("number").alias("number")
        )

    def begin(self, run: str, number: int) -> str:
        """The name of this batch of a run: the one it was given before, or the next; unfinished batches of others go."""
        states = self._states()
        own = (F.col("run") == run) & (F.col("number") == number) & (F.col("state") != "DROPPED")
        for r in states.where((F.col("state") == "INTENDED") & ~own).collect():  # at most one for each stream that broke off
            drop_folders(self.spark, f"{self.table}/ingest_date=*/batch_id={r['name']}")
            self._note(self.spark.createDataFrame([(r["name"], None)], "name string, __file string"), "DROPPED")
        kept = states.where(own).first()
        return kept["name"] if kept else f"batch-{states.count()}"

    def finished_files(self, name: str) -> DataFrame:
        """The files that finished batches other than ``name`` hold."""
        done = self._states().where((F.col("state") == "DONE") & (F.col("name") != name)).select("name")
        return self._entries().where("__file is not null").join(done, "name", "left_semi").select("__file").distinct()

    def intend(self, name: str, run: str, number: int, files: DataFrame) -> None:
        rows = files.select(F.lit(name).alias("name"), F.lit(run).alias("run"), F.lit(number).cast("long").alias("number"), "__file")
        head = self.spark.createDataFrame([(name, run, number, None)], "name string, run string, number long, __file string")
        self._note(rows.unionByName(head), "INTENDED")

    def finish(self, name: str) -> None:
        self._note(self.spark.createDataFrame([(name, None)], "name string, __file string"), "DONE")

    def _note(self, rows: DataFrame, state: str) -> None:
        made = rows.withColumns({"state": F.lit(state), "seq": F.unix_micros(F.current_timestamp())})
        names = [c.split()[0] for c in ENTRY.split(", ")]
        made.select(*[F.col(n) if n in made.columns else F.lit(None).cast("string" if n != "number" else "long").alias(n) for n in names]).write.mode("append").parquet(self.path)


def _folders(spark: SparkSession, pattern: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(system, status.getPath()) for status in (system.globStatus(path) or [])]


def drop_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Remove the folders a pattern names; returns them."""
    found = _folders(spark, pattern)
    for system, path in found:
        system.delete(path, True)
    return [path.toString() for _, path in found]


def drop_expired(spark: SparkSession, table: str, today: datetime.date, days: int, column: str = "ingest_date") -> DataFrame:
    """Remove the day partitions of a table that are more than ``days`` old; (day, age_days, dropped) of every one.

    Only folder names are looked at. Folders whose name holds no date stay.
    """
    rows = []
    for system, path in _folders(spark, f"{table}/{column}=*"):
        named = re.fullmatch(rf"{column}=(\d{{4}}-\d{{2}}-\d{{2}})", path.getName())
        if not named:
            continue
        day = datetime.date.fromisoformat(named[1])
        age = (today - day).days
        if age > days:
            system.delete(path, True)
        rows.append((day, age, age > days))
    return spark.createDataFrame(rows, "day date, age_days int, dropped boolean")
