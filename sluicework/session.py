"""Session defaults, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sluicework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC clock, adaptive plans)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local folder is made up only in local mode, where one machine is the cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="sluicework-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/sluicework/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store the rows as a table in the shared folder and read them from there.

    They survive executor loss and are not computed again. Being Parquet, later reads
    skip unused columns, and the known size lets Spark broadcast small tables.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)



def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session.

    Functions that run in tasks are pickled by reference, so the workers must be able to
    import them wherever the driver was started.
    """
    context = spark.sparkContext
    if getattr(context, "_sluicework_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    # Below the folder from which Spark serves the driver's files; Spark removes it with the session.
    folder = pathlib.Path(SparkFiles.getRootDirectory(), "shipped")
    folder.mkdir(parents=True, exist_ok=True)
    context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", package.parent, package.name))
    context._sluicework_shipped = True
