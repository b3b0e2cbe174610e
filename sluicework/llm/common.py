"""What several of these operators need: reading, row numbers at any size, a bounded word memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicework.session import cut_lineage, ship_package


AT_ONCE = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; the workers get this package, since its functions run in tasks."""
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def task_count(df: DataFrame) -> int:
    """Partitions for a shuffle that carries whole rows: the session's number, or one for each split of the scan."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over the rows, at most ``AT_ONCE`` of an Arrow batch at a time, so that few texts are held as Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), AT_ONCE):
                made = fn(batch.slice(at, AT_ONCE))
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 in the given order, however large a group is.

    Rows are range-partitioned by the order and stored once. Each partition numbers its own
    part of a group, starting from the prefix sum of what earlier partitions hold of it. Ties
    are told apart by the row's place in the input, so a hot key is split like any other.
    Columns whose name begins with ``__`` are reserved.
    """
    keys = [*order, "__row"]
    held = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(task_count(df), *keys)
    held = cut_lineage(held.withColumn("__part", F.spark_partition_id()))
    part = ["__part", *group]
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.groupBy(*part).agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = held.withColumn("__own", F.row_number().over(Window.partitionBy(*part).orderBy(*keys)).cast("long") - 1)
    same = [own[c].eqNullSafe(base[c]) for c in part]
    joined = own.join(base, same)
    return joined.select(*[own[c] for c in df.columns], (F.col("__base") + F.col("__own")).alias(name))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class WordMemory:
    """word -> value for the words met lately; bounded by two generations of ``limit`` short words.

    Values come from ``make(list of unknown words)``. Running text repeats its words, so most
    of them are worked out once for each Python worker. Words beyond ``longest`` are worked
    out where they stand and not kept.
    """

    def __init__(self, make: Callable[[list], list], limit: int = 300_000, longest: int = 48):
        self.make, self.limit, self.longest = make, limit, longest
        self.known: dict = {}
        self.older: dict = {}

    def over(self, words: Sequence) -> list:
        """The value of each word, in order."""
        known, older, brief = self.known, self.older, {}
        missing = set(words).difference(known)
        if missing:
            fresh = [w for w in missing if w not in older]
            if len(fresh) < len(missing):
                known.update((w, older[w]) for w in missing if w in older)
            for at in range(0, len(fresh), 20_000):
                piece = fresh[at : at + 20_000]
                for word, value in zip(piece, self.make(piece), strict=True):
                    (known if len(word) <= self.longest else brief)[word] = value
        values = [known[w] if w in known else brief[w] for w in words] if brief else list(map(known.__getitem__, words))
        if len(known) > self.limit:
            self.known, self.older = {}, known
        return values
