"""Token ids as flat unsigned-integer files with 64-bit document offsets.

``write`` leaves three things below a folder, all through Spark's writers, so any store that
Spark reaches will do and a lost executor leaves nothing half-written:

* ``staged/kind=ids/part-<n>...``: the ids of the documents of range ``n`` in ascending order,
  each document closed by the end id, as little-endian unsigned integers and nothing else;
* ``offsets/part=<n>``: for each of these documents its first id's place in the whole corpus, as
  little-endian 64-bit integers (``staged/kind=documents`` holds the sizes they are made from);
* ``documents``: a table (part, position, doc_id, start, n_tokens).

A file that is only bytes is written as text whose line separator belongs to the data: the end
id closes each document, and the topmost byte of an offset, always zero, closes each offset.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicework.llm.common import WordMemory, map_arrow, task_count
from sluicework.llm.sentencepieces import ship
from sluicework.session import scratch_path


TOGETHER, GROUP_BYTES = 24, 1 << 22


class Tokenizer:
    """A vocabulary of the tokenizers library whose pre-tokeniser never keeps ASCII white space.

    Words between white space are then encoded independently of each other, and each different
    one once for each Python worker. With a normaliser that lower-cases, ASCII letters are
    lower-cased first; with a pre-tokeniser that parts letters from other signs, a full stop or
    comma that ends a word after an ASCII letter is a word of its own. A text that holds the
    string of an added token, in any case of ASCII letters, is encoded whole.
    """

    # The sign comes first, so that the search can skip to it.
    MARKS = re.compile(rb"[.,](?=[ \n]|$)(?<=[A-Za-z][.,])")

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library, self.dtype = Library.from_file(path), dtype
        self.added = [t.content.encode().lower() for t in self.library.get_added_tokens_decoder().values()]
        self.memory = WordMemory(self._cut, limit=400_000)
        normal, cutter = self.library.normalizer, self.library.pre_tokenizer
        self.lowers = normal is not None and normal.normalize_str("Ab Z") == "ab z"
        self.parts = cutter is not None and [p for p, _ in cutter.pre_tokenize_str("ab. cd, ef.")] == ["ab", ".", "cd", ",", "ef", "."]
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends, self.bare = None, None
        if suffix:
            self.ends = np.zeros(self.library.get_vocab_size(), bool)
            for token, k in self.library.get_vocab(with_added_tokens=False).items():
                self.ends[k] = token.endswith(suffix)
        # Where normaliser and pre-tokeniser leave words of small ASCII letters as they are, these need neither.
        letters = "abcdefghijklmnopqrstuvwxyz zyx a"
        if cutter is not None and (normal is None or normal.normalize_str(letters) == letters) and [p for p, _ in cutter.pre_tokenize_str(letters)] == letters.split():
            self.bare = Library.from_file(path)
            self.bare.normalizer, self.bare.pre_tokenizer = None, WhitespaceSplit()

    def _cut(self, words: list[str]) -> list[bytes]:
        """The ids of each word.

        Words of letters alone go to the library ``TOGETHER`` at a time, as one short text: each
        closes at least one token of the kind that ends a word, and where there are as many of
        these as words they part the words. Other words are encoded one by one.
        """
        found: list = [None] * len(words)
        if self.ends is not None:
            letters = [k for k, w in enumerate(words) if w.isalpha()]
            small = [k for k in letters if words[k].isascii() and words[k].islower()] if self.bare else []
            known = set(small)
            self._cut_joint(self.bare, words, small, found)
            self._cut_joint(self.library, words, [k for k in letters if k not in known], found)
        rest = [k for k, f in enumerate(found) if f is None]
        for k, ids in zip(rest, self._ids(self.library, [words[k] for k in rest]), strict=True):
            found[k] = ids.tobytes()
        return found

    def _cut_joint(self, library, words: list[str], chosen: list[int], found: list) -> None:
        groups = [chosen[at : at + TOGETHER] for at in range(0, len(chosen), TOGETHER)]
        for group, ids in zip(groups, self._ids(library, [" ".join([words[k] for k in g]) for g in groups]), strict=True):
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):
                data, start = ids.tobytes(), 0
                for k, stop in zip(group, (stops * ids.itemsize).tolist(), strict=True):
                    found[k] = data[start:stop]
                    start = stop

    def _ids(self, library, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text as bytes."""
        out: list = [b""] * len(texts)
        plain: list[bytes] = []
        places: list[int] = []
        held = 0
        for k, text in enumerate(texts):
            data = text or b""
            small = data.lower()
            if any(a in small for a in self.added):
                out[k] = self._ids(self.library, [data.decode()])[0].tobytes()
                continue
            if self.lowers:
                data = small
            if self.parts:
                data = self.MARKS.sub(rb" \g<0>", data)
            plain.append(data)
            places.append(k)
            held += len(data)
            if held > GROUP_BYTES:
                self._place(out, plain, places)
                plain, places, held = [], [], 0
        self._place(out, plain, places)
        return out

    def _place(self, out: list, texts: list[bytes], places: list[int]) -> None:
        """Cut the texts into words, look each different word up once and lay the ids out in order."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        words = split.flatten().dictionary_encode()  # white space at either end gives an empty word
        different = words.dictionary.to_pylist()
        held: list = list(map(self.memory.known.get, different))
        # Most words are known; only the others go through the memory.
        unknown = list(compress(range(len(held)), map(is_, held, repeat(None))))
        for k, made in zip(unknown, self.memory.over([different[k] for k in unknown]), strict=True):
            held[k] = made
        flat = np.frombuffer(b"".join(held), self.dtype)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // flat.itemsize
        codes = words.indices.to_numpy()
        own = sizes[codes]
        stops = np.cumsum(own)
        starts = np.cumsum(sizes) - sizes
        ids = flat[np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts[codes] - (stops - own), own)]
        ends = np.concatenate(([0], stops))[split.offsets.to_numpy()]
        for k, a, b in zip(places, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = ids[a:b].tobytes()


@lru_cache(maxsize=2)
def _tokenizer(name: str, dtype: str) -> Tokenizer:
    return Tokenizer(SparkFiles.get(name), dtype)


def smallest_type(vocabulary: int) -> str:
    """The smallest little-endian unsigned type that holds the ids below ``vocabulary``."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write(docs: DataFrame, vocabulary_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text, end each with ``end_id`` and write the files below ``folder``; returns the id type.

    Rows are ordered by id, repeated ids by their text; a null id comes first, a null text has
    the end id alone.
    """
    from tokenizers import Tokenizer as Library

    dtype = smallest_type(max(Library.from_file(vocabulary_path).get_vocab_size(), end_id + 1))
    name, closing = ship(docs, vocabulary_path), np.array([end_id], dtype).tobytes()
    width = len(closing)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).withColumn("tie", F.xxhash64("text"))
    order = ["doc_id", "tie"]
    ordered = rows.repartitionByRange(task_count(docs), *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, position = _tokenizer(name, dtype), TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            at = 0
            while at < batch.num_rows:  # texts of about GROUP_BYTES together, or a single longer one
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, "right")))
                piece, at = batch.slice(at, upto - at), upto
                ids = tokenizer.encode(piece.column(1).to_pylist())
                n = len(ids)
                places = range(position, position + n)
                listed = ["%d,%d,%s,%d" % (part, at_of, "" if d is None else d, len(x) // width + 1) for at_of, d, x in zip(places, piece.column(0).to_pylist(), ids, strict=True)]
                position += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["ids"] * n + ["documents"] * n), pa.array([*places] * 2, pa.int64()), pa.array([*ids, *listed], pa.binary())],
                    ["kind", "position", "value"],
                )

    written = ordered.mapInArrow(encode, "kind string, position long, value binary").sortWithinPartitions("kind", "position")
    staged = f"{folder}/staged"
    # ISO-8859-1 names each byte by a character, so any bytes can be the separator.
    written.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("encoding", "ISO-8859-1").option(
        "lineSep", closing.decode("latin-1")
    ).text(staged)
    _index(docs.sparkSession, staged, closing).write.parquet(f"{folder}/documents")
    starts = docs.sparkSession.read.parquet(f"{folder}/documents").select("part", "position", "start")
    digits = F.lpad(F.hex("start"), 16, "0")
    low = F.unhex(F.concat(*[F.substring(digits, at, 2) for at in range(15, 1, -2)]))  # the lower seven bytes, the lowest first
    parts = [r.part for r in starts.select("part").distinct().orderBy("part").collect()]
    starts.repartitionByRange(max(1, len(parts)), "part", "position").sortWithinPartitions("part", "position").select(
        "part", low.cast("string").alias("value")
    ).write.partitionBy("part").option("encoding", "ISO-8859-1").option("lineSep", "\x00").text(f"{folder}/offsets")
    return dtype


def _index(spark: SparkSession, staged: str, closing: bytes) -> DataFrame:
    """(part, position, doc_id, start, n_tokens): a part's base is the prefix sum of the sizes of earlier parts."""
    # A table without rows leaves no folder of either kind, so the parts are chosen by their path.
    lines = spark.read.schema("value string").option("encoding", "ISO-8859-1").option("lineSep", closing.decode("latin-1")).text(staged)
    lines = lines.where("_metadata.file_path like '%/kind=documents/%'")
    cell = F.split("value", ",")
    rows = lines.select(
        cell[0].cast("int").alias("part"), cell[1].cast("long").alias("position"),
        F.when(cell[2] != "", cell[2].cast("long")).alias("doc_id"), cell[3].cast("long").alias("n_tokens"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
        .join(bases, "part")
        .select("part", "position", "doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens")
    )


def files(spark: SparkSession, folder: str, content: bool) -> DataFrame:
    """(part, path, bytes[, content]) of the id files; a part is the number Spark gave the file's task."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/staged").where("path like '%/kind=ids/%'")
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part")
    return found.select(part, "path", F.col("length").alias("bytes"), *(["content"] if content else []))


def read(spark: SparkSession, folder: str, dtype: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    A folder that the executors see as files is memory-mapped; from any other store each file
    comes as one cell, which its range bounds. The crc is over the ids as little-endian
    unsigned 32-bit integers.
    """
    # The files' own scheme tells, as a folder without one lies in the default store.
    found = files(spark, folder, False).select("path").first()
    mapped = found is None or found.path.startswith("file:")

    def from_part(key, found: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        if mapped:
            ids = np.memmap(found["path"].iloc[0].removeprefix("file:").replace("//", "/"), dtype=dtype, mode="r")
        else:
            ids = np.frombuffer(found["content"].iloc[0], dtype)
        starts = (rows["start"] - rows["start"].iloc[0]).to_numpy()
        ends = starts + rows["n_tokens"].to_numpy()
        if ends[-1] != len(ids):
            raise ValueError(f"part {key[0]} holds {len(ids)} ids, its documents {ends[-1]}")
        sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return rows[["doc_id", "start", "n_tokens"]].assign(ids_crc32=sums)

    index = spark.read.parquet(f"{folder}/documents")
    return files(spark, folder, not mapped).groupBy("part").cogroup(index.groupBy("part")).applyInPandas(
        from_part, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


class FlatTokens:
    """Random access for a training loop on a mounted folder: ``tokens[place]`` over all parts, memory-mapped."""

    def __init__(self, folder: str, dtype: str):
        import pyarrow.dataset as ds

        folder = folder.removeprefix("file:").replace("//", "/")
        base = f"{folder}/staged/kind=ids"
        named = sorted(f for f in os.listdir(base) if f.startswith("part-"))
        self.parts = [np.memmap(f"{base}/{f}", dtype=dtype, mode="r") for f in named if os.path.getsize(f"{base}/{f}")]
        self.bases = np.concatenate(([0], np.cumsum([len(p) for p in self.parts])))
        index = ds.dataset(f"{folder}/documents").to_table(columns=["start", "n_tokens"]).to_pandas().sort_values("start")
        self.starts, self.sizes = index["start"].to_numpy(), index["n_tokens"].to_numpy()

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, place: int) -> np.ndarray:
        """The ids of the document at this place of the order."""
        start = self.starts[place]
        part = int(np.searchsorted(self.bases, start, side="right")) - 1
        at = start - self.bases[part]
        return self.parts[part][at : at + self.sizes[place]]


def round_trip(docs: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """Write to a new place of the shared folder and read back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "flat")
    return read(spark, folder, write(docs, vocabulary_path, end_id, folder))
