"""SentencePiece ids with the bytes of the original text each piece stands for, and back.

The text is normalised here: at every position the longest key of the model's compiled
character map that starts there is replaced, and each byte of the outcome remembers the source
position it came from. Pieces are cut from the normalised text by a copy of the model without
a normaliser, and their borders are carried back through that record.

No piece has a space sign after another character, so runs that start with space signs are cut
independently of each other, and each different run once for each Python worker. A model
without that property is given its normalised texts whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import WordMemory, map_arrow

SPACE = "▁"
_SPACE = SPACE.encode()
# Piece kinds of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The rules of a compiled character map: source bytes -> replacement, the longest key first.

    The map is a double-array trie of 32-bit units after its size, followed by the
    replacements, each ended by a zero byte. It is read out into a dictionary once.
    """

    def __init__(self, compiled: bytes = b""):
        self.rules: dict[bytes, bytes] = {}
        if compiled:
            size = int.from_bytes(compiled[:4], "little")
            self._read(np.frombuffer(compiled, "<u4", size // 4, 4).tolist(), compiled[4 + size :])
        self.longest = max(map(len, self.rules), default=0)
        firsts = {k.decode("utf-8", "replace")[0] for k in self.rules}
        self.starts = re.compile("[" + "".join(map(re.escape, sorted(firsts))) + "]") if firsts else None

    def _read(self, units: list[int], texts: bytes) -> None:
        def after(at: int) -> int:
            unit = units[at]
            return at ^ ((unit >> 10) << ((unit & 512) >> 6))

        waiting = [(after(0), b"")]
        while waiting:
            base, key = waiting.pop()
            for byte in range(1, 256):
                at = base ^ byte
                if at >= len(units) or units[at] & 0x800000FF != byte:
                    continue
                follow = after(at)
                if units[at] >> 8 & 1:
                    start = units[follow] & 0x7FFFFFFF
                    self.rules[key + bytes([byte])] = texts[start : texts.index(0, start)]
                waiting.append((follow, key + bytes([byte])))

    def units(self, text: str) -> Iterator[tuple[bytes, int | None]]:
        """(bytes, None) for stretches kept as they are, (replacement, source length) for replaced ones."""
        kept = at = 0
        for hit in self.starts.finditer(text) if self.starts else ():
            if hit.start() < at:
                continue
            window = text[hit.start() : hit.start() + self.longest].encode()[: self.longest]
            for size in range(len(window), 0, -1):
                made = self.rules.get(window[:size])
                if made is not None:
                    if kept < hit.start():
                        yield text[kept : hit.start()].encode(), None
                    yield made, size
                    kept = at = hit.start() + len(window[:size].decode("utf-8", "replace"))
                    break
        if kept < len(text):
            yield text[kept:].encode(), None


class Encoder:
    """Encodes and decodes with one model; made once for each Python worker."""

    def __init__(self, model: bytes):
        pieces, normaliser, trainer = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                pieces.append(dict(_fields(value)))
            elif field == 2:
                trainer |= dict(_fields(value))
            elif field == 3:
                normaliser |= dict(_fields(value))
        if trainer.get(24) or any(p.get(3, NORMAL) == USER_DEFINED for p in pieces):
            raise ValueError("models with space signs as suffixes or user-defined pieces are not supported")
        self.map = CharacterMap(normaliser.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        # The same pieces without a normaliser: a later field of a message replaces an earlier one.
        plain = b"\x12\x00\x18\x00\x20\x00\x28\x00"
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a" + bytes([len(plain)]) + plain)
        self.end_id = self.cutter.eos_id()
        kinds = [p.get(3, NORMAL) for p in pieces]
        names = [p[1] for p in pieces]
        self.by_bytes = BYTE in kinds
        self.sizes = np.array([1 if k == BYTE else len(n) for k, n in zip(kinds, names, strict=True)], np.int64)
        unknown = trainer.get(44, " ⁇ ".encode())
        self.shown = [
            b"" if k == CONTROL else unknown if k == UNKNOWN else bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(_SPACE, b" ")
            for k, n in zip(kinds, names, strict=True)
        ]
        self.kinds, self.spaced = kinds, [n.startswith(_SPACE) for n in names]
        self.controls = [i for i, k in enumerate(kinds) if k == CONTROL]
        self.digits = [str(i).encode() for i in range(len(names))]
        normal = [n.decode() for n, k in zip(names, kinds, strict=True) if k == NORMAL]
        self.separable = not any(SPACE in n.lstrip(SPACE) for n in normal)
        # A line end that no piece holds stands alone.
        alone = "" if any("\n" in n for n in normal) else "\n"
        self.runs = re.compile(f"{alone}|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.memory = WordMemory(self._cut)

    def _cut(self, runs: list[str]) -> list[bytes]:
        return [np.array(ids, np.int32).tobytes() for ids in self.cutter.encode(runs, num_threads=1)]

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte it came from."""
        if not text:
            return "", np.zeros(1, np.int64)
        made, origin, at = [], [], 0
        for piece, size in self.map.units(text):
            if size is None:
                data = np.frombuffer(piece, np.uint8)
                place = np.arange(len(data))
                origin.append(at + np.maximum.accumulate(np.where((data & 0xC0) != 0x80, place, 0)))
                at += len(piece)
            else:
                origin.append(np.full(len(piece), at))
                at += size
            made.append(piece)
        data, origin = b"".join(made), np.concatenate(origin)
        if self.squeeze:
            # One space between words, none around them; what is left out has no byte that refers to it.
            flat = np.frombuffer(data, np.uint8)
            space = flat == 32
            keep = ~(space & np.concatenate(([True], space[:-1])))
            kept = np.flatnonzero(keep)
            while len(kept) and space[kept[-1]]:
                at = int(origin[kept[-1]])
                kept = kept[:-1]
            data, origin = flat[kept].tobytes(), origin[kept]
            if not len(kept):
                return "", np.zeros(1, np.int64)
        if self.dummy:
            data = b" " + data
            origin = np.concatenate((origin[:1] if self.squeeze else [0], origin))
        if self.escape:
            origin = np.repeat(origin, np.where(np.frombuffer(data, np.uint8) == 32, len(_SPACE), 1))
            data = data.replace(b" ", _SPACE)
        return data.decode(), np.concatenate((origin, [at]))

    def encode(self, text: str | None, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first and last (exclusive) byte of the source each stands for. The end id stands for nothing."""
        plain, origin = self.normalise(text or "")
        cut = self.memory.over(self.runs.findall(plain)) if self.separable else self._cut([plain])
        ids = np.frombuffer(b"".join(cut), np.int32)
        sizes = self.sizes[ids]
        if sizes.sum() != len(origin) - 1:  # pieces for unknown characters, which only a model without byte pieces gives
            sizes = np.array([len(p.encode()) for p in self.cutter.encode(plain, out_type=str)], np.int64)
        border = np.concatenate(([0], np.cumsum(sizes)))
        places = origin[border]
        if end:
            ids, places = np.append(ids, np.int32(self.end_id)), np.append(places, places[-1])
        return ids, places[:-1], places[1:]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: byte pieces that form no character give one U+FFFD each."""
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        cut = int(first is not None and self.spaced[first] and (self.dummy or self.squeeze))
        if not any(c in ids[:-1] for c in self.controls):
            try:
                return b"".join(map(self.shown.__getitem__, ids))[cut:].decode()
            except UnicodeDecodeError:
                pass
        out, run = [], b""
        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.shown[i]
            else:
                out += [_bytes_to_text(run), self.shown[i].decode()]
                run = b""
        return "".join([*out, _bytes_to_text(run)])[cut:]


def _bytes_to_text(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size if at + size <= len(run) else len(run) - at
    return "".join(out)


@lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    with open(SparkFiles.get(name), "rb") as file:
        return Encoder(file.read())


def ship(df: DataFrame, path: str) -> str:
    """Send a vocabulary file to every executor; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """(id, ids, starts, ends) of every whole text; a null text counts as empty and has the end id alone."""
    name = ship(docs, model_path)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [encoder.encode(t.as_py(), end) for t in part.column(1)]
            offsets = np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate([f[k] for f in found]).astype(np.int32)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["id", "ids", "starts", "ends"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids; a null list gives an empty text."""
    name = ship(encoded, model_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(name)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["id", "text"])

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")), run, "id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long, n_bytes long"


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``encode`` and ``decode`` give for every whole text, as hashes made in the same pass.

    ``spans_crc32`` is over all starts and then all ends as little-endian 64-bit integers,
    ``n_bytes`` the source bytes that the spans cover.
    """
    name = ship(docs, model_path)

    def row(encoder: Encoder, text: str | None) -> tuple:
        ids, starts, ends = encoder.encode(text)
        listed = ids.tolist()
        spans = zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(starts.astype("<i8").tobytes()))
        written = hashlib.sha256(b" ".join(map(encoder.digits.__getitem__, listed))).hexdigest()
        return len(listed), written, hashlib.sha256(encoder.decode(listed).encode()).hexdigest(), spans, int((ends - starts).sum())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(name)
        columns = list(zip(*(row(encoder, t.as_py()) for t in batch.column(1)), strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True))],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", "n_bytes"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, DIGEST)
