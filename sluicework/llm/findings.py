"""Secrets in texts: fixed patterns, and a character network that judges every other candidate.

Candidates are the runs of at least ``SHORTEST`` characters that keys and tokens are made of.
A small convolutional network reads each with its surrounding characters; runs longer than one
body are read in several bodies and the highest score counts. It is trained in numpy on the
findings of the patterns, on copies of them with other values and other surroundings, and on the
runs and stretches that no pattern marks. A bounded sample gives the starting weights only: every
task then goes on from them over all its documents, and the weights of the tasks are averaged.
Scores are calibrated on a quarter of all documents, kept back, and the threshold is the highest
that still recalls the wanted share of the labelled findings there.
"""

from __future__ import annotations

import io
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import AT_ONCE, map_arrow

# Fixed patterns; matching is done on bytes. ASSIGN reads ASCII lower-cased bytes.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
CUES = (b"passw", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "model")

SHORTEST = 16
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
BEFORE, BODY, AFTER = 24, 40, 16
WIDTH = BEFORE + BODY + AFTER
LETTERS, FILTERS, SPAN, DENSE = 10, 20, 5, 20
BLANK, OTHER = 0, 1

_CODES = np.full(256, OTHER, np.uint8)
_CODES[32:127] = np.arange(2, 97)
_CODES[9:14] = 2


def base_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of what the patterns find, per kind leftmost and not overlapping."""
    low, found = data.lower(), []
    if any(cue in low for cue in CUES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(data)]
    return sorted(found, key=_order)


def _order(span: tuple[int, int, str]) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def candidates(data: bytes, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of the runs that no base span touches."""
    found = []
    for m in CANDIDATE.finditer(data):
        if not any(a < m.end() and m.start() < b for a, b, _ in base):
            found.append((m.start(), m.end()))
    return found


def windows(data: bytes, start: int, end: int) -> list[np.ndarray]:
    """The character codes the network reads for one span: blank-padded context, body, context."""
    rows = []
    for at in range(start, max(end, start + 1), BODY):
        row = np.zeros(WIDTH, np.uint8)
        for place, piece in ((BEFORE - len(b := data[max(0, start - BEFORE) : start]), b), (BEFORE, data[at : min(end, at + BODY)]), (BEFORE + BODY, data[end : end + AFTER])):
            row[place : place + len(piece)] = _CODES[np.frombuffer(piece, np.uint8)]
        rows.append(row)
    return rows


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Judge:
    """The network, its calibration (slope, shift) and its threshold."""

    def __init__(self, weights: dict[str, np.ndarray], slope: float = 1.0, shift: float = 0.0, threshold: float = 0.5):
        self.w, self.slope, self.shift, self.threshold = weights, slope, shift, threshold

    @classmethod
    def fresh(cls, seed: int = 9) -> Judge:
        rng = np.random.default_rng(seed)
        shape = {"letters": (97, LETTERS), "filters": (SPAN * LETTERS, FILTERS), "cut": (FILTERS,), "dense": (3 * FILTERS, DENSE), "dense_cut": (DENSE,), "last": (DENSE,), "last_cut": (1,)}
        return cls({k: (rng.normal(0, 1 / np.sqrt(s[0]) if len(s) > 1 and k != "letters" else 0.3, s) * (not k.endswith("cut"))).astype(np.float32) for k, s in shape.items()})

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, fitted=np.array([self.slope, self.shift, self.threshold]), **self.w)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Judge:
        held = dict(np.load(io.BytesIO(blob)))
        return cls(weights=held, **dict(zip(("slope", "shift", "threshold"), held.pop("fitted").tolist(), strict=True)))

    def _forward(self, x: np.ndarray) -> tuple:
        seen = self.w["letters"][x] * (x != BLANK)[:, :, None]
        padded = np.pad(seen, ((0, 0), (SPAN // 2, SPAN // 2), (0, 0)))
        spans = np.lib.stride_tricks.sliding_window_view(padded, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH, -1)
        raised = np.maximum(spans @ self.w["filters"] + self.w["cut"], 0)
        zones = [(0, BEFORE), (BEFORE, BEFORE + BODY), (BEFORE + BODY, WIDTH)]
        tops = [a + raised[:, a:b].argmax(axis=1) for a, b in zones]
        body = raised[:, BEFORE : BEFORE + BODY]
        pooled = [np.take_along_axis(raised, tops[0][:, None], 1)[:, 0], body.mean(axis=1) + np.take_along_axis(raised, tops[1][:, None], 1)[:, 0], np.take_along_axis(raised, tops[2][:, None], 1)[:, 0]]
        pooled = np.concatenate(pooled, axis=1)
        dense = np.maximum(pooled @ self.w["dense"] + self.w["dense_cut"], 0)
        return spans, raised, tops, pooled, dense, dense @ self.w["last"] + self.w["last_cut"]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The uncalibrated score of each row of codes."""
        return np.concatenate([self._forward(x[at : at + 512])[-1] for at in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def scores(self, data: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
        """Calibrated probability of each span, the highest of its bodies."""
        rows = [windows(data, a, b) for a, b in spans]
        if not rows:
            return np.zeros(0)
        raw = self.raw(np.stack([r for own in rows for r in own]))
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
        return _chance(self.slope * np.maximum.reduceat(raw, starts) + self.shift)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, rows: int = 128, rate: float = 0.01, recall: float = 0.98, seed: int = 13) -> Judge:
        """Train on three quarters of the rows, calibrate and set the threshold on the others."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        kept, used = order[: len(y) // 4], order[len(y) // 4 :]
        classes = [used[y[used] == c] for c in (0, 1)]
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(c, rows // 2) for c in classes if len(c)])
            grads = self._gradients(x[pick], y[pick])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                self.w[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self._calibrate(self.raw(x[kept]).astype(float), y[kept].astype(float), recall)
        return self

    def refine(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rows: int = 128, rate: float = 0.001) -> None:
        """One pass over rows, each batch half of either class; the class with fewer rows comes round again."""
        classes = [rng.permutation(np.flatnonzero(y == c)) for c in (0, 1)]
        half, most = rows // 2, max(map(len, classes))
        for at in range(0, most, half):
            span = min(half, most - at)
            pick = np.concatenate([np.take(c, range(at, at + span), mode="wrap") for c in classes if len(c)])
            for k, g in self._gradients(x[pick], y[pick]).items():
                self.w[k] -= (rate * g / (np.sqrt(np.mean(g * g)) + 1e-3)).astype(np.float32)

    def _calibrate(self, raw: np.ndarray, y: np.ndarray, recall: float, weight: np.ndarray | None = None) -> None:
        """Logistic calibration by Newton steps with a little weight decay; then the highest threshold with that recall."""
        weight = np.ones_like(raw) if weight is None else weight
        theta = np.array([1.0, 0.0])
        z = np.column_stack((raw, np.ones_like(raw)))
        for _ in range(30):
            p = _chance(z @ theta)
            grad = z.T @ (weight * (p - y)) + 1e-2 * theta
            theta = theta - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad)
        self.slope, self.shift = max(1e-3, float(theta[0])), float(theta[1])
        p, own = _chance(self.slope * raw + self.shift)[y == 1], weight[y == 1]
        if len(p):
            order = np.argsort(-p, kind="stable")
            reached = np.cumsum(own[order])
            self.threshold = float(p[order][min(len(p) - 1, int(np.searchsorted(reached, np.ceil(recall * reached[-1]))))])

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        spans, raised, tops, pooled, dense, out = self._forward(x)
        delta = ((_chance(out) - y) / len(y)).astype(np.float32)
        to_dense = np.outer(delta, self.w["last"]) * (dense > 0)
        to_pool = to_dense @ self.w["dense"].T
        back = np.zeros_like(raised)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for k, top in enumerate(tops):
            back[rows, top, cols] += to_pool[:, k * FILTERS : (k + 1) * FILTERS]
        back[:, BEFORE : BEFORE + BODY] += (to_pool[:, FILTERS : 2 * FILTERS] / BODY)[:, None, :]
        back *= raised > 0
        to_spans = (back @ self.w["filters"].T).reshape(len(x), WIDTH, SPAN, LETTERS)
        seen = np.zeros((len(x), WIDTH + SPAN - 1, LETTERS), np.float32)
        for k in range(SPAN):
            seen[:, k : k + WIDTH] += to_spans[:, :, k]
        seen = seen[:, SPAN // 2 : SPAN // 2 + WIDTH] * (x != BLANK)[:, :, None]
        letters = np.zeros_like(self.w["letters"])
        np.add.at(letters, x, seen)
        return {
            "letters": letters, "filters": np.einsum("nts,ntf->sf", spans, back), "cut": back.sum(axis=(0, 1)), "dense": pooled.T @ to_dense,
            "dense_cut": to_dense.sum(axis=0), "last": dense.T @ delta, "last_cut": np.array([delta.sum()], np.float32),
        }


_ALPHABETS = ("0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/")


def _sample_value(rng, size: int) -> bytes:
    letters = _ALPHABETS[rng.integers(0, len(_ALPHABETS))]
    return "".join(letters[i] for i in rng.integers(0, len(letters), size)).encode()


def training_rows(labelled: list[tuple[bytes, int, int, int]], seed: int = 21, copies: int = 4, least: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes and labels from (context bytes, start, end, is a finding).

    Every finding is joined by copies with a made-up value, half of them in the surroundings of
    something that is no finding, so that neither the cue word nor the value alone decides.
    """
    rng = np.random.default_rng(seed)
    plain = [r for r in labelled if not r[3]]
    found = [r for r in labelled if r[3]]
    x, y = [], []

    def add(data: bytes, start: int, end: int, label: int) -> None:
        for row in windows(data, start, end):
            x.append(row)
            y.append(label)

    for data, start, end, label in labelled:
        add(data, start, end, label)
    for k in range(max(copies * len(found), least)):
        data, start, end, _ = found[k % len(found)] if found else (b"api_key = ", 10, 10, 1)
        if k % 2 and plain:
            data, start, end, _ = plain[rng.integers(0, len(plain))]
        value = _sample_value(rng, int(rng.integers(20, 64)))
        add(data[:start] + value + data[end:], start, start + len(value), 1)
    return np.stack(x), np.array(y, np.int64)


def _examples(key: int, text: str, most: int | None, stretches: int) -> list[tuple[bytes, int, int, int]]:
    """(context bytes, start, end, is a finding): findings and other runs of a text, at most ``most`` of each, and some stretches."""
    data = text.encode("utf-8", "replace")
    base = base_spans(data)
    picked = [(a, b, 1) for a, b, _ in base[:most]] + [(a, b, 0) for a, b in candidates(data, base)[:most]]
    rng = np.random.default_rng(abs(key) % (1 << 32))
    for at in rng.integers(0, max(1, len(data) - SHORTEST), stretches).tolist():
        end = at + int(rng.integers(SHORTEST, BODY))
        if end <= len(data) and not any(a < end and at < b for a, b, _ in base):
            picked.append((at, end, 0))
    out = []
    for a, b, label in picked:
        b, lead = min(b, a + 4 * BODY), max(0, a - BEFORE)
        out.append((data[lead : b + AFTER], a - lead, b - lead, label))
    return out


def _start(rows: DataFrame, sample_docs: int, recall: float) -> Judge:
    """Starting weights from at most about ``sample_docs`` documents, drawn by a hash of the id.

    Of each drawn document up to sixteen findings, sixteen other runs and eight stretches without a
    finding reach the driver, each with its context.
    """
    total = rows.count()
    scale = 1 << 30
    share = min(scale, scale * sample_docs // max(1, total) + 1)
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(scale)) < share)

    def examples(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(key, *e) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in _examples(key, text, 16, 8)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "data", "start", "end", "label"])

    made = map_arrow(drawn, examples, "id long, data binary, start int, end int, label int").collect()
    ordered = sorted((r.id, r.start, r.end, r.label, bytes(r.data)) for r in made)
    return Judge.fresh().fit(*training_rows([(d, a, b, label) for _, a, b, label, d in ordered]), recall=recall)


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray] | None:
    """Training rows of all findings and runs of some documents."""
    labelled = [e for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in _examples(key, text, None, 2)]
    return training_rows(labelled, seed=abs(batch.column(0)[0].as_py()), least=0) if labelled else None


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000, recall: float = 0.98) -> Judge:
    """A judge trained on the pattern findings and the other runs of all documents.

    Starting from weights of a sample, each task goes through three quarters of its documents, and
    the tasks' weights are averaged by the rows they saw. The last quarter of all documents gives
    calibration and threshold, by counts of the scores in steps of 1/64. At most a few thousand
    numbers reach the driver each time.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    start = _start(rows, sample_docs, recall)
    blob, kept_back = start.dump(), F.pmod(F.xxhash64("id", F.lit(37)), F.lit(4)) == 0

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, seen = Judge.load(blob), 0
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                made = _rows_of(batch.slice(at, AT_ONCE))
                if made is not None:
                    judge.refine(*made, np.random.default_rng(at))
                    seen += len(made[1])
        if seen:
            flat = np.concatenate([judge.w[k].ravel() for k in sorted(judge.w)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen))], ["place", "value", "seen"])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _rows_of(batch) if batch.num_rows else None
        x, y = made if made is not None else (np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64))
        steps = np.floor(64 * np.clip(_judge(refined).raw(x), -30, 30)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(steps), pa.array(y)], ["step", "label"])

    moved = rows.where(~kept_back).mapInArrow(go_on, "place long, value double, seen long")
    sums = moved.groupBy("place").agg((F.sum("value") / F.sum("seen")).alias("value")).orderBy("place").collect()
    judge = Judge.load(blob)
    if sums:
        flat, at = np.array([r.value for r in sums], np.float32), 0
        for k in sorted(judge.w):
            size = judge.w[k].size
            judge.w[k], at = flat[at : at + size].reshape(judge.w[k].shape), at + size
    refined = judge.dump()
    scored = map_arrow(rows.where(kept_back), count, "step long, label long").groupBy("step", "label").agg(F.count("*").alias("n")).orderBy("step", "label").collect()
    if {r.label for r in scored} == {0, 1}:
        steps, y, n = (np.array([r[c] for r in scored], float) for c in ("step", "label", "n"))
        judge._calibrate(steps / 64, y, recall, n)
    return judge


def spans(text: str | None, judge: Judge) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of every secret of one text, by start and then kind."""
    data = (text or "").encode("utf-8", "replace")
    base = base_spans(data)
    others = candidates(data, base)
    found = base + [(a, b, "model") for (a, b), p in zip(others, judge.scores(data, others), strict=True) if p >= judge.threshold]
    if found and not data.isascii():
        edges = sorted({e for a, b, _ in found for e in (a, b)})
        points, before, last = {}, 0, 0
        for e in edges:
            before, last = before + len(data[last:e].decode()), e
            points[e] = before
        found = [(points[a], points[b], k) for a, b, k in found]
    return sorted(found, key=_order)


def redacted(text: str, found: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


@lru_cache(maxsize=1)
def _judge(blob: bytes) -> Judge:
    return Judge.load(blob)


def scan(docs: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans: array of (start, end, kind), code points, end exclusive) of every whole text; none for a null text."""
    blob = judge.dump()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _judge(blob)
        found = [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans(t.as_py(), own)] for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "id long, spans array<struct<start: bigint, end: bigint, kind: string>>")


def redact(docs: DataFrame, judge: Judge, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """``docs`` with every secret of the text replaced by a mark; ``size_col`` is set to the new number of code points."""
    blob, at = judge.dump(), docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _judge(blob)
        texts = batch.column(at).to_pylist()
        found = [spans(t, own) for t in texts]
        columns = list(batch.columns)
        texts = [redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)]
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if size_at is not None:
            sizes = [len(t) if f else n for t, f, n in zip(texts, found, batch.column(size_at).to_pylist(), strict=True)]
            columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, run, docs.schema)
