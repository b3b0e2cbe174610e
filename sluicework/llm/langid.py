"""Language identification with a bidirectional gated recurrent network over bytes.

A run of letters, lower-cased and closed by a space on either side, is one byte sequence; runs
of more than ``SPAN`` bytes are read in spans. Two gated recurrent layers read it in either
direction, and every byte of a letter gets a distribution over the languages. A document's
probabilities are the mean over all its letter bytes. As a run's distributions depend on the
run alone, each different run is read once for each Python worker.

The network is trained in numpy by backpropagation through time, on stretches of a bounded
sample of labelled documents.
"""

from __future__ import annotations

import io
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import WordMemory, map_arrow

SPAN = 24
UNKNOWN = "und"
RUNS = re.compile(r"[^\W\d_]+")
HIDDEN = 16
GROUP, GROUP_SIZE = 512, 1_000_000  # texts, and characters of all but the last, that are read together
DIRECTIONS = ("f", "b")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def sequences(run: str) -> tuple[list[bytes], list[np.ndarray]]:
    """The byte sequences of one run of letters, each with a mask of the bytes that vote."""
    data = run.encode("utf-8", "replace")
    vote = np.ones(len(data), bool)
    if not run.isalpha():  # number forms such as fractions are among the regex's letters
        vote = np.repeat([c.isalpha() for c in run], [len(c.encode("utf-8", "replace")) for c in run])
    cuts = range(0, len(data), SPAN)
    return [b" " + data[a : a + SPAN] + b" " for a in cuts], [np.concatenate(([False], vote[a : a + SPAN], [False])) for a in cuts]


class Tagger:
    """The network; ``languages`` in alphabetical order."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.languages, self.w = languages, weights
        self.memory = WordMemory(self._read_runs, limit=120_000)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {}
        for d in DIRECTIONS:
            w[f"in_{d}"] = rng.normal(0, 0.4, (256, 3 * hidden)).astype(np.float32)
            w[f"rec_{d}"] = rng.normal(0, 0.8 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        w["out"] = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        w["bias"] = np.zeros(len(languages), np.float32)
        return cls(languages, w)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages, dtype=np.str_), **self.w)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Tagger:
        held = dict(np.load(io.BytesIO(blob)))
        return cls(held.pop("languages").tolist(), held)

    def _layer(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, rows, hidden) of one direction over byte rows ``x`` that start at its first byte."""
        table, rec = self.w[f"in_{d}"], self.w[f"rec_{d}"]
        n = rec.shape[0]
        h = np.zeros((len(x), n), np.float32)
        states = np.empty((x.shape[1], len(x), n), np.float32)
        for t in range(x.shape[1]):
            given, back = table[x[:, t]], h @ rec
            gates = _sigmoid(given[:, : 2 * n] + back[:, : 2 * n])
            new = np.tanh(given[:, 2 * n :] + gates[:, n:] * back[:, 2 * n :])
            if keep is not None:
                keep.append((h, gates, new, back[:, 2 * n :]))
            h = new + gates[:, :n] * (h - new)
            states[t] = h
        return states

    def _output(self, forth: np.ndarray, back: np.ndarray) -> np.ndarray:
        both = np.concatenate((forth, back[::-1]), axis=2)
        scores = both @ self.w["out"] + self.w["bias"]
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        return scores / scores.sum(axis=2, keepdims=True)

    def label(self, x: np.ndarray) -> np.ndarray:
        """(rows, time, languages): the distribution at every byte of equally long byte rows."""
        return self._output(self._layer(x, "f"), self._layer(x[:, ::-1], "b")).transpose(1, 0, 2)

    def _read_runs(self, runs: list[str]) -> list[bytes]:
        """For each run the sum of its letter bytes' distributions and their number, as float32 bytes."""
        pieces, masks, owner = [], [], []
        for k, run in enumerate(runs):
            found, votes = sequences(run)
            pieces += found
            masks += votes
            owner += [k] * len(found)
        sums = np.zeros((len(runs), len(self.languages) + 1), np.float64)
        sizes, owners = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(owner)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            for at in range(0, len(which), 4096):
                part = which[at : at + 4096]
                x = np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8).reshape(-1, size)
                vote = np.stack([masks[i] for i in part])
                probs = self.label(x) * vote[:, :, None]
                np.add.at(sums, owners[part], np.column_stack((probs.sum(axis=1), vote.sum(axis=1))))
        return [row.tobytes() for row in sums.astype(np.float32)]

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """(language, mean probability over all letter bytes) of each text; ``und`` and 0 without a letter.

        Ties go to the first name. The texts of a group share their unknown runs, so that the
        network reads many at a time.
        """
        found, at = [], 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and len(group) < GROUP and size < GROUP_SIZE:
                group.append(RUNS.findall((texts[at] or "").lower()) if self.languages else [])
                size += len(texts[at] or "")
                at += 1
            found += self._predict_group(group)
        return found

    def _predict_group(self, group: list[list[str]]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(group)
        filled = [i for i, runs in enumerate(group) if runs]
        if not filled:
            return out
        held = self.memory.over([run for i in filled for run in group[i]])
        sums = np.frombuffer(b"".join(held), np.float32).reshape(-1, len(self.languages) + 1).astype(np.float64)
        starts = np.concatenate(([0], np.cumsum([len(group[i]) for i in filled])[:-1]))
        for i, row in zip(filled, np.add.reduceat(sums, starts, axis=0), strict=True):
            if row[-1] > 0:
                best = int(row[:-1].argmax())
                out[i] = self.languages[best], round(float(min(1.0, row[best] / row[-1])), 4)
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy at the letter bytes of rows ``x`` of languages ``y``, and its gradient through time."""
        kept = {"f": [], "b": []}
        forth, back = self._layer(x, "f", kept["f"]), self._layer(x[:, ::-1], "b", kept["b"])
        probs = self._output(forth, back)
        n, (steps, rows, hidden) = len(x) * (x.shape[1] - 2), forth.shape
        loss = -np.log(probs[1:-1, np.arange(rows), y] + 1e-9).sum() / n
        delta = probs
        delta[:, np.arange(rows), y] -= 1
        delta[[0, -1]] = 0
        delta /= n
        both = np.concatenate((forth, back[::-1]), axis=2)
        grads = {"out": np.einsum("trh,trc->hc", both, delta), "bias": delta.sum(axis=(0, 1))}
        above = delta @ self.w["out"].T
        for d, given in (("f", above[:, :, :hidden]), ("b", above[::-1, :, hidden:])):
            rec, order = self.w[f"rec_{d}"], x if d == "f" else x[:, ::-1]
            to_table, to_rec, carry = np.zeros_like(self.w[f"in_{d}"]), np.zeros_like(rec), np.zeros((rows, hidden), np.float32)
            for t in reversed(range(steps)):
                h, gates, new, inner = kept[d][t]
                update, reset = gates[:, :hidden], gates[:, hidden:]
                dh = given[t] + carry
                dnew = dh * (1 - update) * (1 - new**2)
                dupdate = dh * (h - new) * update * (1 - update)
                dreset = dnew * inner * reset * (1 - reset)
                through = np.concatenate((dupdate, dreset, dnew * reset), axis=1)
                np.add.at(to_table, order[:, t], np.concatenate((dupdate, dreset, dnew), axis=1))
                to_rec += h.T @ through
                carry = dh * update + through @ rec.T
            grads[f"in_{d}"], grads[f"rec_{d}"] = to_table, to_rec
        return float(loss), grads

    def fit(self, runs: list[list[str]], steps: int = 500, rows: int = 256, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Train on runs of letters, one list for each language, equally often each; the loss of every step."""
        rng = np.random.default_rng(seed)
        by_size: dict[int, tuple[list, list]] = {}
        most = max(map(len, runs), default=0)
        for y, own in enumerate(runs):
            again = [own[i] for i in rng.integers(0, len(own), most)] if own else []
            for piece in (p for r in again for p in sequences(r)[0]):
                xs, ys = by_size.setdefault(len(piece), ([], []))
                xs.append(piece)
                ys.append(y)
        sets = [(np.frombuffer(b"".join(xs), np.uint8).reshape(-1, size), np.array(ys)) for size, (xs, ys) in sorted(by_size.items())]
        if not sets:
            return []
        weight = np.array([len(y) * (x.shape[1] - 2) for x, y in sets], float)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            x, y = sets[rng.choice(len(sets), p=weight / weight.sum())]
            pick = rng.integers(0, len(y), min(rows, 4 * len(y)))
            loss, grads = self._gradients(x[pick], y[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1))) * min(1.0, 1 / (norm + 1e-9))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                self.w[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.memory = WordMemory(self._read_runs, limit=120_000)
        return losses


@lru_cache(maxsize=1)  # a worker reads with one network, and its memory of runs is large
def _tagger(blob: bytes) -> Tagger:
    return Tagger.load(blob)


def in_held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is held out of training: the crc32 of its id as text is 2 modulo 4. Rows without an id are not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 250, stretch: int = 1500, most_languages: int = 256, steps: int = 500) -> Tagger:
    """A network trained on labelled documents that are not held out.

    Bounds of the sample, which is all that reaches the driver: the ``most_languages`` most
    frequent labels, ``per_language`` documents each as a hash of the id picks them, and of each
    a stretch of ``stretch`` characters at a hashed place. Without any labelled document the
    network knows no language and every prediction is ``und``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~in_held_out("id"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_languages).collect()}
    if not counts:
        return Tagger.fresh([])
    # A share that gives twice the wanted number leaves room for chance.
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(scale, 2 * scale * per_language // n + 1))])
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(scale))
    start = F.pmod(F.xxhash64("id", F.lit(12)), F.greatest(F.lit(1), F.length("text") - stretch)).cast("int") + 1
    found = rows.where(draw < F.coalesce(share[F.col("label")], F.lit(0))).select("label", draw.alias("draw"), F.substring("text", start, F.lit(stretch)).alias("text")).collect()
    languages, runs = sorted(counts), []
    for language in languages:
        own = sorted((r.draw, r.text or "") for r in found if r.label == language)[:per_language]
        runs.append([run for _, text in own for run in RUNS.findall(text.lower())])
    tagger = Tagger.fresh(languages)
    tagger.fit(runs, steps)
    return tagger


def identify(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; ``und`` with score 0 when it is null or has no letter."""
    blob = tagger.dump()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _tagger(blob)
        found = own.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"]
        )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, tagger: Tagger, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of at least ``least``; their columns and order stay."""
    blob, at = tagger.dump(), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _tagger(blob)
        found = own.predict(batch.column(at).to_pylist())
        return batch.filter(pa.array([language != UNKNOWN and score >= least for language, score in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
