"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by their class log-count ratios; a linear hinge-loss model is fitted to
them by dual coordinate descent, and a sigmoid turns its margins into probabilities.

The n-grams are character trigrams of the text as written and word bigrams, both hashed into a fixed number of slots,
and four-grams of words up to renaming: which of four neighbouring words are the same.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cragline.llm.common import bounded_sample

SLOTS = 1 << 16
#: The ways in which four words can be equal: 0000, 0001, 0010, 0011, 0012, .., the words numbered as they first occur.
PATTERNS = {p: k for k, p in enumerate(p for p in itertools.product(range(4), repeat=4) if all(x <= max(p[:i], default=-1) + 1 for i, x in enumerate(p)))}
WIDTH = 2 * SLOTS + len(PATTERNS)


def _spread(h: np.ndarray) -> np.ndarray:
    """Slots of 32-bit hashes."""
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(16)


def _patterns(w: np.ndarray) -> np.ndarray:
    """The pattern of each run of four words, as slots."""
    a, b, c, d = w[:-3], w[1:-2], w[2:-1], w[3:]
    second = (b != a).astype(np.int64)
    third = np.where(c == a, 0, np.where(c == b, second, second + 1))
    fourth = np.where(d == a, 0, np.where(d == b, second, np.where(d == c, third, np.maximum(second, third) + 1)))
    numbers = np.zeros(64, np.int64)
    for (_, x, y, z), k in PATTERNS.items():
        numbers[x * 16 + y * 4 + z] = k
    return numbers[second * 16 + third * 4 + fourth]


def indicators(text: str) -> np.ndarray:
    """The slots of the n-grams that the text holds, each once, ascending."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(WIDTH, bool)
    if len(points) > 2:
        there[_spread(points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D))] = True
    words = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.split()], np.uint32)
    if len(words) > 1:
        there[SLOTS + _spread(words[:-1] * np.uint32(0x9E3779B1) ^ words[1:] * np.uint32(0x85EBCA77))] = True
    if len(words) > 3:
        there[2 * SLOTS + _patterns(words)] = True
    return np.flatnonzero(there)


@dataclass
class QualityModel:
    weights: np.ndarray  # of each slot, the log-count ratio included
    squares: np.ndarray  # squared log-count ratios, for the length of a row
    bias: float
    slope: float
    offset: float

    def score(self, text: str) -> float:
        on = indicators(text)
        length = float(np.sqrt(self.squares[on].sum())) or 1.0
        margin = float(self.weights[on].sum()) / length + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float, epochs: int, seed: int) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised hinge loss; the last weight is the bias."""
    w, alpha, rng = np.zeros(WIDTH + 1), np.zeros(len(y)), np.random.default_rng(seed)
    norms = np.array([float(v @ v) for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i]
            slope = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def _sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, with smoothed targets, by Newton's method."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margins).sum() + 1e-3 * (a - 1), d.sum() + 1e-3 * b])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit_rows(found: list[np.ndarray], labels: list[int], smoothing: float = 1.0, cost: float = 10.0, epochs: int = 40, seed: int = 3) -> QualityModel:
    """The model of these indicator rows; every fifth row only calibrates. One class or no rows: a constant score."""
    y = np.where(np.array(labels, int) == 1, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        prior = 0.5 if not len(y) else float((y > 0).mean())
        return QualityModel(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 1.0, 4.0 * (2 * prior - 1))
    held = np.arange(len(y)) % 5 == 4
    if any(not (y[held] == k).any() or not (y[~held] == k).any() for k in (1, -1)):
        held = np.zeros(len(y), bool)
    fitted = np.flatnonzero(~held)
    # ratios, too, are counted over fitted rows alone, so that the others calibrate what they have not been seen by
    counts = np.full((2, WIDTH), smoothing)
    for i in fitted:
        counts[int(y[i] > 0), found[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = []
    for on in found:
        v = ratio[on]
        rows.append((np.append(on, WIDTH), np.append(v / (np.sqrt(v @ v) or 1.0), 1.0)))
    w = _descend([rows[i] for i in fitted], y[fitted], cost, epochs, seed)
    margins = np.array([float(w[at] @ v) for at, v in rows])
    used = held if held.any() else np.ones(len(y), bool)
    slope, offset = _sigmoid(margins[used], y[used])
    return QualityModel(w[:WIDTH] * ratio, ratio**2, float(w[WIDTH]), slope, offset)


def train_quality(docs: DataFrame, labels: DataFrame, max_train_docs_per_class: int = 2500, seed: int = 3) -> QualityModel:
    """Fit on docs(doc_id, text) joined with labels(doc_id, quality).

    Learns from at most about max_train_docs_per_class documents of each class, chosen by a hash of doc_id,
    so what reaches the driver and what is broadcast is bounded. Repeated labels of a document count once;
    a document with contradictory labels, or a null label, teaches nothing. Null texts count as empty.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").select("doc_id", "quality")
    chosen = bounded_sample(known, "quality", "doc_id", max_train_docs_per_class, seed)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [indicators(t or "").astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(on, pa.binary())], ["doc_id", "quality", "on"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInArrow(features, f"doc_id {kind}, quality int, on binary").collect(), key=lambda r: (r.doc_id, r.on))
    order = np.random.default_rng(seed).permutation(len(got))
    return fit_rows([np.frombuffer(got[i].on, np.int32) for i in order], [got[i].quality for i in order], seed=seed)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with two more columns: score (0 to 1) and predicted (1 if score >= 0.5, else 0), for every row.

    Null texts count as empty; empty texts get the model's constant. Columns of docs named score or
    predicted are replaced. Repeated rows give repeated results; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = np.array([m.score(t or "") for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    fields = docs.select(*[F.col(f"`{c}`") for c in kept])
    return fields.mapInArrow(scored, StructType([*fields.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
