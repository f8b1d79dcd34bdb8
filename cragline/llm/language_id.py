"""Language identification with hyperdimensional profiles.

Each letter has a random +1/-1 vector. A letter trigram binds (multiplies) its letters' vectors after
permuting (rotating) them by their place, a document bundles (adds) its trigram vectors, a language's
prototype bundles those of its training documents, and the cosine ranks the prototypes.

Everything that is not a letter becomes one blank, and each text starts and ends with a blank, so that a
single letter already makes a trigram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.llm.common import bounded_sample

BLANK = 32
BLOCK_CHARS = 1 << 20
MAX_CELLS = 1 << 22
UNKNOWN_LANGUAGE = "und"


class Encoder:
    """Bundles of letter trigrams; letter vectors follow from the seed and the code point alone."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.letter = np.full(0x110000, -1, np.int8)
        self.letter[BLANK] = 0
        self.vectors: dict[int, np.ndarray] = {}

    def _vectors(self, points: np.ndarray) -> np.ndarray:
        if len(self.vectors) > 20_000:
            self.vectors.clear()
        for p in map(int, points):
            if p not in self.vectors:
                self.vectors[p] = np.random.Generator(np.random.PCG64([self.seed, p])).integers(0, 2, self.dim, np.int8) * 2 - 1
        return np.stack([self.vectors[int(p)] for p in points])

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points and the number of the text of each, other characters made blanks and runs of blanks one."""
        parts = [f" {t} ".lower() for t in texts]
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        kinds = self.letter[points]
        if (kinds < 0).any():
            for p in np.unique(points[kinds < 0]):
                self.letter[p] = chr(p).isalpha()
            kinds = self.letter[points]
        points = np.where(kinds == 1, points, BLANK)
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != BLANK) | (points[:-1] != BLANK) | (doc[1:] != doc[:-1])
        return points[keep], doc[keep]

    def bundles(self, texts: list[str]) -> Iterator[tuple[slice, np.ndarray]]:
        """The bundle of each text, block by block of about BLOCK_CHARS characters."""
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t) + 2
            if size >= BLOCK_CHARS or i + 1 == len(texts):
                yield from self._block(texts, start, i + 1)
                start, size = i + 1, 0

    def _block(self, texts: list[str], start: int, stop: int) -> Iterator[tuple[slice, np.ndarray]]:
        points, doc = self._symbols(texts[start:stop])
        inside = doc[2:] == doc[:-2] if len(points) > 2 else np.zeros(0, bool)
        if not inside.any():
            yield slice(start, stop), np.zeros((stop - start, self.dim), np.float32)
            return
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        alphabet = np.flatnonzero(seen)
        n = len(alphabet)
        place = np.zeros(0x110000, np.int64)
        place[alphabet] = np.arange(n)
        s = place[points]
        grams = ((s[:-2] * n + s[1:-1]) * n + s[2:])[inside]
        doc = doc[2:][inside]
        if n**3 <= MAX_CELLS:
            there = np.zeros(n**3, bool)
            there[grams] = True
            distinct = np.flatnonzero(there)
            number = np.empty(n**3, np.int32)
            number[distinct] = np.arange(len(distinct), dtype=np.int32)
            grams = number[grams]
        else:
            distinct, grams = np.unique(grams, return_inverse=True)
        letters = self._vectors(alphabet)
        first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        ends = np.searchsorted(doc, np.arange(stop - start + 1))
        step = max(1, MAX_CELLS // max(4096, len(distinct)))
        wide = max(1, 2 * MAX_CELLS // self.dim)
        for a in range(0, stop - start, step):
            b = min(a + step, stop - start)
            own = grams[ends[a] : ends[b]].astype(np.int64) + (doc[ends[a] : ends[b]] - a).astype(np.int64) * len(distinct)
            counts = np.bincount(own, minlength=(b - a) * len(distinct)).reshape(b - a, -1).astype(np.float32)
            out = np.zeros((b - a, self.dim), np.float32)
            for c in range(0, len(distinct), wide):
                g = distinct[c : c + wide]
                bound = first[g // (n * n)] * second[g // n % n] * letters[g % n]
                out += counts[:, c : c + wide] @ bound.astype(np.float32)
            yield slice(start + a, start + b), out


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def train_prototypes(docs: DataFrame, dim: int = 1024, seed: int = 7, max_train_docs_per_lang: int = 4000) -> dict[str, np.ndarray]:
    """Prototype vectors by language from docs(doc_id, text, lang); rows whose text or lang is null teach nothing.

    Learns from at most about max_train_docs_per_lang documents of each language, chosen by a hash of doc_id.
    Bundles are integers, so the sums do not depend on the order of the rows.
    """
    rows = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = bounded_sample(rows, "lang", "doc_id", max_train_docs_per_lang, seed).select("text", "lang")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dim, seed), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for part, vectors in encoder.bundles(_texts(batch)):
                for lang, v in zip(langs[part], vectors, strict=True):
                    sums[lang] = sums.get(lang, 0) + np.rint(v).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [v.tolist() for v in sums.values()]}, pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    cells = rows.mapInArrow(partial, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = cells.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r.lang: np.array([c.x for c in r.v], np.float64) for r in sums.collect()}


def identify_language(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = 1024, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score for every row.

    score is the cosine with the best prototype, held between 0 and 1; ties go to the smaller language name.
    Null texts, texts without a letter, and all texts when nothing was learned: und with score 0. Repeated
    rows give repeated results; an empty table gives an empty result; other columns are not looked at.
    """
    names = sorted(k for k, v in prototypes.items() if np.any(v))
    units = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).astype(np.float32) if names else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dim, seed)
        for batch in batches:
            texts = _texts(batch)
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            if units is not None:
                for part, vectors in encoder.bundles(texts):
                    length = np.linalg.norm(vectors, axis=1)
                    cosine = (vectors @ units.T) / np.maximum(length, 1e-9)[:, None]
                    best[part] = np.where(length > 0, cosine.argmax(axis=1), -1)
                    score[part] = np.where(length > 0, np.clip(cosine.max(axis=1), 0, 1), 0)
                for i in np.flatnonzero(best < 0):  # a bundle that cancels out still has letters
                    if any(c.isalpha() for c in texts[i]):
                        best[i] = 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([names[k] if k >= 0 else UNKNOWN_LANGUAGE for k in best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
