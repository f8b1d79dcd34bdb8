"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment.

An alignment of a document with an item counts +1 for an equal word, -0.5 for another word or a gap. It is found when
it counts a share of the item's words, or, in long items, a fixed number of words: `need` is the lesser of both. Seeds are pairs of words
that are neighbours or have one word between them, in item and document. An alignment of M equal words and E edits that
counts need has E <= 2 (M - need), so of the M - 1 steps between its equal words at least need - 1 have one edit or none,
and each of these is a seed at a place of its own. Only stretches of a document with so many seeds of an item, as long as such an alignment can be, are
aligned; no seed is left out for being frequent, so none that reaches the threshold is lost. Stretches whose words
cannot reach the threshold in any order are passed over, which loses nothing either.

Words are runs of letters and digits in lower case.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cragline.llm.common import materialize

WORD = re.compile(r"\w+")
PENALTY = 0.5


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Items:
    """A block of test items. Keys are words, two at a time, as one integer each."""

    names: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    seeds: np.ndarray | None = None  # keys in order; those of seeds[k] are in items[starts[k]:starts[k + 1]]
    starts: np.ndarray | None = None
    items: np.ndarray | None = None
    alone: dict[int, list[int]] = field(default_factory=dict)  # items of one word, by the word

    def add(self, name, text: str | None) -> None:
        words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
        if len(words):
            if len(words) == 1:
                self.alone.setdefault(int(words[0]), []).append(len(self.names))
            self.names.append(name)
            self.words.append(words)

    def index(self) -> None:
        found = [(np.unique(np.concatenate(self.keys(w))), i) for i, w in enumerate(self.words)]
        keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
        items = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
        order = np.argsort(keys, kind="stable")
        self.items = items[order]
        self.seeds, at = np.unique(keys[order], return_index=True)
        self.starts = np.append(at, len(keys))

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of neighbours and of words with one between them, by the place of the first word. 0: an unknown word."""
        base = len(self.vocabulary) + 1
        return tuple(np.where((words[:-d] > 0) & (words[d:] > 0), words[:-d] * base + words[d:], 0) for d in (1, 2))

    def hits(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """item, place of each seed in the document, by item and place; a place counts once for an item."""
        if len(self.seeds) == 0 or len(doc) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near, far = self.keys(doc)
        keys, places = np.concatenate([near, far]), np.concatenate([np.arange(len(near)), np.arange(len(far))])
        known = np.flatnonzero(keys)
        keys, places = keys[known], places[known]
        at = np.minimum(np.searchsorted(self.seeds, keys), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[at] == keys)
        at, places = at[hit], places[hit]
        n = self.starts[at + 1] - self.starts[at]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(self.items[np.repeat(self.starts[at], n) + inside] * len(doc) + np.repeat(places, n))
        return both // len(doc), both % len(doc)

    def encode(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").filter("text IS NOT NULL").dropDuplicates()


def _block_count(benchmark: DataFrame, block_words: int) -> int:
    """So many blocks have about block_words words each, at most four characters to a word."""
    return int(_items(benchmark).agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4 // block_words) + 1


def _block(benchmark: DataFrame, k: int, n: int) -> Items:
    """The k-th of n blocks of items, dealt by a hash."""
    items, block = _items(benchmark), Items()
    part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    for r in sorted(part.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text)):
        block.add(r.item_id, r.text)
    block.index()
    return block


def alignment(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """The best local alignment score and the place after its last word in the window."""
    lane = np.arange(len(window) + 1) * PENALTY
    above = np.zeros(len(window) + 1)
    best, end = 0.0, 0
    for w in item:
        row = np.zeros(len(window) + 1)
        row[1:] = np.maximum(above[:-1] + np.where(window == w, 1.0, -PENALTY), above[1:] - PENALTY)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + lane) - lane
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
        above = row
    return best, end


def least_seeds(need: float) -> int:
    """The seeds that an alignment which counts need has at least; one, for items so short that a word alone would do."""
    return max(1, math.ceil(need - 1 - 1e-9))


def _stretches(m: int, size: int, places: np.ndarray, need: float) -> list[tuple[int, int]]:
    """The parts of a document of size words that can hold an alignment with an item of m words, by its seeds' places."""
    least = least_seeds(need)
    span = m + math.ceil(max(0.0, 2 * (m - need)))
    if len(places) < least:
        return []
    last = places[least - 1 :]
    first = places[: len(last)]
    fits = np.flatnonzero(last - first <= span)
    parts: list[tuple[int, int]] = []
    for low, high in zip(np.maximum(last[fits] - span, 0).tolist(), np.minimum(first[fits] + span + 1, size).tolist(), strict=True):
        if parts and low <= parts[-1][1]:
            parts[-1] = (parts[-1][0], max(high, parts[-1][1]))
        else:
            parts.append((low, high))
    return parts


def _align(item: np.ndarray, doc: np.ndarray, places: np.ndarray, need: float) -> tuple[float, int, int] | None:
    """Score and span of the best alignment around the places of the item's seeds, or None."""
    m, found = len(item), None
    for low, high in _stretches(m, len(doc), places, need):
        window = doc[low:high]
        values, there = np.unique(item, return_counts=True)
        at = np.searchsorted(values, window)
        have = np.bincount(at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == window)], minlength=len(values))
        if np.minimum(have, there).sum() < need:
            continue
        score, end = alignment(item, window)
        if score >= need and (found is None or score / m > found[0]):
            back, length = alignment(item[::-1], window[:end][::-1])
            found = (score / m, low + end - length, low + end)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, passage_words: int = 30, block_words: int = 1_000_000) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, score, first_word, last_word.

    One row for each document and test item with an alignment that counts threshold times the item's words, or
    passage_words. score is the count over the item's words; first_word and last_word number the words of the passage from
    0, the last one excluded. An item of one word has no seed: it matches the documents that are that word alone.
    Null or empty texts match nothing; repeated documents give repeated rows; items repeated with the same id and text
    count once; an empty table gives an empty result; other columns are not looked at.

    The items are broadcast in blocks of block_words words, and documents are read once for each block; of several
    blocks each is let go before the next one is sent.
    """
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    schema = f"{kinds}, score double, first_word int, last_word int"
    item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    context = docs.sparkSession.sparkContext
    texts = docs.select("doc_id", "text")
    out, n = None, _block_count(benchmark, block_words)
    for k in range(n):
        block = _block(benchmark, k, n)
        if not block.names:
            continue
        shared = context.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            needs = np.array([min(threshold * len(w), passage_words) for w in items.words])
            least = np.array([least_seeds(x) for x in needs], np.int64)
            for batch in batches:
                rows: list[tuple[int, object, float, int, int]] = []
                for n, text in enumerate(batch.column("text").to_pylist()):
                    doc = items.encode(text)
                    if len(doc) == 1:
                        rows += [(n, items.names[i], 1.0, 0, 1) for i in items.alone.get(int(doc[0]), ())]
                    which, places = items.hits(doc)
                    named, first, many = np.unique(which, return_index=True, return_counts=True)
                    for k in np.flatnonzero(many >= least[named]).tolist():
                        i = int(named[k])
                        if found := _align(items.words[i], doc, places[first[k] : first[k] + many[k]], float(needs[i])):
                            rows.append((n, items.names[i], *found))
                if rows:
                    which, names, score, first, last = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which)), pa.array(names, item_kind), pa.array(score, pa.float64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["doc_id", "item_id", "score", "first_word", "last_word"])

        part = texts.mapInArrow(search, schema)
        if n > 1:
            part = materialize(part, "contamination")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4) -> DataFrame:
    """docs without the documents that hold a passage of a test item; rows with a null doc_id stay.

    Rows that share a doc_id go together. Empty tables leave docs as they are.
    """
    leaked = contamination(docs, benchmark, threshold).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
