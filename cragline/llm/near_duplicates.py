"""Jaccard join on word five-grams with Bayesian candidate pruning.

Texts with equal sets of shingles are one class, so exact copies are compared once. MinHash bands bring
classes together; each band key is a bucket, and buckets with the same members are looked at once. Within a
bucket the MinHash values of all pairs are compared a few at a time; a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold is below the tolerance, under a uniform prior
over the similarity. The exact similarity of what is left is computed from the shingles. A pair belongs to the
first band that brings it together, so no pair counts twice and no pair list is shuffled: a task returns the
number of links of each of its members and a spanning forest of its links.

Large buckets are cut into chunks, and each pair of chunks is a task of its own. Chunks grow with the bucket up to a
bound, as a set of shingles goes into as many tasks as there are chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm.common import discard, materialize

SHINGLE = 5
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
STEP = 16
MASK = (1 << 64) - 1


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; a shorter text is one run, one without words has none."""
    w = np.array([words[x] for x in (text or "").lower().split()], np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n] + np.uint64(k + 1))
    return np.unique(h)


_family = np.random.default_rng(20)
FACTORS = _family.integers(1, 1 << 62, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _family.integers(0, 1 << 62, HASHES, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(s), 2048):
        h = (s[a : a + 2048, None] * FACTORS + OFFSETS) >> np.uint64(32)
        out = np.minimum(out, h.min(axis=0).astype(np.uint32))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A hash of each band of ROWS values."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k] + np.uint64(k + 1))
    return h


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For n = STEP, 2 STEP, ..: the fewest equal values with which a pair may go on.

    With m of n values equal and a uniform prior, the similarity is Beta(m + 1, n - m + 1) distributed; the tail
    above the threshold is a binomial sum.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        def tail(m: int, n: int = n) -> float:
            return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= tolerance))
    return np.array(out)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        high, low, count, sketch = [], [], [], []
        for t in batch.column("text").to_pylist():
            s = shingles(t, words)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            high.append((d >> 64) - (1 << 63))
            low.append((d & MASK) - (1 << 63))
            count.append(len(s))
            sketch.append(band_keys(signature(s)).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(count, pa.int32()), pa.array(sketch, pa.binary())], ["doc_id", "hi", "lo", "size", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
        out = [s.tobytes() for s in sets]
        d = [xxhash.xxh3_128_intdigest(s) for s in out]
        yield pa.RecordBatch.from_arrays([pa.array([(x >> 64) - (1 << 63) for x in d], pa.int64()), pa.array([(x & MASK) - (1 << 63) for x in d], pa.int64()), pa.array(out, pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], ["hi", "lo", "shingles", "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            h = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([part.column("hi").take(at), part.column("lo").take(at), part.column("size").take(at), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)), pa.array(h)], ["hi", "lo", "size", "band", "bucket"])


def _evaluate(sig: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, band: int, threshold: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows x cols whose first common band is `band` and whose Jaccard similarity reaches the threshold."""
    found_i, found_j = [], []
    sizes = np.array([len(s) for s in sets], np.float64)
    block = max(1, (1 << 22) // max(1, len(cols)))
    for a in range(0, len(rows), block):
        r = rows[a : a + block]
        alive = np.minimum.outer(sizes[r], sizes[cols]) >= threshold * np.maximum.outer(sizes[r], sizes[cols]) - 1e-9
        alive &= r[:, None] < cols[None, :] if rows is cols else True
        for b in range(band):  # an earlier band has the pair
            same = np.ones_like(alive)
            for k in range(b * ROWS, b * ROWS + ROWS):
                same &= sig[r, k][:, None] == sig[cols, k][None, :]
            alive &= ~same
        i, j = np.nonzero(alive)
        i, j = r[i], cols[j]
        equal = np.zeros(len(i), np.int32)
        for step, need in enumerate(least):
            if not len(i):
                break
            for k in range(step * STEP, step * STEP + STEP):
                equal += sig[i, k] == sig[j, k]
            on = equal >= need
            i, j, equal = i[on], j[on], equal[on]
        if len(i):
            keep = _exact(sets, sizes, i, j, threshold)
            found_i.append(i[keep])
            found_j.append(j[keep])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def _exact(sets: list[np.ndarray], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    who = np.unique(np.concatenate([i, j]))
    if len(i) < 2 * len(who):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.float64)
    else:  # many pairs among few texts: products of indicator matrices over the shingles that two of them share
        flat = np.concatenate([sets[k] for k in who])
        owner = np.repeat(np.arange(len(who)), [len(sets[k]) for k in who])
        values, slot, times = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        on = times[slot] > 1
        owner, slot = owner[on], number[slot[on]]
        width = int(slot.max(initial=-1)) + 1
        x, y = np.searchsorted(who, i), np.searchsorted(who, j)
        common = np.zeros(len(i))
        tall = max(1, (1 << 22) // len(who))
        for c in range(0, width, tall):
            part = np.zeros((len(who), min(tall, width - c)), np.float32)
            inside = (slot >= c) & (slot < c + tall)
            part[owner[inside], slot[inside] - c] = 1
            common += (part @ part.T)[x, y]
    return common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9


def _unit(frame: pd.DataFrame, threshold: float, least: np.ndarray) -> pd.DataFrame:
    """One bucket, or one pair of chunks of it: links of each member and the edges of a spanning forest."""
    frame = frame.sort_values(["hi", "lo"], kind="stable")
    sig = np.frombuffer(b"".join(frame["sketch"]), np.uint32).reshape(-1, HASHES)
    sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
    band, chunk = int(frame["band"].iloc[0]), frame["chunk"].to_numpy()
    a, b = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
    if a == b:
        rows = cols = np.arange(len(frame))
    else:
        rows, cols = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
    i, j = _evaluate(sig, sets, rows, cols, band, threshold, least)
    links = np.bincount(np.concatenate([i, j]), minlength=len(frame))
    parent = np.arange(len(frame))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    top = np.array([root(x) for x in range(len(frame))])
    on = np.flatnonzero(links)
    hi, lo = frame["hi"].to_numpy(), frame["lo"].to_numpy()
    return pd.DataFrame({"hi": hi[on], "lo": lo[on], "links": links[on], "to_hi": hi[top[on]], "to_lo": lo[top[on]]})


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component: the smallest node of each node's component, for nodes with an edge.

    Alternates large-star and small-star steps until nothing changes; each step is written to the shared folder.
    A node's neighbours are only aggregated to their minimum, never gathered.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, edges = edges, materialize(small, "cc")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-9, chunk_rows: int = 1024, chunk_shingles: int = 2_000_000, most_chunks: int = 32) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id, n_links, text_id, text_copies, for every row.

    Two texts are linked when the Jaccard similarity of their sets of five-word shingles (lower case, parted by
    white space) is at least threshold. text_id: the smallest doc_id with the same set of shingles; text_copies:
    the rows with that set; n_links: the different sets linked with it; class_id: the smallest text_id that
    links lead to. A text of fewer than five words is one shingle; texts without words, null ones included,
    are copies of each other without links. Repeated rows are copies. Where all doc_ids of a set are null its
    text_id is null, and such sets still link. An empty table gives an empty result; other columns are not looked at.

    Buckets of more than chunk_rows texts, or chunk_shingles shingles, are cut into chunks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = ["hi", "lo"]
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_sketch, f"doc_id {kind}, hi long, lo long, size int, keys binary"), "sketches")
    texts = rows.groupBy(*key, "size").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("text_copies"), F.first("keys").alias("keys"))
    texts = materialize(texts, "texts")
    bands = texts.filter("size > 0").select(*key, "size", "keys").mapInArrow(_bands, "hi long, lo long, size int, band int, bucket long")
    member = F.xxhash64(*key)
    buckets = bands.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.bit_xor(member).alias("x"), F.bit_xor(F.xxhash64("lo", "hi")).alias("y"), F.sum("size").alias("total")).filter("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket", "total")).alias("first"))
    # up to most_chunks chunks as small as asked for; beyond, chunks grow to eight times the texts or four times the shingles
    texts_in, shingles_in = F.col("n") / chunk_rows, F.col("first.total") / chunk_shingles
    chunks = F.ceil(F.greatest(F.least(F.greatest(texts_in, shingles_in), F.lit(float(most_chunks))), texts_in / 8, shingles_in / 4)).cast("int")
    buckets = buckets.select("first.band", "first.bucket", chunks.alias("chunks"))
    members = materialize(bands.join(buckets, ["band", "bucket"]).select(*key, "band", "bucket", "chunks"), "members")
    chunk = F.pmod(member, F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("a"), F.greatest(k, F.col("chunk")).alias("b")))
    needed = members.select(*key).distinct()
    ids = texts.join(needed, key).filter("text_id IS NOT NULL").select(F.col("text_id").alias("doc_id")).distinct()
    # the texts of the members: by the smallest doc_id of their set, and of every row without one
    members_text = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").unionByName(docs.select("doc_id", "text").filter("doc_id IS NULL"))
    sets = members_text.select("text").mapInArrow(_sets, "hi long, lo long, shingles binary, sketch binary").join(needed, key, "left_semi").dropDuplicates(key)
    full = materialize(sets, "sets")
    units = members.withColumn("chunk", chunk).withColumn("pair", F.explode(pairs)).select(*key, "band", "bucket", "chunk", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    least = least_matches(threshold, tolerance)
    units = units.join(full, key)
    found = units.groupBy("band", "bucket", "a", "b").applyInPandas(lambda frame: _unit(frame, threshold, least), "hi long, lo long, links long, to_hi long, to_lo long")
    found = materialize(found, "links")
    discard(full, members)
    links = found.groupBy(*key).agg(F.sum("links").alias("n_links"))
    node, to = F.struct("hi", "lo"), F.struct(F.col("to_hi").alias("hi"), F.col("to_lo").alias("lo"))
    parts = connected_components(found.select(node.alias("a"), to.alias("b")))
    named = texts.select(*key, "size", "text_id", "text_copies").join(links, key, "left")
    parts = parts.select(F.col("node.hi").alias("hi"), F.col("node.lo").alias("lo"), "component").join(texts.select(*key, "text_id"), key)
    names = parts.groupBy("component").agg(F.min("text_id").alias("class_id"))
    named = named.join(parts.select(*key, "component").join(names, "component").select(*key, "class_id"), key, "left")
    named = named.select(*key, "text_id", "text_copies", F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = materialize(named, "named")  # a plain table, so that the join can split a set with many copies
    discard(found, texts)
    return rows.select("doc_id", *key).join(named, key).select("doc_id", "class_id", "n_links", "text_id", "text_copies")


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate class: that whose doc_id is the class_id.

    Of rows that share that doc_id one stays, that of the smallest text hash. Rows without words stay, as they
    are no copies of a text. Rows whose doc_id is null stay, as no class is named after them.
    """
    heads = near_duplicates(docs, threshold).filter("doc_id IS NOT NULL AND class_id = doc_id")
    heads = heads.groupBy("doc_id").agg((F.count("*") > 1).alias("_nd_many")).withColumnRenamed("doc_id", "_nd_id")
    empty = ~F.coalesce("text", F.lit("")).rlike(r"\S")
    rows = docs.join(heads, F.col("doc_id") == F.col("_nd_id"), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    plain = rows.filter(empty | F.col("doc_id").isNull() | ~F.col("_nd_many"))
    many = rows.filter(~empty & F.col("doc_id").isNotNull() & F.col("_nd_many"))
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    many = many.withColumn("_nd_rank", F.row_number().over(order)).filter("_nd_rank = 1")
    return plain.select(*own).unionByName(many.select(*own))
