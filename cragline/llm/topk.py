"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are integers. They are written in ranges of descending length, so that the longest come first in a table
and in each task. Queries and vectors are rotated by the singular vectors of a bounded sample; any rotation keeps
products, a good one puts most of a product into the leading coordinates. For a block of vectors the products are summed
up a few coordinates at a time. After each step a pair can add at most the product of the residual lengths (Cauchy-
Schwarz), and pairs that cannot reach their query's k-th score so far are dropped: whole queries at once where
even the lengths do not suffice. Pairs that outlast all steps are scored exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm.common import materialize

ROWS = 2048
STEP = 16
SLACK = 1e-9
#: Cells of vectors that the driver holds at once: the sample of the rotation, the first vectors, a block of queries.
MAX_CELLS = 1 << 22
#: Stands for no score yet; unlike the smallest long, its negative is a long.
LOWEST = -(1 << 62)
LAST_ID = np.iinfo(np.int64).max


def quantise(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """key, v: floor(scale * x) of each component as long; rows whose key or vector is null, or with a null or
    non-finite component, take no part."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("e")).filter(F.col("e").isNotNull() & F.col("vec_id").isNotNull())
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.filter(finite).select("vec_id", F.transform("e", lambda c: F.floor(c.cast("double") * float(scale))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to the width, and cut to it."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    start = 0
    for i, n in enumerate(sizes):
        out[i, : min(n, width)] = flat[start : start + min(n, width)]
        start += n
    return out


@dataclass
class Best:
    """The k best (score, id) of each query, ties to the smaller id; an id with the same score counts once."""

    n: int
    k: int
    score: np.ndarray = field(init=False)
    id: np.ndarray = field(init=False)

    def __post_init__(self):
        self.score, self.id = np.full((self.n, self.k), LOWEST), np.full((self.n, self.k), LAST_ID)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        who = np.unique(q)
        there = self.id[who] != LAST_ID
        q = np.concatenate([q, np.repeat(who, there.sum(axis=1))])
        score, ids = np.concatenate([score, self.score[who][there]]), np.concatenate([ids, self.id[who][there]])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        q, score, ids = q[new], score[new], ids[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        on = rank < self.k
        self.score[q[on], rank[on]], self.id[q[on], rank[on]] = score[on], ids[on]


@dataclass
class Search:
    """One block of queries, and what it has cost: pairs seen, and pairs scored exactly."""

    q: np.ndarray
    ids: np.ndarray
    rotation: np.ndarray
    start: np.ndarray
    k: int
    pairs: int = 0
    scored: int = 0

    def __post_init__(self):
        self.turned = self.q @ self.rotation
        self.length = np.sqrt((self.turned**2).sum(axis=1))
        self.best = Best(len(self.q), self.k)

    def bar(self) -> np.ndarray:
        """The score that a vector has to reach; equal ones may still win by their id."""
        return np.maximum(self.best.score[:, -1], self.start).astype(np.float64)

    def block(self, x: np.ndarray, xid: np.ndarray) -> None:
        """Take a block of vectors in."""
        width = x.shape[1]
        self.pairs += len(self.q) * len(x)
        real = x.astype(np.float64)
        xx = (real**2).sum(axis=1)
        longest = float(np.sqrt(xx.max(initial=0.0)))
        slack = SLACK * (1 + self.length * longest)
        bar = self.bar() - slack
        rows = np.flatnonzero(self.length * longest >= bar)
        if not len(rows):
            return
        cols, turned = np.arange(len(x)), self.turned
        qq = self.length[rows] ** 2
        part = np.zeros((len(rows), len(x)))
        hope = np.ones(part.shape, bool)
        for a in range(0, width, STEP):
            b = min(a + STEP, width)
            qa, xa = turned[rows, a:b], real[cols] @ self.rotation[:, a:b]
            part += qa @ xa.T
            qq, xx = np.maximum(qq - (qa**2).sum(axis=1), 0.0), np.maximum(xx - (xa**2).sum(axis=1), 0.0)
            # residuals come by subtraction, so what rounding may have taken from them is given back
            left = np.outer(np.sqrt(qq + SLACK * self.length[rows] ** 2), np.sqrt(xx + SLACK * longest**2)) if b < width else 0.0
            hope &= part + left >= bar[rows, None]
            q_on, x_on = hope.any(axis=1), hope.any(axis=0)
            if not q_on.any():
                return
            if q_on.mean() < 0.8 or x_on.mean() < 0.8:
                rows, cols, qq, xx = rows[q_on], cols[x_on], qq[q_on], xx[x_on]
                part, hope = part[np.ix_(q_on, x_on)], hope[np.ix_(q_on, x_on)]
        i, j = np.nonzero(hope)
        i, j = rows[i], cols[j]
        other = xid[j] != self.ids[i]
        i, j = i[other], j[other]
        self.scored += len(i)
        for a in range(0, len(i), 1 << 16):
            at, to = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            score = np.einsum("ij,ij->i", self.q[at], x[to])
            good = score >= np.maximum(self.best.score[at, -1], self.start[at])
            if good.any():
                self.best.add(at[good], score[good], xid[to][good])

    def results(self) -> pa.RecordBatch | None:
        there = self.best.id != LAST_ID
        if not there.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, there.sum(axis=1))), pa.array(self.best.id[there]), pa.array(self.best.score[there])], ["query_id", "vec_id", "score"])


def _measured(vectors: DataFrame, width: int) -> DataFrame:
    """vectors with their lengths."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"), width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(np.sqrt((m**2).sum(axis=1)))], ["vec_id", "v", "length"])

    return vectors.mapInArrow(measure, "vec_id long, v array<bigint>, length double")


def _held(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded number of rows."""
    t = rows.select("vec_id", "v").toArrow()
    ids = t.column("vec_id").to_numpy().astype(np.int64)
    parts = [_matrix(c, width) for c in t.column("v").chunks if len(c)]
    return ids, (np.concatenate(parts) if parts else np.zeros((0, width))).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 4096, first: int = 4096, sample: int = 65_536) -> DataFrame:
    """vectors(vec_id, v), queries(vec_id, v), v arrays of long -> query_id, rank, vec_id, score.

    The k highest inner products of each query with every vector of another id; all, if fewer. Ties go to the
    smaller vec_id, ranks start at 1. Shorter vectors count as padded with zeros; a vector repeated with the
    same id takes part once, as do rows of one id with equal scores; null and empty tables give empty results. Products
    have to fit into a long.

    Queries go in blocks of at most query_block, one after the other, each broadcast against all vectors and then
    let go. The `first` longest vectors give each query a k-th score to begin with. The rotation is fitted to about
    `sample` vectors, chosen by a hash of their id. All three are cut further so that a block has MAX_CELLS components.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    if not width or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    room = max(1, MAX_CELLS // width)
    ordered = materialize(_measured(vectors.select("vec_id", "v"), width).repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id"), "norm-sorted")
    n = ordered.count()
    chosen = ordered if n <= min(sample, room) else ordered.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < min(sample, room)).limit(2 * room)
    fitted = _held(chosen, width)[1].astype(np.float64)
    rotation = np.ascontiguousarray(np.linalg.eigh(fitted.T @ fitted)[1][:, ::-1])
    lid, longest = _held(ordered.orderBy(F.desc("length"), "vec_id").limit(min(first, room)), width)
    asked = materialize(queries.select("vec_id", "v").dropDuplicates(), "queries")
    blocks = -(-asked.count() // min(query_block, room))
    out = None
    for block in range(blocks):
        rows = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        ids, q = _held(rows, width)
        if not len(ids):
            continue
        ahead = Search(q, ids, rotation, np.full(len(ids), LOWEST), k)
        for a in range(0, len(lid), ROWS):
            ahead.block(longest[a : a + ROWS], lid[a : a + ROWS])
        given = spark.sparkContext.broadcast((q, ids, rotation, ahead.best.score[:, -1].copy()))

        def search(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            own = Search(*given.value, k)
            for b in batches:
                for a in range(0, b.num_rows, ROWS):
                    part = b.slice(a, ROWS)
                    own.block(_matrix(part.column("v"), width), part.column("vec_id").to_numpy(zero_copy_only=False))
            if found := own.results():
                yield found

        part = ordered.select("vec_id", "v").mapInArrow(search, schema)
        if blocks > 1:
            part = materialize(part, "top-k")
            given.unpersist()
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
