"""Nearest neighbours by inner product: a block matrix join with int8 tiles.

Queries and candidates are cut into blocks of bounded size.  A tile multiplies
a block of queries with a block of candidates in int8 (each vector scaled by
its largest component); the products are exact integers.  A vector's rounding
error e is known exactly, so ``|<x, y> - <x', y'>| <= |e_x| |y| + |x'| |e_y|``
bounds every product.  A pair whose upper bound is under the k-th best lower
bound of its query can't be among the k nearest; all others are recomputed in
double precision, components in order, and the best k of each tile are merged
by heaps.  The answer is exact: no pair is lost.

Blocks, not single rows, meet, on a grid: a cell has one block of queries and a
group of at most ``GROUP`` blocks of candidates, and is worked through one
candidate block at a time, with the k-th best of the blocks before as a bound
from the start.  Cells are dealt by their place in the grid, so no task gets a
whole table, whatever share of the vectors has one length; a task holds one
block of either side.  The traffic is candidates * query blocks, and queries *
candidate groups; vectors travel as 32-bit floats where these are exact.

Rules for unusual rows: vectors that are null, empty, zero or that hold a null
or non-finite component take no part.  Only vectors of one length are
compared.  Of rows that share a vec_id the smallest vector counts; a null
vec_id takes no part.  Ties go to the smaller vec_id.  Queries with fewer than
k candidates return all.  Other columns are ignored.  No queries give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._blocks import lean
from ._tables import load, partitions, settle

K, BLOCK, GROUP = 20, 8192, 16
#: Components multiplied at once: 127 * 127 * 1024 is still exact in a 32-bit float.
EXACT = 1024


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, scales, norms of the vectors, of their int8 forms and of the errors (rounded up)."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    up = 1 + 1e-9
    norm = lambda v: np.sqrt((v * v).sum(1)) * up
    return q, scale, norm(x), norm(near), norm(x - near) + norm(x) * 1e-12


def _int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    out = np.zeros((len(a), len(b)), np.float64)
    for i in range(0, a.shape[1], EXACT):
        out += a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, components added from first to last: equal vectors give equal sums."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def tile(qid: np.ndarray, queries: np.ndarray, cid: np.ndarray, candidates: np.ndarray, k: int = K, made: tuple | None = None, least: np.ndarray | None = None) -> Found:
    """The k best candidates of each query in this tile: query row, candidate row, score.

    ``made`` are the queries as _quantised() has them; ``least`` is a score for
    each query under which nothing counts.
    """
    qq, qs, qn, qh, qe = made or _quantised(queries)
    cq, cs, cn, ch, ce = _quantised(candidates)
    rows, cols, scores = [], [], []
    step = max(1, (1 << 21) // max(1, len(cid)))
    for i in range(0, len(qid), step):
        s = slice(i, i + step)
        about = _int_products(qq[s], cq) * qs[s, None] * cs[None, :]
        slack = qe[s, None] * cn[None, :] + qh[s, None] * ce[None, :] + 1e-12 * qn[s, None] * cn[None, :]
        own = qid[s, None] == cid[None, :]
        low = np.where(own, -np.inf, about - slack)
        floor = np.partition(low, max(0, low.shape[1] - k), axis=1)[:, max(0, low.shape[1] - k)]
        if least is not None:
            floor = np.maximum(floor, least[s])
        r, c = np.nonzero((about + slack >= floor[:, None]) & ~own)
        for j in range(0, len(r), 1 << 16):
            rows.append(r[j : j + (1 << 16)] + i)
            cols.append(c[j : j + (1 << 16)])
            scores.append(_in_order(queries[rows[-1]], candidates[cols[-1]]))
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(float)
    return _best(*(np.concatenate(x) for x in (rows, cols, scores)), cid, k)


def _best(r: np.ndarray, c: np.ndarray, v: np.ndarray, cid: np.ndarray, k: int) -> Found:
    """The k best of each query row, ties to the smaller candidate id."""
    order = np.lexsort((cid[c], -v, r))
    r, c, v = r[order], c[order], v[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k], v[rank < k]


class Cell:
    """A block of queries with the best candidates of the blocks that it has met."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int = K) -> None:
        self.ids, self.queries, self.k, self.made = ids, queries, k, _quantised(queries)
        self.row, self.near, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, candidates: np.ndarray) -> None:
        r, c, v = tile(self.ids, self.queries, ids, candidates, self.k, self.made, self.least)
        near = np.r_[self.near, ids[c]]
        r, c, v = _best(np.r_[self.row, r], np.arange(len(near)), np.r_[self.score, v], near, self.k)
        self.row, self.near, self.score = r, near[c], v
        full = np.flatnonzero(np.bincount(r, minlength=len(self.ids)) == self.k)
        self.least[full] = v[np.searchsorted(r, full, "right") - 1]

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.near), pa.array(self.score)], ["query_id", "vec_id", "score"])


def _matrix(data: pa.Scalar, n: int, wide: bool) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.float64 if wide else np.float32).reshape(n, -1).astype(np.float64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK vectors of one length, queries also apart, numbered by task and turn."""
    held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
    task, turn = TaskContext.get().partitionId(), 0

    def block(key: tuple[int, bool]) -> pa.RecordBatch:
        nonlocal turn
        ids, x = (np.concatenate(part) for part in zip(*held.pop(key)))
        if len(ids) > BLOCK:
            held[key] = [(ids[BLOCK:], x[BLOCK:])]
            ids, x = ids[:BLOCK], x[:BLOCK]
        narrow = x.astype(np.float32)
        wide = bool((narrow != x).any())
        turn += 1
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([(task << 32) + turn]), "dim": pa.array([key[0]], pa.int32()), "query": pa.array([key[1]]), "n": pa.array([len(ids)], pa.int32()), "wide": pa.array([wide]), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([(x if wide else narrow).tobytes()], pa.binary())}
        )

    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            ids, query = np.asarray(part.column(0), np.int64), part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            size = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat, at = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                for q in (False, True):
                    pick = np.flatnonzero((size == dim) & (query | (not q)))
                    if len(pick):
                        held.setdefault((dim, q), []).append((ids[pick], flat[at[pick][:, None] + np.arange(dim)]))
                        while sum(len(x) for x, _ in held.get((dim, q), [])) >= BLOCK:
                            yield block((dim, q))
    while held:
        yield block(next(iter(held)))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, its block of queries first."""
    place, cell = None, None
    for b in batches:
        where = list(zip(*(b.column(k).to_pylist() for k in ("dim", "turn", "lot"))))
        for i, (at, query, n, wide) in enumerate(zip(where, *(b.column(k).to_pylist() for k in ("query", "n", "wide")))):
            ids, x = np.frombuffer(b.column("ids")[i].as_buffer(), np.int64), _matrix(b.column("data")[i], n, wide)
            if query:
                if cell:
                    yield cell.found()
                place, cell = at, Cell(ids, x)
            elif place == at:
                cell.meet(ids, x)
    if cell:
        yield cell.found()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by query: a heap of the K best so far for the query at hand."""
    query, heap = None, []

    def result() -> pa.RecordBatch:
        best = sorted(heap, reverse=True)
        return pa.RecordBatch.from_arrays([pa.array([query] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-x[1] for x in best], pa.int64()), pa.array([x[0] for x in best], pa.float64())], ["query_id", "rank", "vec_id", "score"])

    for b in batches:
        for q, vec_id, score in zip(*(c.to_pylist() for c in b.columns)):
            if q != query:
                if heap:
                    yield result()
                query, heap = q, []
            if len(heap) < K:
                heapq.heappush(heap, (score, -vec_id))
            else:
                heapq.heappushpop(heap, (score, -vec_id))
    if heap:
        yield result()


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column) -> DataFrame:
    """query_id, rank, vec_id and score of the K nearest of every row for which is_query holds."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    one = settle(good.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "vectors")
    # as many blocks as the vectors fill, whatever the number of partitions
    n = max(1, -(-one.count() // BLOCK))
    kind = "block long, dim int, query boolean, n int, wide boolean, ids binary, data binary"
    blocks = settle(one.repartition(n, "vec_id").mapInArrow(lean(_packed), kind), "blocks")
    # the grid is laid out without the vectors: a row for each block
    index = blocks.select("block", "dim", "query").withColumn("nth", F.row_number().over(Window.partitionBy("dim", "query").orderBy("block")) - 1)
    sides = index.groupBy("dim").agg(F.count_if(F.col("query")).alias("turns"), F.count_if(~F.col("query")).alias("blocks")).where("turns > 0")
    lots = F.least(F.col("blocks"), F.greatest(F.ceil(F.col("blocks") / GROUP), F.ceil(F.lit(partitions(vectors.sparkSession)) / F.col("turns")))).cast("int")
    index = index.join(sides.select("dim", F.col("turns").cast("int").alias("turns"), lots.alias("lots")), "dim")
    turns = F.when(F.col("query"), F.array("nth")).otherwise(F.sequence(F.lit(0), F.col("turns") - 1))
    cells = index.withColumn("turn", F.explode(turns))
    each = F.when(F.col("query"), F.sequence(F.lit(0), F.col("lots") - 1)).otherwise(F.array(F.col("nth") % F.col("lots")))
    cells = cells.select("block", "turn", F.explode(each).alias("lot"))
    laid = blocks.join(cells, "block").repartition("dim", "turn", "lot").sortWithinPartitions("dim", "turn", "lot", F.desc("query"), "block")
    best = laid.select("dim", "turn", "lot", "query", "n", "wide", "ids", "data").mapInArrow(lean(_cells), "query_id long, vec_id long, score double")
    return best.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lean(_merged), "query_id long, rank int, vec_id long, score double")


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
