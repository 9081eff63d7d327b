"""Nearest neighbours by cosine: int8 product tiles with error bounds, survivors recomputed in double precision, merged by heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zocalo.llm.frames import exact, stored

NEAREST = 5
#: Query ids are the multiples of this.
QUERY_STEP = 50
#: Vectors in a block of queries and in a block of candidates; a tile is one such pair.
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096

BLOCK_SCHEMA = "dim int, size int, ids binary, vectors binary"
TILE_SCHEMA = "query_id long, vec_id long, score double"


def usable(vector: np.ndarray) -> bool:
    return bool(len(vector)) and bool(np.isfinite(vector).all()) and bool(vector.any())


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors of one dimension, as they come in each task.

    Vectors that are null, empty or all zero, or hold null or non-finite components, and rows without an id are left out.
    """

    def pack(dim: int, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([np.array([i for i, _ in held], "<i8").tobytes()], pa.binary()),
             pa.array([np.stack([v for _, v in held]).astype("<f8").tobytes()], pa.binary())], names=["dim", "size", "ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for vec_id, value in zip(b.column(0).to_pylist(), b.column(1)):
                values = value.values
                if vec_id is None or values is None or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(float)
                if not usable(v):
                    continue
                own = held.setdefault(len(v), [])
                own.append((vec_id, v))
                if len(own) == size:
                    yield pack(len(v), held.pop(len(v)))
        for dim, own in held.items():
            yield pack(dim, own)

    return vectors.mapInArrow(run, BLOCK_SCHEMA)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, the step of each, and the length of what rounding left over."""
    step = np.abs(unit).max(1) / 127.0
    code = np.rint(unit / step[:, None]).astype(np.int8)
    return code, step, np.linalg.norm(unit - code * step[:, None], axis=1)


class Side:
    """One block: ids, vectors, their norms and their int8 form."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.vectors = np.frombuffer(vectors, "<f8").reshape(-1, dim)
        # a power of two keeps squares of very large or small components finite and changes no digit
        self.vectors = np.ldexp(self.vectors, -np.frexp(np.abs(self.vectors).max(1))[1][:, None])
        self.norm = np.linalg.norm(self.vectors, axis=1)
        self.code, self.step, self.rest = quantised(self.vectors / self.norm[:, None])
        self.by_id = np.argsort(self.ids, kind="stable")
        self.firsts = np.flatnonzero(np.diff(self.ids[self.by_id], prepend=self.ids[self.by_id[:1]] - 1))  # where each id begins in by_id


def tile(queries: Side, candidates: Side, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query place, candidate places, exact cosines) of the pairs that can be among the ``k`` nearest.

    With unit vectors x, y and their coded forms x', y': |xy - x'y'| <= |x - x'| + |y - y'| (1 + |x - x'|). A pair
    survives if its upper bound reaches both ``floor`` (the query's kth best so far) and the kth best lower bound here, where
    rows that repeat an id count once, by the best of them.
    """
    # products of int8 codes are whole numbers below 2**24 for up to a thousand components, so float32 holds them; more go by double
    kind = np.float32 if queries.code.shape[1] <= 1024 else np.float64
    near = queries.code.astype(kind) @ candidates.code.astype(kind).T
    near = near * queries.step[:, None] * candidates.step[None, :]
    bound = queries.rest[:, None] + candidates.rest[None, :] * (1 + queries.rest[:, None]) + 1e-6
    near[queries.ids[:, None] == candidates.ids[None, :]] = -np.inf
    low = near - bound
    if len(candidates.firsts) < low.shape[1]:
        low = np.maximum.reduceat(low[:, candidates.by_id], candidates.firsts, axis=1)
    if low.shape[1] > k:
        floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
    keep = (near + bound >= floor[:, None]) & np.isfinite(near)
    for q in np.flatnonzero(keep.any(1)).tolist():
        at = np.flatnonzero(keep[q])
        # row sums, so that equal vectors get equal scores wherever they stand in a block
        yield q, at, (candidates.vectors[at] * queries.vectors[q]).sum(1) / (candidates.norm[at] * queries.norm[q])


def search(vectors: DataFrame, k: int = NEAREST, step: int = QUERY_STEP) -> DataFrame:
    """Each query's ``k`` nearest by cosine: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Queries are the rows whose id is a multiple of ``step``; candidates are all rows but those with the query's own id.
    The result is exact: tiles only leave out pairs that their bounds rule out. Query blocks are repeated over groups of
    candidate blocks, so what is moved is the queries times the groups, and one task holds one tile. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of different dimension
    are never compared; rows that repeat an id count as one candidate with their best score; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = exact(vectors, vec_id="vec_id", embedding="embedding")
    candidates = stored(blocks(rows, CANDIDATE_BLOCK).withColumn("place", F.monotonically_increasing_id()), "ann-candidates")
    asked = rows.where(F.col("vec_id") % step == 0)
    queries = stored(blocks(asked.repartition(1 + asked.count() // QUERY_BLOCK), QUERY_BLOCK), "ann-queries")
    groups = max(1, candidates.count() // 4)
    right = candidates.select("dim", F.pmod(F.xxhash64("place"), F.lit(groups)).alias("cell"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    left = queries.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("cell"), "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for dim, ids, own, c_ids, other in zip(*(b.column(i) for i in range(5))):
                q, c = Side(dim.as_py(), ids.as_py(), own.as_py()), Side(dim.as_py(), c_ids.as_py(), other.as_py())
                heaps = [best.setdefault(i, []) for i in q.ids.tolist()]
                floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
                for place, at, scores in tile(q, c, k, floor):
                    heap = heaps[place]
                    for score, vec_id in zip(scores.tolist(), c.ids[at].tolist()):
                        held = next((x for x in heap if x[1] == -vec_id), None)
                        if held is not None:
                            if score > held[0]:
                                heap.remove(held)
                                heapq.heapify(heap)
                            else:
                                continue
                        if len(heap) < k:
                            heapq.heappush(heap, (score, -vec_id))
                        elif (score, -vec_id) > heap[0]:
                            heapq.heapreplace(heap, (score, -vec_id))
        rows_out = [(i, -v, s) for i, heap in best.items() for s, v in heap]
        for a in range(0, len(rows_out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows_out[a:a + (1 << 16)])], names=["query_id", "vec_id", "score"])

    found = left.join(right, ["dim", "cell"]).select("dim", "ids", "vectors", "c_ids", "c_vectors").mapInArrow(run, TILE_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
