"""Exact search for the highest inner products: a KD-tree for each shard of rows, searched best first.

A task reads its rows in shards of bounded size. Each shard becomes a tree of median splits along the widest side of a node's
tight bounding box; rows that are all equal are split by id. What a box can give a query at most is a sum over its sides, so a
query takes the node with the highest bound first and stops when no node left can give better than its k-th best score. That
score goes from shard to shard, and each task begins with the one that a sample of the rows gave. Queries are dealt into blocks
of bounded bytes; every block meets all rows where they lie, and only the best rows of a task move.

All arithmetic is in whole numbers (doubles where they are exact). Ties go to the smaller id, in bounds too, so that equal
vectors are not all looked at.

Defined cases: vectors that are null or hold a null, infinite or not-a-number component take no part; a shorter vector counts as
if zeros followed; components beyond what keeps sums of products within 64 bits count as that bound; rows of a query's own
id are no candidates of it; repeated rows are candidates as often as they occur, and equal queries (id and vector) are answered
once; a null id is no query, and as a candidate comes after all ids; fewer candidates than k are all given; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.materialize import collected, cut
from colloquy.llm.integral import integers, largest, usable, width

K = 10
SCALE = 1024
#: Rows of a shard and of a leaf at most; bytes of a block's vectors, about; rows of the sample that gives the first k-th scores, about.
SHARD = 1 << 14
LEAF = 128
BLOCK_BYTES = 4 << 20
SAMPLE = 1 << 13
NONE = np.iinfo(np.int64).max


class Tree:
    """Points in the order of the leaves, with each node's range, box, least id and children (the second follows the first)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.first, self.last, self.child = [0], [len(ids)], []
        low, high, least = [], [], []
        node = 0
        while node < len(self.first):
            a, b = self.first[node], self.last[node]
            here = points[order[a:b]]
            low.append(here.min(axis=0, initial=NONE))
            high.append(here.max(axis=0, initial=-NONE))
            least.append(ids[order[a:b]].min(initial=NONE))
            self.child.append(0)
            if b - a > leaf:
                sides, middle = high[-1] - low[-1], (b - a) // 2
                if len(sides) and sides.max() > 0:
                    order[a:b] = order[a:b][np.argpartition(here[:, sides.argmax()], middle)]
                else:
                    order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
                self.child[node] = len(self.first)
                self.first += [a, a + middle]
                self.last += [a + middle, b]
            node += 1
        self.points, self.ids, self.least = points[order], ids[order], [int(x) for x in least]
        self.low, self.high = np.array(low), np.array(high)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, best: list[list[tuple[int, int]]], floor: list[tuple[int, int] | None]) -> None:
        """Betters ``best``, for each query up to k of (minus score, id) in order, by the points; none beyond ``floor`` is needed."""
        big = max((int(np.abs(x).max(initial=0)) for x in (self.points, queries)), default=0)
        kind = np.float64 if big * big * max(queries.shape[1], 1) < 1 << 53 else np.int64
        points, asked = self.points.astype(kind), queries.astype(kind)
        bounds = np.maximum(asked, 0) @ self.high.T.astype(kind) + np.minimum(asked, 0) @ self.low.T.astype(kind)
        for q, most in enumerate(bounds):
            most, found, end = (-most).tolist(), best[q], floor[q]
            if len(found) == k and (end is None or found[-1] < end):
                end = found[-1]
            heap = [(most[0], self.least[0], 0)]
            while heap:
                bound, least, node = heappop(heap)
                if end is not None and (bound, least) >= end:
                    break
                if self.child[node]:
                    for c in (self.child[node], self.child[node] + 1):
                        if end is None or (most[c], self.least[c]) < end:
                            heappush(heap, (most[c], self.least[c], c))
                    continue
                a, b = self.first[node], self.last[node]
                scores, ids = points[a:b] @ asked[q], self.ids[a:b]
                good = ids != own[q] if end is None else (ids != own[q]) & (scores >= -end[0])
                if not good.any():
                    continue
                scores, ids = scores[good], ids[good]
                if len(scores) > k:
                    top = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[top], ids[top]
                new = [(-int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist())]
                found = sorted(x for x in found + new if floor[q] is None or x < floor[q])[:k]
                if len(found) == k:
                    end = found[-1]
            best[q] = found


def _searched(read: Callable[[pa.Array], np.ndarray], queries: np.ndarray, own: np.ndarray, k: int, floor: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        vectors, ids = [], []

        def grown() -> None:
            Tree(np.concatenate(vectors), np.concatenate(ids)).search(queries, own, k, best, floor)
            vectors.clear()
            ids.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                if sum(map(len, ids)) + part.num_rows > SHARD:
                    grown()
                vectors.append(read(part.column(0)))
                ids.append(part.column(1).fill_null(NONE).to_numpy(zero_copy_only=False))
        if ids:
            grown()
        q = np.repeat(np.arange(len(best)), [len(x) for x in best])
        rows = np.array([x for found in best for x in found], np.int64).reshape(-1, 2)
        vec = pa.array(rows[:, 1], mask=rows[:, 1] == NONE)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(own[q]), vec, pa.array(-rows[:, 0])], ["_q", "query_id", "vec_id", "score"])

    return run


def top(rows: DataFrame, asked: Column, k: int = K, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row that ``asked`` holds for, ranks from 1."""
    used = rows.filter(usable(vector)).select(F.col(vector).cast("array<double>").alias("_vector"), F.col(id).cast("long").alias("_id"), asked.alias("_asked"))
    total = used.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.size("_vector")), F.lit(0)).alias("width")).first()
    length = total["width"]
    most = largest(max(length, 1), 62)
    read = lambda column: integers(column, scale, length, most)
    queries = cut(used.filter(F.col("_asked") & F.col("_id").isNotNull()).select("_vector", "_id").distinct())
    blocks = max(1, -(-queries.count() * 8 * max(length, 1) // BLOCK_BYTES))
    candidates = used.select("_vector", "_id")
    apart = total["rows"] // SAMPLE
    sample = cut(candidates.filter(F.pmod(F.xxhash64("_vector", "_id"), F.lit(apart)) == 0)) if apart > 1 else None
    schema = "_q int, query_id long, vec_id long, score long"
    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())

    def best(of: DataFrame, vectors: np.ndarray, own: np.ndarray, floor: list) -> DataFrame:
        found = of.mapInArrow(_searched(read, vectors, own, k, floor), schema)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def answers() -> Iterator[DataFrame]:
        for block in range(blocks):
            here = queries.filter(F.pmod(F.xxhash64("_id", "_vector"), F.lit(blocks)) == block).toArrow()
            vectors, own = read(here.column(0).combine_chunks()), here.column(1).to_numpy()
            floor: list[tuple[int, int] | None] = [None] * len(own)
            if sample is not None:
                # the k-th of a part of the rows: the k-th of all is as good or better, and may be that very row
                for r in best(sample, vectors, own, floor).filter(F.col("rank") == k).collect():
                    floor[r["_q"]] = (-r["score"], (NONE if r["vec_id"] is None else r["vec_id"]) + 1)
            yield best(candidates, vectors, own, floor).select("query_id", "rank", "vec_id", "score")

    return collected(answers(), "nearest")
