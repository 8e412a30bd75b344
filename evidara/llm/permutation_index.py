"""Approximate nearest neighbours (largest inner product) by a permutation index.

A vector is represented by its nearest pivots in order. Each vector is posted, with the pivot's rank, in the inverted
files of those pivots. A query reads the files of its own nearest pivots, ranks what it finds by the footrule distance
of the two orders, where a pivot beyond an order's end counts as next to its last, and reranks the best by the exact inner
product. Vectors get one more component that makes all norms equal, so that the largest inner product is the nearest
vector whatever the norms.

Vectors lie in blocks by a hash of their row, each with the files of its own vectors, so that no pivot's file, however
popular, is more than a part of one block; queries go to the blocks in visits. Equal vectors are one entry of a block with
many ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import column, in_arrow, integral, written

#: Pivots (a bounded sample of the vectors, by a hash of their id); how many of them stand for a vector.
PIVOTS, PREFIX = 512, 64
#: What a query reranks of a block: a share of its distinct vectors, and so many times the neighbours asked for.
RERANK, SPARE = 0.06, 10
#: Vectors in a block, queries in one visit.
BLOCK, VISIT = 16_384, 4_096


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more component, so that all vectors have the largest norm (its square: top)."""
    return np.column_stack((x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))))


class Block:
    """rows tell repeated ids apart: equal vectors are one entry, with their (id, row) in order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, pivots: np.ndarray, top: float):
        order = np.lexsort((rows, ids, *x.T))  # equal vectors side by side, ids ascending
        self.ids, self.row_ids, x = ids[order], rows[order], x[order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1)])
        self.x = x[first]
        self.starts = np.r_[first, len(ids)]
        self.pivots = pivots
        self.prefix = min(PREFIX, len(pivots))
        near = self.permutation(lifted(self.x, top))
        post = np.argsort(near.ravel(), kind="stable")
        self.rows, self.ranks = (post // self.prefix).astype(np.int32), (post % self.prefix).astype(np.int16)
        self.files = np.searchsorted(near.ravel()[post], np.arange(len(pivots) + 1))

    def permutation(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivots in order; pivots at the same distance by number."""
        out = np.empty((len(x), self.prefix), np.int32)
        for a in range(0, len(x), 2048):
            far = (self.pivots**2).sum(1) - 2 * x[a : a + 2048] @ self.pivots.T
            out[a : a + 2048] = np.argsort(far, 1, kind="stable")[:, : self.prefix]
        return out

    def footrule(self, near: np.ndarray) -> np.ndarray:
        """Of each vector the footrule distance of its order to near, less what it is if they share no pivot, and halved: a
        pivot of ranks a and b in orders of length l saves l - max(a, b) of it."""
        starts, sizes = self.files[near], self.files[near + 1] - self.files[near]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        saved = self.prefix - np.maximum(self.ranks[at], np.repeat(np.arange(len(near), dtype=np.int16), sizes))
        return -np.bincount(self.rows[at], saved, len(self.x))

    def search(self, row: int, q: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, rows and inner products of the k nearest that are found, but for the query's own row."""
        most = min(len(self.x), int(np.ceil(RERANK * len(self.x))) + SPARE * k)
        rows = np.argpartition(self.footrule(near), most - 1)[:most]
        value = (self.x[rows] * q).sum(1)
        if len(rows) > k + 1:  # all that can be among the k nearest, with every tie
            keep = value >= np.partition(value, len(value) - k - 1)[len(value) - k - 1]
            rows, value = rows[keep], value[keep]
        sizes = np.minimum(self.starts[rows + 1] - self.starts[rows], k + 1)
        at = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        value = np.repeat(value, sizes)
        other = self.row_ids[at] != row
        at, value = at[other], value[other]
        order = np.lexsort((self.row_ids[at], self.ids[at], -value))[:k]
        return self.ids[at[order]], self.row_ids[at[order]], value[order]


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return np.asarray(values.flatten(), np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each query, the rows whose id is divisible by every.

    Null vectors and ids, zero vectors, and those with null or non-finite components take no part, nor do vectors of
    another length than most have. A query's own row is no candidate; each row of a repeated id is a candidate, and a query
    of its own if the id is asked for. Ties go to the smaller id. An empty table, or one without queries, gives no rows.
    """
    integral(vectors, key)
    spark = vectors.sparkSession
    e = F.col("e")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e"))
    rows = rows.where("id is not null and e is not null").where(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0))
    norm = F.aggregate(e, F.lit(0.0), lambda a, v: a + v * v)
    sizes = rows.groupBy(F.size("e").alias("width")).agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.count_if(F.col("id") % every == 0).alias("q")).orderBy(F.desc("n"), "width").head(1)
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    width, n, top, q = sizes[0]
    rows = written(rows.where(F.size("e") == width).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(4 * PIVOTS).collect()
    pivots = lifted(np.unique(np.array([r["e"] for r in sample]), axis=0), top)
    pivots = spark.sparkContext.broadcast(pivots[np.random.default_rng(0).permutation(len(pivots))[:PIVOTS]])
    blocks, visits = -(-n // BLOCK), max(1, -(-q // VISIT))
    block, visit = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(visits))
    every_ = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    placed = rows.select(block.alias("b"), every_(visits).alias("v"), F.lit(0).alias("asks"), "id", "row", "e")
    asked = rows.where(F.col("id") % every == 0).select(every_(blocks).alias("b"), visit.alias("v"), F.lit(1).alias("asks"), "id", "row", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, index = None, [], None
        for batch in batches:
            keys = [np.asarray(column(batch, c)) for c in ("b", "v", "asks", "id", "row")]
            x = _matrix(column(batch, "e"), width)
            cuts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys[:3]], 0), True])
            out: list[tuple] = []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                at = (keys[0][a], keys[1][a])
                if at != place:
                    place, held, index = at, [], None
                if not keys[2][a]:
                    held.append((keys[3][a:z], keys[4][a:z], x[a:z]))
                    continue
                if index is None:
                    index = Block(*(np.concatenate(y) for y in zip(*held, strict=True)), pivots.value, top) if held else False
                    held = []
                if index is False:
                    continue
                own = np.column_stack((x[a:z], np.zeros(z - a)))
                for qid, row, q, near in zip(keys[3][a:z].tolist(), keys[4][a:z].tolist(), x[a:z], index.permutation(own), strict=True):
                    ids, rows_, values = index.search(row, q, near, k)
                    out.append((np.full(len(ids), qid), np.full(len(ids), row), ids, rows_, values))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*out, strict=True)], ["query_id", "query_row", "vec_id", "vec_row", "score"])

    dealt = placed.union(asked).repartition(blocks * visits, "b", "v").sortWithinPartitions("b", "v", "asks")
    found = in_arrow(dealt, run, "query_id long, query_row long, vec_id long, vec_row long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
