"""Hard-negative mining by product quantisation with rigorous bounds.

Vectors of whole numbers lie in blocks. Of each vector a block stores a code per subspace (the number of its nearest
centroid) and the norm of what the centroid leaves over there. An anchor's look-up table has its inner product with every
centroid; a vector's score lies within the sum of its table entries, plus or minus the sum over the subspaces of the
anchor's norm times the stored residual norm. A vector whose interval cannot reach what a block surely offers is left out;
all others get their exact integer score, so the result is exact whatever the codes are.

The index is a stored table with a row per block. Anchors go to it in waves of bounded size, each of which reads the table
once for the positives and once for the negatives; no vector is shuffled for a search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import column, in_arrow, integral, shared_dir, written

#: Components of a subspace, centroids in each, vectors that they are fitted on (by a hash of their row), rounds of it.
SUB, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 4096, 8
#: Vectors of a block and anchors of a wave, about.
BLOCK, WAVE = 8192, 2048
#: Relative slack of the bounds for floating-point sums.
SLACK = 1e-10
INDEX = "block long, codes binary, norms binary, vectors binary, ids binary, rows binary, labels binary"
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def codebooks(sample: np.ndarray) -> np.ndarray:
    """Centroids of whole numbers for each subspace: (subspaces, centroids, components), by Lloyd's rounds."""
    parts = _parts(sample.astype(np.float64))
    out = np.zeros((parts.shape[1], CENTROIDS, SUB))
    for m in range(parts.shape[1]):
        points = np.unique(parts[:, m], axis=0)
        at = points[np.random.default_rng(m).permutation(len(points))[:CENTROIDS]]
        if len(points) > CENTROIDS:
            for _ in range(ROUNDS):
                near = _nearest(points, at)
                n = np.bincount(near, minlength=len(at))
                sums = np.column_stack([np.bincount(near, points[:, c], len(at)) for c in range(SUB)])
                at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
        out[m] = np.r_[at, np.repeat(at[:1], CENTROIDS - len(at), 0)]
    return np.rint(out)


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, subspaces, components), filled up with zeros."""
    width = -(-x.shape[1] // SUB) * SUB
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, SUB)


def _nearest(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((at**2).sum(1) - 2 * points @ at.T).argmin(1)


class Block:
    """Codes, residual norms, vectors, ids, rows and labels of one block, in order of label."""

    def __init__(self, codes: np.ndarray, norms: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.codes, self.norms, self.x, self.ids, self.rows, self.labels = codes, norms, x, ids, rows, labels
        self.longest = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max()))

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, books: np.ndarray, most: int) -> Block:
        """Of equal vectors with one label only the first most (by id, then row) can ever be asked for; the others go."""
        same = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1]
        order = np.lexsort((rows, ids, same, labels))
        same, tag = same[order], labels[order]
        first = np.flatnonzero(np.r_[True, (same[1:] != same[:-1]) | (tag[1:] != tag[:-1])])
        sizes = np.diff(np.r_[first, len(order)])
        order = order[np.arange(len(order)) - np.repeat(first, sizes) < most]
        x = x[order]
        parts = _parts(x.astype(np.float64))
        codes = np.column_stack([_nearest(parts[:, m], books[m]) for m in range(len(books))]).astype(np.uint8)
        left = parts - books[np.arange(len(books)), codes]
        norms = np.nextafter(np.sqrt((left**2).sum(2)).astype(np.float32), np.float32(np.inf))
        return cls(np.ascontiguousarray(codes.T), np.ascontiguousarray(norms.T), x, ids[order], rows[order], labels[order])

    def bounds(self, a: np.ndarray, books: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the vectors from start to stop can have with a."""
        parts = _parts(a[None].astype(np.float64))[0]
        table = np.einsum("mkc,mc->mk", books, parts)
        own = np.sqrt((parts**2).sum(1))
        score = np.zeros(stop - start)
        for m in range(len(books)):
            score += table[m][self.codes[m, start:stop]]
        reach = own @ self.norms[:, start:stop].astype(np.float64) * (1 + SLACK) + 1 + SLACK * float(np.sqrt((own**2).sum())) * self.longest
        return score - reach, score + reach

    def own(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def first(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.rows[at], self.ids[at], -score))[:k]
        return at[order], score[order]

    def positives(self, a: np.ndarray, row: int, label: int, books: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the first k other rows of the label."""
        start, stop = self.own(label)
        low, high = self.bounds(a, books, start, stop)
        other = self.rows[start:stop] != row
        low[~other] = -np.inf
        sure = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        at = start + np.flatnonzero(other & (high >= sure))
        return self.first(at, self.x[at] @ a, k)

    def negatives(self, a: np.ndarray, label: int, windows: list[tuple[int, int]], books: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least and greatest score) places and scores of the first k rows of other labels inside it."""
        low, high = self.bounds(a, books, 0, len(self.ids))
        start, stop = self.own(label)
        low[start:stop] = high[start:stop] = -np.inf
        out = []
        for least, greatest in windows:
            inside = (high >= least) & (low <= greatest)
            surely = low[(low >= least) & (high <= greatest)]
            if len(surely) >= k:
                inside &= high >= np.partition(surely, len(surely) - k)[len(surely) - k]
            at = np.flatnonzero(inside)
            score = self.x[at] @ a
            fits = (score >= least) & (score <= greatest)
            out.append(self.first(at[fits], score[fits], k))
        return out


def _stored(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        for r in range(batch.num_rows):
            at = lambda name, kind: np.frombuffer(column(batch, name)[r].as_buffer(), kind)  # noqa: E731, B023
            ids = at("ids", np.int64)
            n = len(ids)
            yield Block(at("codes", np.uint8).reshape(-1, n), at("norms", np.float32).reshape(-1, n), at("vectors", np.int64).reshape(n, width), ids, at("rows", np.int64), at("labels", np.int64))


def build_index(rows: DataFrame, books: np.ndarray, width: int, blocks: int, most: int) -> DataFrame:
    """rows (id, row, label, e of whole numbers) -> the stored table of blocks."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def build(table: pa.Table) -> pa.Table:
        values = table.column("e").combine_chunks().flatten()
        x = np.asarray(values, np.int64).reshape(-1, width)
        block = Block.of(x, *(np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("id", "row", "label")), sent.value, most)
        parts = [np.asarray(table.column("block").combine_chunks())[:1].tolist(), *([v.tobytes()] for v in (block.codes, block.norms, block.x, block.ids, block.rows, block.labels))]
        return pa.table([pa.array(v, t) for v, t in zip(parts, [pa.int64(), *[pa.binary()] * 6], strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return written(dealt.groupBy("block").applyInArrow(build, INDEX), "codes")


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: float = 256,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of hard negatives.

    A component becomes floor(scale * x), a row's score is its integer inner product with the anchor; higher ones come first,
    ties by smaller id. Anchors are the rows whose id is divisible by every. For each anchor and each of its first positives
    (other rows of its label) come the first negatives (rows of another label) whose score is at most the positive's and at
    least the share (numerator, denominator) of it.

    Rows with a null id, label, vector or component, a non-finite component, an empty vector, or one of another length than
    most have, take no part; nor do vectors whose squared integer norm is 2^62 or more, whose scores no long could hold.
    Rows of a repeated id are rows of their own: each is an anchor if the id asks for it, and a candidate for the others.
    Zero vectors take part. Anchors without positives, and positives without negatives, give no rows; so does an empty table.
    """
    integral(vectors, key)
    integral(vectors, label)
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("e"))
    rows = rows.where("id is not null and label is not null and size(e) > 0").where(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = rows.withColumn("e", F.transform("e", lambda v: F.floor(v * scale))).where(F.aggregate("e", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) < 2.0**62)
    sizes = rows.groupBy(F.size("e").alias("width")).agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("anchors")).orderBy(F.desc("n"), "width").head(1)
    if not sizes or not sizes[0].anchors:
        return spark.createDataFrame([], SCHEMA)
    width, n, anchors = sizes[0]
    rows = written(rows.where(F.size("e") == width).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = rows.orderBy(F.xxhash64("row"), "row").select("e").limit(SAMPLE).collect()
    books = codebooks(np.array([r.e for r in sample], np.int64))
    index = build_index(rows, books, width, -(-n // BLOCK), max(positives + 1, negatives))
    sent = spark.sparkContext.broadcast(books)
    waves = -(-anchors // WAVE)
    asked = written(rows.where(F.col("id") % every == 0).withColumn("wave", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(waves))).repartition("wave"), "anchors")
    path = shared_dir(spark, "negatives")
    for wave in range(waves):
        _wave(index, asked.where(F.col("wave") == wave), sent, width, positives, negatives, share).write.parquet(f"{path}/wave={wave}")
    return spark.read.schema(SCHEMA).parquet(*(f"{path}/wave={wave}" for wave in range(waves)))


def _wave(index: DataFrame, anchors: DataFrame, books, width: int, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame:
    """The result of about WAVE anchors, which with their positives are broadcast; two passes over the index."""
    context = index.sparkSession.sparkContext
    own = anchors.select("row", "id", "label", "e").collect()
    if not own:  # the hash gave this wave none
        return index.sparkSession.createDataFrame([], SCHEMA)
    asks = context.broadcast((*(np.array([r[c] for r in own], np.int64) for c in ("row", "id", "label")), np.array([r.e for r in own], np.int64).reshape(len(own), width)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _stored(batches, width):
            found = [block.positives(a, row, label, books.value, positives) for row, label, a in zip(asks.value[0].tolist(), asks.value[2].tolist(), asks.value[3], strict=True)]
            at, score = (np.concatenate([f[c] for f in found]) for c in (0, 1))
            which = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (which, block.ids[at], block.rows[at], score)], ["which", "id", "row", "score"])

    first = F.row_number().over(Window.partitionBy("which").orderBy(F.desc("score"), "id", "row"))
    best = in_arrow(index, near, "which long, id long, row long, score long").withColumn("n", first).where(F.col("n") <= positives).orderBy("which", "n").collect()
    aims = context.broadcast([[(r.id, r.score) for r in best[a:z]] for a, z in _runs([r.which for r in best], len(own))])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _stored(batches, width):
            out: list[tuple[np.ndarray, ...]] = []
            for which, (name, label, a, aim) in enumerate(zip(asks.value[1].tolist(), asks.value[2].tolist(), asks.value[3], aims.value, strict=True)):
                if aim:
                    windows = [(-(-share[0] * s // share[1]), s) for _, s in aim]
                    for n, ((at, score), (other, s)) in enumerate(zip(block.negatives(a, label, windows, books.value, negatives), aim, strict=True)):
                        out.append((np.full(len(at), which), np.full(len(at), n), np.full(len(at), name), np.full(len(at), other), np.full(len(at), s), block.ids[at], block.rows[at], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in zip(*out, strict=True)], ["which", "n", "anchor_id", "positive_id", "positive_score", "negative_id", "row", "negative_score"])

    last = F.row_number().over(Window.partitionBy("which", "n").orderBy(F.desc("negative_score"), "negative_id", "row"))
    found = in_arrow(index, far, "which long, n long, anchor_id long, positive_id long, positive_score long, negative_id long, row long, negative_score long")
    return found.withColumn("rank", last).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _runs(which: list[int], n: int) -> list[tuple[int, int]]:
    bounds = np.searchsorted(np.array(which, np.int64), np.arange(n + 1)).tolist()
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def relabelled(vectors: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Labels of rows whose id is divisible by 7 go on by one, modulo 10; null ids and labels stay."""
    return vectors.withColumn(label, F.when(F.col(key) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label)))
