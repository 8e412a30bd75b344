"""Connected components of an edge table by large and small stars in turn; nothing goes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.plans.lineage import cut

#: Edges (32 bytes each at work) up to which one task labels them; more are labelled by stars.
ONE_TASK = 1 << 20


def apart(column: F.Column) -> F.Column:
    """The same join key in other words, one to one, so that Spark deals both sides out itself and AQE may split skew."""
    return F.reverse(column.cast("string"))


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices in order, and for each the smallest one that it reaches."""
    ends, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ends))
    while len(a):
        least = np.minimum(label[x], label[y])
        after = label.copy()
        for place in (x, y, label[x], label[y]):
            np.minimum.at(after, place, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return ends, ends[label]


def stars(edges: DataFrame) -> DataFrame:
    """The same as components, for ends of any type that has an order, in rounds over the whole cluster.

    Each round hangs the larger neighbours of every vertex on the least vertex near it (large star), then the smaller ones
    and itself (small star). Edges never grow in number; it ends only when every vertex hangs on one root that hangs on none.
    """
    ends = cut(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct(), "ends")
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    while True:
        pairs = cut(pairs, "pairs")
        roots = pairs.select(apart(F.col("m")).alias("key")).distinct()
        total, single = pairs.agg(F.count("*"), F.count_distinct("v")).first()
        if total == single and pairs.select("v", apart(F.col("v")).alias("key")).join(roots, "key", "left_semi").isEmpty():
            break
        least = pairs.select("v", "m").union(pairs.select("m", "v")).groupBy("v").agg(F.least(F.min("m"), F.first("v")).alias("l"))
        large = pairs.withColumn("key", apart(F.col("m"))).join(least.select(apart(F.col("v")).alias("key"), "l"), "key")
        pairs = cut(large.select("v", F.col("l").alias("m")).distinct(), "pairs")
        least = pairs.groupBy("v").agg(F.min("m").alias("l"))
        small = pairs.withColumn("key", apart(F.col("v"))).join(least.select(apart(F.col("v")).alias("key"), "l"), "key")
        pairs = small.where("m <> l").select(F.col("m").alias("v"), F.col("l").alias("m")).union(least.select("v", F.col("l").alias("m"))).distinct()
    hung = pairs.select(apart(F.col("v")).alias("key"), "m")
    return cut(ends.withColumn("key", apart(F.col("v"))).join(hung, "key", "left").select("v", F.coalesce("m", "v").alias("root")), "labels")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (v, root): for every end of an edge the smallest vertex that it reaches.

    Few edges of longs are labelled by one task, all others by stars; both go on until nothing moves. No edges give no
    rows; loops and repeated edges do no harm, edges with a null end count for nothing.
    """
    edges = cut(edges.select("a", "b").where("a is not null and b is not null"), "edges")
    if [t for _, t in edges.dtypes] != ["bigint", "bigint"] or edges.count() > ONE_TASK:
        return stars(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(batch.column(i)) for i in (0, 1)] for batch in batches]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in labels_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))], ["v", "root"])

    return cut(edges.coalesce(1).mapInArrow(run, "v long, root long"), "labels")
