"""Counts and categories of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.operators.cascade import OUTPUT, Cascade


def brain_summary(members: DataFrame, context: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row of totals; each table is read once and pruned to its keys."""
    own = members.agg(F.count("*").alias("memberships"), F.count_distinct("key_image").alias("rings"), F.count_distinct(*OUTPUT).alias("outputs"))
    tx = context.agg(F.count_distinct("tx_hash").alias("transactions"), F.count_distinct("height").alias("blocks"))
    claims = resolved.agg(F.count("*").alias("resolved"), F.count_if(F.col("pass") >= 0).alias("deterministic"))
    return own.join(tx).join(claims)  # three single rows


def ring_sizes(result: Cascade) -> DataFrame:
    """kind, size, rings. unreduced and partial: unresolved rings that lost nothing, or something, by what they have left;
    effective: both, where size 1 stands for all resolved rings and 0 for empty ones."""
    live = result.live()
    kind = F.when(F.col("left") < F.col("n"), "partial").otherwise("unreduced")
    open_ = live.groupBy(kind.alias("kind"), F.col("left").alias("size")).agg(F.count("*").alias("rings"))
    all_ = live.where(F.col("left") != 1).groupBy(F.col("left").alias("size")).agg(F.count("*").alias("rings"))
    done = result.resolved.agg(F.lit(1).cast("long").alias("size"), F.count("*").alias("rings"))
    return open_.unionByName(all_.unionByName(done).select(F.lit("effective").alias("kind"), "size", "rings"))


def reduction_categories(result: Cascade) -> DataFrame:
    """category, rings: four exclusive categories; empty rings count as reduced."""
    done = result.resolved.join(result.sizes, "key_image").select(F.when(F.col("n") == 1, "deterministic_single").otherwise("deterministic_multi").alias("category"))
    open_ = result.live().select(F.when(F.col("left") < F.col("n"), "reduced").otherwise("unchanged").alias("category"))
    return done.union(open_).groupBy("category").agg(F.count("*").alias("rings"))


def window_totals(blocks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, and totals over the blocks of a window; null where a block's details are missing."""
    incomplete = F.count_if(F.col("detail_status") != "complete")
    total = lambda c: F.when(incomplete == 0, F.sum(c)).alias(c)
    return blocks.groupBy(*(by or [])).agg(F.count("*").alias("blocks"), (F.max("height") - F.min("height") + 1 == F.count("*")).alias("contiguous"), total("ring_input_count"), total("ring_member_count"))
