"""Loading evidence tables, and the ring view of order data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rings:
    """members: (key_image, amount, idx), each once. context: (key_image, tx_hash, height), one row a ring."""

    members: DataFrame
    context: DataFrame

    def details(self) -> DataFrame:
        """(key_image, tx_hash, input_index, height, amount, idx): the members with their context, which may be missing."""
        context = self.context.select("key_image", "tx_hash", F.lit(0).alias("input_index"), "height")
        return self.members.join(context, "key_image", "left").select("key_image", "tx_hash", "input_index", "height", "amount", "idx")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_of(column: str) -> F.Column:
    """Months since January 1995."""
    return ((F.year(column) - 1995) * 12 + F.month(column) - 1).cast("long")


def rings(spark: SparkSession, sf_dir: str) -> Rings:
    """An order is a ring, its parts are the candidate outputs, its customer and month are the transaction."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key_image"), (F.col("l_orderkey") % 10).alias("amount"), F.col("l_partkey").alias("idx"))
    orders = table(spark, sf_dir, "orders")
    height = month_of("o_orderdate")
    context = orders.select(F.col("o_orderkey").alias("key_image"), (F.col("o_custkey") * 1000 + height).alias("tx_hash"), height.alias("height"))
    return Rings(lines.distinct(), context)


def membership(raw: DataFrame) -> DataFrame:
    """(key_image, amount, idx) of a ring_members table: duplicate rows collapse, rows of one key image form one ring."""
    return raw.select("key_image", "amount", F.col("global_output_index").alias("idx")).distinct()
