"""Replaying a table of events as a stream: keyed state merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.plans.lineage import shared_dir
from evidara.sources.ingest import exists

MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
MERGE = {"first_seen": "min", "last_seen": "max", "confirmed": "min", "sightings": "sum"}


def merged(rows: DataFrame) -> DataFrame:
    """Partial states of each key as one; the merge is associative, so batches may come in any size."""
    return rows.groupBy("user_id").agg(*(getattr(F, how)(c).alias(c) for c, how in MERGE.items()))


def partial(events: DataFrame) -> DataFrame:
    us = F.expr(MICROS)
    return merged(events.select("user_id", us.alias("first_seen"), us.alias("last_seen"), F.when(F.col("event_type") == "purchase", us).alias("confirmed"), F.lit(1).cast("long").alias("sightings")))


def replay(spark: SparkSession, events_path: str) -> DataFrame:
    """The state after the whole stream. Version n of the state comes from version n - 1 and batch n, so a batch that is run
    again after a failure writes the same version again."""
    schema = spark.read.parquet(events_path).schema
    path = shared_dir(spark, "replay")
    last = [-1]

    def merge(batch: DataFrame, number: int) -> None:
        new, before = partial(batch), f"{path}/state-{number - 1}"
        if exists(spark, before):
            new = merged(new.unionByName(spark.read.parquet(before)))
        new.write.mode("overwrite").parquet(f"{path}/state-{number}")
        last[0] = number

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet").parquet(events_path + "*")
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if last[0] < 0:
        return partial(spark.createDataFrame([], schema))
    return spark.read.parquet(f"{path}/state-{last[0]}")
