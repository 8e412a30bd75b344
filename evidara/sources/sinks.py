"""Sinks: one JSON document put in place at once, histories that only grow on change, safe CSV, manifests."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions.analytics import csv_safe


def publish(path: str, document: Any) -> None:
    """A small document written beside its place and moved there; readers see the old one or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(document, f, sort_keys=True, allow_nan=False)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def grown(history: list[dict], entry: dict, stamp: str = "generated_at") -> list[dict]:
    """The history with the entry, unless only its time differs from the last one's."""
    plain = lambda x: {k: v for k, v in x.items() if k != stamp}
    return history if history and plain(history[-1]) == plain(entry) else [*history, entry]


def exact_ids(df: DataFrame) -> DataFrame:
    """Long columns as text, as JSON readers lose precision beyond 2^53."""
    return df.select(*(F.col(c).cast("string").alias(c) if t in ("bigint", "decimal(20,0)") else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted cells that no spreadsheet takes for a formula, quotes doubled, lines ended by CR and LF."""
    cell = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(csv_safe(F.col(c)), F.lit("")), '"', '""'), F.lit('"'))
    head = df.sparkSession.createDataFrame([(",".join(f'"{c}"' for c in df.columns),)], "value string")
    lines = df.select(F.concat_ws(",", *(cell(c) for c in df.columns)).alias("value"))
    head.coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/rows")


def unresolved_report(candidates: DataFrame, limit: int = 1000) -> DataFrame:
    """The first unresolved rings by key with their candidates in order: a report of fixed length."""
    first = candidates.select("key_image").distinct().orderBy("key_image").limit(limit)
    return candidates.join(F.broadcast(first), "key_image").groupBy("key_image").agg(F.sort_array(F.collect_set(F.struct("amount", "idx"))).alias("candidates"))


def bounded(column: str, most: int) -> tuple[F.Column, F.Column, F.Column]:
    """The first items of an array in order, how many there are, and whether some are left out."""
    return F.slice(F.sort_array(column), 1, most), F.size(column), F.size(column) > most


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row with a hash that doesn't depend on order: sums of row hashes, so nothing is gathered or sorted."""
    row = F.xxhash64(*keys).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row).alias("sum"), F.bit_xor(F.xxhash64(F.lit(7), *keys)).alias("xor"))


def content_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@contextlib.contextmanager
def one_writer(path: str) -> Iterator[None]:
    """Holds the lock of a folder that only one job may write; another one is refused at once. On a cluster the job runs in one
    driver, and a stream is further kept single by its checkpoint."""
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, ".lock"), "w") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError(f"another job writes {path}") from None
        yield
