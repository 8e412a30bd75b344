"""The stream of recent blocks: which heights a cycle reads, reorganisations, gaps and retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cycle:
    start: int
    end: int
    target: int
    behind: int
    skipped: tuple[int, int] | None


def cycle(tip: int, last: int | None, lag: int = 10, initial: int = 4, limit: int = 12, window: int = 120, skipped_through: int = -1) -> Cycle:
    """Heights start..end (none if end < start) of a cycle. Heights that fall out of the catch-up window are a gap; through
    which height gaps were noted before is skipped_through, so that a failed cycle notes none twice."""
    if type(tip) is not int or tip < 0:
        raise ValueError("the tip's height must be a non-negative integer")
    if last is not None and last > tip:
        raise RuntimeError("the source is behind what was stored")
    target = tip - lag
    start = max(max(0, target - initial + 1) if last is None else last + 1, skipped_through + 1)
    floor, skipped = max(0, target - window + 1), None
    if start < floor:
        skipped, start = (start, floor - 1), floor
    end = min(target, start + limit - 1)
    return Cycle(start, end, target, max(0, target - end), skipped)


def gap_rows(found: Cycle, recorded_at: str) -> list[tuple[int, int, str, str]]:
    """The gap of a cycle as rows (from_height, to_height, reason, recorded_at) for an append that ignores repeats."""
    return [(*found.skipped, "catchup_window_skipped", recorded_at)] if found.skipped else []


def reorganised(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored blocks whose hash the chain no longer has at that height, or that don't follow on their predecessor; a batch with
    any must fail before its offsets move."""
    changed = stored.join(fresh.select("height", F.col("hash").alias("now")), "height").where("hash <> now").select("height", "hash", "now")
    before = stored.select((F.col("height") + 1).alias("height"), F.col("hash").alias("hash"))
    torn = fresh.join(before, "height").where(F.col("previous_hash") != before["hash"]).select("height", before["hash"], F.col("previous_hash").alias("now")) if "previous_hash" in fresh.columns else changed.where("false")
    return changed.unionByName(torn)


def retained(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The newest rows by a unique order: the limit is the feature; only the order column is sorted, and kept to most values."""
    cutoff = rows.select(order).orderBy(F.desc(order)).limit(most).agg(F.min(order).alias("cutoff"))
    return rows.join(F.broadcast(cutoff), F.col(order) >= F.col("cutoff")).drop("cutoff")


def ring_histogram(inputs: DataFrame) -> DataFrame:
    """height, ring_sizes (size -> rings), inputs, members; a map's entries are as few as there are sizes."""
    per = inputs.groupBy("height", "size").agg(F.count("*").alias("n"))
    return per.groupBy("height").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("size", "n")))).alias("ring_sizes"), F.sum("n").alias("inputs"), F.sum(F.col("n") * F.col("size")).alias("members"))


def merged_histograms(blocks: DataFrame, sizes: str = "ring_sizes") -> DataFrame:
    """size, rings over all blocks (height, ring_sizes: map): their histograms added up."""
    return blocks.select(F.explode(sizes).alias("size", "n")).groupBy("size").agg(F.sum("n").cast("long").alias("rings"))


def unreconciled(blocks: DataFrame) -> DataFrame:
    """Complete blocks whose histogram doesn't add up to their counts of inputs and members: (height, reason)."""
    total = lambda of: F.aggregate(F.map_entries("ring_sizes"), F.lit(0).cast("long"), lambda a, e: a + of(e))
    inputs, members = total(lambda e: e["value"].cast("long")), total(lambda e: e["key"].cast("long") * e["value"])
    reason = F.when(F.col("detail_status") != "complete", "incomplete").when(~inputs.eqNullSafe(F.col("ring_input_count").cast("long")), "inputs").when(~members.eqNullSafe(F.col("ring_member_count").cast("long")), "members")
    return blocks.select("height", reason.alias("reason")).where("reason is not null")


def next_target(progress: int, chain_count: int, confirmations: int, blocks: int, most: int | None = None, rings: int = 0, max_rings: int = 2_000_000, free_gb: float = float("inf"), least_gb: float = 1.0) -> int:
    """The height a collecting cycle scans to, or an error: no room, too many rings, a wrong count, a node behind the store."""
    if free_gb < least_gb:
        raise RuntimeError("paused: free disk space is below the minimum")
    if rings >= max_rings:
        raise RuntimeError("paused: the limit of rings is reached")
    if type(chain_count) is not int or chain_count <= 0:
        raise ValueError("the node's count of blocks is no positive integer")
    if progress > chain_count - 1:
        raise RuntimeError("the node is behind the store: nothing is rolled back")
    target = min(chain_count - 1 - confirmations, progress + blocks)
    return target if most is None else min(target, most)


def changed(scan_end: int, dataset_id: str, exported: dict) -> bool:
    """Whether an export is due: the scan or the dataset differs from what was exported last."""
    return scan_end != exported.get("scan_end") or dataset_id != exported.get("dataset_id")
