"""Baselines with exact tie credit, exclusions, sampling, splits and overlaps."""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.features import reuse
from evidara.plans.lineage import cut

BASELINES = ("uniform", "newest", "oldest", "minimum_reuse")
#: Why a claim is left out, in this order (fixed values); the first that holds counts.
EXCLUSIONS = ("missing_members", "invalid_identity", "mixed_amount_buckets", "missing_context", "conflicting_context", "invalid_label", "conflicting_label", "singleton")


def exclusions(details: DataFrame, claims: DataFrame) -> DataFrame:
    """Each claim (key_image, amount, idx) with its ring's size n and the first reason that excludes it, or null.

    details: (key_image, tx_hash, input_index, height, amount, idx), any number of rows for a membership. A label is
    conflicting if several claims name the output; its ring need not hold it.
    """
    bad = lambda c: F.col(c).isNull() | (F.col(c) < 0)
    context = F.struct("tx_hash", "input_index", "height")
    ring = details.groupBy("key_image").agg(
        F.count_distinct("amount", "idx").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.bool_or(bad("amount") | bad("idx")).alias("identity"),
        F.bool_or(F.col("tx_hash").isNull() | bad("input_index") | bad("height")).alias("lost"), F.min(context).alias("one"), F.max(context).alias("other"),
    )
    twice = claims.groupBy("amount", "idx").agg(F.count("*").alias("claimed"))
    inside = details.select("key_image", "amount", "idx", F.lit(1).alias("inside")).distinct()
    rows = claims.join(twice, ["amount", "idx"], "left").join(ring, "key_image", "left").join(inside, ["key_image", "amount", "idx"], "left")
    reason = (
        F.when(F.col("n").isNull(), "missing_members").when(F.col("identity"), "invalid_identity").when(F.col("low") != F.col("high"), "mixed_amount_buckets").when(F.col("lost"), "missing_context")
        .when(F.col("one") != F.col("other"), "conflicting_context").when(bad("amount") | bad("idx") | F.col("inside").isNull(), "invalid_label").when(F.col("claimed") > 1, "conflicting_label").when(F.col("n") < 2, "singleton")
    )
    return rows.select("key_image", "amount", "idx", "n", reason.alias("reason"))


def eligible(details: DataFrame, claims: DataFrame) -> DataFrame:
    return exclusions(details, claims).where("reason is null").select("key_image", F.col("amount").alias("real_amount"), F.col("idx").alias("real_idx"), "n")


def credits(members: DataFrame, own: DataFrame) -> DataFrame:
    """Per eligible ring (key_image, real_amount, real_idx, n) and baseline: ties among its picks, and whether the real output
    is one of them. Whole-snapshot reuse is used, so later rings count as well.
    """
    counted = reuse(members).join(own, "key_image")
    ring = Window.partitionBy("key_image")
    real = (F.col("idx") == F.col("real_idx")) & (F.col("amount") == F.col("real_amount"))
    rows = counted.select("key_image", "n", real.alias("real"), F.lit(True).alias("uniform"), (F.col("idx") == F.max("idx").over(ring)).alias("newest"), (F.col("idx") == F.min("idx").over(ring)).alias("oldest"), (F.col("reuse") == F.min("reuse").over(ring)).alias("minimum_reuse"))
    per = rows.groupBy("key_image", "n").agg(*(F.struct(F.count_if(F.col(k)).alias("ties"), F.bool_or(F.col(k) & F.col("real")).alias("hit")).alias(k) for k in BASELINES))
    return per.select("key_image", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("baseline"), F.col(f"{k}.ties").alias("ties"), F.col(f"{k}.hit").alias("hit")) for k in BASELINES))).alias("v")).select("key_image", "n", "v.*")


def metrics(rows: DataFrame, by: Iterable[str] = ("baseline",)) -> DataFrame:
    """rings, expected (sum of 1/ties over hits), accuracy, contains, unique, unique_correct, tied, and parts: for each number
    of ties the rings and hits, from which credit says the expectation exactly whatever a ring's size."""
    by = list(by)
    per = rows.groupBy(*by, "ties").agg(F.count("*").alias("rings"), F.count_if("hit").alias("hits"))
    total = per.groupBy(*by).agg(
        F.sum("rings").alias("rings"), F.sum(F.col("hits") / F.col("ties")).alias("expected"), F.sum("hits").alias("contains"), F.sum(F.when(F.col("ties") == 1, F.col("rings")).otherwise(0)).alias("unique"),
        F.sum(F.when(F.col("ties") == 1, F.col("hits")).otherwise(0)).alias("unique_correct"), F.sort_array(F.collect_list(F.struct("ties", "rings", "hits"))).alias("parts"),
    )
    return total.withColumn("tied", F.col("rings") - F.col("unique")).withColumn("accuracy", F.col("expected") / F.col("rings"))


def credit(parts: Iterable) -> Fraction:
    """The exact expected number of hits of a row's parts."""
    return sum((Fraction(p["hits"], p["ties"]) for p in parts), Fraction(0))


def size_bucket(column: str) -> F.Column:
    """The sampling strata's sizes (fixed values)."""
    n = F.col(column)
    return F.when(n <= 2, "2").when(n <= 4, "3–4").when(n <= 8, "5–8").when(n <= 16, "9–16").when(n <= 32, "17–32").otherwise("33+")


def sample_frame(details: DataFrame, claims: DataFrame) -> DataFrame:
    """Each ring with its excluded reason, or null and its stratum: status, branch and size bucket.

    details as for exclusions; claims: (key_image, amount, idx, pass, confidence). Rings with a deterministic claim keep
    their members; the others keep those that no claim names. n: members, candidates: what is kept.
    """
    claims = claims.select("key_image", F.struct("amount", "idx").alias("claim"), ((F.col("confidence") == 1.0) & F.coalesce(F.col("pass") >= 0, F.lit(False))).alias("sure"))
    named = claims.select("claim.amount", "claim.idx").distinct().withColumn("named", F.lit(True))
    context = F.struct("tx_hash", "input_index", "height")
    members = details.select("key_image", "amount", "idx").distinct().join(named, ["amount", "idx"], "left")
    sizes = members.groupBy("key_image").agg(F.count("*").alias("n"), F.count_if(F.col("named").isNull()).alias("free"), F.min("amount").alias("low"), F.max("amount").alias("high"))
    where = details.groupBy("key_image").agg(F.count("*").alias("rows"), F.min(context).alias("one"), F.max(context).alias("other"))
    inside = claims.select("key_image", "claim.amount", "claim.idx").join(members.select("key_image", "amount", "idx"), ["key_image", "amount", "idx"], "left_semi").select("key_image", F.lit(True).alias("inside")).distinct()
    rows = sizes.join(where, "key_image").join(claims, "key_image", "left").join(inside, "key_image", "left")
    sure, claimed = F.coalesce("sure", F.lit(False)), F.col("claim").isNotNull()
    branch = F.when(F.col("low") != F.col("high"), "mixed").when(F.col("low") == 0, "amount_zero").otherwise("legacy_nonzero")
    reason = (
        F.when(F.col("n") < 2, "original_size_below_two").when((F.col("one") != F.col("other")) | F.col("one.height").isNull(), "ambiguous_or_missing_input_context").when(branch == "mixed", "mixed_amount_ring")
        .when(claimed & ~sure, "hypothesis_or_unknown_resolution").when(claimed & F.col("inside").isNull(), "deterministic_output_outside_ring").when(~claimed & (F.col("free") < 2), "unresolved_survivors_below_two")
    )
    status = F.when(claimed, "deterministic_training").otherwise("unresolved_scoring")
    return rows.select("key_image", "n", "rows", branch.alias("branch"), F.when(claimed, F.col("n")).otherwise(F.col("free")).alias("candidates"), reason.alias("reason"), F.when(reason.isNull(), F.concat_ws("|", status, branch, size_bucket("n"))).alias("stratum"))


def ranked(rows: DataFrame, order: list[str], rows_per_range: int = 1_000_000, sums: str | None = None) -> DataFrame:
    """rows with a global 0-based rank and their total, without gathering them in one task: rows are dealt by range of the
    whole order, so that one hot value of its first column doesn't fill a range, numbered within their range, and shifted by
    the counts of lower ranges (a row a range, broadcast). With sums also upto, the running sum of that column."""
    n = rows.count()
    ranges = max(1, min(10_000, -(-n // rows_per_range)))
    dealt = rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    value = F.col(sums) if sums else F.lit(0)
    counts = dealt.groupBy("part").agg(F.count("*").alias("m"), F.sum(value).alias("s"))
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shift = counts.select("part", F.coalesce(F.sum("m").over(below), F.lit(0)).alias("shift"), F.coalesce(F.sum("s").over(below), F.lit(0)).alias("lower"))
    own = Window.partitionBy("part").orderBy(*order)
    found = dealt.join(F.broadcast(shift), "part").withColumn("rank0", F.row_number().over(own) - 1 + F.col("shift")).withColumn("total", F.lit(n).cast("long"))
    if sums:
        found = found.withColumn("upto", F.col("lower") + F.sum(sums).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return found.drop("part", "shift", "lower")


def quartiles(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with quartile = floor(4 * rank / N), which is not what ntile gives."""
    return ranked(rows, order).withColumn("quartile", F.floor(4 * F.col("rank0") / F.col("total")).cast("int")).drop("rank0", "total")


def chronological_cutoff(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """One row: the height of the ring at place floor(share * N); it and all of its block are tested."""
    # Heights are few compared with rings: counts per height, then a running sum of them.
    per = rows.groupBy("height").agg(F.count("*").alias("m"))
    running = F.sum("m").over(Window.orderBy("height"))
    total = rows.agg(F.count("*").alias("total"))
    return per.withColumn("upto", running).join(F.broadcast(total)).where(F.col("upto") > F.floor(share * F.col("total"))).agg(F.min("height").alias("cutoff"))


def split(rows: DataFrame, cutoff: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(cutoff)).withColumn("part", F.when(F.col("height") < F.col("cutoff"), "train").otherwise("test")).drop("cutoff")


def overlap(members: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: outputs, transactions and rings that train and test share. parts: key_image, tx_hash, part."""
    rows = members.join(parts.select("key_image", "part"), "key_image")
    both = lambda df, by: df.groupBy(*by).agg(F.count_distinct("part").alias("p")).where("p = 2").agg(F.count("*").alias("x"))
    outputs, txs = both(rows, ["amount", "idx"]), both(parts, ["tx_hash"])
    return outputs.select(F.col("x").alias("outputs")).join(txs.select(F.col("x").alias("transactions"))).join(both(parts, ["key_image"]).select(F.col("x").alias("rings")))


def purge(train: DataFrame, test: DataFrame, roots: DataFrame, members: DataFrame) -> DataFrame:
    """Training rings whose component no test ring touches, by an output or a transaction."""
    past = members.join(roots, "key_image")
    by_output = members.join(test.select("key_image"), "key_image", "left_semi").select("amount", "idx").distinct()
    touched = past.join(by_output, ["amount", "idx"], "left_semi").select("root")
    by_tx = train.join(test.select("tx_hash").distinct(), "tx_hash", "left_semi").join(roots, "key_image").select("root")
    bad = roots.join(touched.union(by_tx).distinct(), "root", "left_semi").select("key_image")
    return train.join(bad, "key_image", "left_anti")


def bottom_k(rows: DataFrame, stratum: str, key: str, k: int = 500, seed: int = 42) -> DataFrame:
    """In each stratum the k rows with the smallest SHA-256 of seed:stratum:key; a limit per group, kept before the shuffle."""
    priority = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(stratum).cast("string"), F.col(key).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("priority", key))
    return rows.withColumn("priority", priority).withColumn("rank", rank).where(F.col("rank") <= k)


def within_budgets(sample: DataFrame, rings: int = 2000, candidates: int = 20_000, stratum: str = "stratum", size: str = "candidates", key: str = "key_image") -> DataFrame:
    """The sampled rows that fit both budgets, taken in turns over the strata; what doesn't fit is passed over, and smaller ones
    that come later may still fit.

    Instead of row by row it goes from one misfit to the next: up to the first row whose running sum is over what is left all
    are taken; after it only rows that are small enough for the rest come into question, and the next round runs over those
    alone. What is left shrinks below the misfit's size, so there are no more rounds than sizes. Sizes are whole numbers of
    0 or more; a null one never fits.
    """
    order = ["rank", stratum, key]
    rest = cut(sample.where(F.col(size).between(0, candidates)), "rest")
    taken: list[DataFrame] = [sample.where("false")]
    while rings > 0:
        placed = cut(ranked(rest, order, sums=size), "placed")
        misfit = placed.where(F.col("upto") > candidates).agg(F.min("rank0")).first()[0]
        fits = placed.where(F.col("rank0") < (rings if misfit is None else min(rings, misfit)))
        taken.append(fits.select(sample.columns))
        n, used = fits.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
        rings, candidates = rings - n, candidates - used
        if misfit is None or rings <= 0:
            break
        rest = placed.where((F.col("rank0") > misfit) & (F.col(size) <= candidates)).select(sample.columns)
        if rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, taken)


def contingency(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two selections of the same rings (key_image, pick, hit): the 2 x 2 table, net change and changed picks."""
    pairs = left.select("key_image", F.col("pick").alias("a"), F.col("hit").alias("x")).join(right.select("key_image", F.col("pick").alias("b"), F.col("hit").alias("y")), "key_image")
    cell = lambda x, y, name: F.count_if((F.col("x") == x) & (F.col("y") == y)).alias(name)
    return pairs.agg(cell(True, True, "both"), cell(True, False, "first_only"), cell(False, True, "second_only"), cell(False, False, "neither"), (F.count_if(F.col("y")) - F.count_if(F.col("x"))).alias("net"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
