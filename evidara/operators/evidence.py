"""What the stored evidence says of each ring, and its totals, rolled up by era.

Claims are (key_image, amount, idx, pass, confidence); only those with confidence 1 and a pass of at least 0 are
deterministic, and they speak against other rings only if their own ring holds the output. Predictions are
(key_image, amount, idx). Rings are never gathered: one shuffle by output, one by ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.operators.cascade import OUTPUT
from evidara.operators.eras import Era, era_of

#: The exclusive categories, and what is counted for each era (fixed values).
CATEGORIES = ("deterministic_resolutions", "hypothesis_resolutions", "unresolved_reduced", "unresolved_unchanged")
FIELDS = (
    "blocks_scanned", "transactions", "ring_members", "total_rings", "original_singleton_rings", "original_multimember_rings", "deterministic_singleton_resolutions", "deterministic_multimember_resolutions",
    *CATEGORIES, "conflict_rings", "orphan_resolution_claims", "fully_resolved", "partially_reduced", "unreduced",
)


def _sure(claims: DataFrame) -> F.Column:
    return (F.col("confidence") == 1.0) & F.coalesce(F.col("pass") >= 0, F.lit(False))


def owners(members: DataFrame, claims: DataFrame) -> DataFrame:
    """Outputs with the deterministic claims on them that their own ring supports: amount, idx, owners, owner (the smallest)."""
    valid = claims.where(_sure(claims)).join(members, ["key_image", *OUTPUT], "left_semi")
    return valid.groupBy(*OUTPUT).agg(F.count_distinct("key_image").alias("owners"), F.min("key_image").alias("owner"))


def rings(members: DataFrame, claims: DataFrame, live: DataFrame, predictions: DataFrame) -> DataFrame:
    """key_image, n, category, conflict of every ring. live: (key_image, left) of rings that the analysis left open.

    A conflict is a claim or a prediction outside the ring, or a ring none of whose candidates is left by the deterministic
    claims of others and its own.
    """
    own = claims.select("key_image", *OUTPUT, F.lit(True).alias("own"), _sure(claims).alias("sure"))
    told = predictions.select("key_image", *OUTPUT, F.lit(True).alias("told"))
    free = F.col("owners").isNull() | ((F.col("owners") == 1) & (F.col("owner") == F.col("key_image")))
    rows = members.join(owners(members, claims), OUTPUT, "left").join(own, ["key_image", *OUTPUT], "left").join(told, ["key_image", *OUTPUT], "left")
    rows = rows.groupBy("key_image").agg(F.count("*").alias("n"), F.count_if(free).alias("free"), F.count_if(free & F.col("own").isNotNull()).alias("free_own"), F.count("own").alias("inside"), F.count("told").alias("told_inside"))
    claimed = claims.groupBy("key_image").agg(F.bool_or(_sure(claims)).alias("sure"))
    asked = predictions.select("key_image").distinct().withColumn("asked", F.lit(True))
    rows = rows.join(claimed, "key_image", "left").join(asked, "key_image", "left").join(live.select("key_image", "left"), "key_image", "left")
    category = F.when(F.col("sure"), CATEGORIES[0]).when(F.col("sure").isNotNull(), CATEGORIES[1]).when(F.coalesce("left", "n") < F.col("n"), CATEGORIES[2]).otherwise(CATEGORIES[3])
    supported = F.when(F.coalesce("sure", F.lit(False)) & (F.col("inside") > 0), F.col("free_own")).otherwise(F.col("free"))
    conflict = (F.col("sure").isNotNull() & (F.col("inside") == 0)) | (supported == 0) | (F.col("asked").isNotNull() & (F.col("told_inside") == 0))
    return rows.select("key_image", "n", category.alias("category"), conflict.alias("conflict"))


def _counts() -> list[F.Column]:
    """Of rows (n, category, conflict)."""
    one, sure = F.col("n") == 1, F.col("category") == CATEGORIES[0]
    return [
        F.count("n").alias("total_rings"), F.count_if(one).alias("original_singleton_rings"), F.count_if(F.col("n") > 1).alias("original_multimember_rings"), F.count_if(sure & one).alias("deterministic_singleton_resolutions"),
        F.count_if(sure & (F.col("n") > 1)).alias("deterministic_multimember_resolutions"), *(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES), F.count_if("conflict").alias("conflict_rings"),
    ]


def _derived(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"fully_resolved": F.col(CATEGORIES[0]) + F.col(CATEGORIES[1]), "partially_reduced": F.col(CATEGORIES[2]), "unreduced": F.col(CATEGORIES[3])})


def orphans(members: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims of rings that aren't there."""
    return claims.join(members.select("key_image").distinct(), "key_image", "left_anti")


def summary(per_ring: DataFrame, members: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: rings by category and cohort, conflicts, orphan claims, and rates as text."""
    total = _derived(per_ring.agg(*_counts())).join(orphans(members, claims).agg(F.count("*").alias("orphan_resolution_claims")))
    rate = lambda c: F.when(F.col("total_rings") > 0, F.format_string("%.2f%%", 100 * F.col(c) / F.col("total_rings"))).otherwise("N/A")
    return total.withColumns({"resolution_rate": rate("fully_resolved"), "deterministic_resolution_rate": rate("deterministic_resolutions")})


def reconciles(totals: DataFrame) -> DataFrame:
    """totals and whether the four categories make up all rings; null where a count is missing."""
    return totals.withColumn("reconciles", sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])) == F.col("total_rings"))


def eras_of_rings(details: DataFrame, eras: tuple[Era, ...]) -> DataFrame:
    """key_image, rows, contexts (distinct transaction, input and height), era, reason (why it is unknown, or null).

    details: (key_image, tx_hash, input_index, height, ...), any number of rows for a membership. A ring belongs to an era if
    all its contexts do; one with a missing or negative height to none.
    """
    context = details.select("key_image", "tx_hash", "input_index", "height", era_of("height", eras).alias("era"))
    per = context.groupBy("key_image").agg(F.count("*").alias("rows"), F.size(F.collect_set(F.struct(F.coalesce("tx_hash", F.lit(-1)), F.coalesce("input_index", F.lit(-1)), F.coalesce("height", F.lit(-1))))).alias("contexts"), F.bool_or(F.col("era").isNull()).alias("bad"), F.min("era").alias("era"), F.max("era").alias("other"))
    reason = F.when(F.lit(not eras), "manifest_unavailable").when(F.col("bad"), "missing_or_invalid_input_height").when(F.col("era") != F.col("other"), "multiple_era_input_contexts")
    return per.select("key_image", "rows", "contexts", F.when(reason.isNull(), F.col("era")).otherwise("unknown").alias("era"), reason.alias("reason"))


def era_roll(placed: DataFrame, per_ring: DataFrame, blocks: DataFrame, transactions: DataFrame, members: DataFrame, claims: DataFrame, eras: tuple[Era, ...], total: bool = False) -> DataFrame:
    """era and FIELDS, a row for each era and one for unknown, with 0 where nothing is; with total one more, whose era is null.

    placed as from eras_of_rings; blocks and transactions: (height), counted by their own heights. Orphan claims count as
    unknown. All that is counted is one table, which one aggregate rolls up.
    """
    spark = placed.sparkSession
    names = spark.createDataFrame([(e.id,) for e in eras] + [("unknown",)], "era string").withColumn("part", F.lit("name"))
    of = lambda rows, part: rows.select(F.coalesce(era_of("height", eras), F.lit("unknown")).alias("era"), F.lit(part).alias("part"))
    lost = orphans(members, claims).select(F.lit("unknown").alias("era"), F.lit("claim").alias("part"))
    ringed = placed.join(per_ring, "key_image").select("era", F.lit("ring").alias("part"), "rows", "n", "category", "conflict")
    rows = ringed
    for more in (names, of(blocks, "block"), of(transactions, "transaction"), lost):
        rows = rows.unionByName(more, allowMissingColumns=True)
    counted = [F.count_if(F.col("part") == part).alias(name) for part, name in (("block", "blocks_scanned"), ("transaction", "transactions"), ("claim", "orphan_resolution_claims"))]
    grouped = rows.rollup("era") if total else rows.groupBy("era")
    return _derived(grouped.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("ring_members"), *counted, *_counts())).select("era", *FIELDS)


def reconciliation(roll: DataFrame, totals: DataFrame) -> DataFrame:
    """field, era_total, summary_total, matches: whether the eras add up to the summary, field by field. roll has its total."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias(name)) for f in FIELDS))).alias("x")).select("x.*")
    known = [f for f in FIELDS if f in totals.columns]
    have = totals.select(*(F.col(f) if f in known else F.lit(None).cast("long").alias(f) for f in FIELDS))
    return long(roll.where("era is null"), "era_total").join(long(have, "summary_total"), "field").withColumn("matches", F.col("era_total").eqNullSafe(F.col("summary_total")))


def coverage(roll: DataFrame) -> DataFrame:
    """One row: rings, blocks and transactions in known eras, in none, and in all."""
    unknown = F.col("era") == "unknown"
    pick = lambda f, e, name: F.sum(F.when(e, F.col(f)).otherwise(0)).alias(name)
    return roll.agg(*(x for f, name in (("total_rings", "rings"), ("blocks_scanned", "blocks"), ("transactions", "transactions")) for x in (pick(f, ~unknown, f"classified_{name}"), pick(f, unknown, f"unknown_{name}"))))


def valid_counts(rows: DataFrame) -> DataFrame:
    """rows of FIELDS with valid: no negative count, no part beyond its whole, and sums that hold."""
    c = F.col
    bounded = [f for f in FIELDS if f not in ("blocks_scanned", "transactions", "total_rings", "ring_members", "orphan_resolution_claims")]
    sums = (("original_singleton_rings", "original_multimember_rings", "total_rings"), ("deterministic_singleton_resolutions", "deterministic_multimember_resolutions", "deterministic_resolutions"), (*CATEGORIES, "total_rings"))
    parts = (("deterministic_singleton_resolutions", "original_singleton_rings"), ("deterministic_multimember_resolutions", "original_multimember_rings"))
    true = F.lit(True)
    ok = c("total_rings").isNotNull()
    for f in FIELDS:
        ok = ok & F.coalesce(c(f) >= 0, true)
    for f in bounded:
        ok = ok & F.coalesce(c(f) <= c("total_rings"), true)
    for *some, whole in sums:
        ok = ok & F.coalesce(sum((c(f) for f in some[1:]), c(some[0])) == c(whole), true)
    for a, b in parts:
        ok = ok & F.coalesce(c(a) <= c(b), true)
    return rows.withColumn("valid", ok)


