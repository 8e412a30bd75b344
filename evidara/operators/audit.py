"""Audits of samples and results: output origins, train-only masks, paired comparisons, record checks, re-derivation.

A scored row is (key_image, amount, idx, label, score); an outcome is one ring's pick and its credit.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.cascade import OUTPUT
from evidara.operators.ranges import quantiles
from evidara.operators.features import FEATURES, duplicate_columns


def origin_sample(members: DataFrame, categories: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """In each category the `count` outputs with the smallest SHA-256 of seed:category:amount:index, each with the smallest of
    its rings as context, and the category's number of outputs: category, amount, idx, key_image, priority, frame.

    categories: (key_image, category). A limit per group, kept before the shuffle.
    """
    outputs = members.join(categories, "key_image").groupBy("category", *OUTPUT).agg(F.min("key_image").alias("key_image"))
    frame = outputs.groupBy("category").agg(F.count("*").alias("frame"))
    priority = F.sha2(F.concat_ws(":", F.lit(str(seed)), "category", F.col("amount").cast("string"), F.col("idx").cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy("category").orderBy("priority", *OUTPUT))
    return outputs.withColumn("priority", priority).withColumn("rank", rank).where(F.col("rank") <= count).drop("rank").join(F.broadcast(frame), "category")


def contexts(sample: DataFrame, details: DataFrame) -> DataFrame:
    """sample with its ring's transaction and height, the first height that names the output, and the ring's size. Sampled
    rings must have one context and one amount; a sample is small and is broadcast."""
    own = details.join(F.broadcast(sample.select("key_image").distinct()), "key_image")
    ring = own.groupBy("key_image").agg(F.count_distinct("tx_hash", "input_index", "height").alias("n"), F.count_distinct("amount").alias("amounts"), F.min("tx_hash").alias("tx_hash"), F.min("height").alias("height"), F.count_distinct(*OUTPUT).alias("size"))
    first = details.join(F.broadcast(sample.select(*OUTPUT).distinct()), OUTPUT).groupBy(*OUTPUT).agg(F.min("height").alias("first_height"))
    wrong = F.when((F.col("n") != 1) | (F.col("amounts") != 1) | F.col("height").isNull(), F.raise_error(F.lit("a sampled ring has no single context")))
    return sample.join(ring, "key_image").join(first, OUTPUT, "left").withColumn("height", F.coalesce(wrong, F.col("height"))).drop("n", "amounts")


def attached(sample: DataFrame, origins: DataFrame) -> DataFrame:
    """sample with each output's origin (amount, idx, origin_height) where it is known, its age in blocks, and whether the origin
    is after a reference; missing origins and negative ages stay to be seen."""
    rows = sample.join(origins.select(*OUTPUT, "origin_height"), OUTPUT, "left")
    return rows.withColumns({"age": F.col("height") - F.col("origin_height"), "origin_after_reference": F.col("origin_height") > F.col("first_height")})


def ages(rows: DataFrame, distinct: tuple[str, ...] = ()) -> DataFrame:
    """One row: contexts, known origins, ages' least, median and most, how many are over 15 blocks or after a reference, and the
    distinct values of some columns, in order."""
    found = rows.agg(
        F.count("*").alias("contexts"), F.count_distinct(*OUTPUT).alias("outputs"), F.count("age").alias("known"), F.count_if("origin_after_reference").alias("after_reference"), F.min("age").alias("age_min"), F.max("age").alias("age_max"),
        F.count_if(F.col("age") > 15).alias("over_15"), *(F.array_sort(F.collect_set(c)).alias(f"{c}_values") for c in distinct),
    )
    return found.join(quantiles(rows, "age", {"age_median": 0.5}).drop("n"))


def zipped(requested: F.Column, answered: F.Column) -> F.Column:
    """Requests and answers by place, as an array of structs; an error if they differ in number."""
    return F.when(F.size(requested) != F.size(answered), F.raise_error(F.lit("answers don't match requests"))).otherwise(F.arrays_zip(requested.alias("request"), answered.alias("answer")))


def masks(train: DataFrame, names: tuple[str, ...] = FEATURES) -> dict[str, list[str]]:
    """Columns kept by each variant, found in training rows alone: all, without constants, and of equal columns the first."""
    constant = train.agg(*((F.count_distinct(c) <= 1).alias(c) for c in names)).first()
    variable = [c for c in names if not constant[c]]
    same = {(r["left"], r["right"]) for r in duplicate_columns(train, tuple(variable)).collect()} if variable else set()
    kept: list[str] = []
    for c in variable:
        if not any((k, c) in same for k in kept):
            kept.append(c)
    if not kept:
        raise ValueError("no column varies")
    return {"all_features": list(names), "drop_constants": variable, "drop_constants_and_duplicates": kept}


def variants(train: DataFrame, test: DataFrame, fitted, names: tuple[str, ...] = FEATURES) -> dict[str, DataFrame]:
    """Outcomes of the test rings under each mask. fitted(train, names) gives a function from rows to scored rows."""
    return {name: outcomes(fitted(train, tuple(columns))(test)) for name, columns in masks(train, names).items()}


def outcomes(scored: DataFrame) -> DataFrame:
    """Per ring: pick (the first best by amount, then index), whether it is right, ties among the best, whether the real output
    is one of them, size. Scores must be in [0, 1]."""
    bad = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)
    rows = scored.withColumn("score", F.when(bad, F.raise_error(F.lit("score out of range"))).otherwise(F.col("score")))
    best = F.max("score").over(Window.partitionBy("key_image"))
    rows = rows.withColumn("top", F.col("score") == best)
    pick = F.min_by(F.struct(*OUTPUT, "label"), F.when(F.col("top"), F.struct(*OUTPUT)))
    return rows.groupBy("key_image").agg(pick.alias("p"), F.count_if("top").alias("ties"), F.bool_or(F.col("top") & (F.col("label") == 1)).alias("among"), F.count("*").alias("size")).select("key_image", F.struct("p.amount", "p.idx").alias("pick"), (F.col("p.label") == 1).alias("hit"), "ties", "among", "size")


def outcome_summary(rows: DataFrame) -> DataFrame:
    """One row: rings, candidates, correct, agreement, tied, expected (sum of 1/ties where the real output is among the best) and
    the exact parts of it (ties, rings)."""
    per = rows.groupBy("ties").agg(F.count("*").alias("rings"), F.sum("size").alias("candidates"), F.count_if("hit").alias("correct"), F.count_if("among").alias("among"))
    total = per.agg(F.sum("rings").alias("rings"), F.sum("candidates").alias("candidates"), F.sum("correct").alias("correct"), F.sum(F.when(F.col("ties") > 1, F.col("rings")).otherwise(0)).alias("tied"), F.sum(F.col("among") / F.col("ties")).alias("expected"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ties", "among"))), lambda x: F.concat_ws(":", x["ties"].cast("string"), x["among"].cast("string"))), ",").alias("parts"))
    return total.withColumn("agreement", F.col("correct") / F.col("rings"))


def comparators(rows: DataFrame) -> DataFrame:
    """scored rows of three plain baselines over rows (key_image, amount, idx, label, reuse): baseline, ... , score."""
    ring = Window.partitionBy("key_image")
    scores = {"uniform": 1.0 / F.count("*").over(ring), "highest_index": (F.col("idx") == F.max("idx").over(ring)).cast("double"), "minimum_reuse": (F.col("reuse") == F.min("reuse").over(ring)).cast("double")}
    wide = rows.select("key_image", *OUTPUT, "label", *(v.alias(k) for k, v in scores.items()))
    return wide.select("key_image", *OUTPUT, "label", F.explode(F.array(*(F.struct(F.lit(k).alias("baseline"), F.col(k).alias("score")) for k in scores))).alias("x")).select("x.baseline", "key_image", *OUTPUT, "label", "x.score")


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row about two sets of rings (key_image, tx_hash, amount, idx, label): outputs of each, shared ones, test rings that
    share an output or a transaction, and real test outputs that train holds too."""
    a, b = train.select(*OUTPUT).distinct(), test.select(*OUTPUT).distinct()
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    rings = lambda rows: rows.select("key_image").distinct()
    parts = [one(a, "train_outputs"), one(b, "test_outputs"), one(b.join(a, OUTPUT, "left_semi"), "shared_outputs"), one(rings(test.join(a, OUTPUT, "left_semi")), "test_rings_sharing_output"), one(rings(test.join(train.select("tx_hash").distinct(), "tx_hash", "left_semi")), "test_rings_sharing_transaction"), one(rings(test.where("label = 1").join(a, OUTPUT, "left_semi")), "test_labels_in_train")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)
    return out


def rederived(scored: DataFrame, stated: DataFrame) -> DataFrame:
    """key_image, reason: rings whose stated outcome (key_image, pick, hit, ties) is not what its scores give, or is missing on a
    side. None: the result holds."""
    now = outcomes(scored)
    both = now.join(stated.select("key_image", F.col("pick").alias("said"), F.col("hit").alias("said_hit"), F.col("ties").alias("said_ties")), "key_image", "full_outer")
    reason = F.when(F.col("pick").isNull(), "no_scores").when(F.col("said").isNull(), "not_stated").when(F.col("pick") != F.col("said"), "pick").when(F.col("hit") != F.col("said_hit"), "hit").when(F.col("ties") != F.col("said_ties"), "ties")
    return both.select("key_image", reason.alias("reason")).where("reason is not null")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often, in any order."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def record_faults(records: DataFrame, names: Iterable[str] = FEATURES, most: int = 128) -> DataFrame:
    """key_image, rule: frozen ring records that break a rule, with the first one. records: (key_image, status, height, members:
    array<struct<amount, idx>>, real: struct<amount, idx>, reuse: array<long>, candidates: array<struct<amount, idx,
    features: array<double>>>)."""
    c, width = F.col, len(list(names))
    ids = F.transform("candidates", lambda x: F.struct(x["amount"], x["idx"]))
    twice = F.count("*").over(Window.partitionBy("key_image")) > 1
    bad = lambda x: (F.size(x["features"]) != width) | F.exists(x["features"], lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    n = F.size("candidates")
    rule = (
        F.when(~F.coalesce(c("key_image").rlike("^[a-f0-9]{64}$"), F.lit(False)) | c("twice"), "identity").when(~c("status").eqNullSafe(F.lit("deterministic_training")), None).when((n < 2) | (n > most) | (F.size("members") != n), "incomplete")
        .when((F.array_sort(F.array_distinct(ids)) != ids) | (F.size(F.array_except(ids, "members")) > 0), "order_or_members").when(F.size(F.array_distinct(F.transform("candidates", lambda x: x["amount"]))) != 1, "mixed_amounts").when(~F.array_contains(ids, c("real")), "label")
        .when(c("height").isNull() | (c("height") < 0), "height").when((F.size("reuse") != n) | F.exists("reuse", lambda v: v.isNull() | (v < 1)), "reuse").when(F.exists("candidates", bad), "features")
    )
    return records.withColumn("twice", twice).select("key_image", rule.alias("rule")).where("rule is not null")


def cohort_hash(rows: DataFrame, key: str, payload: list[str], buckets: int = 4096) -> str:
    """A SHA-256 of a cohort that doesn't depend on the order of its rows: of each of a fixed number of buckets by key the hash of
    its sorted row hashes, then the hash of the buckets in order. No task sees more than a bucket."""
    line = F.sha2(F.to_json(F.struct(key, *payload)), 256)
    per = rows.select(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).alias("b"), line.alias("h")).groupBy("b").agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("h"))
    found = {r["b"]: r["h"] for r in per.collect()}  # at most buckets rows
    import hashlib

    return hashlib.sha256("".join(found.get(b, "") for b in range(buckets)).encode()).hexdigest()


def extracted(sample: DataFrame, described: DataFrame) -> DataFrame:
    """Candidates (key_image, amount, idx) that a sample has and its features lack, or the other way round: none if the
    extraction kept the identities."""
    keys = ["key_image", *OUTPUT]
    missing = sample.select(*keys).join(described.select(*keys), keys, "left_anti").withColumn("where", F.lit("not_described"))
    return missing.unionByName(described.select(*keys).join(sample.select(*keys), keys, "left_anti").withColumn("where", F.lit("not_sampled")))
