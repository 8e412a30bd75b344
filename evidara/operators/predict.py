"""Scoring, predictions as append-only history, and their later verification."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.cascade import FRONTIER, Cascade, latest
from evidara.operators.features import FEATURES, features
from evidara.plans.lineage import cut


def labelled(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Feature rows of deterministic rings of at least two candidates, with label 1 for the real output."""
    real = resolved.where(F.col("pass") >= 0).select("key_image", F.col("amount").alias("a"), F.col("idx").alias("i"))
    out = rows.where("ring_size > 1").join(real, "key_image")
    return out.withColumn("label", ((F.col("amount") == F.col("a")) & (F.col("idx") == F.col("i"))).cast("double")).drop("a", "i")


def known(members: DataFrame, context: DataFrame, result: Cascade) -> DataFrame:
    """labelled of the features of the rings that it keeps: only those are described, which of large tables are few. Reuse and
    tips are those of all members."""
    rings = cut(result.resolved.where("pass >= 0").select("key_image").join(result.sizes.where("n > 1"), "key_image").select("key_image"), "rings")
    rows = cut(members.join(F.broadcast(rings) if rings.count() <= FRONTIER else rings, "key_image", "left_semi"), "known")
    return labelled(features(members, context, rows), result.resolved)


def hash_split(key: str, share: float = 0.8, seed: int = 42) -> F.Column:
    """Whether a ring is for training; by hash, so that it doesn't depend on order."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1000)) < int(1000 * share)


def forest(train: DataFrame, trees: int = 500, depth: int = 30, names: tuple[str, ...] = FEATURES):
    """Scaled features and a balanced random forest. Spark ML draws its own samples, so scores are alike, not equal.

    The node of each row in each tree is kept beside the rows: else every pass sends all trees grown so far to the tasks and
    walks each row down them again. The model is the same."""
    total = train.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    weight = F.when(F.col("label") == 1, total["n"] / (2 * max(total["p"], 1))).otherwise(total["n"] / (2 * max(total["n"] - total["p"], 1)))
    assembler = VectorAssembler(inputCols=list(names), outputCol="raw")
    raw = assembler.transform(train.withColumn("weight", weight))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw)
    model = RandomForestClassifier(numTrees=trees, minInstancesPerNode=3, featureSubsetStrategy="sqrt", weightCol="weight", maxDepth=depth, cacheNodeIds=True, seed=42).fit(scaler.transform(raw))
    return lambda rows: model.transform(scaler.transform(assembler.transform(rows))).withColumn("score", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


def argmax(rows: DataFrame, score: str = "score") -> DataFrame:
    """The best candidate of each ring, ties to the lowest idx, then amount, with the number that tie; two aggregates' worth
    in one pass over the ring."""
    ring = Window.partitionBy("key_image")
    rank = F.row_number().over(ring.orderBy(F.desc(score), "idx", "amount"))
    ties = F.count("*").over(Window.partitionBy("key_image", score))
    return rows.select("*", rank.alias("place"), ties.alias("ties"), F.count("*").over(ring).alias("size")).where("place = 1").drop("place")


def reuse_score(rows: DataFrame) -> DataFrame:
    """A score that SQL can say: the rarer an output is, the likelier."""
    return rows.withColumn("score", 1 / F.col("reuse"))


def soft_cascade(members: DataFrame, score, cascade, confidence: float = 0.95, rounds: int = 10):
    """Rounds of scoring what is left, taking confident guesses as hypotheses, and eliminating with them. score(live members)
    -> key_image, amount, idx, score; cascade as in evidara.operators.cascade."""
    result, guesses = cascade(members), None
    for _ in range(rounds):
        gone = result.eliminated.select("key_image", "amount", "idx")
        live = members.join(result.resolved.select("key_image"), "key_image", "left_anti").join(gone, ["key_image", "amount", "idx"], "left_anti")
        sure = argmax(score(live)).where(F.col("score") >= confidence)
        new = cut(sure.select("key_image", F.col("amount").alias("real_amount"), F.col("idx").alias("real_output_index"), F.lit(-1).alias("resolved_at_pass"), F.col("score").alias("confidence")), "guesses")  # scored once
        if new.isEmpty():
            break
        guesses = new if guesses is None else guesses.unionByName(new)
        result = cascade(members, guesses)
    return result


def save(picks: DataFrame, run: str, at: str, threshold: float = 0.95) -> DataFrame:
    """Prediction records: key_image, run_id, created_at, predicted output, confidence, accepted. Scores must be finite in [0, 1]."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold")
    bad = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)
    checked = F.when(bad, F.raise_error(F.lit("score out of range"))).otherwise(F.col("score"))
    return picks.select("key_image", F.lit(run).alias("run_id"), F.lit(at).alias("created_at"), F.col("amount").alias("predicted_amount"), F.col("idx").alias("predicted_idx"), checked.alias("confidence"), (checked >= threshold).alias("accepted"))


def verify(records: DataFrame, verified: DataFrame, resolved: DataFrame) -> DataFrame:
    """Verifications of accepted records that have none yet, where the ring is now deterministically resolved; each once."""
    open_ = records.where("accepted").join(verified.select("key_image", "run_id"), ["key_image", "run_id"], "left_anti")
    real = resolved.where(F.col("pass") >= 0).select("key_image", "amount", "idx", F.col("pass").alias("resolved_at_pass"))
    correct = (F.col("amount") == F.col("predicted_amount")) & (F.col("idx") == F.col("predicted_idx"))
    return open_.join(real, "key_image").withColumn("correct", correct)


def timing(prediction: str, verification: str) -> F.Column:
    """later_scan, same_or_earlier_scan or unknown."""
    p, v = F.col(prediction), F.col(verification)
    return F.when(p.isNull() | v.isNull(), "unknown").when(v > p, "later_scan").otherwise("same_or_earlier_scan")


def current(records: DataFrame, order: str = "created_at") -> DataFrame:
    """The newest prediction of each ring: a view of the history, not a second table."""
    return latest(records, ["key_image"], order)


def stats(records: DataFrame) -> DataFrame:
    """total, verified, correct, wrong, unverified and accuracy as text, or N/A."""
    count = lambda e, name: F.count_if(e).alias(name)
    out = records.agg(F.count("*").alias("total"), count(F.col("correct").isNotNull(), "verified"), count(F.col("correct") == F.lit(True), "correct_n"), count(F.col("correct") == F.lit(False), "wrong"), count(F.col("correct").isNull(), "unverified"))
    return out.withColumn("accuracy", F.when(F.col("verified") > 0, F.format_string("%.1f%%", 100 * F.col("correct_n") / F.col("verified"))).otherwise("N/A"))
