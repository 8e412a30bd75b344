"""Prediction history: runs, records, their candidates and verifications, as append-only tables; and pages, cohorts, filters
and coverage over them.

records: (prediction_id, run_id, key_image, predicted_amount, predicted_idx, confidence, accepted, original_ring_size,
created_at); candidates: (prediction_id, amount, idx, score); runs: (run_id, created_at, dataset_id, scan_height, origin,
feature_version, artifact_sha256, source_sha256); verifications: (verification_id, prediction_id, correct, scan_height,
provenance, actual_amount, actual_idx, event_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import analytics as an
from evidara.operators.cascade import latest

#: Rows of one page at most (fixed value).
PAGE = 5000
HASH = "^[0-9a-f]{64}$"


def checked(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """records, each with the first rule that it breaks, or null: unique candidates with finite scores in [0, 1], one of them
    the prediction, with the record's confidence."""
    bad = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)
    per = candidates.groupBy("prediction_id").agg(F.count("*").alias("n"), F.count_distinct("amount", "idx").alias("d"), F.bool_or(bad).alias("bad"))
    picked = candidates.select("prediction_id", F.col("amount").alias("predicted_amount"), F.col("idx").alias("predicted_idx"), F.col("score").alias("picked")).dropDuplicates(["prediction_id", "predicted_amount", "predicted_idx"])
    rows = records.join(per, "prediction_id", "left").join(picked, ["prediction_id", "predicted_amount", "predicted_idx"], "left")
    rule = F.when(F.col("n").isNull(), "no_candidates").when(F.col("n") > F.col("d"), "repeated_candidate").when(F.col("bad"), "score_out_of_range").when(F.col("picked").isNull() | ~F.col("picked").eqNullSafe(F.col("confidence")), "prediction_is_no_candidate")
    return rows.select(*records.columns, rule.alias("rule"))


def open_records(records: DataFrame, verifications: DataFrame) -> DataFrame:
    """Accepted predictions that no verification names."""
    return records.where("accepted").join(verifications.select("prediction_id"), "prediction_id", "left_anti")


def current(records: DataFrame) -> DataFrame:
    """The last accepted prediction of each ring."""
    return latest(records.where("accepted"), ["key_image"], "prediction_id")


def claim_events(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Deterministic claims (key_image, amount, idx, pass, confidence) with the newest event that says the same: event_id."""
    sure = claims.where((F.col("confidence") == 1.0) & (F.col("pass") >= 0))
    same = events.groupBy("key_image", F.col("real_amount").alias("amount"), F.col("real_output_index").alias("idx"), F.col("resolved_at_pass").alias("pass"), "confidence").agg(F.max("id").alias("event_id"))
    return sure.join(same, ["key_image", "amount", "idx", "pass", "confidence"], "left")


def rows(records: DataFrame, runs: DataFrame, verifications: DataFrame) -> DataFrame:
    """All records with their run's scan height, the last verification, and its timing."""
    last = latest(verifications, ["prediction_id"], "verification_id").select("prediction_id", "verification_id", "correct", F.col("scan_height").alias("verification_height"), "provenance", "actual_amount", "actual_idx", "event_id")
    out = records.join(runs.select("run_id", "scan_height"), "run_id").join(last, "prediction_id", "left")
    sure = (F.col("provenance") == "deterministic_resolution") & (F.col("scan_height") >= 0) & F.col("verification_height").isNotNull()
    timing = F.when(sure, F.when(F.col("verification_height") > F.col("scan_height"), "later_scan").otherwise("same_or_earlier_scan")).otherwise("unknown")
    return out.withColumns({"verified": F.col("verification_id").isNotNull(), "timing": timing})


def page(found: DataFrame, limit: int = 200) -> DataFrame:
    """The newest records first; the limit is the feature. The total is found.count()."""
    if type(limit) is not int or not 0 <= limit <= PAGE:
        raise ValueError(f"the limit must be between 0 and {PAGE}")
    return found.orderBy(F.desc("created_at"), F.desc("prediction_id")).limit(limit)


def run_counts(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run with its scored and accepted records."""
    counts = records.groupBy("run_id").agg(F.count("*").alias("scored"), F.count_if("accepted").alias("accepted"))
    return runs.join(counts, "run_id", "left").fillna(0, ["scored", "accepted"])


def legacy_import(old: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """runs, records, candidates and verifications of a latest-only table (key_image, predicted_amount, predicted_idx,
    confidence, created_at, verified, correct): what wasn't recorded stays null, the only candidate is the prediction.
    Import it once; ids follow time, then ring."""
    from evidara.operators.baselines import ranked

    spark = old.sparkSession
    runs = spark.createDataFrame([(run_id, None, None, None, "legacy_import", None, None, None)], "run_id string, created_at string, dataset_id string, scan_height long, origin string, feature_version string, artifact_sha256 string, source_sha256 string")
    numbered = ranked(old, ["created_at", "key_image"]).withColumn("prediction_id", F.col("rank0") + 1)
    records = numbered.select("prediction_id", F.lit(run_id).alias("run_id"), "key_image", "predicted_amount", "predicted_idx", "confidence", F.lit(True).alias("accepted"), F.lit(None).cast("int").alias("original_ring_size"), "created_at")
    candidates = numbered.select("prediction_id", F.col("predicted_amount").alias("amount"), F.col("predicted_idx").alias("idx"), F.col("confidence").alias("score"))
    none = F.lit(None).cast("long")
    verifications = numbered.where("verified").select(F.col("prediction_id").alias("verification_id"), "prediction_id", "correct", none.alias("scan_height"), F.lit("legacy_unknown").alias("provenance"), none.alias("actual_amount"), none.alias("actual_idx"), none.alias("event_id"))
    return runs, records, candidates, verifications


def cohort(found: DataFrame, runs: DataFrame) -> DataFrame:
    """found with cohort: where a record comes from, its run, and the height it was scored at, which may all be unknown."""
    known = runs.select("run_id", F.col("origin").alias("run_origin"), F.col("scan_height").alias("run_height"), F.lit(True).alias("known"))
    out = found.join(known, "run_id", "left")
    height = F.coalesce("scan_height", "run_height")
    origin = F.when(F.col("run_origin") == "legacy_import", "legacy_import").when(F.col("known"), "recorded_run").when(F.col("run_id").isNotNull(), "run_missing").otherwise("run_unknown")
    return out.withColumn("cohort", F.concat_ws("/", origin, F.coalesce("run_id", F.lit("?")), F.coalesce(height.cast("string"), F.lit("?")))).drop("run_origin", "run_height", "known")


def verification_cohort() -> F.Column:
    """Of rows: pending, or how sure one is of the verification and of when it was made."""
    scans = F.col("scan_height").isNotNull() & F.col("verification_height").isNotNull()
    timed = F.when(~scans, "deterministic_time_unknown").when(F.col("verification_height") > F.col("scan_height"), "deterministic_later_scan").otherwise("deterministic_same_or_earlier")
    return F.when(~F.col("verified"), "pending").when(F.col("verified").isNull(), "unknown").when(F.col("provenance") == "legacy_unknown", "legacy").when(F.col("provenance") == "deterministic_resolution", timed).otherwise("other_provenance")


def ambiguity(found: DataFrame, candidates: DataFrame, runs: DataFrame, listed: int = 128) -> DataFrame:
    """prediction_id, state, margin (best score less the second), bin: null margins where the alternatives aren't complete.

    found's candidates_total says how many there should be, where it is known.
    """
    score_ok = F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(0, 1) & F.col("amount").isNotNull() & F.col("idx").isNotNull()
    per = candidates.groupBy("prediction_id").agg(F.count("*").alias("n"), F.count_if(score_ok).alias("good"), F.count_distinct("amount", "idx").alias("d"), F.max_by("score", "score").alias("top1"), F.sort_array(F.collect_list("score"), False).alias("scores"))
    rows_ = found.join(per, "prediction_id", "left").join(runs.select("run_id", "origin"), "run_id", "left")
    n, total = F.coalesce("n", F.lit(0)), F.col("candidates_total")
    state = (
        F.when(F.col("origin") == "legacy_import", "legacy_alternatives_unavailable").when((total > n) | (total > listed), "candidate_list_truncated").when(total.isNull() | (total != n), "completeness_unknown").when(n < 2, "fewer_than_two")
        .when(F.col("good") < n, "invalid_scores_or_identities").when(F.col("d") < n, "duplicate_identities").otherwise("complete")
    )
    rows_ = rows_.withColumn("state", state).withColumn("margin", F.when(F.col("state") == "complete", F.element_at("scores", 1) - F.element_at("scores", 2)))
    bin_ = F.when(F.col("margin") < 0.01, 0).when(F.col("margin") < 0.05, 1).when(F.col("margin") < 0.2, 2).when(F.col("margin").isNotNull(), 3)
    return rows_.select("prediction_id", "state", "margin", bin_.alias("bin"))


def reduction_groups(evidence: DataFrame) -> DataFrame:
    """group, rings: each ring once by (original, remaining) of its records (key_image, candidates, remaining, conflicts);
    where its records differ, or a count can't be, the group is unknown. All groups are there."""
    ok = (F.col("candidates") > 0) & (F.col("remaining") >= 0) & (F.col("remaining") <= F.col("candidates"))
    said = F.when(ok, F.struct("candidates", "remaining", (F.size("conflicts") > 0).alias("conflict")))
    per = evidence.where("key_image is not null").groupBy("key_image").agg(F.count_distinct(F.coalesce(said, F.struct(F.lit(-1).cast("long").alias("candidates"), F.lit(-1).cast("long").alias("remaining"), F.lit(False).alias("conflict")))).alias("d"), F.min(said).alias("s"), F.count_if(said.isNull()).alias("none"))
    name = F.when((F.col("d") > 1) | (F.col("none") > 0), "unknown").when(F.col("s.remaining") == 0, "zero").when(F.col("s.remaining") == 1, "one").when(F.col("s.remaining") < F.col("s.candidates"), "reduced").otherwise("unchanged")
    names = evidence.sparkSession.createDataFrame([(x,) for x in ("zero", "one", "reduced", "unchanged", "unknown")], "group string")
    return F.broadcast(names).join(per.groupBy(name.alias("group")).agg(F.count("*").alias("rings")), "group", "left").select("group", F.coalesce("rings", F.lit(0)).alias("rings"))


def provenance(found: DataFrame, runs: DataFrame, margins: DataFrame) -> DataFrame:
    """check, known, total: how many records, or verified ones, have each part of their provenance."""
    known = runs.select("run_id", F.lit(True).alias("run"), "feature_version", "artifact_sha256", "source_sha256")
    out = found.join(known, "run_id", "left").join(margins.select("prediction_id", "margin"), "prediction_id", "left")
    hashed = lambda c: F.coalesce(F.col(c).rlike(HASH), F.lit(False))
    scans = F.col("scan_height").isNotNull() & F.col("verification_height").isNotNull()
    every = F.lit(True)
    checks = (
        ("run_metadata", F.col("run").isNotNull(), every), ("scan_height", F.col("scan_height").isNotNull(), every), ("feature_version", F.col("feature_version").isNotNull(), every), ("artifact_hash", hashed("artifact_sha256"), every), ("source_hash", hashed("source_sha256"), every),
        ("complete_alternatives", F.col("margin").isNotNull(), every), ("deterministic_with_both_heights", (F.col("provenance") == "deterministic_resolution") & scans, F.col("verified")),
    )
    one = out.agg(*(F.count_if(of & F.coalesce(c, F.lit(False))).alias(f"{n}_known") for n, c, of in checks), *(F.count_if(of).alias(f"{n}_total") for n, _, of in checks))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"{n}_known").alias("known"), F.col(f"{n}_total").alias("total")) for n, *_ in checks))).alias("x")).select("x.*")


def search(found: DataFrame, query: str = "", texts: tuple[str, ...] = ("key_image", "run_id", "prediction_id", "predicted_amount", "predicted_idx"), least: float | None = None, heights: tuple[int | None, int | None] = (None, None), size: int | None = None, outcome: str = "all", acceptance: str = "all") -> DataFrame:
    """Records that hold the query, as text without regard to case, in any of the columns texts, and lie within the bounds. A
    record without a number fails every bound on it."""
    keep = F.lit(True)
    query = query.strip().lower()
    if query:
        keep = keep & F.coalesce(sum((F.coalesce(F.lower(F.col(c).cast("string")).contains(query), F.lit(False)).cast("int") for c in texts), F.lit(0)) > 0, F.lit(False))
    bounds = [(F.col("confidence") >= least, least), (F.col("height") >= heights[0], heights[0]), (F.col("height") <= heights[1], heights[1]), (F.col("original_ring_size") == size, size)] if "height" in found.columns else [(F.col("confidence") >= least, least), (F.col("original_ring_size") == size, size)]
    for bound, given in bounds:
        if given is not None:
            keep = keep & F.coalesce(bound, F.lit(False))
    if outcome != "all":
        keep = keep & (an.outcome("verified", "correct") == outcome)
    if acceptance != "all":
        keep = keep & (F.when(F.col("accepted").isNull(), "unknown").when(F.col("accepted"), "accepted").otherwise("below") == acceptance)
    return found.where(keep)


def merged(scores: DataFrame, explained: DataFrame) -> DataFrame:
    """The candidates that a record scored (key_image, amount, idx, score) and those of the evidence (with state), side by side:
    what either lacks is null, and a candidate without evidence is unknown."""
    both = scores.join(explained, ["key_image", "amount", "idx"], "full_outer")
    return both.withColumn("state", F.coalesce("state", F.lit("unknown")))


def snapshots(rows_: DataFrame, dataset: str, value: str = "n") -> DataFrame:
    """Snapshots (at, dataset_id, value columns) of one dataset: at, value, delta to the one before, conflict (several values of
    one time: the value is null, and so are the deltas next to it). Others are left out; use cohorts to count them."""
    own = rows_.where((F.col("dataset_id") == dataset) & F.col("at").isNotNull())
    per = own.groupBy("at").agg(F.count_distinct(value).alias("d"), F.min(value).alias(value))
    per = per.select("at", F.when(F.col("d") == 1, F.col(value)).alias(value), (F.col("d") > 1).alias("conflict"))
    return per.withColumn("delta", F.col(value) - F.lag(value).over(Window.orderBy("at")))  # a row a snapshot


def cohorts(rows_: DataFrame, dataset: str) -> DataFrame:
    """cohort (current, other, unknown), snapshots."""
    name = F.when(F.col("dataset_id").isNull(), "unknown").when(F.col("dataset_id") == dataset, "current").otherwise("other")
    return rows_.groupBy(name.alias("cohort")).agg(F.count("*").alias("snapshots"))
