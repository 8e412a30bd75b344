"""Registered queries over a prediction history that a fixed rule makes of the ring view, with SQL that says the same.

Each unresolved or cascaded ring's record is its rarest output, scored by 1/reuse, in one of four runs: run0 is a legacy
import, run3 has no metadata. Resolved rings are verified, some of them twice, some with unknown provenance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import analytics as an
from evidara.operators import cascade as cas
from evidara.operators import features, graph, history, predict
from evidara.plans.evidence import CLAIMS, stored
from evidara.plans.lineage import cut
from evidara.plans.queries import FEATURE_SQL, PROFILED, WITH, _cascade, _unpivot, query
from evidara.ringview import rings, table

HISTORY = CLAIMS + f""", u AS MATERIALIZED (SELECT amount, idx, count(*) AS reuse FROM m GROUP BY amount, idx),
cand AS MATERIALIZED (SELECT m.key_image AS prediction_id, m.amount, m.idx, 1.0::DOUBLE / u.reuse AS score FROM m JOIN u USING (amount, idx) JOIN siz USING (key_image) WHERE siz.n > 1),
runs AS MATERIALIZED (SELECT 'run' || r AS run_id, CASE WHEN r <> 1 THEN 100 * r END AS scan_height, CASE WHEN r = 0 THEN 'legacy_import' END AS origin, CASE WHEN r = 2 THEN 'v2' END AS feature_version, CASE WHEN r > 0 THEN repeat('ab', 32) END AS artifact_sha256, CASE WHEN r = 1 THEN 'no' END AS source_sha256 FROM (SELECT unnest([0, 1, 2]) AS r)),
rec AS MATERIALIZED (SELECT prediction_id, 'run' || prediction_id % 4 AS run_id, prediction_id AS key_image, amount AS predicted_amount, idx AS predicted_idx, score AS confidence, CASE WHEN prediction_id % 13 <> 0 THEN score >= 0.5 END AS accepted, n AS original_ring_size, height AS created_at, height
 FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY score DESC, idx, amount) AS place FROM cand) c JOIN siz ON siz.key_image = c.prediction_id JOIN ctx ON ctx.key_image = c.prediction_id WHERE place = 1),
ver AS MATERIALIZED (SELECT 2 * prediction_id + x AS verification_id, prediction_id, CASE WHEN prediction_id % 17 <> 0 THEN (res.amount = predicted_amount AND res.idx = predicted_idx) <> (x = 0 AND prediction_id % 6 = 0) END AS correct, CASE WHEN prediction_id % 7 <> 0 THEN height * 4 END AS scan_height, CASE WHEN prediction_id % 10 = 0 THEN 'legacy_unknown' WHEN prediction_id % 11 = 0 THEN 'manual_unknown' ELSE 'deterministic_resolution' END AS provenance
 FROM rec JOIN res USING (key_image), (SELECT unnest([0, 1]) AS x) WHERE x = 1 OR prediction_id % 3 = 0),
hist AS MATERIALIZED (SELECT r.*, runs.scan_height, v.verification_id, v.correct, v.scan_height AS verification_height, v.provenance, v.verification_id IS NOT NULL AS verified, CASE WHEN v.provenance = 'deterministic_resolution' AND runs.scan_height >= 0 AND v.scan_height IS NOT NULL THEN CASE WHEN v.scan_height > runs.scan_height THEN 'later_scan' ELSE 'same_or_earlier_scan' END ELSE 'unknown' END AS timing,
 CASE WHEN v.verification_id IS NULL THEN 'pending' WHEN v.correct THEN 'correct' WHEN NOT v.correct THEN 'wrong' ELSE 'unknown' END AS outcome, runs.origin FROM rec r JOIN runs USING (run_id) LEFT JOIN (SELECT * FROM ver QUALIFY row_number() OVER (PARTITION BY prediction_id ORDER BY verification_id DESC) = 1) v USING (prediction_id))
"""


def _history(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    r, c, claims, told = stored(spark, sf)
    scored = predict.reuse_score(features.reuse(r.members)).join(c.sizes.where("n > 1"), "key_image")
    candidates = cut(scored.select(F.col("key_image").alias("prediction_id"), "amount", "idx", "score"), "candidates")
    key = F.col("key_image")
    picks = predict.argmax(scored).join(r.context.select("key_image", "height"), "key_image")
    records = cut(picks.select(key.alias("prediction_id"), F.concat(F.lit("run"), (key % 4).cast("string")).alias("run_id"), key, F.col("amount").alias("predicted_amount"), F.col("idx").alias("predicted_idx"), F.col("score").alias("confidence"), F.when(key % 13 != 0, F.col("score") >= 0.5).alias("accepted"), F.col("n").alias("original_ring_size"), F.col("height").alias("created_at"), "height"), "records")
    runs = spark.createDataFrame([("run0", 0, "legacy_import", None, None, None), ("run1", None, None, None, "ab" * 32, "no"), ("run2", 200, None, "v2", "ab" * 32, None)], "run_id string, scan_height long, origin string, feature_version string, artifact_sha256 string, source_sha256 string")
    real = c.resolved.select("key_image", "amount", "idx")
    x = records.join(real, "key_image").withColumn("x", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("x") == 1) | (key % 3 == 0))
    right = (F.col("amount") == F.col("predicted_amount")) & (F.col("idx") == F.col("predicted_idx"))
    verifications = x.select((2 * key + F.col("x")).alias("verification_id"), "prediction_id", F.when(key % 17 != 0, right != ((F.col("x") == 0) & (key % 6 == 0))).alias("correct"), F.when(key % 7 != 0, F.col("height") * 4).alias("scan_height"), F.when(key % 10 == 0, "legacy_unknown").when(key % 11 == 0, "manual_unknown").otherwise("deterministic_resolution").alias("provenance"), F.col("amount").alias("actual_amount"), F.col("idx").alias("actual_idx"), F.lit(None).cast("long").alias("event_id"))
    found = cut(history.rows(records, runs, verifications), "history")
    return {"rings": r, "cascade": c, "claims": claims, "told": told, "records": records, "candidates": candidates, "runs": runs, "verifications": verifications, "rows": found}


@query(HISTORY + "SELECT prediction_id, run_id, key_image, predicted_amount, predicted_idx, round(confidence, 6) AS confidence, accepted, scan_height, verified, correct, verification_height, provenance, timing FROM hist ORDER BY created_at DESC, prediction_id DESC LIMIT 200")
def prediction_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.page(_history(spark, sf)["rows"])
    return rows.select("prediction_id", "run_id", "key_image", "predicted_amount", "predicted_idx", F.round("confidence", 6).alias("confidence"), "accepted", "scan_height", "verified", "correct", "verification_height", "provenance", "timing")


@query(HISTORY + "SELECT run_id, scan_height, origin, count(rec.prediction_id) AS scored, count(*) FILTER (accepted) AS accepted FROM runs LEFT JOIN rec USING (run_id) GROUP BY ALL")
def prediction_runs(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    return history.run_counts(h["records"], h["runs"]).select("run_id", "scan_height", "origin", "scored", "accepted")


@query(HISTORY + "SELECT count(*) AS records, count(*) FILTER (accepted AND prediction_id NOT IN (SELECT prediction_id FROM ver)) AS open, CAST(0 AS BIGINT) AS broken FROM rec")
def prediction_open(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    broken = history.checked(h["records"], h["candidates"]).where("rule is not null")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(h["records"], "records").join(one(history.open_records(h["records"], h["verifications"]), "open")).join(one(broken, "broken"))


SUMMARY = """count(*) AS total, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (NOT accepted) AS below_run_threshold, count(*) FILTER (accepted IS NULL) AS acceptance_unknown, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'pending') AS pending, count(*) FILTER (outcome = 'unknown') AS unknown, count(*) FILTER (confidence IS NULL) AS unknown_scores"""
SHARES = f"""correct + wrong AS n_verified, round(total / (SELECT count(*) FROM hist), 6) AS coverage, round((correct + wrong) / total, 6) AS verified_share, round(correct / nullif(correct + wrong, 0), 6) AS accuracy,
CASE WHEN n > 0 THEN round(greatest(0, (h / n + {an.Z**2} / (2 * n) - {an.Z} * sqrt(h / n * (1 - h / n) / n + {an.Z**2} / (4 * n * n))) / (1 + {an.Z**2} / n)), 6) END AS low, CASE WHEN n > 0 THEN round(least(1, (h / n + {an.Z**2} / (2 * n) + {an.Z} * sqrt(h / n * (1 - h / n) / n + {an.Z**2} / (4 * n * n))) / (1 + {an.Z**2} / n)), 6) END AS high"""


def _grouped_sql(key: str, name: str) -> str:
    return HISTORY + f"SELECT * EXCLUDE (n, h), {SHARES} FROM (SELECT *, correct + wrong AS n, correct AS h FROM (SELECT {key} AS {name}, {SUMMARY} FROM hist GROUP BY 1))"


def _grouped(rows: DataFrame, name: str) -> DataFrame:
    out = an.summarized(rows, [name])
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "verified_share", "accuracy", "low", "high")})


@query(_grouped_sql("original_ring_size", "original_ring_size"))
def outcomes_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return _grouped(_history(spark, sf)["rows"], "original_ring_size")


@query(_grouped_sql("CASE WHEN origin = 'legacy_import' THEN 'legacy_import' ELSE 'recorded_run' END || '/' || run_id || '/' || coalesce(CAST(scan_height AS VARCHAR), '?')", "cohort"))
def outcomes_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    return _grouped(history.cohort(h["rows"], h["runs"]), "cohort")


@query(_grouped_sql("CASE WHEN NOT verified THEN 'pending' WHEN provenance = 'legacy_unknown' THEN 'legacy' WHEN provenance = 'deterministic_resolution' THEN CASE WHEN scan_height IS NULL OR verification_height IS NULL THEN 'deterministic_time_unknown' WHEN verification_height > scan_height THEN 'deterministic_later_scan' ELSE 'deterministic_same_or_earlier' END ELSE 'other_provenance' END", "cohort"))
def outcomes_by_verification(spark: SparkSession, sf: str) -> DataFrame:
    return _grouped(_history(spark, sf)["rows"].withColumn("cohort", history.verification_cohort()), "cohort")


AMBIGUITY = """, am AS MATERIALIZED (SELECT prediction_id, state, CASE WHEN state = 'complete' THEN l[1] - l[2] END AS margin FROM (SELECT h.prediction_id, l, CASE WHEN origin = 'legacy_import' THEN 'legacy_alternatives_unavailable' WHEN total > n THEN 'candidate_list_truncated' WHEN total IS NULL THEN 'completeness_unknown' ELSE 'complete' END AS state
 FROM (SELECT *, CASE WHEN prediction_id % 19 = 0 THEN NULL WHEN prediction_id % 23 = 0 THEN original_ring_size + 1 ELSE original_ring_size END AS total FROM hist) h JOIN (SELECT prediction_id, count(*) AS n, list(score ORDER BY score DESC) AS l FROM cand GROUP BY 1) c USING (prediction_id)))
"""


def _ambiguity(h: dict) -> DataFrame:
    key = F.col("prediction_id")
    told = F.when(key % 19 == 0, F.lit(None)).when(key % 23 == 0, F.col("original_ring_size") + 1).otherwise(F.col("original_ring_size"))
    return history.ambiguity(h["rows"].withColumn("candidates_total", told), h["candidates"], h["runs"])


@query(HISTORY + AMBIGUITY + "SELECT state, CASE WHEN margin < 0.01 THEN 0 WHEN margin < 0.05 THEN 1 WHEN margin < 0.2 THEN 2 WHEN margin IS NOT NULL THEN 3 END::INTEGER AS bin, count(*) AS records FROM am GROUP BY 1, 2")
def ambiguity_states(spark: SparkSession, sf: str) -> DataFrame:
    return _ambiguity(_history(spark, sf)).groupBy("state", "bin").agg(F.count("*").alias("records"))


@query(HISTORY + AMBIGUITY + """SELECT unnest(['run_metadata', 'scan_height', 'feature_version', 'artifact_hash', 'source_hash', 'complete_alternatives', 'deterministic_with_both_heights']) AS check, unnest([count(*), count(scan_height), count(feature_version), count(artifact_sha256), CAST(0 AS BIGINT), count(margin), count(*) FILTER (verified AND provenance = 'deterministic_resolution' AND scan_height IS NOT NULL AND verification_height IS NOT NULL)]) AS known,
unnest([count(*), count(*), count(*), count(*), count(*), count(*), count(*) FILTER (verified)]) AS total FROM (SELECT hist.*, runs.feature_version, runs.artifact_sha256, am.margin FROM hist JOIN runs USING (run_id) JOIN am USING (prediction_id))""")
def provenance_coverage(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    return history.provenance(h["rows"], h["runs"], _ambiguity(h))


@query(HISTORY + "SELECT prediction_id FROM hist WHERE (CAST(key_image AS VARCHAR) LIKE '%7%' OR run_id LIKE '%7%' OR CAST(predicted_amount AS VARCHAR) LIKE '%7%' OR CAST(predicted_idx AS VARCHAR) LIKE '%7%') AND confidence >= 0.25 AND height BETWEEN 12 AND 60 AND original_ring_size = 4 AND outcome = 'pending' AND accepted IS NOT NULL AND NOT accepted")
def prediction_search(spark: SparkSession, sf: str) -> DataFrame:
    return history.search(_history(spark, sf)["rows"], " 7 ", least=0.25, heights=(12, 60), size=4, outcome="pending", acceptance="below").select("prediction_id")


REDUCED = """, b AS (SELECT m.key_image, coalesce(o.owners, 0) - (c.key_image IS NOT NULL)::INT AS others, c.key_image IS NOT NULL AS mine FROM m LEFT JOIN own o ON o.amount = m.amount AND o.idx = m.idx LEFT JOIN (SELECT * FROM claims WHERE confidence = 1.0 AND pass >= 0) c ON c.key_image = m.key_image AND c.amount = m.amount AND c.idx = m.idx),
g AS (SELECT key_image, count(*) AS n, count(*) FILTER (others = 0 AND (mine OR NOT held)) AS remaining FROM (SELECT *, bool_or(mine) OVER (PARTITION BY key_image) AS held FROM b) GROUP BY key_image)
"""


@query(CLAIMS + REDUCED + """SELECT grp AS "group", count(key_image) AS rings FROM (SELECT unnest(['zero', 'one', 'reduced', 'unchanged', 'unknown']) AS grp) LEFT JOIN (SELECT key_image, CASE WHEN key_image % 31 = 0 THEN 'unknown' WHEN remaining = 0 THEN 'zero' WHEN remaining = 1 THEN 'one' WHEN remaining < n THEN 'reduced' ELSE 'unchanged' END AS grp FROM g) USING (grp) GROUP BY grp""")
def reduction_groups(spark: SparkSession, sf: str) -> DataFrame:
    r, _, claims, told = stored(spark, sf)
    rows = graph.conflicts(graph.explain(r.members, claims), r.members, claims, told)
    twice = rows.where("key_image % 31 = 0").withColumn("remaining", F.col("remaining") + 1)  # a second record that says otherwise
    return history.reduction_groups(rows.union(twice))


@query(HISTORY + """, src AS (SELECT claims.amount, claims.idx, claims.key_image AS source FROM claims SEMI JOIN m ON m.key_image = claims.key_image AND m.amount = claims.amount AND m.idx = claims.idx WHERE confidence = 1.0 AND pass >= 0),
s AS (SELECT m.*, (SELECT count(*) FROM src WHERE src.amount = m.amount AND src.idx = m.idx AND source <> m.key_image) AS others, EXISTS (SELECT 1 FROM src WHERE src.amount = m.amount AND src.idx = m.idx AND source = m.key_image) AS mine FROM m),
t AS (SELECT key_image, amount, idx, CASE WHEN others > 0 THEN 'eliminated' WHEN bool_or(mine) OVER (PARTITION BY key_image) AND NOT mine THEN 'excluded' ELSE 'remaining' END AS state FROM s),
p AS (SELECT prediction_id AS key_image, amount, CASE WHEN prediction_id % 12 = 0 THEN idx + 1000000 ELSE idx END AS idx, score FROM cand)
SELECT coalesce(state, 'unknown') AS state, count(*) AS candidates, count(score) AS scored FROM p FULL JOIN t USING (key_image, amount, idx) GROUP BY 1""")
def candidate_states(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    scores = h["candidates"].select(F.col("prediction_id").alias("key_image"), "amount", F.when(F.col("prediction_id") % 12 == 0, F.col("idx") + 1_000_000).otherwise(F.col("idx")).alias("idx"), "score")
    both = history.merged(scores, graph.explain(h["rings"].members, h["claims"]).select("key_image", "amount", "idx", "state"))
    return both.groupBy("state").agg(F.count("*").alias("candidates"), F.count("score").alias("scored"))


@query("""WITH b AS (SELECT CAST(ts AS DATE) AS d, CASE WHEN user_id % 3 = 0 THEN 'x' WHEN user_id % 3 = 1 THEN 'y' END AS dataset_id, CASE WHEN day(ts) % 5 = 0 THEN user_id // 60 ELSE 0 END AS half, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT d, CASE WHEN count(DISTINCT n) = 1 THEN min(n) END AS n, count(DISTINCT n) > 1 AS conflict FROM b WHERE dataset_id = 'x' GROUP BY d)
SELECT d AS "at", n, conflict, n - lag(n) OVER (ORDER BY d) AS delta FROM e""")
def snapshot_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth day has several snapshots of a data set, by parts of its users, which may contradict each other."""
    user = F.col("user_id")
    rows = table(spark, sf, "events").groupBy(F.to_date("ts").alias("at"), F.when(user % 3 == 0, "x").when(user % 3 == 1, "y").alias("dataset_id"), F.when(F.dayofmonth("ts") % 5 == 0, F.floor(user / 60)).otherwise(0).alias("half")).agg(F.count("*").alias("n"))
    return history.snapshots(rows, "x")


@query("""WITH t AS MATERIALIZED (SELECT o_custkey AS c, o_orderkey AS k FROM orders) SELECT a.k AS "left", b.k AS "right", count(*) AS shared FROM t a JOIN t b ON a.c = b.c AND a.k < b.k GROUP BY 1, 2""")
def relationship_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("key_image"))
    return graph.pairs(rows, ["group"])


@query(FEATURE_SQL + f""", p AS (SELECT feature, count(*) AS finite, count(DISTINCT value) AS d FROM ({_unpivot(PROFILED)}) GROUP BY feature) SELECT feature, finite, CASE WHEN d = 1 THEN 'constant' ELSE 'varying' END AS quality FROM p WHERE replace(feature, '_', ' ') LIKE '%in%'""")
def feature_states(spark: SparkSession, sf: str) -> DataFrame:
    r = rings(spark, sf)
    profile = features.profile(features.features(r.members, r.context), PROFILED)
    rows = profile.select("feature", "finite", (F.col("finite") + F.col("missing") + F.col("nonfinite")).alias("candidates"), "missing", "nonfinite", F.lit(0).alias("nonnumeric"), F.when(F.col("constant"), 1).otherwise(2).alias("distinct"), "constant")
    return an.find_features(an.feature_quality(rows), "in").select("feature", "finite", "quality")


@query(WITH + """SELECT o_orderkey AS id, CASE WHEN o_custkey % 50 > 0 THEN CASE WHEN f * 100 // (o_custkey % 50) = 0 AND f > 0 THEN '<0.01' ELSE (f * 100 // (o_custkey % 50)) // 100 || '.' || lpad(CAST((f * 100 // (o_custkey % 50)) % 100 AS VARCHAR), 2, '0') END END AS density, (f * 1000003) // 1000000000000 || '.' || lpad(CAST((f * 1000003) % 1000000000000 AS VARCHAR), 12, '0') AS amount
FROM (SELECT *, CAST(o_orderkey % 7 AS HUGEINT) * o_custkey * 12345 AS f FROM orders)""")
def exact_amounts(spark: SparkSession, sf: str) -> DataFrame:
    fee = (F.col("o_orderkey") % 7) * F.col("o_custkey") * 12345
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), fee.alias("fee"), (F.col("o_custkey") % 50).alias("weight"))
    return rows.select("id", an.fee_density("fee", "weight").alias("density"), an.decimal_places((F.col("fee").cast("decimal(38,0)") * 1000003).cast("decimal(38,0)")).alias("amount"))


@query(CLAIMS + "SELECT count(*) AS claims, count(*) FILTER (res.key_image IS NOT NULL) AS with_event FROM claims LEFT JOIN res ON res.key_image = claims.key_image AND res.amount = claims.amount AND res.idx = claims.idx AND res.pass = claims.pass WHERE confidence = 1.0 AND claims.pass >= 0")
def claim_events(spark: SparkSession, sf: str) -> DataFrame:
    _, c, claims, _ = stored(spark, sf)
    found = history.claim_events(claims, cas.events(c)[0])
    return found.agg(F.count("*").alias("claims"), F.count("event_id").alias("with_event"))


@query(CLAIMS + "SELECT count(*) AS claims FROM claims LEFT JOIN res ON res.key_image = claims.key_image AND res.amount = claims.amount AND res.idx = claims.idx AND res.pass = claims.pass WHERE res.key_image IS NULL")
def legacy_claims(spark: SparkSession, sf: str) -> DataFrame:
    _, c, claims, _ = stored(spark, sf)
    named = claims.select("key_image", F.col("amount").alias("real_amount"), F.col("idx").alias("real_output_index"), F.col("pass").alias("resolved_at_pass"), "confidence")
    return cas.legacy(cas.events(c)[0], named).agg(F.count("*").alias("claims"))


@query()
def event_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that the analysis's own events break: none."""
    r, c = rings(spark, sf), _cascade(spark, sf)[1]
    return cas.broken(*cas.events(c), r.members)
