import math

import pytest
from pyspark.sql import functions as F

from evidara.functions import analytics as an
from evidara.operators import audit, cascade, graph, history, predict

RECORDS = "prediction_id long, run_id string, key_image string, predicted_amount long, predicted_idx long, confidence double, accepted boolean, original_ring_size int, created_at string"
CANDIDATES = "prediction_id long, amount long, idx long, score double"
RUNS = "run_id string, scan_height long, origin string, feature_version string, artifact_sha256 string, source_sha256 string"
VERIFIED = "verification_id long, prediction_id long, correct boolean, scan_height long, provenance string, actual_amount long, actual_idx long, event_id long"
SCORED = "key_image string, amount long, idx long, label int, score double"


@pytest.fixture
def store(spark):
    records = [(1, "a", "k", 0, 7, 0.99, True, 2, "t1"), (2, "a", "k", 5, 7, 0.98, True, 2, "t2"), (3, "b", "m", 0, 1, 0.3, False, 3, "t2"), (4, "b", "n", 0, 2, 0.97, True, 2, "t3")]
    candidates = [(1, 0, 7, 0.99), (1, 0, 8, 0.1), (2, 5, 7, 0.98), (2, 5, 7, 0.2), (3, 0, 1, 0.3), (4, 0, 2, 0.5), (4, 0, 3, 1.5)]
    verified = [(1, 1, False, 40, "deterministic_resolution", 0, 8, 3), (2, 1, True, 90, "deterministic_resolution", 0, 7, 4), (3, 4, None, None, "legacy_unknown", None, None, None)]
    return spark.createDataFrame(records, RECORDS), spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame([("a", 60, None, "v", "f" * 64, None), ("b", None, "legacy_import", None, "zz", None)], RUNS), spark.createDataFrame(verified, VERIFIED)


def test_history_pages_and_rules(store):
    records, candidates, runs, verified = store
    assert {r.prediction_id: r.rule for r in history.checked(records, candidates).collect()} == {1: None, 2: "repeated_candidate", 3: None, 4: "score_out_of_range"}
    assert [r.prediction_id for r in history.open_records(records, verified).collect()] == [2] and {r.key_image: r.prediction_id for r in history.current(records).collect()} == {"k": 2, "n": 4}
    rows = history.rows(records, runs, verified)
    assert [(r.prediction_id, r.verified, r.correct, r.timing) for r in history.page(rows, 3).collect()] == [(4, True, None, "unknown"), (3, False, None, "unknown"), (2, False, None, "unknown")]
    assert [(r.timing, r.correct) for r in rows.where("prediction_id = 1").collect()] == [("later_scan", True)]
    with pytest.raises(ValueError):
        history.page(rows, 5001)
    assert {r.run_id: (r.scored, r.accepted) for r in history.run_counts(records, runs).collect()} == {"a": (2, 2), "b": (2, 1)}
    assert {r.cohort for r in history.cohort(rows, runs).collect()} == {"recorded_run/a/60", "legacy_import/b/?"}
    assert {r.prediction_id: (r.state, r.margin) for r in history.ambiguity(rows.withColumn("candidates_total", F.when(F.col("prediction_id") == 1, 2).otherwise(9)), candidates, runs).collect()} == {1: ("complete", 0.89), 2: ("candidate_list_truncated", None), 3: ("legacy_alternatives_unavailable", None), 4: ("legacy_alternatives_unavailable", None)}
    margins = history.ambiguity(rows.withColumn("candidates_total", F.lit(2)), candidates, runs)
    assert {r.check: (r.known, r.total) for r in history.provenance(rows, runs, margins).collect()} == {"run_metadata": (4, 4), "scan_height": (2, 4), "feature_version": (2, 4), "artifact_hash": (2, 4), "source_hash": (0, 4), "complete_alternatives": (1, 4), "deterministic_with_both_heights": (1, 2)}
    assert [r.prediction_id for r in history.search(rows, "K", least=0.985).collect()] == [1] and history.search(rows, outcome="unknown").first().prediction_id == 4 and history.search(rows, acceptance="below").first().prediction_id == 3


def test_legacy_import_keeps_unknowns(spark):
    old = spark.createDataFrame([("y", 0, 5, 0.9, "2", True, False), ("x", 0, 4, 0.8, "1", False, None)], "key_image string, predicted_amount long, predicted_idx long, confidence double, created_at string, verified boolean, correct boolean")
    runs, records, candidates, verified = history.legacy_import(old, "legacy-1")
    assert [(r.prediction_id, r.key_image, r.original_ring_size) for r in records.orderBy("prediction_id").collect()] == [(1, "x", None), (2, "y", None)] and candidates.count() == 2
    assert [(r.prediction_id, r.correct, r.provenance, r.scan_height) for r in verified.collect()] == [(2, False, "legacy_unknown", None)] and runs.first().origin == "legacy_import"


def test_groups_and_snapshots(spark):
    rows = spark.createDataFrame([("a", 3, 0, []), ("b", 3, 1, []), ("c", 3, 2, []), ("d", 3, 3, []), ("e", 3, 3, []), ("e", 3, 2, []), ("f", 3, 4, []), (None, 3, 3, [])], "key_image string, candidates long, remaining long, conflicts array<string>")
    assert {r.group: r.rings for r in history.reduction_groups(rows).collect()} == {"zero": 1, "one": 1, "reduced": 1, "unchanged": 1, "unknown": 2}
    snaps = spark.createDataFrame([(1, "d", 5), (2, "d", 9), (2, "d", 8), (3, "d", 20), (4, "d", 21), (4, "o", 1), (5, None, 2)], "at long, dataset_id string, n long")
    assert [(r["at"], r.n, r.conflict, r.delta) for r in history.snapshots(snaps, "d").orderBy("at").collect()] == [(1, 5, False, None), (2, None, True, None), (3, 20, False, None), (4, 21, False, 1)]
    assert {r.cohort: r.snapshots for r in history.cohorts(snaps, "d").collect()} == {"current": 5, "other": 1, "unknown": 1}


def test_outcomes_and_rederivation(spark):
    scored = spark.createDataFrame([("p", 3, 1, 0, 0.5), ("p", 3, 2, 1, 0.5), ("p", 3, 3, 0, 0.1), ("q", 3, 1, 1, 0.9), ("q", 3, 4, 0, 0.2), ("r", 3, 5, 0, 0.7), ("r", 3, 6, 1, 0.6)], SCORED)
    found = audit.outcomes(scored)
    assert {r.key_image: (r.pick.idx, r.hit, r.ties, r.among) for r in found.collect()} == {"p": (1, False, 2, True), "q": (1, True, 1, True), "r": (5, False, 1, False)}
    total = audit.outcome_summary(found).first()
    assert (total.rings, total.candidates, total.correct, total.tied, total.parts) == (3, 7, 1, 1, "1:1,2:1") and math.isclose(total.expected, 1.5)
    assert audit.rederived(scored, found).isEmpty() and audit.same_rows(found, audit.outcomes(scored.orderBy("idx")))
    wrong = found.withColumn("hit", F.when(F.col("key_image") == "q", False).otherwise(F.col("hit"))).where("key_image <> 'r'")
    assert {tuple(r) for r in audit.rederived(scored, wrong).collect()} == {("q", "hit"), ("r", "not_stated")}
    with pytest.raises(Exception, match="score out of range"):
        audit.outcomes(spark.createDataFrame([("p", 3, 1, 0, 1.5)], SCORED)).collect()


def test_masks_come_from_training_rows(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 2.0, 5.0), (1.0, 3.0, 3.0, 5.0), (1.0, 4.0, 4.0, 6.0)], "a double, b double, c double, d double")
    assert audit.masks(rows, ("a", "b", "c", "d")) == {"all_features": ["a", "b", "c", "d"], "drop_constants": ["b", "c", "d"], "drop_constants_and_duplicates": ["b", "d"]}
    with pytest.raises(ValueError):
        audit.masks(rows.limit(1), ("a", "b"))
    used = []

    def fitted(train, names):
        used.append(names)
        return lambda test: test

    scored = spark.createDataFrame([("p", 3, 1, 1, 0.5), ("p", 3, 2, 0, 0.4)], SCORED)
    assert {k: v.first().hit for k, v in audit.variants(rows, scored, fitted, ("a", "b", "c", "d")).items()} == {"all_features": True, "drop_constants": True, "drop_constants_and_duplicates": True} and used[2] == ("b", "d")


def test_frozen_records(spark):
    kind = "key_image string, status string, height long, members array<struct<amount: long, idx: long>>, real struct<amount: long, idx: long>, reuse array<long>, candidates array<struct<amount: long, idx: long, features: array<double>>>"
    good = lambda k, **x: {"key_image": k * 64, "status": "deterministic_training", "height": 5, "members": [(2, 1), (2, 4)], "real": (2, 4), "reuse": [1, 3], "candidates": [(2, 1, [0.5]), (2, 4, [1.0])]} | x
    rows = [good("a"), good("b", real=(2, 9)), good("c", reuse=[1, 0]), good("d", candidates=[(2, 4, [0.5]), (2, 1, [1.0])]), good("e", candidates=[(2, 1, [0.5]), (2, 4, [float("nan")])]), good("f", height=None), good("1", members=[(2, 1)]), good("2", status="other", reuse=[]), good("3"), good("3")]
    names = [c.split()[0] for c in ("key_image", "status", "height", "members", "real", "reuse", "candidates")]
    found = audit.record_faults(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], kind), ("x",)).collect()
    assert sorted((r.key_image[0], r.rule) for r in found) == [("1", "incomplete"), ("3", "identity"), ("3", "identity"), ("b", "label"), ("c", "reuse"), ("d", "order_or_members"), ("e", "features"), ("f", "height")]
    both = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert audit.cohort_hash(both, "k", ["v"]) == audit.cohort_hash(both.orderBy(F.desc("k")), "k", ["v"]) != audit.cohort_hash(both.limit(1), "k", ["v"])
    ids = spark.createDataFrame([("k", 1, 2)], "key_image string, amount long, idx long")
    assert audit.extracted(ids, ids).isEmpty() and audit.extracted(ids, ids.where("false")).first()["where"] == "not_described"
    pairs = spark.createDataFrame([([1, 2], ["x", "y"])], "a array<int>, b array<string>").select(audit.zipped(F.col("a"), F.col("b")).alias("z")).first().z
    assert [tuple(p) for p in pairs] == [(1, "x"), (2, "y")]


def test_soft_cascade_resolves_by_confident_guesses(spark):
    members = spark.createDataFrame([("s", 0, 1), ("a", 0, 1), ("a", 0, 2), ("a", 0, 3), ("b", 0, 2), ("b", 0, 4), ("c", 0, 8), ("c", 0, 9)], "key_image string, amount long, idx long")
    score = lambda live: live.withColumn("score", F.when(F.col("idx") == 2, 0.99).otherwise(0.3))
    result = predict.soft_cascade(members, score, cascade.cascade)
    found = {r.key_image: (r.idx, r["pass"] >= 0) for r in result.resolved.collect()}
    assert found["s"] == (1, True) and found["a"][0] == 2 and not found["a"][1] and "c" not in found


def test_consistency_and_local_graph(spark):
    rows = spark.createDataFrame([(10, 5, 1, 2, 2, 1, 0.6, 0.7), (10, 5, 1, 2, 3, 1, 0.6, 0.7), (10, 5, 1, 2, 2, 0, 0.6, 0.7)], "rings long, both long, first_only long, second_only long, neither long, net long, agreement_first double, agreement_second double")
    assert [r.ok for r in rows.select(an.paired_holds().alias("ok")).collect()] == [True, False, False]
    rows = spark.createDataFrame([(4, 2.0, 0.5), (4, 2.0, 0.6), (0, 0.0, None)], "rings long, expected double, accuracy double")
    assert [r.ok for r in rows.select(an.baseline_holds().alias("ok")).collect()] == [True, False, False]
    assert [r.s for r in spark.createDataFrame([(10.0,), (9000.0,), (None,)], "a double").select(an.archive_state(F.col("a"), 3600).alias("s")).collect()] == ["current", "stale", "unknown"]
    assert [r.s for r in spark.createDataFrame([(10.0,), (9000.0,), (-90.0,)], "a double").select(an.freshness(F.col("a"), 60).alias("s")).collect()] == ["recent", "stale", "clock_mismatch"]
    assert [r.t for r in spark.createDataFrame([(1.5,), (float("nan"),), (float("-inf"),)], "a double").select(an.finite_tag(F.col("a")).alias("t")).collect()] == [None, "nan", "-inf"]
    members = spark.createDataFrame([("one", 0, 5), ("x", 0, 5), ("x", 0, 6), ("x", 0, 7), ("x", 0, 8)], "key_image string, amount long, idx long")
    claims = spark.createDataFrame([("one", 0, 5, 0, 1.0)], "key_image string, amount long, idx long, pass int, confidence double")
    nodes, edges = graph.local_graph(graph.explain(members, claims).where("key_image = 'x'"), spark.createDataFrame([("x", 0, 8)], "key_image string, amount long, idx long"), 4)
    assert {(r.id, r.place) for r in nodes.collect()} == {("ring:x", 0), ("output:0:8", 1), ("output:0:6", 2), ("output:0:7", 3), ("output:0:5", 4), ("ring:one", None)}
    assert edges.where("kind = 'eliminates'").first().target == "output:0:5" and edges.count() == 5
