import random

import pytest
from pyspark.sql import functions as F

from evidara.operators import cascade as cas
from evidara.operators import components, evidence, graph, summary

MEMBERS = "key_image string, amount long, idx long"


@pytest.fixture(autouse=True, params=[cas.ONE_TASK, 0])
def both_ways(request, monkeypatch):
    """In one task and pass by pass."""
    monkeypatch.setattr(cas, "ONE_TASK", request.param)


def rings(spark, spec):
    return spark.createDataFrame([(k, *o) for k, outs in spec.items() for o in outs], MEMBERS)


#: d falls first, then c, then a and b at once; e keeps two.
LADDER = {"d": [(6, 40)], "c": [(6, 40), (6, 31)], "a": [(6, 31), (6, 40), (6, 22)], "b": [(6, 31), (6, 23)], "e": [(6, 22), (6, 90), (6, 91)]}


def claims(result):
    return {r.key_image: (r.amount, r.idx, r["pass"], r.method) for r in result.resolved.collect()}


def test_ladder_and_lineage(spark):
    members = rings(spark, LADDER)
    result = cas.cascade(members)
    assert claims(result) == {"d": (6, 40, 0, "ring_size_one"), "c": (6, 31, 1, "cascade"), "a": (6, 22, 2, "cascade"), "b": (6, 23, 2, "cascade")}
    deps = {(r.key_image, r.source, r.idx) for r in cas.dependencies(result).collect()}
    assert deps == {("c", "d", 40), ("a", "d", 40), ("a", "c", 31), ("b", "c", 31)}
    found = {(r.key_image, r.ancestor, r.depth) for r in graph.trace(cas.dependencies(result)).collect()}
    assert found == {("c", "d", 1), ("a", "d", 1), ("a", "c", 1), ("b", "c", 1), ("b", "d", 2)}
    assert result.passes == 2 and [(r.key_image, r.left) for r in result.live().collect()] == [("e", 2)]
    events, links = cas.events(result, 12)
    assert [r.key_image for r in events.orderBy("id").collect()] == ["d", "c", "a", "b"] and cas.broken(events, links, members).isEmpty()
    stored = events.select("key_image", "real_amount", "real_output_index", "resolved_at_pass", "confidence")
    whole = graph.trace_of(events, links, stored, "a")
    assert [e["key_image"] for e in whole["events"]] == ["a", "c", "d"] and whole["complete"] and not whole["truncated"] and whole["events"][0]["dependencies"] == [(6, 31, 2), (6, 40, 1)]
    short = graph.trace_of(events, links, stored, "a", 1)
    assert len(short["events"]) == 1 and short["truncated"] and not short["complete"]
    lost = graph.trace_of(events.where("key_image <> 'd'"), links, stored, "b")
    assert lost["missing"] == [1] and not lost["complete"] and graph.trace_of(events, links, stored, "e")["root"] is None
    # What is stated already is not appended; another basis is.
    assert cas.append_events(events, links, *cas.events(result, 13, after=4)).isEmpty()
    again = cas.append_events(events, links.where("event_id <> 4"), *cas.events(result, 13, after=4))
    assert [r.key_image for r in again.collect()] == ["b"] and cas.legacy(events, stored.union(stored.limit(1).selectExpr("'x'", "1L", "2L", "0", "1.0D"))).count() == 1
    bad = events.withColumn("method", F.when(F.col("key_image") == "c", "ml_prediction").otherwise(F.col("method")))
    assert {r.rule for r in cas.broken(bad, links, members).collect()} == {"method_and_confidence_differ"}
    assert {(r.id, r.rule) for r in cas.broken(events, links.where("event_id <> 3"), members).collect()} == {(3, "members_not_accounted_for")}


def test_taint_of_stored_hypotheses(spark):
    stored = spark.createDataFrame([("guess", 6, 70, -1, 0.97)], "key_image string, real_amount long, real_output_index long, resolved_at_pass int, confidence double")
    result = cas.cascade(rings(spark, {"guess": [(6, 70), (6, 71)], "p": [(6, 70), (6, 72)], "q": [(6, 72), (6, 73)], "sure": [(6, 99)]}), stored)
    found = claims(result)
    assert found["p"][2:] == found["q"][2:] == (-2, "soft_cascade") and found["sure"][3] == "ring_size_one"
    assert {r.key_image for r in result.resolved.where("pass >= 0").collect()} == {"sure"}


def test_two_singles_on_one_output_conflict_and_rings_can_empty(spark):
    members = rings(spark, {"a": [(0, 1)], "b": [(0, 1)], "c": [(0, 1), (0, 2)], "d": [(0, 2), (0, 1)]})
    result = cas.cascade(members)
    assert set(claims(result)) == {"a", "b", "c", "d"}
    told = spark.createDataFrame([], MEMBERS)
    named = result.resolved.select("key_image", "amount", "idx", "pass", F.lit(1.0).alias("confidence"))
    rows = evidence.rings(members, named, result.live(), told)
    assert {r.key_image for r in rows.where("conflict").collect()} == {"a", "b", "c", "d"}
    result = cas.cascade(rings(spark, {"a": [(0, 1)], "b": [(0, 2)], "e": [(0, 1), (0, 2)]}))
    assert [(r.n, r.left) for r in result.live().collect()] == [(2, 0)]
    assert result.passes == 1 and {r.source for r in cas.empty_rings(result).collect()} == {"a", "b"}
    assert {(r.kind, r["size"], r.rings) for r in summary.ring_sizes(result).collect()} == {("partial", 0, 1), ("effective", 0, 1), ("effective", 1, 2)}


def test_evidence_summary_keeps_categories_apart(spark):
    members = rings(spark, {"one": [(2, 5)], "two": [(2, 5), (2, 6)], "hyp": [(2, 50), (2, 51)], "less": [(2, 5), (2, 60), (2, 61)], "same": [(3, 7), (3, 8)], "out": [(4, 1), (4, 2)]})
    named = spark.createDataFrame([("one", 2, 5, 0, 1.0), ("two", 2, 6, 1, 1.0), ("hyp", 2, 50, -1, 1.0), ("gone", 9, 9, 0, 1.0), ("out", 4, 3, 1, 1.0)], "key_image string, amount long, idx long, pass int, confidence double")
    live = spark.createDataFrame([("less", 2), ("same", 2)], "key_image string, left long")
    told = spark.createDataFrame([("same", 3, 99)], MEMBERS)
    rows = evidence.rings(members, named, live, told)
    r = evidence.reconciles(evidence.summary(rows, members, named)).first()
    assert (r.total_rings, r.deterministic_resolutions, r.hypothesis_resolutions, r.unresolved_reduced, r.unresolved_unchanged, r.orphan_resolution_claims, r.conflict_rings) == (6, 3, 1, 1, 1, 1, 2)
    assert r.resolution_rate == "66.67%" and r.reconciles and {x.key_image for x in rows.where("conflict").collect()} == {"out", "same"}
    said = {(x.key_image, x.idx): (x.eliminated_by, x.state) for x in graph.explain(members, named).collect()}
    assert said["two", 5] == (["one"], "eliminated") and said["two", 6][1] == "remaining" and said["hyp", 51][1] == "remaining" and said["out", 1][1] == "remaining"
    why = {x.key_image: x.conflicts for x in graph.conflicts(graph.explain(members, named), members, named, told).collect()}
    assert why["out"] == ["resolution_outside_ring"] and why["same"] == ["prediction_outside_ring"] and why["two"] == []


def test_amount_is_part_of_identity(spark):
    result = cas.cascade(rings(spark, {"a": [(0, 1)], "b": [(5, 1), (5, 2)]}))
    assert set(claims(result)) == {"a"}


def test_empty_table(spark):
    result = cas.cascade(spark.createDataFrame([], MEMBERS))
    assert result.resolved.count() == result.eliminated.count() == result.passes == 0


def test_golden_counts_of_the_ring_view(spark):
    from evidara.ringview import rings as view

    result = cas.cascade(view(spark, "/root/testdata/sf0.001").members)
    assert result.resolved.count() == 140 and result.live().where("left = 0").count() == 2 and result.passes == 4


@pytest.mark.parametrize("part", [512, 2])
def test_related_counts_shared_outputs(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)
    spec = {f"r{i}": [(1, 100), (1, 100 + i), (2, 100 + i // 2)] for i in range(1, 9)}
    members = rings(spark, spec)
    want = sorted(((len(set(spec["r3"]) & set(v)), k) for k, v in spec.items() if k != "r3" and set(spec["r3"]) & set(v)), key=lambda x: (-x[0], x[1]))
    rows = [(r.shared, r.related) for r in graph.related(members).where("key_image = 'r3'").orderBy("rank").collect()]
    assert rows == want == [(r.shared, r.related) for r in graph.related_of(members, "r3").collect()]
    shared = {(r.left, r.right): r.shared for r in graph.pairs(members.where("amount = 1"), ["idx"], 3).collect()}
    assert len(shared) == 28 and set(shared.values()) == {1}


def test_components_join_through_bridges(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (10, 11), (7, 7)], "a long, b long")
    assert {(r.v, r.root) for r in graph.components(edges).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (10, 10), (11, 10), (7, 7)}


@pytest.mark.parametrize("kind, one_task", [("long", 1 << 20), ("long", 0), ("string", 0)])
def test_components_of_long_paths_with_random_ids(spark, monkeypatch, kind, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    ids = list(range(300))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (900, 900)], "a long, b long").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b")
    assert {(str(r.v), str(r.root)) for r in graph.components(edges).collect()} == {(str(i), "0") for i in ids} | {("900", "900")}
