"""Quantiles and interval joins against numpy and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.operators import ranges


@pytest.mark.parametrize("small", [100_000, 40])
def test_quantiles_equal_numpy(spark, monkeypatch, small):
    monkeypatch.setattr(ranges, "SMALL", small)
    r = np.random.default_rng(2)
    groups = {"even": r.normal(size=700).tolist(), "ties": r.integers(0, 3, 500).astype(float).tolist(), "one": [7.5], "far": [1e300, -1e300, *r.exponential(size=300).tolist()], "same": [2.0] * 400, "two": [1.0, 2.0]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("even", None), ("none", None), ("even", float("nan"))]
    frame = spark.createDataFrame(rows, "kind string, x double").repartition(3)
    asked = {"low": 0.0, "q": 0.25, "median": 0.5, "p90": 0.9, "top": 1.0}
    got = {row.kind: row for row in ranges.quantiles(frame, "x", asked, ["kind"]).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g].n == len(own)
        assert [got[g][k] for k in asked] == pytest.approx([float(np.quantile(own, f)) for f in asked.values()], rel=1e-12, abs=1e-12)


def test_quantiles_of_a_whole_table(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SMALL", 1000)
    rows = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("x"))
    got = ranges.quantiles(rows, "x", {"a": 0.1, "b": 0.999}).first()
    want = np.quantile(np.array([r.x for r in rows.collect()]), [0.1, 0.999])
    assert (got.n, got.a, got.b) == (200_000, pytest.approx(want[0]), pytest.approx(want[1]))
    assert [tuple(r) for r in ranges.quantiles(rows.limit(0), "x", {"a": 0.5}).collect()] == [(0, None)]
    with pytest.raises(ValueError, match="from 0 to 1"):
        ranges.quantiles(rows, "x", {"a": 1.5})


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_equals_brute_force(spark, how):
    r = random.Random(3)
    spans = [(i, s, s + r.choice([0, 1, 3, 50, 900, 100_000])) for i in range(120) for s in [r.randrange(-500, 3000)]]
    spans += [(200, 0, None), (201, None, 5), (202, 10, 9), (203, -(2**40), 2**40), (204, 2900, None), (205, 0, 0), (206, 0, 0)]
    points = [(i, r.randrange(-600, 4000)) for i in range(150)] + [(500, None), (501, 2**41), (502, -(2**41)), (503, 0), (503, 0)]
    got = ranges.interval_join(spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(spans, "i long, a long, z long"), "at", "a", "z", how)
    assert got.columns == ["p", "at", "i", "a", "z"]
    want = [(p, at, *s) for p, at in points for s in spans if at is not None and s[1] is not None and s[1] <= at and (s[2] is None or at <= s[2])]
    if how == "left":
        want += [(p, at, None, None, None) for p, at in points if not any((p, at) == w[:2] for w in want)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_interval_join_has_no_nested_loop(spark):
    points, spans = spark.range(1000).select(F.col("id").alias("at")), spark.range(10).select(F.col("id").alias("a"), (F.col("id") + 5).alias("z"))
    joined = ranges.interval_join(points, spans, "at", "a", "z")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and joined.count() == 60
    none = ranges.interval_join(points, spans.limit(0), "at", "a", "z", "left")
    assert none.count() == 1000 and none.where("a is not null").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        ranges.interval_join(points, points, "at", "at", "at")
