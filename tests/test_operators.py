import json
import math

import pytest
from pyspark.sql import functions as F

from evidara.functions import analytics as an
from evidara.operators import baselines, eras, features, predict
from evidara.operators import cascade as cas
from evidara.plans import queries
from evidara.plans.lineage import cut
from evidara.sources import ingest, sinks
from evidara.streaming import live, pool


def test_manifest_must_be_contiguous(spark, tmp_path):
    good = '{"schema_version":1,"network":"mainnet","classification_basis":"mainnet_height_inferred","eras":[{"id":"a","start_height":0,"end_height":9,"versions":[1]},{"id":"b","start_height":10,"end_height":null,"versions":[2,3]}]}'
    bad = {
        "start": good.replace("10,", "11,"), "end": good.replace("null", "20"), "start ": good.replace('"start_height":0', '"start_height":false'), "versions": good.replace("[2,3]", "[2,2]"), "versions ": good.replace("[1]", "[]"), "versions  ": good.replace("[1]", "[1.0]"),
        "versions   ": good.replace("[1]", "[256]"), "id": good.replace('"id":"b"', '"id":"unknown"'), "id ": good.replace('"id":"b"', '"id":5'), "repeated": good.replace('"id":"b"', '"id":"a"'), "end ": good.replace('"end_height":9', '"end_height":"9"'),
    }
    heads = {"network": good.replace('mainnet"', 'testnet"'), "schema": good.replace(":1,", ":true,", 1), "basis": good.replace("inferred", "told"), "eras": good[: good.index("[")] + "[]}", "json": "{", "eras ": good[: good.index("[")] + '{"id":"a"}}'}
    rows, whole = eras.checked(spark.createDataFrame([*bad.items(), *heads.items(), ("good", good)], "source string, json string"))
    found = {}
    for r in rows.collect():
        found[r.source] = found.get(r.source, set()) | set(r.faults)
    faults = {r.source: r.faults for r in whole.collect()}
    assert faults.pop("good") == [] and found["good"] == set()
    assert all(k.strip() in found[k] and faults[k] == ["eras"] for k in bad)
    assert all(k.strip() in faults[k] for k in heads)
    (tmp_path / "good.json").write_text(good)
    (tmp_path / "label.json").write_text(good.replace('"id":"a"', '"label":"x", "id":"a"'))
    (tmp_path / "bad.json").write_text(bad["start"])
    (tmp_path / "raw.json").write_bytes(b"\xff")
    load = lambda name: eras.load_manifest(spark, f"{tmp_path}/{name}.json")
    one, other = load("good"), load("label")
    assert one["eras"] == (eras.Era("a", 0, 9, (1,)), eras.Era("b", 10, None, (2, 3))) and one["mapping_sha256"] == other["mapping_sha256"] and one["manifest_sha256"] != other["manifest_sha256"]
    assert [load(n)["unavailable_reason"] for n in ("bad", "raw", "none")] == ["manifest_invalid", "manifest_invalid", "manifest_unreadable"]


def test_era_boundaries(spark):
    rows = spark.createDataFrame([(0,), (11,), (12,), (None,), (-1,), (10**6,)], "height long").select("height", eras.era_of("height", eras.MONTH_ERAS).alias("e"))
    assert {r.height: r.e for r in rows.collect()} == {0: "first", 11: "first", 12: "second", None: None, -1: None, 10**6: "fifth"}


@pytest.mark.parametrize("reuse, want", [([1, 1, 1], [0.5, 0.5, 0.5]), ([2, 1, 2, 9], [0.5, 0.0, 0.5, 1.0])])
def test_midrank(spark, reuse, want):
    rows = spark.createDataFrame([("k", i, r) for i, r in enumerate(reuse)], "key_image string, idx long, reuse long")
    assert [r.midrank for r in features.midrank(rows).orderBy("idx").collect()] == want


def test_features_of_legacy_ring(spark):
    big = 2**53 + 1
    members = spark.createDataFrame([("k", big, 100), ("k", big, 200), ("k", big, 400)], "key_image string, amount long, idx long")
    context = spark.createDataFrame([("k", "t", 5)], "key_image string, tx_hash string, height long")
    rows = features.features(members, context).orderBy("idx").collect()
    assert [r.reuse_rank_in_ring for r in rows] == [0, 0.5, 1] and {r.gamma_recent_window for r in rows} == {1.0}
    assert all(math.isclose(r.gamma_decoy_log_likelihood, -7.495541943884256) for r in rows) and [r.amount_bucket_progress for r in rows] == [r.legacy_triangular_likelihood for r in rows]
    pairs = {tuple(r) for r in features.duplicate_columns(features.features(members, context)).collect()}
    assert ("legacy_triangular_likelihood", "amount_bucket_progress") in pairs


def test_profile_counts_missing_and_nonfinite(spark):
    rows = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 8.0), ("b", 4.0)], "key_image string, x double")
    r = features.profile(rows, ("x",)).first()
    assert (r.finite, r.missing, r.nonfinite, r.min, r.max, r.varying_rings) == (2, 1, 1, 4.0, 8.0, 1) and r.variance == 4.0


def test_exclusions_take_the_first_reason(spark):
    rows = {"ok": [(3, 1), (3, 2)], "one": [(3, 4)], "wrong": [(3, 5), (3, 6)], "both": [(3, 7), (4, 7)], "p": [(3, 8), (3, 9)], "q": [(3, 8), (3, 10)], "lost": [(3, 11), (3, 12)], "neg": [(3, -1), (3, 12)]}
    details = [(k, f"t{k}", 0, None if k == "lost" else 5, *o) for k, own in rows.items() for o in own] + [("two", "x", 0, 5, 3, 20), ("two", "y", 0, 5, 3, 21)]
    claims = [("ok", 3, 1), ("one", 3, 4), ("wrong", 3, 99), ("both", 3, 7), ("p", 3, 8), ("q", 3, 8), ("gone", 3, 50), ("lost", 3, 11), ("neg", 3, 12), ("two", 3, 20)]
    got = baselines.exclusions(spark.createDataFrame(details, "key_image string, tx_hash string, input_index int, height long, amount long, idx long"), spark.createDataFrame(claims, "key_image string, amount long, idx long"))
    want = {"ok": None, "one": "singleton", "wrong": "invalid_label", "both": "mixed_amount_buckets", "p": "conflicting_label", "q": "conflicting_label", "gone": "missing_members", "lost": "missing_context", "neg": "invalid_identity", "two": "conflicting_context"}
    assert {r.key_image: r.reason for r in got.collect()} == want


def test_tie_credit_is_exact_for_any_ring(spark):
    from fractions import Fraction

    rows = spark.createDataFrame([("uniform", 16, True), ("uniform", 16, True), ("uniform", 3, True), ("uniform", 33, False)], "baseline string, ties long, hit boolean")
    r = baselines.metrics(rows.withColumn("key_image", F.lit("k"))).first()
    assert baselines.credit(r.parts) == Fraction(2, 16) + Fraction(1, 3) and math.isclose(r.expected, 2 / 16 + 1 / 3) and (r.rings, r.contains, r.tied) == (4, 3, 4)


def test_quartiles_are_not_ntile(spark):
    rows = spark.createDataFrame([(i // 2, str(i)) for i in range(5)], "height long, key_image string")
    sizes = [r["count"] for r in baselines.quartiles(rows, ["height", "key_image"]).groupBy("quartile").count().orderBy("quartile").collect()]
    assert sizes == [2, 1, 1, 1]


def test_chronological_cutoff_keeps_the_boundary_block_together(spark):
    heights = [1, 2, 3, 4, 5, 6, 7, 9, 9, 10]
    rows = spark.createDataFrame([(str(i), h) for i, h in enumerate(heights)], "key_image string, height long")
    cutoff = baselines.chronological_cutoff(rows)
    assert cutoff.first()[0] == 9 and sorted(r.height for r in baselines.split(rows, cutoff).where("part = 'test'").collect()) == [9, 9, 10]


@pytest.mark.parametrize("per_range", [1_000_000, 7])
def test_sampling_keeps_both_budgets(spark, monkeypatch, per_range):
    import random

    monkeypatch.setattr(baselines.ranked, "__defaults__", (per_range, None))
    r = random.Random(5)
    for rings, candidates in ((11, 37), (100, 60), (3, 1000), (0, 5), (9, 0)):
        rows = [(f"ring{i:02d}", "abcd"[i % 4], r.choice([1, 2, 3, 5, 9, 17, 30])) for i in range(60)]
        sample = cut(baselines.bottom_k(spark.createDataFrame(rows, "key_image string, stratum string, candidates int"), "stratum", "key_image", 9), "sample")
        want, used = [], 0
        for row in sorted(sample.collect(), key=lambda x: (x["rank"], x.stratum, x.key_image)):
            if len(want) < rings and used + row.candidates <= candidates:
                want.append(row.key_image)
                used += row.candidates
        assert sorted(x.key_image for x in baselines.within_budgets(sample, rings, candidates).collect()) == sorted(want)


@pytest.mark.parametrize("per_range", [1_000_000, 50])
def test_ranks_over_a_hot_first_column(spark, per_range):
    rows = [(0 if i % 10 else i, i * 7 % 1000, None if i % 50 == 0 else i % 3) for i in range(1000)]
    got = baselines.ranked(spark.createDataFrame(rows, "a int, b int, c int").repartition(5), ["a", "b"], per_range, "b").collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.rank0)] == sorted(x[:2] for x in rows) and {x.total for x in got} == {1000}
    total = 0
    for x in sorted(got, key=lambda x: x.rank0):
        total += x.b
        assert x.upto == total


def test_wilson_and_bins(spark):
    low, high = an.wilson(F.col("h"), F.col("n"))
    rows = spark.createDataFrame([(5, 10), (0, 0), (5, 4)], "h long, n long").select(low.alias("l"), high.alias("u")).collect()
    assert math.isclose(rows[0].l, 0.236593090512564) and math.isclose(rows[0].u, 0.763406909487436) and rows[1].l is rows[2].u is None
    bins = [r.b for r in spark.createDataFrame([(0.0,), (0.1,), (0.99,), (1.0,), (None,)], "s double").select(an.score_bin(F.col("s")).alias("b")).collect()]
    assert bins == [0, 1, 9, 9, None]


def test_threshold_summary(spark):
    rows = spark.createDataFrame([(0.98, True, True), (0.96, True, False), (0.95, False, None), (0.4, False, None), (None, False, None)], "confidence double, verified boolean, correct boolean")
    r = an.summary(rows, 0.95).first()
    assert (r.total, r.retained, r.below, r.correct, r.wrong, r.pending, r.unknown_score) == (5, 3, 1, 1, 1, 1, 1)


def test_text_helpers(spark):
    odd = spark.createDataFrame([(5.0, 42.4, 185.0, 7260.0, 352_800.0, -1.0)], "a double, b double, c double, d double, e double, f double")
    assert list(odd.select(*(an.duration(F.col(c)) for c in odd.columns)).first()) == ["5.0 s", "42 s", "3m 5s", "2h 1m", "4d 2h", "Unknown"]
    urls = spark.createDataFrame([("http://u:p@Node.x:18/a?b",), ("https://h/",), ("ftp://h",), (None,)], "u string")
    assert [x.o for x in urls.select(an.origin(F.col("u")).alias("o")).collect()] == ["http://node.x:18", "https://h", None, None]
    fees = spark.createDataFrame([(str(2**64 - 1), 3), ("1", 1000), ("5", 0), (None, 1), ("0", 7)], "f string, w long").withColumn("f", F.col("f").cast("decimal(20,0)"))
    assert [x.d for x in fees.select(an.fee_density("f", "w").alias("d")).collect()] == ["6148914691236517205.00", "<0.01", None, None, "0.00"]
    r = spark.createDataFrame([("=1+1", 1234567890123456789, "  Ｆoo\tBAR ")], "a string, b long, c string").select(an.csv_safe(F.col("a")).alias("a"), an.decimal_places(F.col("b")).alias("b"), an.folded(F.col("c")).alias("c")).first()
    assert tuple(r) == ("'=1+1", "1234567.890123456789", "foo bar")


def test_flatten_makes_offsets_absolute(spark):
    body = '{"vin":[{"gen":{"height":1}},{"key":{"amount":7,"key_offsets":[3,5,2],"k_image":"k0"}}]}'
    rows = ingest.flatten(spark.createDataFrame([("t", body)], "tx_hash string, json string")).orderBy("position").collect()
    assert [(r.key_image, r.amount, r.global_output_index) for r in rows] == [("k0", 7, 3), ("k0", 7, 8), ("k0", 7, 10)]


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "height long, hash string")
    for _ in range(2):
        ingest.append_new(str(tmp_path / "t"), rows.union(spark.createDataFrame([(1, "A")], rows.schema)), ["height"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "A"), (2, "b")]


def test_block_checks(spark):
    good = "ab" * 32
    rows = spark.createDataFrame([(1, good, "x", 1_700_000_000), (2, "zz", good, 1_700_000_000), (3, good, good, None)], "height long, hash string, previous_hash string, timestamp long")
    ok, bad = ingest.validated(rows)
    assert ok.count() == 1 and {r.reason for r in bad.collect()} == {"hash", "timestamp"}
    chain = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (5, "e", "d"), (6, "f", "wrong")], "height long, hash string, previous_hash string")
    assert {tuple(r) for r in ingest.gaps(chain).collect()} == {(3, 4), (6, 5)} and not ingest.contiguous(chain)


def test_gaps_between_ranges_of_heights(spark):
    far = 10**10
    rows = [(99_998, "a", None), (100_001, "b", "x"), (199_999, "c", "x"), (200_000, "d", "c"), (299_999, "e", "x"), (300_000, "f", "wrong"), (950_000, "g", "x"), (far - 1, "h", "x"), (far, "i", "wrong"), (10**15, "j", "x"), (10**15, "j", "x")]
    found = ingest.gaps(spark.createDataFrame(rows, "height long, hash string, previous_hash string"))
    assert sorted(map(tuple, found.collect())) == [
        (99_999, 100_000), (100_002, 199_998), (200_001, 299_998), (300_000, 299_999), (300_001, 949_999), (950_001, far - 2), (far, far - 1), (far + 1, 10**15 - 1)
    ]
    assert ingest.gaps(spark.createDataFrame([], "height long, hash string, previous_hash string")).count() == 0


def test_publish_and_history(tmp_path):
    path = tmp_path / "x.json"
    sinks.publish(str(path), {"a": 1})
    with pytest.raises(ValueError):
        sinks.publish(str(path), {"a": float("nan")})
    assert path.read_text() == '{"a": 1}' and len(list(tmp_path.iterdir())) == 1
    one = sinks.grown([], {"generated_at": 1, "n": 5})
    assert len(sinks.grown(one, {"generated_at": 2, "n": 5})) == 1 and len(sinks.grown(one, {"generated_at": 2, "n": 6})) == 2


def test_rpc_retries_and_budget():
    from evidara.sources.rpc import BudgetExceeded, Client

    waits, calls = [], []

    def send(url, body, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise ConnectionError
        return b'{"result": {"count": 7, "status": "OK"}}'

    assert Client("http://n", send=send, sleep=waits.append).height() == 7 and waits == [1.0, 2.0]
    with pytest.raises(BudgetExceeded):
        Client("http://n", max_requests=0, send=send).height()
    answer = lambda body: Client("http://n", send=lambda *a: json.dumps(body).encode())
    for body in ({"txs": [{}]}, {"txs": [{"tx_hash": "a"}, {"tx_hash": "a"}]}, {"txs": [{"tx_hash": "a"}, {"tx_hash": "c"}]}):
        with pytest.raises(RuntimeError):
            answer(body).batched("get_transactions", "txs_hashes", ["a", "b"], 100)
    assert answer({"txs": [{"tx_hash": "b"}, {"tx_hash": "a"}]}).batched("get_transactions", "txs_hashes", ["a", "b"], 100) == [{"tx_hash": "a"}, {"tx_hash": "b"}]
    for count in (0, True, "7", None):
        with pytest.raises(RuntimeError):
            answer({"result": {"count": count}}).height()
    head = {"height": 3, "hash": "h", "timestamp": 5}
    assert answer({"result": {"block_header": head, "json": "{}"}}).block(3) == (3, "h", None, 5, "{}")
    for bad in (head | {"height": 4}, head | {"height": True}, head | {"hash": 1}, None):
        with pytest.raises(RuntimeError):
            answer({"result": {"block_header": bad, "json": "{}"}}).block(3)
    outs = [{"height": 1, "txid": "ab" * 32}, {"height": 2, "txid": "cd" * 32}]
    assert answer({"outs": outs}).outputs([(0, 5), (7, 1)]) == [(0, 5, 1, "ab" * 32), (7, 1, 2, "cd" * 32)]
    with pytest.raises(RuntimeError):
        answer({"outs": [outs[0], {"height": -1, "txid": "cd" * 32}]}).outputs([(0, 5), (7, 1)])


def test_live_cycle():
    first = live.cycle(100, None, limit=2)
    assert (first.start, first.end, first.target, first.behind) == (87, 88, 90, 2)
    assert (live.cycle(100, 88, limit=2).start, live.cycle(100, 88, limit=2).end) == (89, 90)
    assert live.cycle(1000, 88).skipped == (89, 870)


def polled(spark, state, n, at, ids, blocks=(), gap=None, **more):
    known = spark.createDataFrame(list(blocks), "id string, height long, observed double")
    return pool.step(state, {"poll_id": n, "seen": at, "monotonic_seen": at, "session": "s", "tip": 100} | more, spark.createDataFrame([(i,) for i in ids], "id string"), known, gap)


def test_pool_state_machine(spark):
    state = polled(spark, spark.createDataFrame([], pool.STATE), 1, 0.0, ["old"], gap="cold_start")
    state = polled(spark, state, 2, 60.0, ["old", "a", "c"])
    state = polled(spark, state, 3, 120.0, ["old"])
    assert {r.id: r.state for r in state.collect()} == {"old": "pending", "a": "disappeared", "c": "disappeared"}
    blocks = [("a", 101, 180.0), ("old", 101, 180.0)]
    state = polled(spark, state, 4, 180.0, ["b", "c"], blocks)
    rows = {r.id: r for r in state.collect()}
    assert rows["a"].state == "confirmed" and rows["a"].delay == 120.0 and rows["old"].state == "confirmed" and rows["old"].delay is None and rows["c"].reappearances == 1
    with pytest.raises(pool.Paused):
        polled(spark, state, 5, 240.0, ["a"])
    total = pool.consistent(pool.summary(state)).first()
    assert total.consistent and (total.tracked, total.eligible, total.excluded, total.bin1) == (4, 1, 1, 1)


def test_pool_gap_censors_and_retention_drops_what_is_settled(spark):
    state = polled(spark, spark.createDataFrame([], pool.STATE), 1, 0.0, ["a", "z"])
    state = polled(spark, state, 2, 900.0, ["a", "b"], gap="poll_gap")
    assert {r.id: (r.censored, r.cold, r.state) for r in state.collect()} == {"a": (True, False, "pending"), "b": (False, True, "pending"), "z": (True, False, "disappeared")}
    kept, gone = pool.pruned(state, 22_000.0)
    assert {r.id: r.state for r in kept.collect()} == {"a": "censored", "b": "pending", "z": "censored"} and gone.first().pruned == 0
    kept, gone = pool.pruned(kept, 86_401.0)
    assert {r.id: r.state for r in kept.collect()} == {"b": "censored"} and gone.first().pruned == 2
    few = pool.Settings(tracked=3)
    assert [r.id for r in pool.untracked(state.limit(2), spark.createDataFrame([("m",), ("n",)], "id string"), few).collect()] == ["n"]


def test_pool_snapshots_are_refused_as_a_whole(spark):
    good, big = "ab" * 32, str(2**64 - 1)
    entry = lambda **x: {"id_hash": good, "fee": 5, "weight": 7, "receive_time": 0} | x
    polls = [{"status": "OK"}, {"status": "OK", "transactions": [entry(fee=2**64 - 1)]}, {"status": "OK", "transactions": [entry(), entry(id_hash=good.upper())]}, {"status": "BUSY"}, {"status": "OK", "transactions": [entry(weight=0)]}, {"status": "OK", "transactions": [entry(), entry(id_hash="cd" * 32), entry(id_hash="ef" * 32)]}, {"status": "OK", "transactions": {}}]
    head, entries = pool.parsed(spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(polls)], "poll_id long, json string"), 2)
    assert {r.poll_id: r.reason for r in head.collect()} == {0: None, 1: None, 2: "repeated", 3: "status", 4: "entry", 5: "limit", 6: "list"}
    assert [(r.poll_id, str(r.fee), r.receive_time) for r in entries.collect()] == [(1, big, None)]
    assert pool.bracket({"height": 5, "hash": "A"}, {"height": 6, "hash": "b"}, "a") == 6
    for second, anchor in (({"height": 4, "hash": "a"}, None), ({"height": 5, "hash": "b"}, None), ({"height": 6, "hash": "b"}, "c")):
        with pytest.raises(pool.Paused):
            pool.bracket({"height": 5, "hash": "a"}, second, anchor)
    kinds = spark.createDataFrame([("error", None, True, 3), ("error", None, None, None), ("ok", None, False, 1), ("ok", None, True, 0), ("ok", None, None, None)], "state string, error_type string, pool_complete boolean, pool_count long")
    assert [r.k for r in kinds.select(pool.poll_kind().alias("k")).collect()] == ["followup_failed", "failed", "partial", "complete", "unknown"]
    assert [pool.job_state("observing", n, t, 9) for n, t in ((1, 9), (2, 8), (2, 9))] == ["warming_up", "warming_up", "observing"]


def test_pool_job_replays_to_the_same_state(spark, tmp_path):
    blocks = lambda s: s.createDataFrame([(11, 130.0, ["a"])], "height long, observed double, tx_hashes array<string>")
    job = pool.PoolJob(str(tmp_path), blocks, binding="public")
    kind = "poll_id long, seen double, monotonic_seen double, session string, tip long, txs array<string>"
    first = spark.createDataFrame([(1, 0.0, 0.0, "s", 10, []), (2, 60.0, 60.0, "s", 10, ["a", "b"])], kind)
    second = spark.createDataFrame([(3, 135.0, 135.0, "s", 11, ["b"])], kind)
    for _ in range(2):
        job(first, 0)
        job(second, 1)
    rows = {r.id: (r.state, r.delay) for r in job.state(spark, 1).collect()}
    assert rows == {"a": ("confirmed", 70.0), "b": ("pending", None)}
    job.restart(spark, 1)
    job(spark.createDataFrame([(4, 140.0, 140.0, "t", 11, ["b", "n"])], kind), 2)
    assert {r.id: (r.censored, r.cold, r.reason) for r in job.state(spark, 2).where("id <> 'a'").collect()} == {"b": (True, False, "observer_restart"), "n": (False, True, None)}
    with pytest.raises(ValueError):
        pool.PoolJob(str(tmp_path), blocks, binding="private")(second, 3)


def test_live_guards_and_histograms(spark):
    assert live.cycle(1000, 88, skipped_through=870).skipped is None and live.gap_rows(live.cycle(1000, 88), "t") == [(89, 870, "catchup_window_skipped", "t")]
    with pytest.raises(RuntimeError):
        live.cycle(50, 88)
    assert live.next_target(10, 100, 10, 20) == 30 and live.next_target(85, 100, 10, 20) == 89 and live.next_target(10, 100, 10, 20, most=15) == 15
    for bad in ({"progress": 100, "chain_count": 100}, {"progress": 0, "chain_count": True}, {"progress": 0, "chain_count": 9, "rings": 2_000_000}, {"progress": 0, "chain_count": 9, "free_gb": 0.5}):
        with pytest.raises((RuntimeError, ValueError)):
            live.next_target(confirmations=1, blocks=1, **bad)
    assert live.changed(5, "d", {"scan_end": 5, "dataset_id": "e"}) and not live.changed(5, "d", {"scan_end": 5, "dataset_id": "d"})
    blocks = spark.createDataFrame([(1, {2: 3, 5: 1}, 4, 11, "complete"), (2, {2: 1}, 2, 2, "complete"), (3, {}, None, None, "partial")], "height long, ring_sizes map<int,int>, ring_input_count int, ring_member_count int, detail_status string")
    assert {(r["size"], r.rings) for r in live.merged_histograms(blocks).collect()} == {(2, 4), (5, 1)} and {tuple(r) for r in live.unreconciled(blocks).collect()} == {(2, "inputs"), (3, "incomplete")}
    assert [r.height for r in live.retained(blocks, "height", 2).orderBy("height").collect()] == [2, 3]
    chain = spark.createDataFrame([(1, "a", None), (2, "b", "a")], "height long, hash string, previous_hash string")
    assert [r.height for r in live.reorganised(chain, spark.createDataFrame([(2, "x", "a"), (3, "c", "y")], "height long, hash string, previous_hash string")).orderBy("height").collect()] == [2, 3]


def test_predictions_are_verified_once(spark):
    picks = spark.createDataFrame([("k", 0, 7, 0.99)], "key_image string, amount long, idx long, score double")
    records = predict.save(picks, "r", "t")
    resolved = spark.createDataFrame([("k", 0, 7, 1)], "key_image string, amount long, idx long, pass int")
    found = predict.verify(records, records.where("false"), resolved)
    assert [r.correct for r in found.collect()] == [True] and predict.verify(records, found, resolved).count() == 0
    with pytest.raises(ValueError):
        predict.save(picks, "r", "t", 1.5)


def test_holdout_fits_the_whole_forest(spark, monkeypatch):
    asked = {}

    def forest(**params):
        asked.update(params)
        raise InterruptedError

    monkeypatch.setattr(predict, "RandomForestClassifier", forest)
    with pytest.raises(InterruptedError):
        queries.QUERIES["rf_holdout"](spark, "/root/testdata/sf0.001")
    assert (asked["numTrees"], asked["maxDepth"]) == (500, 30)


def test_forest_keeps_the_nodes_of_rows(spark, monkeypatch):
    asked, plain = [], predict.RandomForestClassifier
    rows = spark.range(400).selectExpr("id", "cast(id % 7 as double) as a", "cast(id * 37 % 101 as double) as b", "cast(id % 7 > 3 and id * 37 % 101 > 20 as double) as label")

    def scores(**other):
        monkeypatch.setattr(predict, "RandomForestClassifier", lambda **params: asked.append(params) or plain(**(params | other)))
        return [r.score for r in predict.forest(rows, trees=5, names=("a", "b"))(rows).orderBy("id").collect()]

    assert scores() == scores(cacheNodeIds=False) and len(asked) == 2 and all(p["cacheNodeIds"] for p in asked)


def test_only_known_rings_are_described(spark, monkeypatch):
    asked, plain = [], predict.features
    monkeypatch.setattr(predict, "features", lambda *a: asked.append(a[2]) or plain(*a))
    r = queries.rings(spark, "/root/testdata/sf0.001")
    result = cas.cascade(r.members, one_task=0)
    every = sorted(map(tuple, predict.labelled(features.features(r.members, r.context), result.resolved).collect()))
    for most in (cas.FRONTIER, 0):  # joined with and without a broadcast
        monkeypatch.setattr(predict, "FRONTIER", most)
        assert sorted(map(tuple, predict.known(r.members, r.context, result).collect())) == every
    assert asked[0].count() == asked[1].count() == len(every) < r.members.count()
    monkeypatch.setattr(cas, "FRONTIER", 0)
    again = cas.cascade(r.members, one_task=0)
    for a, b in ((result.resolved, again.resolved), (result.eliminated, again.eliminated)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
