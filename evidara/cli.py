"""The command line: python -m evidara.cli COMMAND --data FOLDER. Tables are Parquet below the folder."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators import cascade as cas
from evidara.operators import eras, evidence, features, graph, history, predict, summary
from evidara.operators.baselines import ranked
from evidara.plans.lineage import cut
from evidara.ringview import membership
from evidara.sources import artifacts, ingest, rpc, sinks
from evidara.streaming import live


def _share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("must be in [0, 1]")
    return value


def _count(most: int):
    def parse(text: str) -> int:
        value = int(text)
        if not 1 <= value <= most:
            raise argparse.ArgumentTypeError(f"must be in 1..{most}")
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="evidara")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "analyze", "predict", "export", "verify", "diagnose", "export-viz", "status", "brain", "collect"):
        sub = commands.add_parser(name)
        sub.add_argument("--data", required=True)
        if name == "scan":
            sub.add_argument("--url", required=True)
            sub.add_argument("--start", type=int, default=None, help="the first height; else the one after the last stored block")
            sub.add_argument("--end", type=int, required=True)
        if name in ("analyze", "predict", "verify"):
            sub.add_argument("--max-passes", type=_count(100_000), default=100)
        if name in ("predict", "export-viz"):
            sub.add_argument("--confidence", type=_share, default=0.95)
        if name in ("export", "export-viz"):
            sub.add_argument("--out", required=True)
        if name == "collect":
            sub.add_argument("--url", required=True)
            sub.add_argument("--out", required=True)
            sub.add_argument("--blocks", type=_count(100_000), default=1000)
            sub.add_argument("--confirmations", type=int, default=10)
            sub.add_argument("--max-height", type=int, default=None)
            sub.add_argument("--prediction-every", type=int, default=6)
            sub.add_argument("--confidence", type=_share, default=0.95)
            sub.add_argument("--max-passes", type=_count(100_000), default=100)
        if name in ("export-viz", "collect"):
            sub.add_argument("--manifest", default=None)
            sub.add_argument("--limit", type=_count(1000), default=200)
        if name == "brain":
            sub.add_argument("question", choices=("recall", "related", "explain", "trace", "summary"))
            sub.add_argument("key_image", nargs="?")
            sub.add_argument("--limit", type=_count(1000), default=20)
    return top


EVENTS = "id long, key_image string, real_amount long, real_output_index long, resolved_at_pass int, confidence double, method string, scan_height long"
LINKS = "event_id long, eliminated_amount long, eliminated_output_index long, source_event_id long"
CLAIMS = "key_image string, amount long, idx long, pass int, confidence double"
RECORDS = "prediction_id long, run_id string, key_image string, predicted_amount long, predicted_idx long, confidence double, accepted boolean, original_ring_size long, created_at string"
RUNS = "run_id string, created_at string, dataset_id string, scan_height long, origin string, feature_version string, artifact_sha256 string, source_sha256 string, metadata_json string"
CANDIDATES = "prediction_id long, amount long, idx long, score double"
VERIFICATIONS = "verification_id long, prediction_id long, correct boolean, scan_height long, provenance string, actual_amount long, actual_idx long, event_id long"
#: Items of an exported array at most (fixed values).
LISTED = 128


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def has(self, name: str) -> bool:
        return ingest.exists(self.spark, f"{self.path}/{name}.parquet")

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet") if schema is None or self.has(name) else self.spark.createDataFrame([], schema)

    def members(self) -> DataFrame:
        return membership(self.read("ring_members"))

    def details(self) -> DataFrame:
        heights = self.read("transactions").select("tx_hash", F.col("block_height").alias("height"))
        return self.read("ring_members").join(heights, "tx_hash", "left").select("key_image", "tx_hash", "input_index", "height", "amount", F.col("global_output_index").alias("idx"))

    def context(self) -> DataFrame:
        return self.details().groupBy("key_image").agg(F.min("tx_hash").alias("tx_hash"), F.when(F.count_distinct("height") == 1, F.min("height")).alias("height"))

    def height(self) -> int | None:
        """The last stored block's height, or the last transaction's where no blocks are stored."""
        rows = self.read("blocks").select("height") if self.has("blocks") else self.read("transactions").select(F.col("block_height").alias("height"))
        return rows.agg(F.max("height")).first()[0]

    def claims(self, result: cas.Cascade) -> DataFrame:
        return result.resolved.select("key_image", "amount", "idx", "pass", F.lit(1.0).alias("confidence"))

    def predictions(self) -> DataFrame:
        return history.current(self.read("prediction_records", RECORDS)).select("key_image", F.col("predicted_amount").alias("amount"), F.col("predicted_idx").alias("idx"))

    def append(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        ingest.append_new(f"{self.path}/{name}.parquet", rows, keys)

    def next_id(self, name: str, column: str, schema: str) -> int:
        return (self.read(name, schema).agg(F.max(column)).first()[0] or 0) + 1


def scan(store: Store, args: argparse.Namespace) -> dict:
    """Blocks from the one after the last stored one; members first and blocks last, so that a stored block has all its rows and
    a scan that failed goes on where it did."""
    spark = store.spark
    start = args.start if args.start is not None else store.height() + 1 if store.has("blocks") else 0
    if start > args.end:
        return {"scanned": 0, "rejected": 0, "start": start}
    if store.has("blocks") and not ingest.contiguous(store.read("blocks")):
        raise RuntimeError("the stored scan has gaps in its heights")
    spark.dataSource.register(rpc.NodeSource)
    rows = cut(spark.read.format("node_blocks").options(url=args.url, start=str(start), end=str(args.end)).load(), "blocks")
    good, bad = ingest.validated(rows)
    found = cut(ingest.transactions(good, {"url": args.url}), "transactions")
    store.append("ring_members", ingest.flatten(found), ["tx_hash", "input_index", "position"])
    store.append("transactions", found.drop("json"), ["tx_hash"])
    store.append("blocks", good, ["height"])
    return {"scanned": args.end - start + 1, "rejected": bad.count(), "start": start}


def analyze(store: Store, result: cas.Cascade, members: DataFrame) -> dict:
    """Records what the analysis found as events, those that aren't stated yet, and gives its totals."""
    old, links = store.read("resolution_events", EVENTS), store.read("resolution_dependencies", LINKS)
    found, found_links = cas.events(result, store.height(), store.next_id("resolution_events", "id", EVENTS) - 1)
    new = cut(cas.append_events(old, links, found, found_links), "events")
    store.append("resolution_dependencies", found_links.join(new.select(F.col("id").alias("event_id")), "event_id", "left_semi").select("event_id", "eliminated_amount", "eliminated_output_index", "source_event_id"), ["event_id", "eliminated_amount", "eliminated_output_index", "source_event_id"])
    store.append("resolution_events", new, ["id"])
    sizes: dict = {}
    for r in summary.ring_sizes(result).collect():
        sizes.setdefault(r["kind"], {})[r["size"]] = r["rings"]
    total, resolved = result.sizes.count(), result.resolved.count()
    return {"passes": result.passes, "total_rings": total, "fully_resolved": resolved, "resolution_rate": f"{100 * resolved / total:.2f}%" if total else "N/A", "categories": {r.category: r.rings for r in summary.reduction_categories(result).collect()}, "ring_sizes": sizes, "new_events": new.count()}


def predict_rings(store: Store, result: cas.Cascade, members: DataFrame, threshold: float) -> dict:
    """Scores every candidate of the unresolved rings and stores the run, its records, accepted or not, and all candidates."""
    gone = result.eliminated.select("key_image", "amount", "idx")
    live = members.join(result.resolved.select("key_image"), "key_image", "left_anti").join(gone, ["key_image", "amount", "idx"], "left_anti")
    known = cut(predict.known(members, store.context(), result), "labelled")
    if known.select("key_image").distinct().limit(10).count() < 10:
        return {"predictions": 0, "reason": "fewer than ten rings to learn from"}
    scored = cut(predict.forest(known)(features.features(members, store.context(), live)).select("key_image", "amount", "idx", "score"), "scored")
    stamp = store.spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")").first()[0]
    first = store.next_id("prediction_records", "prediction_id", RECORDS)
    numbered = ranked(predict.argmax(scored), ["key_image"]).withColumn("prediction_id", F.col("rank0") + first)
    saved = predict.save(numbered, stamp, stamp, threshold).join(numbered.select("key_image", "prediction_id"), "key_image").join(result.sizes, "key_image")
    records = cut(saved.select("prediction_id", "run_id", "key_image", "predicted_amount", "predicted_idx", "confidence", "accepted", F.col("n").alias("original_ring_size"), "created_at"), "records")
    candidates = scored.join(records.select("key_image", "prediction_id"), "key_image").select("prediction_id", "amount", "idx", "score")
    faults = history.checked(records, candidates).where("rule is not null").count()
    if faults:
        raise RuntimeError(f"{faults} predictions break a rule")
    meta = artifacts.run_metadata({"threshold": threshold, "trees": 500}, features.FEATURES)
    run = store.spark.createDataFrame([(stamp, stamp, None, store.height(), meta["origin"], meta["feature_version"], None, None, json.dumps(meta, sort_keys=True))], RUNS)
    for name, rows, keys in (("prediction_candidates", candidates, ["prediction_id", "amount", "idx"]), ("prediction_records", records, ["prediction_id"]), ("prediction_runs", run, ["run_id"])):
        store.append(name, rows, keys)
    return {"predictions": records.count(), "accepted": records.where("accepted").count(), "run_id": stamp}


def verify(store: Store, result: cas.Cascade) -> dict:
    """Every accepted prediction without a verification is held against the deterministic claims, once."""
    records, kept = store.read("prediction_records", RECORDS), store.read("prediction_verifications", VERIFICATIONS)
    claims = history.claim_events(store.claims(result), store.read("resolution_events", EVENTS))
    found = history.open_records(records, kept).join(claims.select("key_image", "amount", "idx", "event_id"), "key_image")
    numbered = ranked(found, ["prediction_id"]).withColumn("verification_id", F.col("rank0") + store.next_id("prediction_verifications", "verification_id", VERIFICATIONS))
    right = (F.col("amount") == F.col("predicted_amount")) & (F.col("idx") == F.col("predicted_idx"))
    store.append("prediction_verifications", numbered.select("verification_id", "prediction_id", right.alias("correct"), F.lit(store.height()).cast("long").alias("scan_height"), F.lit("deterministic_resolution").alias("provenance"), F.col("amount").alias("actual_amount"), F.col("idx").alias("actual_idx"), "event_id"), ["prediction_id"])
    last = cas.latest(store.read("prediction_verifications", VERIFICATIONS), ["prediction_id"], "verification_id").select("prediction_id", "correct")
    return predict.stats(history.current(records).join(last, "prediction_id", "left")).first().asDict()


def document(store: Store, result: cas.Cascade, members: DataFrame) -> dict:
    """The analysis as a document: totals, all resolved rings, the first thousand unresolved ones."""
    left = members.join(result.live().where("left > 1").select("key_image"), "key_image", "left_semi").join(result.eliminated.select("key_image", "amount", "idx"), ["key_image", "amount", "idx"], "left_anti")
    rows = sinks.unresolved_report(left).join(result.sizes, "key_image").orderBy("key_image")
    listed = [{"key_image": r.key_image, "remaining_candidates": [[str(v) for v in c] for c in r.candidates], "original_size": r.n, "current_size": len(r.candidates)} for r in rows.collect()]
    resolved = [{"key_image": r.key_image, "real_amount": str(r.amount), "real_output_index": str(r.idx)} for r in result.resolved.orderBy("key_image").toLocalIterator()]
    return {"schema_version": 2, "passes": result.passes, "summary": {r.category: r.rings for r in summary.reduction_categories(result).collect()}, "resolved_spends": resolved, "unresolved": listed}


def dashboard(store: Store, result: cas.Cascade, members: DataFrame, args: argparse.Namespace) -> dict:
    """The evidence summary, its eras with their reconciliation, and the newest predictions with bounded evidence."""
    claims, told = store.claims(result), store.predictions()
    rows = cut(evidence.rings(members, claims, result.live(), told), "rings")
    totals = evidence.summary(rows, members, claims)
    mapping = eras.load_manifest(members.sparkSession, args.manifest) if args.manifest else {"status": "available", "eras": eras.NETWORK_ERAS, "mapping_sha256": eras.fingerprint(eras.NETWORK_ERAS), "unavailable_reason": None}
    placed = evidence.eras_of_rings(store.details(), mapping["eras"])
    heights = store.read("transactions").select(F.col("block_height").alias("height"))
    blocks = store.read("blocks").select("height") if store.has("blocks") else heights.distinct()
    roll = cut(evidence.era_roll(placed, rows, blocks, heights, members, claims, mapping["eras"], True), "roll")
    checks = evidence.reconciliation(roll, totals).where("summary_total is not null")
    page = cut(history.page(history.rows(store.read("prediction_records", RECORDS), store.read("prediction_runs", RUNS), store.read("prediction_verifications", VERIFICATIONS)), args.limit), "page")
    asked = page.select("key_image").distinct()
    explained = cut(graph.explain(members, claims, asked), "explained")
    why = {r.key_image: r for r in graph.conflicts(explained, members.join(asked, "key_image", "left_semi"), claims.join(asked, "key_image", "left_semi"), told.join(asked, "key_image", "left_semi")).collect()}
    near: dict = {}
    for r in graph.related(members, 11, asked).orderBy("key_image", "rank").collect():
        near.setdefault(r.key_image, []).append({"key_image": r.related, "shared": r.shared})
    scores: dict = {}
    best, count, more = sinks.bounded("c", LISTED)
    listed = store.read("prediction_candidates", CANDIDATES).join(page.select("prediction_id"), "prediction_id", "left_semi").groupBy("prediction_id").agg(F.collect_list(F.struct((-F.col("score")).alias("order"), "amount", "idx", "score")).alias("c")).select("prediction_id", best.alias("c"), count.alias("n"), more.alias("more"))
    for r in listed.collect():
        scores[r.prediction_id] = {"candidates": [{"amount": str(c["amount"]), "index": str(c["idx"]), "score": c["score"]} for c in r.c], "candidates_total": r.n, "candidates_truncated": r.more}
    out = []
    for r in sinks.exact_ids(page.withColumn("id", F.col("prediction_id").cast("string"))).collect():
        row, key = r.asDict(), r["key_image"]
        said = why.get(key)
        row |= scores.get(int(r["id"]), {"candidates": [], "candidates_total": 0, "candidates_truncated": False})
        row["evidence"] = None if said is None else {"candidate_count": said.candidates, "remaining_candidate_count": said.remaining, "conflicts": said.conflicts, "related_rings": near.get(key, [])[:10], "related_rings_truncated": len(near.get(key, [])) > 10}
        out.append(row)
    total = {k: v for k, v in totals.first().asDict().items()}
    entry = {"generated_at": store.spark.sql("SELECT current_timestamp()").first()[0].isoformat(), "scan_end": store.height(), "total_rings": total["total_rings"], "fully_resolved": total["fully_resolved"]}
    try:
        with open(args.out, encoding="utf-8") as f:
            before = json.load(f).get("history", [])
    except (OSError, ValueError):
        before = []
    return {
        "schema_version": 2, "scope": {"scan_end": entry["scan_end"], "generated_at": entry["generated_at"]}, "summary": total, "passes": result.passes,
        "protocol_eras": {"status": mapping["status"], "unavailable_reason": mapping["unavailable_reason"], "mapping_sha256": mapping["mapping_sha256"], "rows": [r.asDict() for r in roll.collect()], "coverage": evidence.coverage(roll).first().asDict(), "unknown_reasons": {r["reason"]: r["count"] for r in placed.where("reason is not null").groupBy("reason").count().collect()}, "reconciliation": {r["field"]: r["matches"] for r in checks.collect()}},
        "prediction_browser": {"total": store.read("prediction_records", RECORDS).count(), "exported": len(out), "order": "newest_first", "rows": out, "runs": [r.asDict() for r in history.run_counts(store.read("prediction_records", RECORDS), store.read("prediction_runs", RUNS)).drop("metadata_json").collect()]},
        "history": sinks.grown(before, entry),
    }


def answer(store: Store, result: cas.Cascade, members: DataFrame, args: argparse.Namespace) -> object:
    """A question about one ring, or all."""
    if args.question == "summary":
        return summary.brain_summary(members, store.context(), result.resolved).first().asDict() | {"predictions": store.predictions().count()}
    key, claims = args.key_image, store.claims(result)
    if members.where(F.col("key_image") == key).isEmpty():
        raise KeyError(f"unknown ring: {key}")
    only = store.spark.createDataFrame([(key,)], "key_image string")
    if args.question == "trace":
        named = claims.select("key_image", F.col("amount").alias("real_amount"), F.col("idx").alias("real_output_index"), F.col("pass").alias("resolved_at_pass"), "confidence")
        if store.has("resolution_events"):
            return graph.trace_of(store.read("resolution_events", EVENTS), store.read("resolution_dependencies", LINKS), named, key, args.limit)
        return graph.trace_of(*cas.events(result), named, key, args.limit)
    if args.question == "explain":
        told = store.predictions().join(only, "key_image", "left_semi")
        rows = cut(graph.explain(members, claims, only), "explained")
        why = graph.conflicts(rows, members.join(only, "key_image", "left_semi"), claims.join(only, "key_image", "left_semi"), told).first()
        return {"candidates": [r.asDict() for r in rows.orderBy("amount", "idx").collect()], "remaining": why.remaining, "conflicts": why.conflicts}
    rows = {"recall": lambda: graph.recall(members, store.context(), result.resolved, key), "related": lambda: graph.related_of(members, key, args.limit)}[args.question]()
    return [r.asDict(recursive=True) for r in rows.collect()]


def collect(store: Store, args: argparse.Namespace) -> dict:
    """One cycle: scan as far as is safe, and if that brought something new, analyse, verify, score every so many cycles, and
    export. The first cycle's export and the count of cycles are in the exported document."""
    node = rpc.client({"url": args.url})
    progress = store.height() if store.has("blocks") else -1
    rings = store.members().select("key_image").distinct().count() if store.has("ring_members") else 0
    free = shutil.disk_usage(args.data if os.path.isdir(args.data) else os.path.dirname(os.path.abspath(args.out))).free / 1e9
    height = node.height()
    target = live.next_target(progress, height, args.confirmations, args.blocks, args.max_height, rings, free_gb=free)
    if progress >= 0:
        known = store.read("blocks").where(F.col("height") == progress).first()["hash"]
        if node.block(progress)[1] != known:
            raise RuntimeError("the stored tip is not on the node's chain: nothing goes on before someone has looked")
    if target > progress:
        scan(store, argparse.Namespace(start=progress + 1, end=target, url=args.url))
    latest = store.height() if store.has("blocks") else -1
    state = "caught_up" if latest >= height - 1 - args.confirmations else "collecting"
    try:
        with open(args.out, encoding="utf-8") as f:
            old = json.load(f)
    except (OSError, ValueError):
        old = {}
    cycles = old.get("collection", {}).get("cycles", 0)
    if store.has("ring_members") and live.changed(latest, args.data, old.get("scope", {})):
        members = store.members()
        result = cas.cascade(members, None, args.max_passes)
        analyze(store, result, members)
        verify(store, result)
        cycles += 1
        if args.prediction_every and cycles % args.prediction_every == 0:
            predict_rings(store, result, members, args.confidence)
        shown = dashboard(store, result, members, args)
        shown["scope"]["dataset_id"] = args.data
        shown["collection"] = {"cycles": cycles, "chain_tip": height - 1, "confirmation_lag": args.confirmations, "blocks_behind": max(0, height - 1 - latest)}
        sinks.publish(args.out, shown)
    return {"state": "height_limit_reached" if args.max_height is not None and latest >= args.max_height else state, "scanned_height": latest, "cycles": cycles}


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    store = Store(spark, args.data)
    if args.command == "collect":
        with sinks.one_writer(args.data):
            return collect(store, args)
    if args.command == "scan":
        return scan(store, args)
    members = store.members()
    if args.command == "status":
        return {"memberships": members.count(), "rings": members.select("key_image").distinct().count(), "predictions": store.read("prediction_records", RECORDS).count(), "scan_end": store.height(), "events": store.read("resolution_events", EVENTS).count()}
    result = cas.cascade(members, None, getattr(args, "max_passes", 100))
    if args.command == "analyze":
        return analyze(store, result, members)
    if args.command == "diagnose":
        return [r.asDict() for r in cas.empty_rings(result).orderBy("key_image", "idx").limit(1000).collect()]
    if args.command == "predict":
        return predict_rings(store, result, members, args.confidence)
    if args.command == "verify":
        return verify(store, result)
    if args.command in ("export", "export-viz"):
        sinks.publish(args.out, document(store, result, members) if args.command == "export" else dashboard(store, result, members, args))
        return {"written": args.out}
    return answer(store, result, members, args)


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("evidara").getOrCreate()
    json.dump(run(spark, args), sys.stdout, default=str, sort_keys=True)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
