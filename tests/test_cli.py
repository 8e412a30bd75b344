import http.server
import json
import threading

import pytest

from evidara import cli
from evidara.sources import sinks


@pytest.fixture
def data(spark, tmp_path):
    rings = {"seed": [1], "middle": [1, 2], "end": [1, 2, 3], "open": [3, 4, 5]}
    rows = [(f"t{k}", 0, k, 0, i) for k, own in rings.items() for i in own]
    spark.createDataFrame(rows, "tx_hash string, input_index int, key_image string, amount long, global_output_index long").write.parquet(str(tmp_path / "ring_members.parquet"))
    spark.createDataFrame([(f"t{k}", 10, 1, 2) for k in rings], "tx_hash string, block_height long, num_inputs int, num_outputs int").write.parquet(str(tmp_path / "transactions.parquet"))
    return str(tmp_path)


def ask(spark, *argv):
    return cli.run(spark, cli.parser().parse_args(argv))


def test_commands(spark, data, tmp_path):
    assert ask(spark, "status", "--data", data) == {"memberships": 9, "rings": 4, "predictions": 0, "scan_end": 10, "events": 0}
    first = ask(spark, "analyze", "--data", data)
    assert (first["passes"], first["total_rings"], first["new_events"], first["resolution_rate"]) == (2, 4, 3, "75.00%")
    assert first["categories"] == {"deterministic_single": 1, "deterministic_multi": 2, "reduced": 1} and first["ring_sizes"] == {"partial": {2: 1}, "effective": {1: 3, 2: 1}}
    assert ask(spark, "analyze", "--data", data)["new_events"] == 0
    assert [r["related"] for r in ask(spark, "brain", "--data", data, "related", "end")] == ["middle", "open", "seed"]
    found = ask(spark, "brain", "--data", data, "trace", "end")
    assert [e["key_image"] for e in found["events"]] == ["end", "seed", "middle"] and found["complete"]
    told = ask(spark, "brain", "--data", data, "explain", "end")
    assert [(c["idx"], c["eliminated_by"], c["state"]) for c in told["candidates"]] == [(1, ["seed"], "eliminated"), (2, ["middle"], "eliminated"), (3, [], "remaining")] and told["remaining"] == 1 and told["conflicts"] == []
    assert ask(spark, "brain", "--data", data, "summary")["deterministic"] == 3
    with pytest.raises(KeyError):
        ask(spark, "brain", "--data", data, "recall", "none")
    out = tmp_path / "x.json"
    ask(spark, "export", "--data", data, "--out", str(out))
    document = json.loads(out.read_text())
    assert document["unresolved"] == [{"key_image": "open", "remaining_candidates": [["0", "4"], ["0", "5"]], "original_size": 3, "current_size": 2}] and len(document["resolved_spends"]) == 3


def test_predictions_are_kept_shown_and_verified_once(spark, data, tmp_path):
    assert ask(spark, "predict", "--data", data)["predictions"] == 0  # too few rings to learn from
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{data}/{name}.parquet")
    put("prediction_records", [(1, "r", "end", 0, 3, 0.99, True, 3, "t1"), (2, "r", "open", 0, 4, 0.7, False, 3, "t2"), (3, "r", "middle", 0, 1, 0.98, True, 2, "t3")], cli.RECORDS)
    put("prediction_candidates", [(1, 0, i, s) for i, s in ((1, 0.2), (2, 0.4), (3, 0.99))], cli.CANDIDATES)
    put("prediction_runs", [("r", "t", None, 5, None, None, None, None, "{}")], cli.RUNS)
    ask(spark, "analyze", "--data", data)
    for _ in range(2):
        assert ask(spark, "verify", "--data", data) == {"total": 2, "verified": 2, "correct_n": 1, "wrong": 1, "unverified": 0, "accuracy": "50.0%"}
    assert spark.read.parquet(f"{data}/prediction_verifications.parquet").where("event_id is not null").count() == 2
    out = tmp_path / "viz.json"
    for _ in range(2):
        ask(spark, "export-viz", "--data", data, "--out", str(out), "--limit", "2")
    shown = json.loads(out.read_text())
    assert shown["summary"]["total_rings"] == 4 and shown["summary"]["unresolved_reduced"] == 1 and all(shown["protocol_eras"]["reconciliation"].values()) and len(shown["history"]) == 1
    rows = shown["prediction_browser"]["rows"]
    assert [r["id"] for r in rows] == ["3", "2"] and shown["prediction_browser"]["total"] == 3 and rows[0]["evidence"]["remaining_candidate_count"] == 1 and rows[0]["timing"] == "later_scan"


def test_bounds():
    for argv in (["predict", "--data", "x", "--confidence", "2"], ["brain", "--data", "x", "related", "k", "--limit", "0"], ["fly"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(argv)


class Node(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/get_transactions":
            ring = {"vin": [{"key": {"amount": 0, "key_offsets": [5, 2, 0], "k_image": "k"}}, {"gen": {}}], "vout": [{"amount": 0}, {"amount": 0}]}
            answer = {"status": "OK", "txs": [{"tx_hash": h, "block_height": int(h[1:]), "as_json": json.dumps(ring | {"vin": [{"key": ring["vin"][0]["key"] | {"k_image": "k" + h}}, {"gen": {}}]})} for h in asked["txs_hashes"]]}
        elif asked["method"] == "get_block_count":
            answer = {"result": {"count": 5}}
        else:
            height = asked["params"]["height"]
            answer = {"result": {"block_header": {"height": height, "hash": f"{height:064x}", "timestamp": 1_500_000_000}, "json": json.dumps({"tx_hashes": [f"t{height}"] if height else []})}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


def test_scan_stores_transactions_and_rings(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert ask(spark, "scan", "--data", str(tmp_path), "--url", url, "--end", "1") == {"scanned": 2, "rejected": 0, "start": 0}
    assert ask(spark, "scan", "--data", str(tmp_path), "--url", url, "--end", "2") == {"scanned": 1, "rejected": 0, "start": 2}
    assert ask(spark, "scan", "--data", str(tmp_path), "--url", url, "--end", "2")["scanned"] == 0
    assert ask(spark, "scan", "--data", str(tmp_path), "--url", url, "--start", "0", "--end", "2")["scanned"] == 3  # adds nothing
    out = str(tmp_path / "shown.json")
    grown = [ask(spark, "collect", "--data", str(tmp_path), "--url", url, "--out", out, "--confirmations", "1", "--blocks", "9", *more) for more in ((), (), ("--max-height", "3"))]
    assert [(g["state"], g["scanned_height"], g["cycles"]) for g in grown] == [("caught_up", 3, 1), ("caught_up", 3, 1), ("height_limit_reached", 3, 1)]
    assert json.loads(open(out).read())["collection"]["blocks_behind"] == 1 and ask(spark, "status", "--data", str(tmp_path))["rings"] == 3
    with sinks.one_writer(str(tmp_path)), pytest.raises(RuntimeError):
        ask(spark, "collect", "--data", str(tmp_path), "--url", url, "--out", out)
    server.shutdown()
    read = lambda name, *columns: sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).select(*columns or "*").collect()))
    assert read("transactions.parquet", "tx_hash", "block_height", "num_inputs", "num_outputs") == [(f"t{i}", i, 1, 2) for i in (1, 2, 3)] and len(read("blocks.parquet")) == 4
    assert read("ring_members.parquet", "tx_hash", "input_index", "key_image", "amount", "position", "global_output_index") == [(t, 0, "k" + t, 0, p, i) for t in ("t1", "t2", "t3") for p, i in enumerate((5, 7, 7))]
