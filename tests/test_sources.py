"""Sources: a node's blocks over several tasks, one budget for a scan, SQLite files with pushed filters."""

import http.server
import json
import os
import sqlite3
import threading

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidara.sources import rpc, sqlite


class Node(http.server.BaseHTTPRequestHandler):
    tip, asked = 1011, []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("get_outs"):
            answer = {"outs": [{"height": o["amount"] * 1000 + o["index"], "txid": f"{o['index']:064x}"} for o in body["outputs"]], "status": "OK"}
            Node.asked.append(("outs", len(body["outputs"])))
        elif body["method"] == "get_block_count":
            answer = {"result": {"count": Node.tip, "status": "OK"}}
        else:
            h = body["params"]["height"]
            Node.asked.append(("block", h))
            answer = {"result": {"block_header": {"height": h, "hash": f"{h:064x}", "prev_hash": f"{h - 1:064x}", "timestamp": 1_600_000_000 + h}, "json": "{}", "status": "OK"}}
        raw = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        pass


@pytest.fixture
def node():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Node.tip, Node.asked = 1011, []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def run(spark, node, path, seen, **options):
    def put(batch, number):
        rows = batch.withColumn("task", F.spark_partition_id()).collect()
        seen.setdefault(number, []).append(({r.height for r in rows}, len({r.task for r in rows})))
        if options.get("fail") == number:
            raise RuntimeError("lost")

    own = {k: str(v) for k, v in options.items() if k != "fail"}
    stream = spark.readStream.format("node_blocks").options(url=node, lag="10", per_partition="125", **own).load()
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_a_batch_of_blocks_runs_in_several_tasks(spark, node, tmp_path):
    spark.dataSource.register(rpc.NodeSource)
    seen = {}
    run(spark, node, tmp_path, seen, start=1, limit=1000)
    assert list(seen) == [0] and seen[0] == [(set(range(1, 1001)), 8)]
    Node.tip = 1012
    run(spark, node, tmp_path, seen)  # goes on from the checkpoint
    assert seen[1] == [({1001}, 1)] and [n for k, n in Node.asked if k == "block"].count(7) == 1


def test_a_failed_batch_reads_the_same_heights_again(spark, node, tmp_path):
    spark.dataSource.register(rpc.NodeSource)
    seen, cursor = {}, f"file://{tmp_path}/cursor"
    with pytest.raises(Exception, match="lost"):
        run(spark, node, tmp_path, seen, start=1, limit=300, cursor=cursor, fail=1)
    assert list(seen) == [0, 1]
    Node.tip = 2011
    run(spark, node, tmp_path, seen, limit=300, cursor=cursor)
    assert seen[1][0] == seen[1][1] and seen[1][0][0] == set(range(301, 601))
    assert set().union(*(x[-1][0] for x in seen.values())) == set(range(1, 2001))
    assert all(len(x[-1][0]) <= 300 for x in seen.values())  # the cursor bounds the first batch of a new run too


def test_one_budget_for_all_tasks_of_a_scan(spark, node):
    spark.dataSource.register(rpc.NodeSource)
    read = lambda **o: spark.read.format("node_blocks").options(url=node, start="0", end="99", per_partition="10", **o).load()
    assert read(max_requests="100").count() == 100
    for short in ({"max_requests": "90"}, {"max_bytes": "2000"}, {"budget_seconds": "0"}):
        with pytest.raises(Exception, match="BudgetExceeded"):
            read(**short).count()
    Node.asked = []
    with pytest.raises(Exception, match="BudgetExceeded"):
        read(max_requests="50").count()
    assert len(Node.asked) <= 50
    parts = rpc.dealt({"per_partition": "30"}, 10, 100)
    assert [(p.start, p.end) for p in parts] == [(10, 40), (40, 70), (70, 100)] and sum(p.share for p in parts) == pytest.approx(1)
    assert rpc.dealt({}, 5, 5) == []


def test_origins_are_looked_up_once_in_batches(spark, node):
    rows = [(a, i) for a in range(3) for i in range(200)] * 2 + [(None, 1)]
    got = rpc.origins(spark.createDataFrame(rows, "amount int, idx int"), {"url": node, "max_requests": "40"}, tasks=4, size=50).collect()
    assert sorted((r.amount, r.idx) for r in got) == sorted(set(rows[:-1])) and all(r.height == r.amount * 1000 + r.idx and int(r.txid, 16) == r.idx for r in got)
    assert sum(n for k, n in Node.asked if k == "outs") == 600 and max(n for _, n in Node.asked) == 50
    with pytest.raises(Exception, match="BudgetExceeded"):
        rpc.origins(spark.createDataFrame(rows, "amount int, idx int"), {"url": node, "max_requests": "4"}, tasks=4, size=50).collect()


@pytest.fixture
def store(tmp_path):
    path = f"{tmp_path}/store.db"
    own = sqlite3.connect(path)
    own.execute("CREATE TABLE ring_members (id INTEGER PRIMARY KEY AUTOINCREMENT, tx_hash TEXT NOT NULL, input_index INTEGER, key_image TEXT, amount INTEGER DEFAULT 0, global_output_index INTEGER, price REAL, body BLOB, odd DECIMAL(10,2), loose)")
    own.execute("CREATE TABLE transactions (tx_hash TEXT PRIMARY KEY, block_height INTEGER) WITHOUT ROWID")
    own.execute("CREATE TABLE empty (a INTEGER)")
    own.execute('CREATE TABLE "odd ""name" ("a b" INTEGER)')
    rows = [(f"t{i % 7}", i % 3, None if i % 11 == 0 else f"k{i % 50}", i % 4, i * i, i / 3, bytes([i % 256]), i, str(i)) for i in range(1000)]
    own.executemany("INSERT INTO ring_members(tx_hash,input_index,key_image,amount,global_output_index,price,body,odd,loose) VALUES (?,?,?,?,?,?,?,?,?)", rows)
    own.execute("DELETE FROM ring_members WHERE id BETWEEN 300 AND 420")  # a hole in the row ids
    own.executemany("INSERT INTO transactions VALUES (?,?)", [(f"t{i}", 100 + i) for i in range(7)])
    own.execute('INSERT INTO "odd ""name" VALUES (5)')
    own.execute("CREATE VIEW seen AS SELECT key_image, amount FROM ring_members")
    own.commit()
    own.close()
    return path, [(n + 1, *r) for n, r in enumerate(rows) if not 300 <= n + 1 <= 420]


def test_sqlite_rows_equal_the_table(spark, store):
    path, rows = store
    frame = sqlite.table(spark, path, "ring_members", rows_per_partition=100)
    assert frame.dtypes == [("id", "bigint"), ("tx_hash", "string"), ("input_index", "bigint"), ("key_image", "string"), ("amount", "bigint"), ("global_output_index", "bigint"), ("price", "double"), ("body", "binary"), ("odd", "string"), ("loose", "string")]
    assert frame.rdd.getNumPartitions() == 10 and frame.count() == len(rows)
    got = sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in frame.collect())
    assert got == [(*r[:8], str(r[8]), r[9]) for r in rows]
    members, txs = sqlite.rings(spark, path)
    assert members.columns == ["tx_hash", "input_index", "key_image", "amount", "idx"]
    assert members.join(txs, "tx_hash").groupBy("block_height").count().count() == 7
    assert sqlite.table(spark, path, "empty").count() == 0 and sqlite.table(spark, path, "seen").count() == len(rows)
    assert [tuple(r) for r in sqlite.table(spark, path, 'odd "name').collect()] == [(5,)]
    with pytest.raises(Exception, match="no table"):
        sqlite.table(spark, path, "none").count()
    before = os.path.getmtime(path)
    with pytest.raises(sqlite3.OperationalError, match="readonly"):
        sqlite.opened(path).execute("DELETE FROM ring_members")
    assert os.path.getmtime(path) == before


@pytest.mark.parametrize("where", ["amount = 2", "amount > 1 AND tx_hash = 't3'", "key_image IS NULL", "key_image IS NOT NULL AND price <= 50.5", "tx_hash IN ('t1', 't2') OR amount = 0", "tx_hash IN ('t1', 't2')", "NOT amount = 2", "key_image LIKE 'k1%'", "odd > '5'", "loose = '17'", "amount <=> 2", "tx_hash > 'T9' AND id < 50", "amount = 2.5"])
def test_pushed_filters_lose_nothing(spark, store, where):
    path, rows = store
    spark.createDataFrame([(*r[:7], bytearray(r[7]), str(r[8]), r[9]) for r in rows], sqlite.table(spark, path, "ring_members").schema).createOrReplaceTempView("plain")
    want = sorted(r.id for r in spark.sql(f"SELECT id FROM plain WHERE {where}").collect())
    assert want and sorted(r.id for r in sqlite.table(spark, path, "ring_members").where(where).select("id").collect()) == want or where == "amount = 2.5" and not want


def test_filters_and_columns_are_in_the_query(store):
    path, _ = store
    reader = sqlite.Reader({"path": path, "table": "ring_members", "rows_per_partition": "400"}, StructType.fromDDL("key_image string, amount long, odd string"))
    asked = [ds.EqualTo(("amount",), 2), ds.In(("key_image",), ("k1", "k2")), ds.EqualTo(("odd",), "5"), ds.GreaterThan(("amount",), "x"), ds.Not(ds.IsNull(("amount",)))]
    assert list(reader.pushFilters(asked)) == asked
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(1, 400), (401, 800), (801, 1000)]
    sql, values = reader.sql(parts[1])
    assert sql == 'SELECT "key_image", "amount", "odd" FROM "ring_members" WHERE (rowid BETWEEN ? AND ?) AND ("amount" COLLATE BINARY = ?) AND ("key_image" COLLATE BINARY IN (?, ?)) AND ("amount" IS NOT NULL)'
    assert values == [401, 800, 2, "k1", "k2"]


def test_sqlite_refuses_values_of_another_type(spark, store):
    path, _ = store
    own = sqlite3.connect(path)
    own.execute("INSERT INTO transactions VALUES ('bad', 'high')")
    own.commit()
    with pytest.raises(Exception, match="holds 'high'"):
        sqlite.table(spark, path, "transactions").collect()


def test_sqlite_files_of_tasks_make_one_table(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"é{i}", i / 2, bytes([i]), i % 2 == 0) for i in range(200)]
    frame = spark.createDataFrame(rows, "a long, b string, c double, d binary, e boolean").repartition(3)
    sqlite.write(frame, f"file://{tmp_path}/parts", "t")
    sqlite.write(frame, f"file://{tmp_path}/parts", "t")  # once more gives the same files
    assert sorted(os.listdir(f"{tmp_path}/parts")) == [f"part-{i:06d}.db" for i in range(3)]
    got = sqlite.table(spark, f"file://{tmp_path}/parts", "t", "a long, b string, c double, d binary, e boolean", 50).collect()
    assert sorted((r.a, r.b, r.c, bytes(r.d), r.e) for r in got) == rows
    with pytest.raises(Exception, match="can't be written"):
        sqlite.write(spark.createDataFrame([(1, [2])], "a long, b array<long>"), f"{tmp_path}/x", "t")
