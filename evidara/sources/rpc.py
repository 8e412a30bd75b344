"""A JSON-RPC node as a Spark data source: blocks by height in batch, and heights as a stream.

Options: url; start, end (batch); per_partition (heights that one task reads); retries (1, 2, 4 s apart, on connection errors
and time-outs only); lag, initial, limit, cursor (stream: blocks behind the tip, blocks to begin with, blocks of one batch, and a
folder that remembers where it was). budget_seconds, max_requests and max_bytes hold for a whole scan or batch: its tasks
have one deadline, and each has its share of the requests and bytes.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "height long, hash string, previous_hash string, timestamp long, json string"


class BudgetExceeded(RuntimeError):
    pass


def post(url: str, body: bytes, timeout: float) -> bytes:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


@dataclass
class Client:
    """Requests within a budget of time, number and bytes."""

    url: str
    budget_seconds: float = 300.0
    max_requests: int = 10_000
    max_bytes: int = 1 << 30
    retries: int = 3
    send: Callable[[str, bytes, float], bytes] = post
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    began: float = field(default=-1.0)
    requests: int = 0
    received: int = 0

    def call(self, path: str, payload: dict) -> dict:
        self.began = self.clock() if self.began < 0 else self.began
        for attempt in range(self.retries + 1):
            left = self.budget_seconds - (self.clock() - self.began)
            if left <= 0 or self.requests >= self.max_requests:
                raise BudgetExceeded(path)
            self.requests += 1
            try:
                raw = self.send(f"{self.url.rstrip('/')}/{path}", json.dumps(payload).encode(), min(30.0, left))
                break
            except urllib.error.HTTPError:
                raise
            except (urllib.error.URLError, ConnectionError, TimeoutError):
                if attempt == self.retries:
                    raise
                self.sleep(2.0**attempt)
        self.received += len(raw)
        if self.received > self.max_bytes:
            raise BudgetExceeded("bytes")
        answer = json.loads(raw)
        result = answer.get("result", answer)
        if "error" in answer or result.get("status", "OK") != "OK":
            raise RuntimeError(f"node refused {path}: {answer.get('error') or result.get('status')}")
        return result

    def height(self) -> int:
        count = self.call("json_rpc", {"jsonrpc": "2.0", "id": "0", "method": "get_block_count"}).get("count")
        if type(count) is not int or count <= 0:
            raise RuntimeError(f"the node's count of blocks is {count!r}")
        return count

    def block(self, height: int) -> tuple:
        found = self.call("json_rpc", {"jsonrpc": "2.0", "id": "0", "method": "get_block", "params": {"height": height}})
        head, body = found.get("block_header"), found.get("json")
        if not isinstance(head, dict) or type(head.get("height")) is not int or head["height"] != height:
            raise RuntimeError(f"asked for {height}, got {head.get('height') if isinstance(head, dict) else head!r}")
        if not isinstance(head.get("hash"), str) or type(head.get("timestamp")) is not int or not isinstance(body, str):
            raise RuntimeError(f"the header or body of block {height} is not what a node gives")
        return height, head["hash"], head.get("prev_hash"), head["timestamp"], body

    def batched(self, path: str, name: str, keys: list, size: int, **more: object) -> list[dict]:
        """Look-ups in batches; every key must be answered, in order, and transactions by their own hash."""
        out: list[dict] = []
        for i in range(0, len(keys), size):
            part = keys[i : i + size]
            found = self.call(path, {name: part} | more)
            rows = found.get("txs") or found.get("outs") or []
            if not isinstance(rows, list) or len(rows) != len(part) or found.get("missed_tx") or any(not isinstance(r, dict) for r in rows):
                raise RuntimeError(f"{path}: {len(rows)} of {len(part)} answered")
            if name == "txs_hashes":
                own = {r.get("tx_hash"): r for r in rows}
                if own.keys() != set(part):
                    raise RuntimeError(f"{path}: answers and hashes don't match")
                rows = [own[h] for h in part]
            out += rows
        return out

    def outputs(self, identities: list[tuple[int, int]], size: int = 1000) -> list[tuple[int, int, int, str]]:
        """(amount, index, height, txid) of outputs, matched by their place in the answer."""
        rows = self.batched("get_outs", "outputs", [{"amount": a, "index": i} for a, i in identities], size, get_txid=True)
        out = []
        for (amount, index), row in zip(identities, rows, strict=True):
            height, txid = row.get("height"), row.get("txid")
            if type(height) is not int or height < 0 or not isinstance(txid, str) or len(txid) != 64 or any(c not in "0123456789abcdefABCDEF" for c in txid):
                raise RuntimeError(f"output {amount}:{index} lacks a height or a transaction")
            out.append((amount, index, height, txid))
        return out

    def transactions(self, height: int, hashes: list[str]) -> Iterator[tuple[str, int, int, int, str]]:
        """(tx_hash, block_height, num_inputs, num_outputs, json) of a block's transactions, all of them, or an error."""
        if any(not isinstance(h, str) or not h for h in hashes) or len(set(hashes)) != len(hashes):
            raise RuntimeError(f"transaction hashes of block {height}")
        found = self.batched("get_transactions", "txs_hashes", hashes, 100, decode_as_json=True)
        if {tx.get("tx_hash") for tx in found} != set(hashes):
            raise RuntimeError(f"transactions of block {height} don't match")
        for tx in found:
            if tx.get("in_pool") or tx.get("block_height", height) != height:
                raise RuntimeError(f"transaction {tx['tx_hash']} is not of block {height}")
            body = json.loads(tx["as_json"])
            keys = [i["key"] for i in body["vin"] if "key" in i]
            for key in keys:
                numbers = [key["amount"], *key["key_offsets"]]
                if not key["k_image"] or not key["key_offsets"] or any(type(x) is not int or x < 0 for x in numbers):
                    raise RuntimeError(f"ring input of transaction {tx['tx_hash']}")
            yield tx["tx_hash"], height, len(keys), len(body["vout"]), tx["as_json"]


LIMITS = {"budget_seconds": 300.0, "max_requests": 10_000, "max_bytes": 1 << 30}


def limits(options: dict) -> dict:
    o = {k.lower(): v for k, v in options.items()}
    return {k: type(d)(o.get(k, d)) for k, d in LIMITS.items()}


def client(options: dict, share: float = 1.0, deadline: float | None = None) -> Client:
    """With a share of the requests and bytes (one request at least), and until a deadline on the wall clock, where one is set."""
    o, most = {k.lower(): v for k, v in options.items()}, limits(options)
    seconds = most["budget_seconds"] if deadline is None else deadline - time.time()
    return Client(o["url"], seconds, max(1, int(most["max_requests"] * share)), max(1, int(most["max_bytes"] * share)), int(o.get("retries", 3)))


class Heights(InputPartition):
    """Heights from start to before end, with this share of the scan's budget, until its deadline."""

    def __init__(self, start: int, end: int, share: float, deadline: float):
        self.start, self.end, self.share, self.deadline = start, end, share, deadline


def dealt(options: dict, start: int, end: int) -> list[Heights]:
    """Heights from start to before end, dealt out to tasks; their shares make up one budget."""
    step, deadline = int(options.get("per_partition", 100)), time.time() + limits(options)["budget_seconds"]
    if step < 1:
        raise ValueError("per_partition must be 1 or more")
    return [Heights(a, min(a + step, end), (min(a + step, end) - a) / (end - start), deadline) for a in range(start, end, step)]


def fetched(options: dict, part: Heights) -> Iterator[tuple]:
    node = client(options, part.share, part.deadline)
    for height in range(part.start, part.end):
        yield node.block(height)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Heights]:
        return dealt(self.options, int(self.options.get("start", 0)), int(self.options.get("end", -1)) + 1)

    def read(self, partition: Heights) -> Iterator[tuple]:
        return fetched(self.options, partition)


class Stream(DataSourceStreamReader):
    """Confirmed heights as offsets. The driver asks for the tip alone; tasks fetch the blocks, so a batch is spread over the
    executors, and a batch that runs again fetches the same heights again.

    With a cursor folder a batch has at most limit heights: Spark doesn't say where a query stands when it asks how far there is
    data, so the reader keeps the end of each batch that it plans there. Without it the first batch of a run goes up to the tip.
    """

    def __init__(self, options: dict):
        self.options = options
        self.at = self._remembered()

    def _target(self) -> int:
        """The height after the last one that is confirmed."""
        return max(0, client(self.options).height() - int(self.options.get("lag", 10)))

    def _cursor(self) -> tuple[fs.FileSystem, str] | None:
        folder = self.options.get("cursor")
        return fs.FileSystem.from_uri(folder) if folder else None

    def _remembered(self) -> int | None:
        where = self._cursor()
        if where is None or where[0].get_file_info(f"{where[1]}/height").type != fs.FileType.File:
            return None
        with where[0].open_input_stream(f"{where[1]}/height") as file:
            return int(file.read())

    def initialOffset(self) -> dict:
        start = self.options.get("start")
        self.at = max(0, self._target() - int(self.options.get("initial", 4))) if start is None else int(start)
        return {"height": self.at}

    def latestOffset(self) -> dict:
        target = self._target()
        if self.at is None and self.options.get("cursor"):  # a new query
            self.initialOffset()
        if self.at is not None:
            target = max(self.at, min(target, self.at + int(self.options.get("limit", 1000))))
        return {"height": target}

    def partitions(self, start: dict, end: dict) -> list[Heights]:
        self.at, where = end["height"], self._cursor()
        if where is not None:
            where[0].create_dir(where[1], recursive=True)
            with where[0].open_output_stream(f"{where[1]}/_height") as file:
                file.write(str(self.at).encode())
            where[0].move(f"{where[1]}/_height", f"{where[1]}/height")
        return dealt(self.options, start["height"], self.at)

    def read(self, partition: Heights) -> Iterator[tuple]:
        return fetched(self.options, partition)


def origins(outputs: DataFrame, options: dict, tasks: int = 8, size: int = 1000) -> DataFrame:
    """Outputs (amount, idx) -> (amount, idx, height, txid), looked up once each in batches of so many.

    Tasks deal with the outputs by a hash; they have one deadline, and each an equal share of the scan's requests and bytes.
    An output that the node doesn't answer fails the scan. Nulls are left out.
    """
    deadline = time.time() + limits(options)["budget_seconds"]
    asked = outputs.select(F.col("amount").cast("long").alias("amount"), F.col("idx").cast("long").alias("idx")).dropna().distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = client(options, 1 / tasks, deadline), []

        def found() -> pa.RecordBatch:
            columns = zip(*node.outputs(held, size), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], ["amount", "idx", "height", "txid"])

        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(pair)
                if len(held) == size:
                    yield found()
                    held = []
        if held:
            yield found()

    dealt = asked.repartition(tasks, F.xxhash64("amount", "idx"))  # by the columns themselves the shuffle of distinct would serve, which may be coalesced
    return dealt.mapInArrow(run, "amount long, idx long, height long, txid string")


class NodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "node_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Stream(self.options)
