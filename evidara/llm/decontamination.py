"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by document: each row is one shard of a few MB of text with its sorted terms, their posting
offsets and their positions. Nothing is shuffled to build it, no shard depends on how often a term or a source occurs,
and it is stored as a table that can be searched again. A search intersects, for each test window, the posting lists
shifted by the term's place in the window, from the shard's rarest term on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import ALNUM, column, groups, in_arrow, shared_dir, utf8, words, written

#: Words in a test window.
WINDOW = 10
#: Empty positions between documents; more than a window and twice a slop together reach.
GAP = 256
#: Test text (UTF-8 bytes) that one search broadcasts; more is searched in several blocks.
BLOCK_BYTES = 16 << 20
#: Postings that are held against a window's other terms at once.
PIECE = 1 << 20
INDEX = "shard long, doc_ids binary, id_nulls binary, starts binary, sizes binary, terms binary, offsets binary, positions binary"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of every word `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of whole A-Z lower-cased texts, as a stored table.

    A null text has no words; repeated rows and null keys are separate documents; key must be an integer column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8(column(batch, "t"))
            keys = column(batch, "k")
            for i, j in groups(offsets):
                hashes, firsts = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                sizes = np.diff(firsts)
                starts = firsts[:-1] + GAP * np.arange(j - i)
                places = np.arange(len(hashes)) + np.repeat(GAP * np.arange(j - i), sizes)
                order = np.argsort(hashes, kind="stable")
                terms, first = np.unique(hashes[order], return_index=True)
                ids = keys.slice(i, j - i)
                parts = [np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()), starts.astype(np.int64), sizes.astype(np.int64), terms, np.append(first, len(hashes)).astype(np.int32), places[order].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], [x.split()[0] for x in INDEX.split(", ")])
                shard += 1

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return written(in_arrow(rows, run, INDEX), "positions")


class Windows:
    """The distinct test windows: rows of term numbers (-1: none), how long each is, and whose it is."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        hashes, firsts = words(data, offsets, ALNUM)
        self.terms, codes = np.unique(hashes, return_inverse=True)
        sizes = np.diff(firsts)
        n = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
        owner = np.repeat(np.arange(len(sizes)), n)
        at = firsts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        places = at[:, None] + np.arange(window)
        rows = np.where(places < firsts[owner + 1][:, None], np.r_[codes, 0][np.minimum(places, len(codes))], -1).astype(np.int32)
        self.rows, kind = np.unique(rows, axis=0, return_inverse=True)
        whose = np.unique(np.column_stack((kind.ravel(), owner)), axis=0)
        self.owner = whose[:, 1]
        self.owners = np.searchsorted(whose[:, 0], np.arange(len(self.rows) + 1))
        self.lengths = (self.rows >= 0).sum(1)
        self.names = [x for x, _ in items]


def matches(shard: dict[str, np.ndarray], test: Windows, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Window, first and last position of each match in a shard, in pieces that start from PIECE postings or one window.

    With slop 0 a match is the exact phrase. Else each term may stand up to slop words before or after its place.
    """
    terms, offsets, positions = shard["terms"], shard["offsets"].astype(np.int64), shard["positions"]
    if not len(terms) or not len(test.rows):
        return
    at = np.minimum(np.searchsorted(terms, test.terms), len(terms) - 1)
    known = terms[at] == test.terms
    count = np.where(known, offsets[at + 1] - offsets[at], 0)
    often = np.where(test.rows >= 0, count[test.rows], np.iinfo(np.int64).max)
    alive = np.flatnonzero(often.min(1) > 0)
    if not len(alive):
        return
    rows, often = test.rows[alive].astype(np.int64), often[alive]
    order = np.argsort(often, 1, kind="stable")
    rarest = rows[np.arange(len(alive)), order[:, 0]]
    used = np.unique(rows[rows >= 0])  # all postings of the test terms that live windows use, by term and position
    m = count[used]
    keys = (np.repeat(used, m) << 32) + positions[np.repeat(offsets[at[used]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
    upto = np.cumsum(count[rarest])
    a = 0
    while a < len(alive):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PIECE, "right")))
        n = count[rarest[a:z]]
        which = np.repeat(np.arange(a, z), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = last = positions[np.repeat(offsets[at[rarest[a:z]]], n) + inside].astype(np.int64)
        place = first - order[which, 0]
        for k in range(1, test.rows.shape[1]):
            there = order[which, k]
            term = rows[which, there]
            need = term >= 0
            target = (term << 32) + place + there
            near = np.searchsorted(keys, target - slop)
            found = keys[np.minimum(near, len(keys) - 1)]
            ok = ~need | ((near < len(keys)) & (found <= target + slop) & (found >= target - slop) & (place + there >= 0))
            if slop:
                seen = np.where(need, found - (term << 32), first)
                first, last = np.minimum(first, seen)[ok], np.maximum(last, seen)[ok]
            which, place = which[ok], place[ok]
            if not len(which):
                break
        if len(which):
            if not slop:
                first, last = place, place + test.lengths[alive[which]] - 1
            yield alive[which], first, last
        a = z


def joined(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of positions, each once, put together where they meet; those of two documents never do."""
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    begin = np.flatnonzero(np.r_[True, first[1:] > stop[:-1]]) if len(first) else np.zeros(0, np.int64)
    return first[begin], stop[np.r_[begin[1:], len(first)] - 1] if len(first) else stop


def _hits(index: DataFrame, block: list[tuple[str | None, str | None]], window: int, slop: int, only: bool) -> DataFrame:
    """shard, row, k, n of each document (only: of those hit) with its hit spans and the names of its items."""
    sent = index.sparkSession.sparkContext.broadcast(Windows(block, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda name, kind: np.frombuffer(column(batch, name)[row].as_buffer(), kind)  # noqa: E731, B023
                shard = {"terms": at("terms", np.uint64), "offsets": at("offsets", np.int32), "positions": at("positions", np.int32)}
                starts, sizes = at("starts", np.int64), at("sizes", np.int64)
                pairs, first, stop = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                for which, a, z in matches(shard, test, slop):
                    doc = np.searchsorted(starts, a, "right") - 1
                    pairs = np.unique(np.r_[pairs, np.column_stack((doc, which))], axis=0)
                    first, stop = joined(np.r_[first, a], np.r_[stop, z + 1])
                names: dict[int, set[str]] = {}
                for d, w in pairs.tolist():
                    names.setdefault(d, set()).update(test.names[o] for o in test.owner[test.owners[w] : test.owners[w + 1]].tolist() if test.names[o] is not None)
                spans: dict[int, list[int]] = {}
                for a, z, d in zip(first.tolist(), stop.tolist(), (np.searchsorted(starts, first, "right") - 1).tolist(), strict=True):
                    spans.setdefault(d, []).extend((a - int(starts[d]), z - int(starts[d])))
                docs = np.array(sorted(spans), np.int64) if only else np.arange(len(starts))
                ids = pa.array(at("doc_ids", np.int64)[docs], mask=at("id_nulls", bool)[docs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([column(batch, "shard")[row].as_py()] * len(docs), pa.int64()), pa.array(docs), ids, pa.array(sizes[docs]),
                        pa.array([spans.get(d) for d in docs.tolist()], pa.list_(pa.int64())), pa.array([sorted(names[d]) if names.get(d) else None for d in docs.tolist()], pa.list_(pa.string())),
                    ],
                    ["shard", "row", "k", "n", "spans", "items"],
                )

    return in_arrow(index, run, "shard long, row long, k long, n long, spans array<long>, items array<string>")


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One document's spans of all blocks, at most as many as blocks hold them."""
    ends = [np.array([x for s in rows["spans"] if s is not None for x in s[side::2]], np.int64) for side in (0, 1)]
    spans = np.column_stack(joined(*ends)).ravel()
    return rows.head(1).assign(spans=[spans], items=[sorted({x for s in rows["items"] if s is not None for x in s})])


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """For each document: key, n_words, n_hit (words inside any match), n_items, items_sha256, contaminated.

    An item is matched by windows of so many consecutive words; one of fewer words, but not none, is one window; null
    texts have none. Items with a null id count as hits, but not among the items; equal ids count once. An empty items
    table hits nothing. slop > 0 makes it a proximity search; window and twice slop together must stay below GAP, as
    documents of a shard lie so far apart. Equal windows are searched once, whoever's they are.

    Test text is dealt by a hash into blocks of about BLOCK_BYTES. One block at a time is broadcast; of several, each
    block's hits are written before the next is read, and its broadcast goes.
    """
    if window + 2 * slop >= GAP:
        raise ValueError(f"window and twice slop must be below {GAP}")
    asked = items.select(F.col(item).cast("string").alias("name"), F.col(text).cast("string").alias("body")).where("body is not null")
    size = asked.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks == 1:
        found = _hits(index, [tuple(r) for r in asked.collect()], window, slop, False)
    else:
        asked = written(asked.withColumn("block", F.pmod(F.xxhash64("name", "body"), F.lit(blocks))).repartition("block"), "items")
        path = shared_dir(index.sparkSession, "hits")
        for block in range(blocks):
            part = _hits(index, [tuple(r) for r in asked.where(F.col("block") == block).select("name", "body").collect()], window, slop, block > 0)
            part.write.parquet(f"{path}/block={block}")
        found = index.sparkSession.read.schema(part.schema).parquet(*(f"{path}/block={block}" for block in range(blocks)))
        found = found.groupBy("shard", "row").applyInPandas(_merged, found.schema)
    spans, names = F.coalesce("spans", F.array().cast("array<long>")), F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("k").alias(key), F.col("n").alias("n_words"), n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """search() over a fresh index of docs."""
    return search(build_index(docs, key, text), items, key=key, text=text)
