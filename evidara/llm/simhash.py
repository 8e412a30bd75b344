"""SimHash near-duplicates by exact comparison of tiles.

A document's fingerprint has a bit for each of 64 that is set in over half of its shingles' hashes. Distinct fingerprints
lie in tiles by their population count. Two fingerprints within the radius have population counts that differ by no more
than it, so only tiles of such counts meet; all others are skipped before anything is read. A pair of tiles is compared
whole by numpy exclusive-or and bit counts, and gives a spanning forest of its links, never more edges than fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import apart, column, in_arrow, integral, utf8, written
from evidara.operators.components import components

#: Words in a shingle, seed of its hash, bits in which linked fingerprints may differ.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a tile (of one population count), and how many of them are held against another tile at once.
TILE, STRIP = 8192, 32
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Pairs of tiles in one task.
TASK_PAIRS = 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64 bits set in over half of the XXH64 hashes of all shingles of the A-Z lower-cased text, repeats included.

    Words are `[^\\x20\\x09-\\x0D]+`; fewer words than a shingle are one shingle; no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, stops[:-1] + 1][: max(1, len(words) - shingle + 1)]
    stops = stops[shingle - 1 :] if len(words) >= shingle else stops[-1:]
    of = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for a in range(0, len(starts), CHUNK):
        some = [of(joined[s:e], SEED) for s, e in zip(starts[a : a + CHUNK].tolist(), stops[a : a + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k and f: each row's key and fingerprint as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(column(batch, "t"))
            prints = np.array([fingerprint(data[a:z].tobytes()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "k"), pa.array(prints.view(np.int64))], ["k", "f"])

    integral(docs, key)
    return in_arrow(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")), run, "k long, f long")


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links (as places in a, then b) that connect whatever the pairs of a and b connect; without b the pairs within a."""
    other = a if b is None else b
    shift = 0 if b is None else len(a)
    label = np.arange(len(a) + (0 if b is None else len(b)))
    out = []
    for at in range(0, len(a), STRIP):
        strip = a[at : at + STRIP]
        begin = at if b is None else 0
        rows, cols = np.nonzero(np.bitwise_count(strip[:, None] ^ other[None, begin:]) <= radius)
        if not len(rows) or (b is None and len(rows) == len(strip)):  # in its own tile each is near itself
            continue
        for row, near in zip(*_by_row(rows, cols + begin + shift), strict=True):
            if (label[near] != label[at + row]).any():
                kinds, first = np.unique(np.r_[label[at + row], label[near]], return_index=True)
                out += [(at + row, int(near[f - 1])) for f in first.tolist() if f]
                label[np.isin(label, kinds)] = kinds[0]
    return out


def _by_row(rows: np.ndarray, cols: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[cuts].tolist(), np.split(cols, cuts[1:])


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: distinct longs f -> (a, b): enough links between fingerprints within radius to connect all that all links connect.

    Only the numbers of fingerprints of each of the 65 population counts go to the driver.
    """
    spark = prints.sparkSession
    count = prints.groupBy(F.bit_count("f").cast("int").alias("pop")).count().collect()
    if not count:
        return spark.createDataFrame([], "a long, b long")
    parts = {pop: -(-n // TILE) for pop, n in count}
    pop = F.bit_count("f").cast("int")
    of = F.create_map(*(F.lit(x) for item in parts.items() for x in item))
    tile = prints.select(pop.alias("pop"), F.pmod(F.xxhash64("f"), of[pop].cast("long")).alias("part"), "f")
    tiles = written(tile.groupBy("pop", "part").agg(F.collect_list("f").alias("fs")), "tiles")
    met = [(p, n, p + d, parts[p + d]) for p, n in parts.items() for d in range(radius + 1) if p + d in parts]
    pairs = spark.createDataFrame(met, "p long, n long, q long, m long").select("p", "q", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    pairs = pairs.select("p", "i", "q", F.explode(F.sequence(F.when(F.col("p") == F.col("q"), F.col("i")).otherwise(0).cast("long"), F.col("m") - 1)).alias("j"))
    total = sum(n * (n + 1) // 2 if p == q else n * m for p, n, q, m in met)
    left = tiles.select(F.col("pop").alias("p"), F.col("part").alias("i"), F.col("fs").alias("x"))
    right = tiles.select(F.col("pop").alias("q"), F.col("part").alias("j"), F.col("fs").alias("y"))
    met_ = pairs.join(left, ["p", "i"]).join(right, ["q", "j"])
    dealt = met_.repartition(max(spark.sparkContext.defaultParallelism, -(-total // TASK_PAIRS)), "p", "i", "q", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                p, i, q, j = (column(batch, c)[row].as_py() for c in ("p", "i", "q", "j"))
                x, y = (np.asarray(column(batch, c)[row].values, np.int64) for c in ("x", "y"))
                own = (p, i) == (q, j)
                both = x if own else np.r_[x, y]
                found = forest(x.view(np.uint64), None if own else y.view(np.uint64), radius)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(both[list(side)]) for side in zip(*found, strict=True)], ["a", "b"])

    return in_arrow(dealt.select("p", "i", "q", "j", "x", "y"), run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 lower-case hex digits) and component_id of every row: the smallest key reachable by links between
    fingerprints that differ in at most radius bits, its own included.

    Null and empty texts, and those without words, have fingerprint 0, which links like any other. Rows of one fingerprint
    are linked; rows with null keys link too, but give no id: a component of null keys alone has none. Other columns are
    ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, key, text), "prints")
    kinds = written(prints.groupBy("f").agg(F.min("k").alias("least"), F.count("*").alias("n")), "kinds")
    labels = components(links(kinds.select("f"), radius)).withColumnRenamed("v", "f")
    linked = written(labels.join(kinds.select("f", "least"), "f"), "linked")
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.select("f", apart(F.col("root")).alias("r")).join(roots.select(apart(F.col("root")).alias("r"), "component"), "r")
    copies = kinds.where("n > 1").join(linked.select("f"), "f", "left_anti").select("f", F.col("least").alias("component"))
    shared = linked.select("f", "component").union(copies).select(apart(F.col("f")).alias("g"), "component", F.lit(True).alias("of"))
    rows = prints.withColumn("g", apart(F.col("f"))).join(shared, "g", "left")
    return rows.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.when(F.col("of"), F.col("component")).otherwise(F.col("k")).alias("component_id"))
