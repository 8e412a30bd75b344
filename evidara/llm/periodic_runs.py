"""Maximal periodic runs of words, found on a harmonic grid.

A run of smallest period q and at least 4 q words has at least 3 q places whose word comes again q words later, so one of
them is a multiple of 3 q. For each period all multiples of three times the period are tried: some n/3 ln n places in all.
Where the word at a place and the one a period later are equal, how far both go on alike, forwards and backwards, is found
by binary search over prefix hashes, for all places of all periods at once. Prefix hashes can only make a stretch too
long, so every run's words are compared in the end; if any differ, the texts are searched again with another hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import column, groups, in_arrow, integral, mixed, utf8

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Hashes are polynomials modulo this prime.
PRIME = np.uint64((1 << 31) - 1)
#: Grid places looked at together.
PLACES = 1 << 20
SCHEMA = "k long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Prefix:
    """Prefix hashes of all words, of which any two stretches can be compared."""

    def __init__(self, ids: np.ndarray, attempt: int):
        base = int(mixed(np.array([attempt + 1], np.uint64))[0] % (PRIME - np.uint64(2))) + 2
        self.power = np.ones(len(ids) + 1, np.uint64)
        done = 1
        while done < len(self.power):  # twice as many powers each time
            step = np.uint64(pow(base, done, int(PRIME)))
            self.power[done : 2 * done] = self.power[: len(self.power) - done][:done] * step % PRIME
            done *= 2
        codes = mixed(ids.astype(np.uint64) + np.uint64((attempt + 1) << 40)) % PRIME
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(codes * self.power[:-1] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether so many words from i on hash like those from j on, a period later."""
        a, b = self.sums[i + length] + PRIME - self.sums[i], self.sums[j + length] + PRIME - self.sums[j]
        return a * self.power[j - i] % PRIME == b % PRIME

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words are alike from i and j on (back: before i and j), at most so many each: never too few."""
        low, high = np.zeros_like(most), most + 1
        while len(open_ := np.flatnonzero(high - low > 1)):
            middle = (low[open_] + high[open_]) // 2
            off = middle if back else 0
            same = self.equal(i[open_] - off, j[open_] - off, middle)
            low[open_[same]], high[open_[~same]] = middle[same], middle[~same]
        return low


def runs_of(ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Rows of text, start, length and period, in this order, of all runs of the texts whose word numbers stand in ids.

    Text t has the words from firsts[t] to firsts[t + 1].
    """
    sizes = np.diff(firsts)
    periods = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    places = -(-(sizes[text] - period) // (3 * period))
    upto = np.cumsum(places)
    attempt = 0
    while True:
        prefix, found = Prefix(ids, attempt), [np.zeros((0, 4), np.int64)]
        a = 0
        while a < len(text):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PLACES, "right")))
            n = places[a:z]
            row = np.repeat(np.arange(a, z), n)
            p = period[row]
            i = firsts[text[row]] + 3 * p * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
            alike = ids[i] == ids[i + p]
            i, p, t = i[alike], p[alike], text[row[alike]]
            start = i - prefix.common(i, i + p, i - firsts[t], True)
            length = i + p + prefix.common(i, i + p, firsts[t + 1] - i - p, False) - start
            long_ = length >= np.maximum(LEAST, TIMES * p)
            found.append(np.column_stack((t, start, length, p))[long_])
            a = z
        rows = np.unique(np.concatenate(found), axis=0)
        first = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]) if len(rows) else np.zeros(0, np.int64)
        kept = rows[first]  # of one stretch the smallest period; the others must be its multiples
        multiple = rows[:, 3] % np.repeat(kept[:, 3], np.diff(np.r_[first, len(rows)])) == 0
        if multiple.all() and all(np.array_equal(ids[s : s + n - q], ids[s + q : s + n]) for _, s, n, q in kept.tolist()):
            kept[:, 1] -= firsts[kept[:, 0]]
            return kept
        attempt += 1


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: key, n_words, runs (start, length, period of each, by start, then period), collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of consecutive words in which words a period apart
    are identical, that no neighbouring word extends, of at least max(6, 4 periods) words; its period is its smallest.
    collapsed is the text without the words that a run holds after its first period, joined by one space.
    A null or empty text has no words, no runs and an empty collapsed text. Rows with repeated or null keys are separate
    documents. Whole texts are searched; one text is held by one task. Other columns are ignored; an empty table gives none.
    """
    integral(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(column(batch, "t"))
            keys = column(batch, "k")
            for i, j in groups(offsets):
                words = [data[offsets[t] : offsets[t + 1]].tobytes().split() for t in range(i, j)]
                firsts = np.cumsum([0, *map(len, words)])
                coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
                found = runs_of(np.asarray(coded.indices, np.int64), firsts)
                bounds = np.searchsorted(found[:, 0], np.arange(j - i + 1))
                collapsed = []
                for own, a, z in zip(words, bounds[:-1], bounds[1:], strict=True):
                    if a < z:
                        drops = np.zeros(len(own) + 1, np.int64)
                        _, s, n, q = found[a:z].T
                        np.add.at(drops, s + q, 1)
                        np.add.at(drops, s + n, -1)
                        own = [own[w] for w in np.flatnonzero(np.cumsum(drops[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(own))
                parts = pa.StructArray.from_arrays([pa.array(found[:, c], pa.int64()) for c in (1, 2, 3)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(np.diff(firsts), pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["k", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return in_arrow(rows, run, SCHEMA).withColumnRenamed("k", key)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text, where the texts of one in ten keys (by their CRC-32) repeat a stretch of their own words to their end.

    A text that is changed has its words joined by one space. Null keys, and texts without words, stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(key), F.col(text), F.when(h % 10 == 0, split).alias("_words"), g.alias("_g"))
    n = F.size("_words")
    rows = rows.withColumn("_from", F.when(n > 0, F.col("_g") % n).cast("int"))
    rows = rows.withColumn("_period", (1 + F.floor((n - F.col("_from")) / (3 + F.col("_g") % 8))).cast("int"))
    word = lambda w, i: F.when(i < F.col("_from"), w).otherwise(F.get("_words", F.col("_from") + (i - F.col("_from")) % F.col("_period")))
    return rows.select(key, F.when(n > 0, F.array_join(F.transform("_words", word), " ")).otherwise(F.col(text)).alias(text))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_runs, the longest run (ties: smallest start, then period; nulls without runs) with its exponent in thousandths,
    and SHA-256 digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    return rows.select(
        key, "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"),
        F.expr("(1000 * b.length) div (-b.p)").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
