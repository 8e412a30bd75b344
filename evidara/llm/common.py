"""Shared pieces of the training-data operators: the shared folder, written tables, Arrow text access, byte-level words.

Text columns are handled as UTF-8 bytes straight from Arrow buffers, so the hot loops are numpy passes over bytes and
never build a Python object for each word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.plans.lineage import cut as written
from evidara.plans.lineage import shared_dir

#: Bytes of text handled at once in one numpy pass.
CHUNK = 1 << 20
#: Bytes of text whose words are held together.
GROUP = 4 << 20
#: Bytes and rows of one Arrow batch.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded bytes, so that long texts don't make large ones; a task that ends gives the memory
    back that its worker, which Spark uses again, no longer needs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(bounded, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(column: F.Column) -> F.Column:
    """The same join key in other words, one to one, so that Spark deals both sides out itself and AQE may split skew."""
    return F.reverse(column.cast("string"))


def integral(df: DataFrame, key: str) -> None:
    """Keys are whole numbers, which are compared and carried as longs; text keys would fail only in a task, so they are refused."""
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{key} is {kind}; a whole number is needed")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than needed to know."""
    return df.limit(rows + 1).count() <= rows


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def groups(offsets: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BASE = 0x9E3779B97F4A7C15 | 1
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: By lower-cased byte.
LOWER_CODES = BYTE_CODES[LOWER]
#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of A-Z lower-cased text, by byte.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """1, b, b^2 ... modulo 2^64 for b the base or its inverse."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        b = np.uint64(BASE if kind == "up" else pow(BASE, -1, 1 << 64))
        out = np.full(max(n, CHUNK + 1), b, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        if n <= 4 * CHUNK:
            _powers[kind] = have
    return have


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in data, in order, and for each text the number of its first word
    (one more entry than texts). Words never span texts. A word's hash is a polynomial in its A-Z lower-cased bytes, taken
    from prefix sums, so the cost is a few numpy passes over the bytes.
    """
    hashes, firsts = [np.zeros(0, np.uint64)], []
    at, end, inner = 0, len(data), offsets[1:-1]
    while at < end:
        stop = min(end, at + CHUNK)
        if stop < end:
            gap = np.flatnonzero(~is_word[data[at:stop]])
            bound = inner[np.searchsorted(inner, stop, "right") - 1] if len(inner) and inner[0] <= stop else 0
            cut = max(at + int(gap[-1]) + 1 if len(gap) else 0, int(bound))
            while cut <= at:  # a word longer than a chunk
                gap = np.flatnonzero(~is_word[data[stop : stop + CHUNK]])
                k = np.searchsorted(inner, stop)
                bound = int(inner[k]) if k < len(inner) else end
                cut = min(bound, stop + int(gap[0]) + 1 if len(gap) else bound) if len(gap) or bound <= stop + CHUNK or stop + CHUNK >= end else 0
                stop = stop if cut else stop + CHUNK
            stop = cut
        part = data[at:stop]
        mask = is_word[part]
        edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        breaks = inner[np.searchsorted(inner, at, "right") : np.searchsorted(inner, stop)] - at
        breaks = np.unique(breaks[(breaks > 0) & (breaks < len(part))])
        breaks = breaks[mask[breaks - 1] & mask[breaks]] if len(breaks) else breaks
        edges = np.concatenate(([0] if mask[0] else [], edges, breaks, breaks, [len(part)] if mask[-1] else [])).astype(np.int64)
        edges.sort(kind="stable")
        start, stops = edges[0::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(LOWER_CODES[part] * _power("up", len(part))[: len(part)], out=sums[1:])
            hashes.append(mixed((sums[stops] - sums[start]) * _power("down", len(part) + 1)[start]))
        firsts.append(start + at)
        at = stop
    starts = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(starts, offsets)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def crc_text(name: str) -> F.Column:
    return F.crc32(F.col(name).cast("string").cast("binary"))
