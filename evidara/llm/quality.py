"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.boosting import Boosted, fit
from evidara.llm.common import NOT_SPACE, column, crc_text, groups, in_arrow, integral, utf8, words

#: The classifier is fitted on about so many labelled rows at most, chosen by a hash of the id.
TRAIN_ROWS = 20_000
_CLASSES = np.zeros(256, np.int64)
for _n, _set in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?;:", "\"'()-", "|", "#*&%$@^~=+_", "<>{}[]\\/"), 1):
    _CLASSES[[ord(c) for c in _set]] = _n
_CLASSES[128:192] = 13  # continuation bytes
_CLASSES[192:] = 14
N_CLASSES = 15
_LINE = np.ones(256, bool)
_LINE[10] = False
_SENTENCE = np.ones(256, bool)
_SENTENCE[[10, 46]] = False


def _repeats(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each text: how many items, distinct share, share of the commonest."""
    out = np.zeros((len(firsts) - 1, 3))
    for i in range(len(firsts) - 1):
        n = firsts[i + 1] - firsts[i]
        if n:
            own = np.sort(hashes[firsts[i] : firsts[i + 1]])
            edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
            out[i] = n, (len(edges) - 1) / n, np.diff(edges).max() / n
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text; an empty text has zeros."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n) * N_CLASSES, sizes)
    counts = np.bincount(owner + _CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    letters = counts[:, 1] + counts[:, 2] + counts[:, 14]
    chars = np.maximum(sizes - counts[:, 13], 1)
    hashes, firsts = words(data, offsets, NOT_SPACE)
    with np.errstate(over="ignore"):
        pairs = hashes[:-1] * np.uint64(31) + hashes[1:] if len(hashes) else hashes
    pairs = np.delete(pairs, np.unique(firsts[(firsts > 0) & (firsts < len(hashes))]) - 1)  # of the last word of a text and the next text's first
    by_word = _repeats(hashes, firsts)
    by_pair = _repeats(pairs, np.r_[0, np.cumsum(np.maximum(np.diff(firsts) - 1, 0))])
    by_line = _repeats(*words(data, offsets, _LINE))
    by_sentence = _repeats(*words(data, offsets, _SENTENCE))
    share = counts / chars[:, None]
    n_words, n_lines = np.maximum(by_word[:, 0], 1), np.maximum(by_line[:, 0], 1)
    return np.column_stack([
        share, np.log1p(sizes), np.log1p(by_word[:, 0]), letters / n_words, by_word[:, 1:], by_pair[:, 1:], by_line[:, 1:], by_sentence[:, 1:],
        np.log1p(by_line[:, 0]), n_words / n_lines, counts[:, 6] / n_words, counts[:, 7] / n_words, counts[:, 2] / np.maximum(letters, 1), n_words / np.maximum(by_sentence[:, 0], 1), by_word[:, 1] * np.log1p(by_word[:, 0]),
    ])


def _numbers(docs: DataFrame, keep: list[str], kinds: str, model=None) -> DataFrame:
    """keep columns with each row's statistics, or its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(column(batch, "t"))
            for i, j in groups(offsets):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                last = pa.array(model.value.score(x)) if model else pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(i, j - i) for c in keep), last], [*keep, "x"])

    return in_arrow(docs, run, f"{kinds}, x {'double' if model else 'array<double>'}")


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int, key: str, text: str) -> DataFrame:
    """Texts with the label y of about so many rows at most: those outside the held-out remainder of crc32(key as text)
    with the smallest hashes. Null labels don't count; of several labels of one key the largest holds. Where documents repeat
    ids so often that there would be twice as many rows, rows are chosen by a hash of key and text too."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.pmod(crc_text(key), F.lit(modulus)) != held))
    known = known.groupBy(F.col(key).cast("long").alias("k")).agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    known = F.broadcast(known)  # bounded by rows
    found = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(known, "k").select("k", "t", "y")
    n = found.count()  # reads ids alone
    return found if n <= 2 * rows else found.where(F.pmod(F.xxhash64("k", "t"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> Boosted:
    data = _numbers(labelled(docs, labels, label, modulus, held, rows, key, text), ["k", "y"], "k long, y int").distinct().orderBy(F.xxhash64("k", F.lit(7)), "k").collect()
    x = np.array([r["x"] for r in data], float) if data else np.zeros((0, 1))
    return fit(x, np.array([r["y"] for r in data], float))


def quality_scores(docs: DataFrame, model: Boosted, modulus: int = 3, held: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every row's whole text.

    A null text counts as empty and gets a score too; a null key is never held out; repeated rows, empty tables and
    other columns do no harm. Without labels, or with one label only, every score is the same.
    """
    integral(docs, key)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = _numbers(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), ["k"], "k long", sent)
    held_out = F.coalesce(F.pmod(crc_text("k"), F.lit(modulus)) == held, F.lit(False))
    return scored.select(F.col("k").alias(key), held_out.alias("held_out"), F.col("x").alias("score"), (F.col("x") >= 0.5).cast("int").alias("predicted"))
