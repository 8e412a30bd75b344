"""Token counts: rank-synchronous array merging of byte-level BPE.

Pre-tokens are held as ragged numpy arrays; each step applies every sequence's lowest-rank pair at once, and the symbols
that survive are counted. Pre-tokens that were met before come from a bounded memo in the Python worker.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import column, groups, in_arrow
from evidara.llm.merges import check_kind, merges

#: The pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the vocabulary file says of its text rules (fixed values).
RULES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: The characters of \s, spelled out: Python's \s has \x1c-\x1f besides.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
DOUBLE_SPACE = regex.compile(f"[{SPACE}][{SPACE}]")
#: Segments in each of a worker's two memo generations.
MEMO = 300_000


def pre_tokens(text: str) -> list[str]:
    """Plain words need no pattern."""
    if text.isascii():
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return [text]
        if text[1:-1].isalpha() and text[0] == " " and text[-1] in ",.":
            return [text[:-1], text[-1]]
    return PIECES.findall(text)


class Counter:
    def __init__(self, path: str):
        self.path, self.rules = path, merges(path)
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.rules.specials, key=len, reverse=True))) or r"(?!)")

    def segments(self, text: str) -> tuple[list[str], int]:
        """Parts that pre-tokenise alone, and the number of special tokens.

        A single space between other characters always starts a pre-token, so texts fall apart there; a text with white
        space in a row goes through the pattern as a whole.
        """
        if "\0" in text:  # the mark below
            return ["\0" + x for part in self.split.split(text) for x in PIECES.findall(part)], len(self.split.findall(text))
        parts, special = [text], 0
        if "<|" in text:
            parts = self.split.split(text)
            special = len(parts) - 1
        out: list[str] = []
        for part in parts:
            if DOUBLE_SPACE.search(part):
                out += ["\0" + x for x in PIECES.findall(part)]
            elif part:
                first, *rest = part.split(" ")
                out.append("\0" + first)  # no leading space; the others are remembered without theirs
                out += rest
        return out, special

    def learn(self, new: list[str]) -> None:
        owners, pieces = [], []
        for i, segment in enumerate(new):
            found = pre_tokens(segment[1:] if segment[:1] == "\0" else " " + segment)
            pieces += found
            owners += [i] * len(found)
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.rules.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        _, left = self.rules.merge(symbols, lengths)
        counts = np.bincount(np.array(owners, np.int64), left, len(new)).astype(np.int64) if owners else np.zeros(len(new), np.int64)
        self.memo.update(zip(new, counts.tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.segments(t) for t in texts]
        if len(self.memo) > MEMO:  # what is used again is taken over from the last generation
            self.memo, self.old = {}, self.memo
        new = set().union(*(segments for segments, _ in split)).difference(self.memo)
        known = new.intersection(self.old)
        self.memo.update(zip(known, map(self.old.__getitem__, known), strict=True))
        new = list(new - known)
        for i in range(0, len(new), 50_000):
            self.learn(new[i : i + 50_000])
        get = self.memo.__getitem__
        return [sum(map(get, segments)) + special for segments, special in split]


def texts_of(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of a few MB with their texts; null counts as empty."""
    values = column(batch, name)
    sizes = np.array([0, *np.cumsum(np.asarray(pc.fill_null(pc.binary_length(values), 0), np.int64))], np.int64)
    for i, j in groups(sizes):
        yield i, j, [x or "" for x in values.slice(i, j - i).to_pylist()]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row's whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Rows are independent: repeated rows and null keys come back as they
    are, an empty table gives an empty table, other columns are ignored. A special string inside a text is one token. A
    vocabulary of other text rules than those built in is refused.
    """
    check_kind(vocabulary, None, RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and scans of the memo cost time
        counter = Counter(vocabulary)
        for batch in batches:
            counts: list[int] = []
            for _, _, texts in texts_of(batch, "t"):
                counts += counter.counts(texts)
            yield pa.RecordBatch.from_arrays([column(batch, "k"), column(batch, "b"), pa.array(counts, pa.int64())], ["k", "b", "n"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b"), F.col(text).alias("t"))
    out = in_arrow(rows, run, f"k {kind}, b long, n long")
    return out.select(F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))

