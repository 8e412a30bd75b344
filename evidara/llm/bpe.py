"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands in no token of the vocabulary marks a certain cut: no merge can ever cross it. Words fall
into fragments at such cuts, the fragments are encoded alone (and remembered), and the ids are put together again.
"""

from __future__ import annotations

import gc
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import column, in_arrow
from evidara.llm.merges import check_kind, merges
from evidara.llm.token_counts import SPACE, texts_of

#: The pre-token pattern of the word-end vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What the vocabulary file says of its text rules (fixed values).
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
RULES = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PIECES = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}"))
SPACES = regex.compile(f"[{SPACE}]+")
#: Python splits at these too, the vocabulary's library doesn't.
ODD = regex.compile(r"[\x1c-\x1f]")
#: Words in each of a worker's two memo generations.
MEMO = 60_000


class Codec:
    def __init__(self, path: str):
        self.rules = merges(path)
        self.numbers = [str(i) for i in range(self.rules.size)]
        #: word -> its ids as text, and its tokens joined by a space
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        self.old: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.rules.specials, key=len, reverse=True))) + ")")

    @staticmethod
    def normal(word: str) -> str:
        """Composed and lower-cased character by character (a last sigma is no special case)."""
        return unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()

    def pieces(self, word: str) -> list[str]:
        """Plain words need no pattern."""
        if word.isascii():
            word = word.lower()
            if word.isalpha():
                return [word]
            if word[:-1].isalpha() and word[-1] in ",.":
                return [word[:-1], word[-1]]
            return PIECES.findall(word)
        return PIECES.findall(self.normal(word))

    def words(self, text: str) -> list[str]:
        """White-space-separated parts; special strings stand alone."""
        parts = [text]
        if "<|" in text:
            parts = self.split.split(text)
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append("\0" + part)
            elif ODD.search(part):
                out += [w for w in SPACES.split(part) if w]
            else:
                out += part.split()
        return out

    def fragments(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all pieces, the lengths of their fragments, and the number of each fragment's piece."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        symbols = self.rules.byte_ids[data]
        symbols[ends - 1] = self.rules.end_ids[data[ends - 1]]
        cut = np.zeros(len(data), bool)
        cut[ends - sizes] = True
        if len(data) > 1:
            cut[1:] |= ~self.rules.inside[data[:-1], data[1:]]
        starts = np.flatnonzero(cut)
        return symbols, np.diff(np.r_[starts, len(data)]), np.searchsorted(ends, starts, "right")

    def learn(self, new: list[str]) -> None:
        owners: list[int] = []
        pieces: list[bytes] = []
        for i, word in enumerate(new):
            if word[0] != "\0" or word[1:] not in self.rules.specials:
                found = self.pieces(word)
                pieces += [p.encode("utf-8", "surrogatepass") for p in found]
                owners += [i] * len(found)
        numbers: list[str] = []
        names: list[str] = []
        ends = np.zeros(len(new) + 1, np.int64)
        if pieces:
            symbols, lengths, piece = self.fragments(pieces)
            merged, left = self.rules.merge(symbols, lengths)
            np.cumsum(np.bincount(np.array(owners)[piece], left, len(new)), out=ends[1:])
            symbols = merged.tolist()
            numbers, names = list(map(self.numbers.__getitem__, symbols)), list(map(self.rules.names.__getitem__, symbols))
        at = 0
        for word, end in zip(new, ends[1:].tolist(), strict=True):
            if word[0] == "\0" and word[1:] in self.rules.specials:
                self.ids[word], self.tokens[word] = str(self.rules.specials[word[1:]]), word[1:]
            else:
                self.ids[word], self.tokens[word] = " ".join(numbers[at:end]), " ".join(names[at:end])
            at = end

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """The ids of each text joined by spaces, and their decoding."""
        split = [self.words(t) for t in texts]
        if len(self.ids) > MEMO:  # what is used again is taken over from the last generation
            self.old, self.ids, self.tokens = (self.ids, self.tokens), {}, {}
        new = set().union(*split).difference(self.ids)
        known = new.intersection(self.old[0])
        for had, has in zip(self.old, (self.ids, self.tokens), strict=True):
            has.update(zip(known, map(had.__getitem__, known), strict=True))
        new = list(new - known)
        for i in range(0, len(new), 50_000):
            self.learn(new[i : i + 50_000])
        ids, tokens = self.ids.__getitem__, self.tokens.__getitem__
        return [(" ".join(map(ids, words)), " ".join(map(tokens, words))) for words in split]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """key, n_tokens, and ids (array) with decoded (text), or with digests their SHA-256 only.

    decoded is what the vocabulary's library gives back: tokens with their word-end marks, joined by spaces. A null text
    counts as empty: no ids, empty text. Rows are independent: repeated rows, null keys and an empty table come back as
    they are; other columns are ignored. Whole texts are encoded, of any length. A vocabulary of other text rules than
    those built in is refused.
    """
    check_kind(vocabulary, NORMAL, RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and scans of the memo cost time
        codec = Codec(vocabulary)
        for batch in batches:
            keys = column(batch, "k")
            for i, j, texts in texts_of(batch, "t"):
                coded = codec.encode(texts)
                n = [x.count(" ") + 1 if x else 0 for x, _ in coded]
                if digests:
                    more = [pa.array([sha(x) for x, _ in coded], pa.string()), pa.array([sha(x) for _, x in coded], pa.string())]
                else:
                    more = [pa.array([[int(y) for y in x.split()] for x, _ in coded], pa.list_(pa.int32())), pa.array([x for _, x in coded], pa.string())]
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(n, pa.int64()), *more], ["k", "n", "a", "b"])

    kind = docs.schema[key].dataType.simpleString()
    out = in_arrow(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, n long, a {'string' if digests else 'array<int>'}, b string")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_tokens"), F.col("a").alias(names[0]), F.col("b").alias(names[1]))
