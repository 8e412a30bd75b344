"""Toxicity: a support vector machine over sentences with a subsequence string kernel and Nystroem landmarks.

A text is read as sentences, a sentence as units: its words, runs of spaced single characters put together, and overlapping
windows of long words; a sentence of many units is read in pieces. A unit is a string of letters: accents, look-alike digits
and signs are folded, letters of other scripts stand for one letter each, all else is dropped. The kernel of two units counts
their common subsequences of four letters, each weighted by a power of the stretch it covers, so gaps and inserted characters
cost little; it is normalised, and a mark stands before and after each unit. The kernel of two sentences is the sum over
their distinct units. The machine works on Nystroem features over landmark units; as its decision is a weighted sum of
kernels, it is folded into one weight for each four letters, which gives the same value and is quick.

Its training rows are sentences of labelled texts. A sentence of a clean text is negative. Of a toxic text it is not known
which sentences are; after each fit those that lie below the margin are left out, but for the highest of each text, and the
machine is fitted again. A text's score is calibrated, on the labelled texts, from its highest sentences.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import BYTE_CODES, _power, column, crc_text, groups, in_arrow, integral, mixed, utf8, written
from evidara.llm.quality import labelled

#: The classifier is fitted on about so many labelled rows at most, chosen by a hash of the id, and on so many distinct
#: sentences of either label at most, chosen by a hash of the sentence.
TRAIN_ROWS, TRAIN_SENTENCES = 20_000, 12_000
#: Landmarks: units that stand out in toxic texts, and as many of clean ones; two of the former are no closer than this.
LANDMARKS, APART = 128, 0.8
#: Rounds of fitting and choosing sentences; the cost of a margin, and how much dearer a clean sentence's is.
ROUNDS, COST, CLEAN = 6, 10.0, 8.0
DECAY = 0.5
#: Letters and the two marks; letters in a subsequence.
ALPHABET, ORDER = 28, 4
#: Highest sentences of a text that its score is calibrated on; units of a sentence, beyond which it is read in pieces.
TOP, PIECE = 3, 24
#: A word longer than this is read in windows, one for each stride.
LONGEST, STRIDE = 20, 10
#: Units whose values a task remembers.
MEMO = 1_000_000
#: What a character is, if no letter (below 26).
SPACE, STOP, BANG, END, DROP = range(26, 31)
#: Look-alikes (fixed values).
LOOKS = dict(zip("0134578@$!", "oieastbasi", strict=True))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point its letter, or what it is."""
    out = np.full(0x110000, DROP, np.uint8)
    rest = np.arange(0x20000, 0x32400)  # ideographs only
    out[rest] = rest % 26
    for point in itertools.chain(range(0xD800), range(0xE000, 0x20000)):
        char = chr(point)
        if char == "\n" or char in "。！？":
            out[point] = END
        elif char.isspace():
            out[point] = SPACE
        elif char in ".?…":
            out[point] = STOP
        elif char == "!":
            out[point] = BANG
        elif char in LOOKS:
            out[point] = ord(LOOKS[char]) - 97
        elif char.isalpha():
            base = unicodedata.normalize("NFKD", char.lower())[0]
            out[point] = ord(base) - 97 if "a" <= base <= "z" else ord(base) % 26
    return out


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the place of each one's first byte."""
    if not len(data) or data.max() < 128:
        return data, np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[at].astype(np.int64)
    n = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    out = np.where(n == 1, first, first & (0x7F >> n))
    padded = np.r_[data, np.zeros(3, np.uint8)]
    for k in (1, 2, 3):
        more = n > k
        out[more] = out[more] << 6 | (padded[at[more] + k] & 0x3F)
    return np.minimum(out, 0x10FFFF), at


@dataclass
class Units:
    """Units of some texts in order of their sentences: starts and sizes in letters, the sentence of each, the text of each
    sentence."""

    letters: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    sentences: np.ndarray
    texts: np.ndarray


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def units(data: np.ndarray, offsets: np.ndarray) -> Units:
    points, at = characters(data)
    kinds = _kinds()[points]
    bounds = np.searchsorted(at, offsets)
    after = np.r_[kinds[1:], np.uint8(SPACE)][: len(kinds)]
    after[(bounds[1:] - 1)[bounds[1:] > bounds[:-1]]] = SPACE
    ends = ((kinds == STOP) | (kinds == BANG)) & (after >= SPACE) & (after <= END)
    kinds[(kinds == BANG) & ~ends] = ord(LOOKS["!"]) - 97
    kinds[(kinds == STOP) & ~ends] = DROP
    kinds[ends] = END
    keep = kinds != DROP
    bounds = np.r_[0, np.cumsum(keep)][bounds]
    c = kinds[keep]
    letter = c < 26
    inner = np.unique(bounds[1:-1])
    inner = inner[(inner > 0) & (inner < len(c))]
    inner = inner[letter[inner - 1] & letter[inner]]
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edges = np.sort(np.concatenate(([0] if len(c) and letter[0] else [], edges, inner, inner, [len(c)] if len(c) and letter[-1] else [])).astype(np.int64))
    starts, stops = edges[0::2], edges[1::2]
    text = np.searchsorted(bounds, starts, "right") - 1
    number = np.cumsum(c == END)[starts] + text if len(starts) else starts
    # Runs of at least three spaced single letters are a unit too.
    single = stops - starts == 1
    if single.any():
        a = _runs(2 * number + single)
        z = np.r_[a[1:], len(starts)]
        spaced = [(i, j) for i, j in zip(a, z, strict=True) if single[i] and j - i >= 3]
        if spaced:
            sizes = np.array([j - i for i, j in spaced])
            places, lead = len(c) + np.cumsum(sizes) - sizes, np.array([i for i, _ in spaced])
            c = np.concatenate([c, *(c[starts[i:j]] for i, j in spaced)])
            order = np.argsort(np.r_[number, number[lead]], kind="stable")
            starts, stops, text, number = (np.r_[x, y][order] for x, y in ((starts, places), (stops, places + sizes), (text, text[lead]), (number, number[lead])))
    parts = 1 + np.maximum(0, -(-(stops - starts - LONGEST) // STRIDE))
    owner = np.repeat(np.arange(len(starts)), parts)
    begun = starts[owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    sizes, number, text = np.minimum(LONGEST, stops[owner] - begun), number[owner], text[owner]
    first = _runs(number)
    place = np.arange(len(number)) - np.repeat(first, np.diff(np.r_[first, len(number)]))
    new = place % PIECE == 0
    return Units(c, begun, sizes, np.cumsum(new) - 1, text[new])


def hashes(own: Units) -> np.ndarray:
    """A 64-bit hash of each unit's letters."""
    c = own.letters
    with np.errstate(over="ignore"):
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(BYTE_CODES[c] * _power("up", len(c))[: len(c)], out=sums[1:])
        return mixed((sums[own.starts + own.sizes] - sums[own.starts]) * _power("down", len(c) + 1)[own.starts])


@lru_cache(LONGEST)
def _shape(n: int) -> tuple:
    """Of the subsequences of a unit of n letters: where their halves are in its table of pairs, and their weights; and the
    matrix that discounts and sums what lies before."""
    places = np.array(list(itertools.combinations(range(n), ORDER)), np.int64)
    gap = np.subtract.outer(np.arange(n), np.arange(n))
    weights = DECAY ** (places[:, -1] - places[:, 0] + 1.0)
    return places[:, 0] * n + places[:, 1], places[:, 2] * n + places[:, 3], weights.astype(np.float32), np.where(gap > 0, DECAY ** np.maximum(gap, 0.0), 0.0)


def _parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes: equally long units. Their subsequences as numbers (a column for each unit), the subsequences' weights, and each
    unit's norm."""
    m, n = codes.shape
    first, second, weights, before = _shape(n)
    columns = np.ascontiguousarray(codes.T)
    pairs = (columns[:, None] * np.int32(ALPHABET) + columns).reshape(n * n, m)
    level = same = (codes[:, :, None] == codes[:, None, :]).astype(np.float64)
    for _ in range(ORDER - 1):
        for _ in range(2):
            level = (level.reshape(m * n, n) @ before.T).reshape(m, n, n).transpose(0, 2, 1)
        level = same * level
    return pairs[first] * np.int32(ALPHABET**2) + pairs[second], weights, np.sqrt(DECAY**2 * level.sum((1, 2))).astype(np.float32)


def _alike(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of equally long units with their marked codes; units of a single letter have no subsequence and are left out."""
    for n in range(2, LONGEST + 1):
        at = np.flatnonzero(sizes == n)
        for a in range(0, len(at), 512):
            own = at[a : a + 512]
            codes = np.full((len(own), n + 2), ALPHABET - 2, np.int32)
            codes[:, 1:-1] = letters[starts[own][:, None] + np.arange(n)]
            codes[:, -1] += 1
            yield own, codes


def _listed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a to z as letters, starts and sizes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8) - 97, np.cumsum(sizes) - sizes, sizes


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised subsequence features as rows, numbers and values, for the few words that a model is fitted on."""
    rows, numbers, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for own, codes in _alike(*_listed(words)):
        number, weights, norm = _parts(codes)
        rows.append(np.repeat(own, len(number)))
        numbers.append(number.T.ravel())
        values.append((weights[:, None] / norm).T.ravel())
    return np.concatenate(rows), np.concatenate(numbers), np.concatenate(values)


def kernels(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The normalised kernel of each word with each landmark."""
    rows, numbers, values = features(landmarks)
    used = np.unique(numbers)
    base = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(base, (np.searchsorted(used, numbers), rows), values)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    place = np.full(ALPHABET**ORDER, -1, np.int32)
    place[used] = np.arange(len(used))
    for own, codes in _alike(*_listed(words)):
        number, weights, norm = _parts(codes)
        at = place[number]
        col, row = np.nonzero(at.T >= 0)
        for a in range(0, len(row), 10_000):
            rows, cols = row[a : a + 10_000], col[a : a + 10_000]
            starts = _runs(cols)
            sums = np.add.reduceat(base[at[rows, cols]] * weights[rows, None], starts)
            out[own[cols[starts]]] += sums / norm[cols[starts], None]
    return out


@dataclass
class Machine:
    """alphas: of each landmark; weights: the same folded, one for each subsequence."""

    weights: np.ndarray
    bias: float
    landmarks: list[bytes] = field(default_factory=list)
    alphas: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Of the logistic calibration: for each of the TOP values, and the intercept.
    slopes: tuple[float, ...] = (4.0, 0.0, 0.0)
    shift: float = 0.0

    def __post_init__(self):
        """As multiples of 2^-24 they are added up without rounding, so a unit's value is the same whatever is near it."""
        self.weights = (np.rint(self.weights.astype(np.float64) * 2**24) / 2**24).astype(np.float32)

    def values(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What each unit adds to its sentence."""
        out = np.zeros(len(starts), np.float32)
        for own, codes in _alike(letters, starts, sizes):
            numbers, weights, norm = _parts(codes)
            out[own] = weights.astype(np.float64) @ self.weights.take(numbers).astype(np.float64) / norm
        return out


class Scorer:
    def __init__(self, machine: Machine):
        self.machine = machine
        self.keys, self.known = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def unit_values(self, keys: np.ndarray, own: Units, at: np.ndarray) -> np.ndarray:
        """Of distinct units, in order of their hashes."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        have = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys), np.float32)
        out[have] = self.known[place[have]]
        out[~have] = self.machine.values(own.letters, own.starts[at[~have]], own.sizes[at[~have]])
        if len(self.keys) + (~have).sum() > MEMO:
            self.keys, self.known = keys[:MEMO], out[:MEMO]
        elif not have.all():
            merged = np.concatenate((self.keys, keys[~have]))
            order = np.argsort(merged, kind="stable")
            self.keys, self.known = merged[order], np.concatenate((self.known, out[~have]))[order]
        return out

    def sentences(self, own: Units) -> np.ndarray:
        """The decision value of each sentence: the bias, and what its distinct units add."""
        keys, first, which = np.unique(hashes(own), return_index=True, return_inverse=True)
        values = self.unit_values(keys, own, first)
        pairs = np.unique(own.sentences * np.int64(max(1, len(keys))) + which)
        return self.machine.bias + np.bincount(pairs // max(1, len(keys)), values[pairs % max(1, len(keys))], len(own.texts))

    def best(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The TOP highest values of each text's sentences; the bias for sentences that a text lacks."""
        out = np.full((len(offsets) - 1, TOP), self.machine.bias)
        own = units(data, offsets)
        if len(own.texts):
            value = self.sentences(own)
            order = np.lexsort((-value, own.texts))
            text = own.texts[order]
            first = _runs(text)
            rank = np.arange(len(text)) - np.repeat(first, np.diff(np.r_[first, len(text)]))
            top = rank < TOP
            out[text[top], rank[top]] = value[order][top]
        return out


def solved(z: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, costs c, by Newton steps. The last column is the bias."""
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.ones(z.shape[1] - 1), 1e-3]
    loss = lambda w: (ridge * w * w).sum() / 2 + (c * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()
    for _ in range(40):
        slack = np.maximum(0, 1 - y * (z @ w))
        on = slack > 0
        grad = ridge * w - 2 * (z[on] * (c * y * slack)[on, None]).sum(0)
        hess = np.diag(ridge) + 2 * (z[on] * c[on, None]).T @ z[on]
        step, rate, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while loss(w - rate * step) > now and rate > 1e-4:
            rate /= 2
        w = w - rate * step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(sentences: list[tuple[int, int, bytes]], most: int = LANDMARKS) -> Machine:
    """sentences: (text, label above 0 if toxic, units joined by spaces), each once."""
    toxic = np.array([y > 0 for _, y, _ in sentences], bool)
    if toxic.all() or not toxic.any():
        return Machine(np.zeros(ALPHABET**ORDER, np.float32), 1.0 if len(toxic) and toxic.all() else -1.0)
    numbers: dict[bytes, int] = {}
    rows = [[numbers.setdefault(u, len(numbers)) for u in set(units_.split())] for _, _, units_ in sentences]
    words = list(numbers)
    flat, owner = np.array([u for own in rows for u in own], np.int64), np.repeat(np.arange(len(rows)), [len(own) for own in rows])
    # Landmarks: by how far their share of toxic sentences lies above that of clean ones.
    shares = [np.bincount(flat[toxic[owner] == t], minlength=len(words)) / (toxic == t).sum() for t in (True, False)]
    both = np.bincount(flat, minlength=len(words)) / len(rows)
    lead = (shares[0] - shares[1]) / np.sqrt(both * (1 - both) + 1e-12)
    order = [i for i in np.argsort(-lead, kind="stable")[: 8 * most] if lead[i] > 0]
    near, close, good = kernels([words[i] for i in order], [words[i] for i in order]), np.zeros(len(order)), []
    for k, i in enumerate(order):
        if close[k] < APART and len(good) < most:
            good.append(i)
            close = np.maximum(close, near[k])
    clean = np.flatnonzero(shares[1] > 0)
    common = clean[np.argsort(-shares[1][clean], kind="stable")]
    some = common[: 16 * most]
    hard = some[np.argsort(-kernels([words[i] for i in some], [words[i] for i in good]).max(1, initial=0), kind="stable")]
    base = [words[i] for i in dict.fromkeys([*good, *hard[: most // 2], *common[: most // 2]])]
    gram = kernels(base, base).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-4 * max(values[-1], 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    each = kernels(words, base) @ root.astype(np.float32)
    z = np.zeros((len(rows), each.shape[1] + 1))
    z[:, -1] = 1
    starts = _runs(owner)
    for a in range(0, len(starts), 2000):
        own = starts[a : a + 2000]
        stop = starts[a + 2000] if a + 2000 < len(starts) else len(flat)
        z[owner[own], :-1] = np.add.reduceat(each[flat[own[0] : stop]], own - own[0])
    text = np.unique(np.array([t for t, *_ in sentences]), return_inverse=True)[1]
    y, active = np.where(toxic, 1.0, -1.0), np.ones(len(rows), bool)
    for _ in range(ROUNDS):
        p, n = (active & toxic).sum(), (~toxic).sum()
        c = COST * (p + n) / 2 * np.where(toxic, 1 / p, CLEAN / n)
        w = solved(z[active], y[active], c[active])
        f = z @ w
        best = np.full(text.max() + 1, -np.inf)
        np.maximum.at(best, text[toxic], f[toxic])
        active = ~toxic | (f >= np.minimum(best[text], 0.0))
    alphas = root @ w[:-1]
    at, number, value = features(base)
    return Machine(np.bincount(number, value * alphas[at], ALPHABET**ORDER).astype(np.float32), float(w[-1]), base, alphas)


def calibrated(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (none below 0) and intercept of a logistic model by damped Newton steps on smoothed targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    z = np.column_stack((x, np.ones(len(x))))
    w = np.r_[np.ones(x.shape[1]), 0.0]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        ridge = penalty * np.r_[np.ones(x.shape[1]), 0.0]
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6), z.T @ (p - target) + ridge * w)
        w = w - np.clip(step, -1, 1)
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _values(docs: DataFrame, machine: Machine, keep: list[str], kinds: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            data, offsets = utf8(column(batch, "t"))
            for i, j in groups(offsets):
                best = scorer.best(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(i, j - i) for c in keep), pa.array(list(best), pa.list_(pa.float64()))], [*keep, "x"])

    return in_arrow(docs, run, f"{kinds}, x array<double>")


def _sentences(data: DataFrame, most: int) -> list[tuple[int, int, bytes]]:
    """At most so many distinct sentences of either label, by a hash; one that a clean text has is clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(column(batch, "t"))
            keys, marks = (np.asarray(column(batch, c)) for c in ("k", "y"))
            for i, j in groups(offsets):
                own = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                plain = (own.letters + np.uint8(97)).tobytes()
                found: list[list[bytes]] = [[] for _ in own.texts]
                for s, a, n in zip(own.sentences.tolist(), own.starts.tolist(), own.sizes.tolist(), strict=True):
                    found[s].append(plain[a : a + n])
                joined = pa.array([b" ".join(sorted(set(x))) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][own.texts]), pa.array(marks[i:j][own.texts]), joined], ["k", "y", "u"])

    rows = in_arrow(data.select("k", "y", "t"), run, "k long, y int, u binary").groupBy("u").agg(F.min(F.struct("y", "k")).alias("s"))
    rows = written(rows.select("s.k", "s.y", "u", F.xxhash64("u").alias("h")), "sentences")
    pick = lambda which: rows.where(which).orderBy("h", "u").limit(most).collect()
    return [(r["k"], r["y"], bytes(r["u"])) for which in ("y > 0", "y <= 0") for r in pick(which)]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", sentences: int = TRAIN_SENTENCES) -> Machine:
    data = written(labelled(docs, labels, label, modulus, held, rows, key, text), "labelled")
    machine = fit(_sentences(data, sentences))
    marks = _values(data.select("k", "y", "t"), machine, ["k", "y"], "k long, y int").select("y", "x").collect()
    if marks:
        raw, y = np.array([r["x"] for r in marks]), np.array([float(r["y"] > 0) for r in marks])
        order = np.lexsort((y, *raw.T))  # the same sums whatever the tasks
        *slopes, shift = calibrated(raw[order], y[order])
        machine.slopes, machine.shift = tuple(map(float, slopes)), float(shift)
    return machine


def toxicity_scores(docs: DataFrame, machine: Machine, modulus: int = 5, held: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every row's whole text.

    A null text counts as empty and gets a score too; a null key is never held out; repeated rows, empty tables and
    other columns do no harm, and equal texts have equal scores. Without labels, or with one label only, every score is
    the same.
    """
    integral(docs, key)
    scored = _values(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), machine, ["k"], "k long")
    raw = sum((F.col("x")[k] * slope for k, slope in enumerate(machine.slopes)), F.lit(machine.shift))
    score = 1 / (1 + F.exp(-raw))
    held_out = F.coalesce(F.pmod(crc_text("k"), F.lit(modulus)) == held, F.lit(False))
    return scored.select(F.col("k").alias(key), held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
