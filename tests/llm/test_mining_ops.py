"""Hard negatives, periodic runs and SimHash against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from evidara.llm import hard_negatives, periodic_runs, simhash
from evidara.operators import components

SF = "/root/testdata/sf0.001"


def brute_mine(rows, every=100, k=5):
    """rows: (id, vector or None, label or None), as contract says."""
    kept = []
    for n, (i, x, label) in enumerate(rows):
        if i is not None and label is not None and x and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, n, label, [math.floor(256 * v) for v in x]))
    out = []
    for i, n, label, a in kept:
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, x, strict=True)), j, m, own) for j, m, own, x in kept if m != n)
        for s, j, _, _ in [r for r in scored if r[3] == label][:k]:
            fits = [r for r in scored if r[3] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(i, j, rank, r[1], -s, -r[0]) for rank, r in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "wave"), [(8192, 2048), (40, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, wave):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "WAVE", wave)
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=7) * (0.1 if i % 3 else 0.02)).astype("float32").tolist(), int(r.integers(0, 4))) for i in range(400)]
    rows += [(400 + i, rows[17][1], i % 3) for i in range(90)]  # a common vector, so many ties
    rows += [(i, rows[50][1], rows[50][2]) for i in (600, 600, 601, 700)]  # repeated ids, copies of an anchor
    rows += [(800, [0.0] * 7, 1), (801, None, 1), (802, [1.0] * 7, None), (None, [1.0] * 7, 1), (900, [float("nan")] + [0.0] * 6, 1), (803, [None] + [0.0] * 6, 1), (1000, [float("inf")] * 7, 1), (1100, [-0.1] * 7, 2), (804, [], 1)]
    frame = spark.createDataFrame([(i, x, label, "c", 0) for i, x, label in rows], "vec_id long, embedding array<float>, label int, row string, block int")
    got = [tuple(x) for x in hard_negatives.mine(frame.repartition(3)).collect()]
    want = brute_mine(rows)
    assert len(want) > 60 and sorted(got) == want


def test_hard_negatives_without_a_range_of_positives(spark):
    mine = lambda rows: [tuple(x) for x in hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()]
    assert mine([]) == [] and mine([(1, [1.0], 1)]) == [] and mine([(0, [1.0], 1)]) == [] and mine([(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert mine([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.5], 2)]) == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert mine([(0, [1.0], 1), (1, [1e300], 1), (2, [0.0], 1), (3, [0.0], 2)]) == [(0, 2, 1, 3, 0, 0)]  # too large for a long
    assert mine([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.9], 2)]) == [(0, 1, 1, 2, 65536, 256 * 230)]
    with pytest.raises(TypeError):
        hard_negatives.mine(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<float>, label int"))


def test_bounds_hold_every_score():
    r = np.random.default_rng(1)
    for scale in (3, 300, 2**27):
        x = np.rint(r.normal(size=(500, 9)) * scale).astype(np.int64)
        books = hard_negatives.codebooks(x[:100])
        block = hard_negatives.Block.of(x, np.arange(500), np.arange(500), r.integers(0, 3, 500), books, 6)
        assert block.codes.shape == (5, 500)
        for a in x[:20]:
            low, high = block.bounds(a, books, 0, len(block.ids))
            exact = [sum(p * q for p, q in zip(a.tolist(), v, strict=True)) for v in block.x.tolist()]
            assert all(lo <= s <= hi for lo, s, hi in zip(low.tolist(), exact, high.tolist(), strict=True))


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q):
                out.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_row(doc, text, plant):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode())
    if plant and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def run_texts():
    r = random.Random(4)
    texts = [None, "", " \t\n ", "a", "a a a a a", "a a a a a a", "a " * 400, "a b " * 300 + "c", "x\x0by\x0cx y x y x y", "a b " * 9, "é ü " * 5, "A a " * 7]
    for n in (5, 8, 12, 40, 200, 1500):
        for letters in ("ab", "abc", "abcdefghijkl"):
            texts.append(" ".join(r.choice(letters) for _ in range(n)))
    for _ in range(25):  # nested: runs of runs
        unit = [r.choice("abcd") for _ in range(r.randrange(1, 5))] * r.randrange(1, 8) + [r.choice("xyz")]
        texts.append(" ".join([r.choice("abc") for _ in range(r.randrange(6))] + (unit * 9)[: r.randrange(4, 9 * len(unit))] + [r.choice("abx") for _ in range(r.randrange(6))]))
    bits = "a"
    for _ in range(11):  # Thue and Morse: its halves hash alike under weak prefix hashes
        bits += bits.translate(str.maketrans("ab", "ba"))
    return [*texts, " ".join(bits), " ".join(bits * 4)[: 2 * 4096 * 4], *(" ".join(f"w{r.randrange(50)}" for _ in range(30)) for _ in range(60))]


@pytest.mark.parametrize("places", [1 << 20, 50])
def test_periodic_runs_equal_brute_force(spark, monkeypatch, places):
    monkeypatch.setattr(periodic_runs, "PLACES", places)
    texts = run_texts() if places > 50 else run_texts()[:-62]
    rows = [*enumerate(texts), (0, texts[10]), (None, "b " * 40), (-10, "a b c " * 30)]
    frame = spark.createDataFrame([(d, t, 1, [1]) for d, t in rows], "doc_id long, text string, k int, runs array<int>").repartition(2)
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(frame)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute_row(d, t, True) for d, t in rows), key=repr)


def test_runs_of_a_small_table_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(docs)))
    want = [brute_row(r.doc_id, r.text if len((r.text or "").split()) < 2000 else None, True) for r in docs.collect()]
    short = {r.doc_id for r in docs.collect() if len((r.text or "").split()) < 2000}
    assert len(short) > 150 and sorted(tuple(r) for r in got.collect() if r.doc_id in short) == sorted(w for w in want if w[0] in short)
    assert sum(w[1] for w in want) > 10


def test_a_weak_hash_is_found_out_and_replaced(monkeypatch):
    r = np.random.default_rng(0)
    ids, firsts = r.integers(0, 3, 600), np.array([0, 0, 200, 600])
    want = periodic_runs.runs_of(ids, firsts)
    whole, tried = periodic_runs.Prefix, []

    class Weak(whole):
        def __init__(self, ids, attempt):
            tried.append(attempt)
            super().__init__(ids if attempt > 2 else ids % 2, attempt)

    monkeypatch.setattr(periodic_runs, "Prefix", Weak)
    assert np.array_equal(periodic_runs.runs_of(ids, firsts), want) and tried == [0, 1, 2, 3]


def test_periodic_runs_of_nothing(spark):
    got = periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == 0


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """prints: (doc, fingerprint) -> the smallest doc of each class, by fingerprint."""
    kinds = sorted({f for _, f in prints})
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for f in kinds}


@pytest.mark.parametrize("tile", [8192, 3])
def test_simhash_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    monkeypatch.setattr(components, "ONE_TASK", 1 << 20 if tile > 3 else 0)
    r = random.Random(2)
    say = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts = [None, "", "  ", " ", "a", "A", "a b c", "a b c d", "a  b\tC d", "É é É é"]
    for n in (40, 300, 300, 900):
        base = say(n)
        for _ in range(12 if tile > 3 else 6):
            own = list(base)
            own[r.randrange(n)] = "other"
            texts.append(" ".join(own))
    rows = [*enumerate(texts), (3, texts[-1]), (None, texts[-1]), (None, "all alone here"), (None, "all alone here"), (-5, "a b c")]
    frame = spark.createDataFrame([(d, t, 1, "g") for d, t in rows], "doc_id long, text string, f int, g string").repartition(3)
    got = sorted(map(tuple, simhash.near_duplicates(frame).collect()), key=repr)
    prints = [(d, brute_print(t)) for d, t in rows]
    want = brute_classes(prints)
    assert got == sorted(((d, f"{f:016x}", want[f]) for d, f in prints), key=repr)
    assert len(set(want.values())) < len(set(f for _, f in prints))


@pytest.mark.parametrize("strip", [32, 3])
def test_forest_connects_what_all_links_connect(strip, monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", strip)
    r = random.Random(7)
    for _ in range(40):
        pool = [r.getrandbits(64) for _ in range(6)]
        near = lambda f: f ^ sum(1 << b for b in r.sample(range(64), r.randrange(5)))
        both = list(dict.fromkeys(near(near(r.choice(pool))) for _ in range(r.randrange(1, 70))))
        cut = r.randrange(len(both) + 1)
        for a, b in ((both, None), (both[:cut], both[cut:])):
            links = simhash.forest(np.array(a, np.uint64), None if b is None else np.array(b, np.uint64), 4)
            assert len(links) < max(1, len(both)) and all((both[i] ^ both[j]).bit_count() <= 4 for i, j in links)
            inside = lambda i, j: (i < cut) != (j < cut) if b is not None else True  # noqa: E731, B023
            every = [(i, j) for i in range(len(both)) for j in range(i) if inside(i, j) and (both[i] ^ both[j]).bit_count() <= 4]
            label = lambda edges: components.labels_of(*(np.array([*(e[c] for e in edges), *range(len(both))], np.int64) for c in (0, 1)))[1].tolist()
            assert label(links) == label(every)


def test_simhash_of_nothing(spark):
    got = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0
