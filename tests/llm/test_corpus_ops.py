import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from evidara.llm import boosting, html_text, jaccard_join, permutation_index, quality, toxicity, warc
from evidara.operators import components

SF = "/root/testdata/sf0.001"


def brute_classes(texts):
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    holders = collections.defaultdict(list)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        common = collections.Counter(e for t in sets[d] for e in holders[t])
        for e, n in common.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
        for t in sets[d]:
            holders[t].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    texts = [None, "", "  ", "a b", "A B", "a b c d e", "a b c d e f"]
    for n in [3, 5, 6, 20, 60, 120] * 4 + [150]:
        base = say(n)
        for _ in range(r.choice([1, 2, 3]) if n != 150 else 90):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(words)
            texts.append(" ".join(own))
    passage = say(50)
    texts += [" ".join(say(r.randrange(3, 40)) + passage + say(r.randrange(20))) for _ in range(50)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, one_task):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 20)
    monkeypatch.setattr(jaccard_join, "BUCKET", 16)
    monkeypatch.setattr(jaccard_join, "SKETCH_BITS", 10)
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    texts = corpus()
    rows = spark.createDataFrame([(d, t, "k", "t") for d, t in texts] + [(0, texts[0][1], "k", "t"), (None, "a b", "k", "t")], "doc_id long, text string, k string, sid string")
    got = jaccard_join.near_duplicates(rows).collect()
    want = brute_classes(texts)
    assert len(got) == len(texts) + 2 and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]


@pytest.mark.parametrize("part", [2000, 7])
def test_links_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard_join, "PART_SETS", part)
    texts = corpus()
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    want = {d: sum(e != d and bool(own) and 100 * len(own & x) >= 80 * len(own | x) for e, x in sets.items()) for d, own in sets.items()}
    rows = spark.createDataFrame([*texts, texts[0], (None, "a b")], "doc_id long, text string")
    got = {(r.doc_id, r.n_links) for r in jaccard_join.near_duplicates(rows).collect()}
    assert max(want.values()) > 20 and got == {*want.items(), (None, None)}


def test_weights_of_sparse_and_dense_sets():
    r = np.random.default_rng(1)
    for top in (40, 100_000):
        sets = [np.unique(r.integers(0, top, 30)).astype(np.uint64) for _ in range(40)]
        sets += [np.append(s, np.uint64(top + 1)) for s in sets[:20]]
        copies = r.integers(1, 5, 60)
        near = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets]) & ~np.eye(60, dtype=bool)
        assert (jaccard_join.weights(sets, copies, 80) == near @ copies).all()
        side = np.arange(60) < 40
        assert (jaccard_join.weights(sets, copies, 80, 40) == (near & (side[:, None] != side)) @ copies).all()


def test_near_duplicates_of_nothing(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(0)
    for _ in range(60):
        base = r.integers(0, 1 << 62, r.integers(3, 400)).astype(np.uint64)
        sets = []
        for _ in range(6):
            own = base.copy()
            own[: r.integers(0, max(1, len(own) // 6))] = r.integers(0, 1 << 62)
            sets.append(np.unique(own))
        exact, loose = jaccard_join.linked(sets, 80), jaccard_join.plausible(np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets], 80)
        assert all(loose[i] == loose[exact[i]] for i in range(len(sets)))


def test_warc_salvage_recovers_after_damage():
    pages = [b"<p>%d</p>" % i * 50 for i in range(20)]
    members = [warc.member(warc.response(str(i), "u", "d", p, warc.payload_digest(p))) for i, p in enumerate(pages)]
    starts = np.cumsum([0, *map(len, members)])
    data = bytearray(b"".join(members))
    data[starts[3] + 40] ^= 255
    data[starts[7]] = 0
    found = list(warc.salvage(bytes(data)))
    assert [r.headers["x-page-id"] for r in found if isinstance(r, warc.Record)] == [str(i) for i in range(20) if i not in (3, 7)]
    assert [(g[0], g[1]) for g in found if not isinstance(g, warc.Record)] == [(starts[i], len(members[i])) for i in (3, 7)]
    plain = b"".join(warc.response(str(i), "u", "d", p, warc.payload_digest(p)) for i, p in enumerate(pages))
    broken = plain.replace(b"<p>5</p>", b"<p>X</p>", 1)[:-30]
    ids = [r.headers["x-page-id"] for r in warc.salvage(broken) if isinstance(r, warc.Record)]
    assert ids == [str(i) for i in range(19) if i != 5] and list(warc.salvage(b"")) == [] and [g[:2] for g in warc.salvage(b"junk")] == [(0, 4)]


def test_warc_salvage_inside_members():
    r = random.Random(2)
    pages = [bytes(r.randrange(256) for _ in range(3000)) for _ in range(30)]
    records = [warc.response(str(i), "u", "d", p, warc.payload_digest(p)) for i, p in enumerate(pages)]
    ids = lambda data: [int(x.headers["x-page-id"]) for x in warc.salvage(data) if isinstance(x, warc.Record)]
    gaps = lambda data: [x for x in warc.salvage(data) if not isinstance(x, warc.Record)]
    for bad in (0, 4, 29):
        broken = [x.replace(b"\r\n\r\n", b"\r\n\r\n?", 1) if i == bad else x for i, x in enumerate(records)]
        one = warc.member(b"".join(broken))
        assert ids(one + warc.member(records[0])) == [*(i for i in range(30) if i != bad), 0]
        assert [g[:2] for g in gaps(one)] == [(0, len(broken[bad]))]
    whole = warc.member(b"".join(records))
    assert ids(whole[:-4] + b"none" + warc.member(records[5])) == [*range(30), 5]  # the member's CRC and length are wrong
    cut = ids(whole[: len(whole) // 2])
    assert cut == list(range(len(cut))) and len(cut) >= 13 and sum(g[1] for g in gaps(whole[: len(whole) // 2])) == len(whole) // 2
    assert ids(warc.member(b"".join(records), 0)[:-4] + b"none") == list(range(30))  # stored as they are
    hurt = bytearray(warc.member(b"".join(records), 1) + warc.member(records[7]))
    hurt[20_000:20_040] = b"\xff" * 40
    kept = ids(bytes(hurt))
    assert kept[-1] == 7 and kept[:-1] == list(range(len(kept) - 1)) and len(kept) > 4


@pytest.mark.parametrize("smallest", [0, 5])
def test_warc_round_trip(spark, smallest):
    rows = [(4, "u", "same page é", "x"), (2, "u", "same page é", "x"), (9, None, "same page é", "x"), (5, "u", None, "x"), (6, "u", "", "x"), (7, "u", "abc", "x"), (8, "u", "abc", "x"), (None, "u", "abc", "x")]
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), smallest).collect())
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        first = min((j for j, _, x, _ in rows if j is not None and (x or "") == (h or "")), default=None)
        again = i is not None and first < i and len(raw) >= smallest
        want.append((i or -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=lambda x: x[0])


def test_html_blocks_and_labels():
    model = html_text.train(500, 5)
    data = html_text._grammar(200, 77)
    labels = html_text.labelled([html_text.blocks(p) for p, _ in data], model)
    wrong = sum(bool(a) != bool(b) for (_, want), got in zip(data, labels, strict=True) for a, b in zip(want, got, strict=True))
    assert wrong < 0.04 * sum(len(w) for _, w in data)
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Big  Title</h1><p><b>One &amp; two,\n three.<br><p>Second para, with words.</article><footer>&copy; me. All rights.</footer><script>var t='</p>'</script>"
    assert html_text.main_text([page, "", "<p>"], model) == ["Big Title\n\nOne & two, three.\n\nSecond para, with words.", "", ""]
    assert html_text.blocks("<p>" * 5000 + "<a \"" * 2000 + "<!--") is not None


def test_html_reads_everything():
    of = lambda page: html_text.vectors(html_text.blocks(page))[0]
    words = html_text.PATH, html_text.PATH + html_text.WORDS
    long = "word " * 60
    assert (of(f"<p>{long}{'other ' * 40}")[slice(*words)] != of(f"<p>{long}{'third ' * 40}")[slice(*words)]).any()
    assert [b.text for b in html_text.blocks("<object>" + "<div>" * 300 + "</object><p>seen")] == ["seen"]
    eight = "aa bb cc dd ee ff gg hh"
    assert (of(f'<p class="{eight} comment">x') != of(f'<p class="{eight}">x')).any()
    assert (of("<div>" * 30 + "<nav>" + "<div>" * 30 + "x") != of("<div>" * 30 + "<aside>" + "<div>" * 30 + "x")).any()
    page = f'<p>a</p><img src="{"d" * 70_000}"><p title="x > y">b</p>'
    assert [b.text for b in html_text.blocks(page)] == ["a", "b"]


def test_html_nulls(spark):
    rows = spark.createDataFrame([(1, "u", None), (None, None, "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_text.extract(rows, html_text.Labeller(html_text.PATH + html_text.WORDS + html_text.NUMBERS)).collect()] == [("", 0)] * 2


def test_boosting_learns_and_survives_one_class():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert np.mean((model.score(x[2000:]) >= 0.5) == y[2000:]) > 0.93
    assert len(set(boosting.fit(x, np.ones(3000)).score(x))) == 1 and len(boosting.fit(x[:0], y[:0]).score(x)) == 3000


@pytest.mark.parametrize("train, score, label, modulus, held, least", [(quality.train, quality.quality_scores, "quality", 3, 1, 0.95), (toxicity.train, toxicity.toxicity_scores, "toxic", 5, 0, 0.9)])
def test_classifiers_on_held_out_rows(spark, train, score, label, modulus, held, least):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train(docs, labels)
    rows = score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[label] for r in own]) > least and all(0 <= r.score <= 1 for r in rows)
    odd = score(spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1)], "doc_id long, text string, x int"), model).collect()
    assert len(odd) == 3 and all(r.score is not None and not math.isnan(r.score) for r in odd)


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, quality.train(docs, none)).count() == 1
    assert toxicity.toxicity_scores(docs, toxicity.train(docs, none)).count() == 1


def test_string_kernel_is_the_sum_over_subsequences():
    import itertools

    def plain(s, t):
        s, t = [f"^{w}$" for w in (s, t)]
        total = 0.0
        for a in itertools.combinations(range(len(s)), toxicity.ORDER):
            for b in itertools.combinations(range(len(t)), toxicity.ORDER):
                if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    words = ["idiot", "idxiot", "loser", "idiocy"]
    got = toxicity.kernels([w.encode() for w in words], [w.encode() for w in words])
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert math.isclose(got[i, j], plain(s, t) / math.sqrt(plain(s, s) * plain(t, t)), rel_tol=1e-4)


def brute_sentences(text):
    """Sentences of simple ASCII text as sets of units: what the module reads, said plainly."""
    out = []
    for sentence in re.split(r"[.?!](?=\s|$)|\n", text.lower()):
        words = [re.sub("[^a-z]", "", w.translate(str.maketrans("0134578@$!", "oieastbasi"))) for w in sentence.split()]
        words = [w for w in words if w]
        run, own = [], []
        for w in [*words, "xx"]:
            if len(w) == 1:
                run.append(w)
                continue
            own += ["".join(run)] if len(run) > 2 else []
            run = []
        own += words
        out.append({w[a : a + toxicity.LONGEST] for w in own for a in (range(0, max(1, len(w) - toxicity.LONGEST + toxicity.STRIDE), toxicity.STRIDE))})
    return [x for x in out if x]


def test_folded_values_equal_sums_of_kernels():
    r = random.Random(1)
    bad = ["grumpel", "snork", "blathero"]
    say = lambda: [r.choice(["alma", "bero", "cint", "dorun", "ester", "fanli"]) + r.choice(["a", "o", "us", "ent"]) for _ in range(6)]
    rows = []
    for t in range(120):
        for _ in range(4):
            words = say()
            if t % 3 == 0 and r.random() < 0.6:
                words[2] = r.choice(bad)
            rows.append((t, int(t % 3 == 0), " ".join(sorted(set(words))).encode()))
    machine = toxicity.fit(rows, 24)
    texts = ["alma snork, bero! g r u m p e l Sn0rk. cint", "", "a. b", "grum-pel estera? blathero " + "abcdefghij" * 5, "grxumpel dorunus ester", "кретин дурак 日本語"]
    scorer = toxicity.Scorer(machine)
    data = [t.encode() for t in texts]
    got = scorer.best(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for text, own in zip(texts[:5], got, strict=False):
        want = []
        for sentence in brute_sentences(text):
            words = [w.encode() for w in sorted(sentence) if len(w) > 1]
            want.append(machine.bias + (toxicity.kernels(words, machine.landmarks).sum(0) @ machine.alphas if words else 0.0))
        want = sorted(want, reverse=True)[: toxicity.TOP]
        assert np.allclose(own, want + [machine.bias] * (toxicity.TOP - len(want)), atol=1e-3)
    assert got[0, 0] > 0 and got[4, 0] > got[2, 0] and len(set(got[5])) > 1  # other scripts have letters
    assert (toxicity.Scorer(machine).best(np.frombuffer(data[0] * 2, np.uint8), np.array([0, len(data[0]), 2 * len(data[0])])) == got[0]).all()  # repeated rows


def test_units_of_long_texts_and_bad_bytes():
    piece = (b"word " * 1000 + b"x" * 5000 + b". " + bytes(range(128, 256)) + b"\n") * 20
    own = toxicity.units(np.frombuffer(piece, np.uint8), np.array([0, 0, len(piece), len(piece)]))
    assert set(own.texts.tolist()) == {1} and own.sizes.max() == toxicity.LONGEST and np.bincount(own.sentences).max() <= toxicity.PIECE
    assert len(toxicity.units(np.zeros(0, np.uint8), np.array([0])).starts) == 0


def recall(rows, spark):
    data = rows.toPandas().sort_values("vec_id")
    ids, x = data.vec_id.values, np.array(data.embedding.tolist(), float)
    hit = total = 0
    for query, own in permutation_index.nearest(rows).toPandas().groupby("query_id"):
        i = np.flatnonzero(ids == query)[0]
        value = x @ x[i]
        value[i] = -9
        assert sorted(own["rank"]) == list(range(1, 21)) and query not in set(own.vec_id)
        hit += len(set(ids[np.argsort(-value, kind="stable")[:20]]) & set(own.vec_id))
        total += 20
    return hit / total


@pytest.mark.parametrize("table, block", [("sf0.01", 16_384), ("sf0.1", 16_384), ("sf0.1", 700), ("made", 16_384), ("made", 4_096)])
def test_nearest_has_recall(spark, monkeypatch, table, block):
    monkeypatch.setattr(permutation_index, "BLOCK", block)
    if table == "made":
        x = np.random.default_rng(3).normal(size=(10_000, 64))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        rows = spark.createDataFrame([(17 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    else:
        rows = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    assert recall(rows, spark) >= 0.9


def test_footrule_is_that_of_the_orders():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8))
    top = float((x * x).sum(1).max())
    index = permutation_index.Block(np.arange(300), np.arange(300), x, permutation_index.lifted(x[:100], top), top)
    near = index.permutation(permutation_index.lifted(index.x, top))
    place = lambda order, pivot: order.index(pivot) if pivot in order else index.prefix
    got, own = index.footrule(near[5]), near[5].tolist()
    for i in range(0, 300, 7):
        other = near[i].tolist()
        want = sum(abs(place(own, p) - place(other, p)) for p in {*own, *other})
        assert 2 * got[i] + index.prefix * (index.prefix + 1) == want


def test_nearest_breaks_ties_by_id_and_takes_odd_rows(spark):
    odd = [(1, None), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (20, [1.0, 2.0]), (40, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [3.0, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [1.0, None])]
    ask = lambda rows: [tuple(r) for r in permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, row string, e string")).orderBy("query_id", "rank", "vec_id").collect()]
    wide = lambda rows: [(*r, "id", "row", "e") for r in rows]
    assert [r[:3] for r in ask(wide(odd))] == [(20, 1, 4), (20, 2, 5), (20, 3, 40), (40, 1, 4), (40, 2, 5), (40, 3, 20)]
    # Rows of a repeated id are candidates each, and queries each.
    assert ask(wide([(20, [1.0, 0.0]), (3, [5.0, 0.0]), (3, [9.0, 0.0])])) == [(20, 1, 3, 9.0), (20, 2, 3, 5.0)]
    assert ask(wide([(20, [1.0, 0.0]), (20, [2.0, 0.0]), (20, [2.0, 0.0])])) == [(20, 1, 20, 2.0), (20, 1, 20, 4.0), (20, 1, 20, 4.0), (20, 2, 20, 2.0), (20, 2, 20, 2.0), (20, 2, 20, 2.0)]
    assert ask([]) == ask(wide([(1, [1.0, 2.0])])) == ask(wide([(20, [1.0, 2.0])])) == []


def test_warc_of_no_partition_and_gap_log(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == warc.round_trip(none.where("false")).count() == 0
    at, good = tmp_path / "in", warc.response("1", "u", "d", b"<p>x</p>", warc.payload_digest(b"<p>x</p>"))
    at.mkdir()
    (at / "a.warc.gz").write_bytes(warc.member(good) + b"junk between" + warc.member(good.replace(b"<p>x", b"<p>y")) + warc.member(good))
    records, gaps = warc.salvaged(spark, str(at), str(tmp_path / "out"))
    assert records.count() == 2 and [(r.offset, r.length > 12) for r in gaps.collect()] == [(len(warc.member(good)), True)]
    with pytest.raises(TypeError):
        warc.round_trip(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"))


def test_text_keys_are_refused(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    for f in (lambda: jaccard_join.near_duplicates(docs), lambda: quality.quality_scores(docs, boosting.fit(np.zeros((0, 1)), np.zeros(0))), lambda: toxicity.toxicity_scores(docs, toxicity.fit([])), lambda: permutation_index.nearest(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))):
        with pytest.raises(TypeError):
            f()


def test_classifiers_with_ties_and_clashing_columns(spark):
    rows = [(1, "same words here", 5, "k", "t", "x"), (1, "same words here", 6, "k", "t", "x"), (2, "same words here", 7, None, None, None), (3, "very long " * 60_000, 8, "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, y int, k string, t string, x string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(1, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for train, score in ((quality.train, quality.quality_scores), (toxicity.train, toxicity.toxicity_scores)):
        got = score(docs, train(docs, labels)).collect()
        assert len(got) == 4 and len({r.score for r in got if r.doc_id < 3}) == 1 and score(docs.where("false"), train(docs, labels)).count() == 0


def test_quality_scores_equal_walking_every_tree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, model).collect()}
    for r in docs.limit(40).collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        alone = float(model.score(quality.statistics(data, np.array([0, len(data)])))[0])
        assert math.isclose(got[r.doc_id], alone, abs_tol=1e-12)


def test_html_of_odd_rows(spark):
    model = html_text.train(200, 2)
    page = "<article><h1>Title</h1><p>One sentence, two.</p></article>"
    deep = "<div>" * 20_000 + "<p>end</p>"
    rows = [(1, "u", page, "k", "t"), (1, "u", page, "k", "t"), (2, None, "x" * 500_000, None, None), (None, "v", deep, "", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, k string, t string"), model).collect()
    same = [r.text for r in got if r.page_id == 1]
    assert len(got) == 4 and same[0] == same[1] and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, tmp_path, stage):
    import corpus_pipeline

    for name, rows, kind in (("labels", [(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None)], "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, _key string, row string, k string, t string"
    texts = ["mail me at a.b@example.com now", None, "", "alpha beta gamma delta epsilon zeta eta theta iota kappa and more", "plain words only here", "word " * 50_000]
    rows = [(i, x, "en", None, len(x or ""), f"key{i}", "row", None, "t") for i, x in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4], (None, "no id at all", None, None, None, None, None, None, None)], kind)
    _, run = corpus_pipeline.STAGES[stage]
    got = run(spark, docs, str(tmp_path))
    if stage < 4:
        assert got.columns == docs.columns
        kept = got.collect()
        assert sum(r.doc_id is None for r in kept) == 1 and all(r._key == f"key{r.doc_id}" and r.row == "row" for r in kept if r.doc_id is not None)
        assert stage not in (2, 3) or {r.doc_id for r in kept} == ({0, 1, 2, 4, 5, None} if stage == 2 else {0, 1, 2, 3, 4, 5, None})
        assert stage != 3 or {r.doc_id: (r.text or "")[:20] for r in kept}[0] == "mail me at [EMAIL] n"
        assert sum(r.doc_id == 4 for r in kept) in (0, 2)
    else:
        assert got.count() == docs.count()
    assert run(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_pipeline_keeps_columns_and_cleans(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS) and 0.5 * before < docs.count() <= before
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(not re.search(r"[\w.]+@\w+\.\w", t or "") for _, t in texts)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
