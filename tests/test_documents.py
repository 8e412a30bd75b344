import gzip
import hashlib
import json
import os
import subprocess

import pytest

from evidara.sources import artifacts, documents

PAGES = [
    ("index.md", "---\nsummary: start\nstatus: current\n---\n# Home\n[one](notes/index.md) [web](https://x.y/z.md) [one again](notes/index.md#top)\n"),
    ("notes/index.md", "# Notes\n[a](a-page.md) [up](../index.md) [lost](gone.md)\n"),
    ("notes/a-page.md", "no heading\n- [ ] **B7: later** do `it` [now](x)\n~~~\n- [x] not this\n[nor](this.md)\n~~~\n- [X] Ｄone   Task\n"),
    ("notes/far.md", "# Far\n"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "path string, content string")


def test_nodes_and_edges(pages):
    got = {r.path: r for r in documents.nodes(pages).collect()}
    assert (got["index.md"].title, got["index.md"].summary, got["index.md"].status, got["index.md"].branch) == ("Home", "start", "current", "root")
    assert (got["notes/a-page.md"].title, got["notes/a-page.md"].status, got["notes/a-page.md"].branch) == ("a page", "unknown", "notes")
    assert {tuple(r) for r in documents.edges(pages).collect()} == {("index.md", "notes/index.md"), ("notes/index.md", "notes/a-page.md"), ("notes/index.md", "index.md"), ("notes/index.md", "notes/gone.md")}
    tree = {("index.md", "notes/index.md"), ("notes/index.md", "notes/a-page.md"), ("notes/index.md", "notes/far.md")}
    assert {tuple(r) for r in documents.graph(pages).collect()} == {(*e, "hierarchy") for e in tree}
    assert {tuple(r) for r in documents.faults(pages).collect()} == {("notes/index.md", "dead_link"), ("notes/far.md", "unreached")}
    assert [r.address for r in documents.sources(pages).collect()] == ["https://x.y/z.md"]
    assert documents.manifest(pages).first().pages == 4 and documents.manifest(pages).first() == documents.manifest(pages.orderBy("content")).first()


def test_tasks(pages):
    rows = {r.title: r for r in documents.tasks(pages).collect()}
    assert set(rows) == {"B7: later", "Ｄone   Task"} and rows["B7: later"].id == "notes/a-page.md#B7" and rows["Ｄone   Task"].done
    assert rows["Ｄone   Task"].id.endswith("title-" + hashlib.sha256(b"done task").hexdigest()[:16])
    assert documents.ambiguous(documents.tasks(pages).union(documents.tasks(pages))).count() == 2
    found = documents.matching(documents.tasks(pages), " TASK ", done=True)
    assert [r.title for r in found.collect()] == ["Ｄone   Task"] and documents.matching(documents.tasks(pages), "task", done=False).count() == 0


def test_codes_need_a_mark_and_images_are_no_links(spark):
    lines = ["AI2 model card", "T12345 — far", "AB1-x", "X9: y", "ABCDE1: no", "t1: no", "Q2 : z"]
    pages = spark.createDataFrame([("a.md", "\n".join(f"- [ ] {x}" for x in lines) + "\n![pic](b.md) [see](c.md) [](d.md)")], "path string, content string")
    assert {r.title: r.code for r in documents.tasks(pages).collect()} == dict(zip(lines, [None, "T12345", "AB1", "X9", None, None, "Q2"], strict=True))
    assert [tuple(r) for r in documents.edges(pages).collect()] == [("a.md", "c.md")]


def test_task_lifecycle(spark):
    snaps = spark.createDataFrame([(1, "t", False), (2, "t", True), (3, "t", False), (3, "u", False), (4, "u", False), (5, "t", False), (5, "u", False)], "seq long, id string, done boolean")
    found = documents.events(snaps)
    assert {(r.seq, r.id, r.kind) for r in found.collect()} == {(1, "t", "first_recorded"), (2, "t", "closed"), (3, "t", "reopened"), (4, "t", "removed"), (5, "t", "reintroduced"), (3, "u", "first_recorded")}
    empty = spark.createDataFrame([(6,), *((i,) for i in range(1, 6))], "seq long")
    assert documents.events(snaps, empty).where("seq = 6 and kind = 'removed'").count() == 2
    now = spark.createDataFrame([("t", True), ("n", False)], "id string, done boolean")
    assert {r.id: (r.status, r.pending) for r in documents.history(found, now).collect()} == {"t": ("completed", False), "u": ("removed", True), "n": ("open", True)}
    assert documents.unseen(found, found.where("id = 't'")).count() == 1
    status = {"first_recorded": "open", "closed": "completed", "reopened": "open", "removed": "removed", "reintroduced": "open"}
    rows = [(r.seq, r.id, r.kind, status[r.kind]) for r in found.collect()]
    kind = "seq long, id string, kind string, status string"
    assert documents.illegal(spark.createDataFrame(rows, kind)).isEmpty()
    assert {(r.seq, r.id) for r in documents.illegal(spark.createDataFrame([r for r in rows if r[0] != 2] + [(3, "u", "closed", "completed")], kind)).collect()} == {(3, "t"), (3, "u")}


def test_git_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    for text in ("# A\n- [ ] one\n", "# A\n- [x] one\n", None):
        if text:
            (tmp_path / "a.md").write_text(text)
        else:
            os.unlink(tmp_path / "a.md")
            (tmp_path / "b.txt").write_text("x")
        run("add", "-A")
        run("commit", "-qm", "c")
    commits, found = documents.git_snapshots(spark, str(tmp_path))
    assert commits.count() == 3 and [r.seq for r in found.orderBy("seq").collect()] == [0, 1]
    tasks = documents.tasks(found.where("seq = 0")).selectExpr("0L as seq", "id", "done").union(documents.tasks(found.where("seq = 1")).selectExpr("1L as seq", "id", "done"))
    assert [r.kind for r in documents.events(tasks, commits.select("seq")).orderBy("seq").collect()] == ["first_recorded", "closed", "removed"]
    notes = found.selectExpr("seq", "path as id", "sha2(content, 256) as sha")
    assert [r.kind for r in documents.note_events(notes, commits.select("seq")).orderBy("seq").collect()] == ["note_added", "note_updated", "note_removed"]


def test_strict_json_and_pins(tmp_path):
    for bad in (b'{"a": 1, "a": 2}', b"[NaN]", b"[Infinity]"):
        with pytest.raises(ValueError):
            artifacts.strict(bad)
    at = tmp_path / "m.json.gz"
    at.write_bytes(gzip.compress(b'{"rows": [1, 2]}'))
    assert artifacts.pinned(str(at), artifacts.file_hash(str(at))) == {"rows": [1, 2]}
    for sha, expanded in (("0" * 64, 100), (artifacts.file_hash(str(at)), 5)):
        with pytest.raises(ValueError):
            artifacts.pinned(str(at), sha, expanded=expanded)


def test_archive(spark, tmp_path):
    source, target = tmp_path / "live", tmp_path / "kept"
    source.mkdir()
    spark.range(5).write.parquet(str(source / "polls.parquet"))
    view = artifacts.Snapshot(spark, str(source))
    done = artifacts.archive(str(source), str(target), ("polls",), {"mode": "public"})
    assert spark.read.parquet(f"{done['path']}/polls.parquet").count() == 5 and json.load(open(f"{done['path']}/manifest.json"))["config"] == {"mode": "public"}
    spark.range(7).write.mode("append").parquet(str(source / "polls.parquet"))
    assert view.table("polls").count() == 5
    status = str(tmp_path / "status.json")
    assert artifacts.archive_status(status, lambda: done)["state"] == "ok"
    full = artifacts.archive_status(status, lambda: artifacts.archive(str(source), str(target), ("polls",), {}, most_archives=1))
    assert full["state"] == "error" and full["last_success"]["created_at"] == done["created_at"]
    (source / "stray.txt").write_text("x")
    with pytest.raises(ValueError):
        artifacts.archive(str(source), str(target), ("polls",), {})
    for inside in (source, source / "polls.parquet", tmp_path):
        with pytest.raises(ValueError):
            artifacts.guard(str(source), str(inside))


def test_claims():
    doc = {"rows": [{"k": "a", "n": 3}, {"k": "b", "n": 5}], "at": "2024-03-01T23:30:00-05:00", "x/y": [0.5], "z": [2]}
    get = lambda p: {"artifact": "d", "pointer": p}
    plucked = {"op": "pluck", "value": get("/rows"), "field": "n"}
    expressions = {
        "len": ({"op": "len", "value": get("/rows")}, 2), "sum": ({"op": "sum", "value": plucked}, 8), "max": ({"op": "max", "value": plucked}, 5), "ratio": ({"op": "ratio", "numerator": get("/rows/0/n"), "denominator": {"literal": 4}}, 0.75),
        "filter": ({"op": "len", "value": {"op": "filter", "value": get("/rows"), "where": {"k": {"literal": "b"}}}}, 1), "year": ({"op": "date_part", "value": get("/at"), "part": "year"}, 2024), "month": ({"op": "date_part", "value": get("/at"), "part": "month_name"}, "March"),
        "series": ({"op": "constant_series_count", "values": [get("/x~1y"), get("/z")]}, 2), "text": ({"op": "format", "template": "{n:Words} of {share:.1f}", "values": {"n": get("/rows/1/n"), "share": get("/x~1y/0")}}, "Five of 0.5"),
    }
    claims = [{"id": k, "value": v, "expression": e} for k, (e, v) in expressions.items()]
    assert artifacts.checked_claims(claims, {"d": doc}) == []
    wrong = [{"id": "len", "value": 3, "expression": expressions["len"][0]}, {"id": "p", "value": 1, "expression": get("/none")}, {"id": "p", "value": 1, "expression": {"op": "eval"}}, {"id": "b", "value": 1, "expression": {"literal": True}}]
    assert [w.split(":")[0] for w in artifacts.checked_claims(wrong, {"d": doc}, {"d": "0" * 64}, {"d": b"x"})] == ["d", "len", "p", "p", "p", "b"]
    assert artifacts.uncovered(claims, "d", {"rows": [], "free": 3}) == ["/free"]
