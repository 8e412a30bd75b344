"""Markdown pages as a graph of nodes, links and tasks; changes of pages and tasks between snapshots."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions.analytics import folded

#: Front matter, fences, tasks, links (images are none) and task codes (fixed values).
FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
FENCE = r"(?ms)^(`{3,}|~{3,}).*?^\1\s*$"
TASK = r"(?m)^\s*[-*]\s+\[([ xX])\]\s+(.+)$"
LINK = r"(?<!!)\[([^\]]+)\]\(([^\s)]+)\)"
CODE = r"^([A-Z]{1,4}\d+)\s*[—:-]"
KINDS = ("first_recorded", "closed", "reopened", "removed", "reintroduced")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each page below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    return files.select("path", F.col("content").cast("string").alias("content"))


def body(column: str = "content") -> F.Column:
    """The page without its front matter."""
    return F.regexp_replace(column, FRONT, "")


def without_fences(column: str = "content") -> F.Column:
    return F.regexp_replace(body(column), FENCE, "")


def field(name: str, column: str = "content") -> F.Column:
    """A field of the front matter; null if it isn't there."""
    value = F.regexp_extract(F.regexp_extract(column, FRONT, 1), rf"(?m)^{name}\s*:\s*[\"']?(.*?)[\"']?\s*$", 1)
    return F.nullif(value, F.lit(""))


def nodes(pages: DataFrame, root: str = "") -> DataFrame:
    """path, title (the first heading, else the file's name), summary, branch (the folder below root), status, reviewed, sha."""
    heading = F.nullif(F.regexp_extract(body(), r"(?m)^#[ \t]+(.+?)\s*$", 1), F.lit(""))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*?)(?:\.md)?$", 1), "-", " ")
    below = F.regexp_replace("path", f"^{root}/?" if root else "^", "")
    branch = F.when(below.contains("/"), F.split(below, "/")[0]).otherwise("root")
    return pages.select("path", F.coalesce(heading, name).alias("title"), F.coalesce(field("summary"), F.lit("")).alias("summary"), branch.alias("branch"), F.coalesce(field("status"), F.lit("unknown")).alias("status"), field("reviewed").alias("reviewed"), F.sha2("content", 256).alias("sha"))


def links(pages: DataFrame) -> DataFrame:
    """(path, label, address): links outside fences, in order of the page, each address once."""
    prose = without_fences()
    found = F.arrays_zip(F.regexp_extract_all(prose, F.lit(LINK), 1).alias("label"), F.regexp_extract_all(prose, F.lit(LINK), 2).alias("address"))
    rows = pages.select("path", F.posexplode(found).alias("pos", "l")).select("path", "pos", "l.label", "l.address")
    return rows.groupBy("path", "address").agg(F.min(F.struct("pos", "label")).alias("x")).select("path", "x.label", "address")


def sources(pages: DataFrame) -> DataFrame:
    """(path, label, address) of web addresses."""
    return links(pages).where(F.col("address").rlike("^https?:"))


def _resolved(base: F.Column, target: F.Column) -> F.Column:
    """A relative path from a page's folder, with . and .. taken out."""
    parts = F.split(F.concat(F.regexp_replace(base, "[^/]*$", ""), target), "/")
    start = F.array().cast("array<string>")
    step = lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, start, step), "/")


def edges(pages: DataFrame) -> DataFrame:
    """(path, target): links to other pages, each once; outside addresses are left out."""
    inner = links(pages).where(~F.col("address").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//|^#"))
    plain = F.regexp_replace("address", r"[?#].*$", "")
    return inner.where(plain.rlike(r"\.md$")).select("path", _resolved(F.col("path"), plain).alias("target")).where("path <> target").distinct()


def hierarchy(pages: DataFrame, root: str = "index.md") -> DataFrame:
    """(path, parent): the index that each page but the root hangs on, by folders; parent is null where there is none."""
    folder = F.regexp_replace("path", "[^/]+$", "")
    above = F.when(F.col("path").rlike(r"(^|/)index\.md$"), F.regexp_replace(F.regexp_replace(folder, "/$", ""), "[^/]*$", "")).otherwise(folder)
    rows = pages.where(F.col("path") != root).select("path", F.concat(above, F.lit("index.md")).alias("asked"))
    return rows.join(pages.select(F.col("path").alias("asked"), F.col("path").alias("parent")), "asked", "left").select("path", "parent")


def graph(pages: DataFrame, root: str = "index.md") -> DataFrame:
    """(source, target, kind): hierarchy edges, and reference edges between pages that no hierarchy edge joins."""
    tree = hierarchy(pages, root).where("parent is not null").select(F.col("parent").alias("source"), F.col("path").alias("target"))
    pair = lambda a, b: F.concat_ws("\n", F.least(a, b), F.greatest(a, b))
    known = edges(pages).join(pages.select(F.col("path").alias("target")), "target", "left_semi").select(F.col("path").alias("source"), "target")
    other = known.withColumn("pair", pair("source", "target")).join(tree.select(pair("source", "target").alias("pair")), "pair", "left_anti").select("source", "target")
    return tree.withColumn("kind", F.lit("hierarchy")).unionByName(other.withColumn("kind", F.lit("reference")))


def faults(pages: DataFrame, root: str = "index.md") -> DataFrame:
    """(path, reason): pages without a parent index, links to pages that aren't there, and pages that links don't reach."""
    lost = hierarchy(pages, root).where("parent is null").select("path", F.lit("no_parent").alias("reason"))
    dead = edges(pages).join(pages.select(F.col("path").alias("target")), "target", "left_anti").select("path", F.lit("dead_link").alias("reason")).distinct()
    far = pages.select("path").join(reachable(edges(pages), root), "path", "left_anti").select("path", F.lit("unreached").alias("reason"))
    return lost.union(dead).union(far)


def plain(column: F.Column) -> F.Column:
    """Text without the marks of links, bold and code."""
    for mark in (r"\[([^\]]+)\]\([^\n]*?\)", r"\*\*([^*]+)\*\*", r"`([^`]+)`"):
        column = F.regexp_replace(column, mark, "$1")
    return F.trim(column)


def tasks(pages: DataFrame) -> DataFrame:
    """(path, id, code, title, text, done): identity is the path with the task's code, else with a hash of its folded title."""
    prose = without_fences()
    marks, texts = F.regexp_extract_all(prose, F.lit(TASK), 1), F.regexp_extract_all(prose, F.lit(TASK), 2)
    rows = pages.select("path", F.explode(F.arrays_zip(marks.alias("mark"), texts.alias("text"))).alias("t")).select("path", F.trim("t.text").alias("text"), (F.lower("t.mark") == "x").alias("done"))
    bold = F.regexp_extract("text", r"^\*\*(.+?)\*\*", 1)
    rows = rows.withColumn("title", plain(F.when(bold != "", bold).otherwise(F.col("text"))))
    code = F.nullif(F.regexp_extract("title", CODE, 1), F.lit(""))
    suffix = F.coalesce(code, F.concat(F.lit("title-"), F.substring(F.sha2(folded(F.col("title")), 256), 1, 16)))
    return rows.select("path", F.concat_ws("#", "path", suffix).alias("id"), code.alias("code"), "title", "text", "done")


def ambiguous(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def _changes(rows: DataFrame, seqs: DataFrame, state: str) -> DataFrame:
    """rows (seq, id, state) of snapshots, marked with places, the row before and the row after of each id."""
    order = F.broadcast(seqs.withColumn("place", F.row_number().over(Window.orderBy("seq"))))  # snapshots are few
    w = Window.partitionBy("id").orderBy("place")
    return rows.join(order, "seq").select("seq", "id", state, "place", F.lag("place").over(w).alias("before"), F.lag(state).over(w).alias("was"), F.lead("place").over(w).alias("after"))


def _gone(marked: DataFrame, seqs: DataFrame, kind: str) -> DataFrame:
    last = F.broadcast(seqs.withColumn("gone_at", F.row_number().over(Window.orderBy("seq"))).withColumnRenamed("seq", "gone"))
    return marked.where((F.col("after") > F.col("place") + 1) | F.col("after").isNull()).join(last, F.col("gone_at") == F.col("place") + 1).select(F.col("gone").alias("seq"), "id", F.lit(kind).alias("kind"))


def events(snapshots: DataFrame, seqs: DataFrame | None = None) -> DataFrame:
    """snapshots: (seq, id, done), one row for each task in each snapshot -> (seq, id, kind): first_recorded, closed, reopened,
    removed, reintroduced. seqs: (seq) of all snapshots, where some hold no task."""
    seqs = snapshots.select("seq").distinct() if seqs is None else seqs
    marked = _changes(snapshots, seqs, "done")
    kind = F.when(F.col("before").isNull(), KINDS[0]).when(F.col("place") > F.col("before") + 1, KINDS[4]).when(F.col("done") & ~F.col("was"), KINDS[1]).when(~F.col("done") & F.col("was"), KINDS[2])
    return marked.select("seq", "id", kind.alias("kind")).where("kind is not null").union(_gone(marked, seqs, KINDS[3]))


def note_events(snapshots: DataFrame, seqs: DataFrame | None = None) -> DataFrame:
    """snapshots: (seq, id, sha) of pages -> (seq, id, kind, sha): note_added, note_updated, note_removed."""
    seqs = snapshots.select("seq").distinct() if seqs is None else seqs
    marked = _changes(snapshots, seqs, "sha")
    kind = F.when(F.col("before").isNull() | (F.col("place") > F.col("before") + 1), "note_added").when(F.col("sha") != F.col("was"), "note_updated")
    return marked.select("seq", "id", kind.alias("kind"), "sha").where("kind is not null").unionByName(_gone(marked, seqs, "note_removed").withColumn("sha", F.lit(None).cast("string")))


def illegal(found: DataFrame) -> DataFrame:
    """Events (seq, id, kind, status) that can't follow on the one before in their task, or of which a task has two at once."""
    w = Window.partitionBy("id").orderBy("seq")
    was, first = F.lag("status").over(w), F.row_number().over(w) == 1
    open_ = F.col("status").isin("open", "completed")
    ok = (
        F.when(F.col("kind") == KINDS[0], first & open_).when(F.col("kind") == KINDS[1], (was == "open") & (F.col("status") == "completed")).when(F.col("kind") == KINDS[2], (was == "completed") & (F.col("status") == "open"))
        .when(F.col("kind") == KINDS[3], was.isin("open", "completed") & (F.col("status") == "removed")).when(F.col("kind") == KINDS[4], (was == "removed") & open_)
    )
    twice = F.count("*").over(Window.partitionBy("id", "seq")) > 1
    return found.select("*", F.coalesce(ok, F.lit(False)).alias("ok"), twice.alias("twice")).where("not ok or twice").drop("ok", "twice")


def history(found: DataFrame, now: DataFrame) -> DataFrame:
    """id, status, changes, pending: each task that ever was with its present status, and whether it (id, done) differs from what
    the events (seq, id, kind) left."""
    last = found.groupBy("id").agg(F.max_by("kind", "seq").alias("kind"), F.count("*").alias("changes"))
    rows = last.join(now.select("id", "done"), "id", "full_outer")
    status = F.when(F.col("done").isNull(), "removed").when(F.col("done"), "completed").otherwise("open")
    pending = F.when(F.col("kind").isNull(), True).when(F.col("kind") == KINDS[3], F.col("done").isNotNull()).when(F.col("done").isNull(), True).when(F.col("kind") == KINDS[1], ~F.col("done")).when(F.col("kind") == KINDS[2], F.col("done")).otherwise(False)
    return rows.select("id", status.alias("status"), F.coalesce("changes", F.lit(0)).alias("changes"), pending.alias("pending"))


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Events that a reader hasn't seen: seen holds (seq, id, kind)."""
    return found.join(seen.select("seq", "id", "kind"), ["seq", "id", "kind"], "left_anti")


def matching(rows: DataFrame, query: str = "", done: bool | None = None, columns: tuple[str, ...] = ("path", "title", "text")) -> DataFrame:
    """Notes, tasks or events that hold the query without regard to case in any of the columns, and have the state asked for."""
    query = query.strip().lower()
    keep = F.lit(True)
    if query:
        keep = F.lit(False)
        for c in columns:
            keep = keep | F.coalesce(F.lower(F.col(c)).contains(query), F.lit(False))
    if done is not None:
        keep = keep & (F.col("done") == done)
    return rows.where(keep)


def manifest(pages: DataFrame) -> DataFrame:
    """One row: the SHA-256 of all (path, hash) pairs in order; a folder of pages is small."""
    lines = F.sort_array(F.collect_list(F.concat_ws(" ", "path", F.sha2("content", 256))))
    return pages.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("content_sha256"), F.count("*").alias("pages"))


def reachable(links_: DataFrame, root: str, most: int = 10_000) -> DataFrame:
    """Pages that links (path, target) reach from the root; an error if that takes more than `most` steps."""
    found = new = links_.sparkSession.createDataFrame([(root,)], "path string")
    for _ in range(most):
        new = new.join(links_, "path").select(F.col("target").alias("path")).distinct().join(found, "path", "left_anti")
        rows = [r["path"] for r in new.collect()]  # pages of a folder: few
        if not rows:
            return found
        new = links_.sparkSession.createDataFrame([(r,) for r in rows], "path string")
        found = links_.sparkSession.createDataFrame([(r["path"],) for r in found.collect()] + [(r,) for r in rows], "path string")
    raise RuntimeError("the pages are too deep")


def git_snapshots(spark: SparkSession, repository: str, folder: str = ".", most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The first-parent history of a repository, oldest first: commits (seq, commit, at), and the Markdown pages of each (seq,
    path, content). A blob is read once, whatever the number of commits that hold it; the driver reads, as git is local."""
    git = lambda *a: subprocess.run(["git", "-C", repository, *a], check=True, capture_output=True, timeout=60).stdout
    lines = git("log", "--first-parent", "--reverse", "--format=%H %ct").decode().split("\n")[:-1]
    if len(lines) > most:
        raise ValueError("the history is too long")
    commits, pages, blobs = [], [], {}
    for seq, line in enumerate(lines):
        commit, at = line.split()
        commits.append((seq, commit, int(at)))
        for entry in git("ls-tree", "-r", "-z", commit, "--", folder).decode().split("\0")[:-1]:
            head, path = entry.split("\t", 1)
            _, kind, blob = head.split()
            if kind == "blob" and path.endswith(".md"):
                if blob not in blobs:
                    blobs[blob] = git("cat-file", "blob", blob).decode()
                pages.append((seq, path, blobs[blob]))
    return spark.createDataFrame(commits, "seq long, commit string, at long"), spark.createDataFrame(pages, "seq long, path string, content string")
