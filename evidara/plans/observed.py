"""Registered queries of blocks, polls and pages that are checked as they come in, each through the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.plans.lineage import cut
from evidara.plans.queries import query
from evidara.ringview import table
from evidara.sources import blocks, ingest
from evidara.streaming import follow, live, pool

#: Orders as blocks: some heights are missing, some don't follow on the block before, some have a bad header.
CHAIN = """WITH b AS MATERIALIZED (SELECT o_orderkey AS height, CASE WHEN o_orderkey % 17 = 4 THEN 'short' ELSE sha256('b' || o_orderkey) END AS hash, CASE WHEN o_orderkey % 101 = 7 THEN 'torn' ELSE sha256('b' || (o_orderkey - 1)) END AS previous_hash, CASE WHEN o_orderkey % 19 = 3 THEN 5 ELSE 1600000000 + o_orderkey END AS timestamp FROM orders WHERE o_orderkey % 13 <> 5)
"""


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    named = lambda n: F.sha2(F.concat(F.lit("b"), n.cast("string")), 256)
    rows = table(spark, sf, "orders").where("o_orderkey % 13 <> 5")
    return rows.select(
        k.alias("height"), F.when(k % 17 == 4, "short").otherwise(named(k)).alias("hash"), F.when(k % 101 == 7, "torn").otherwise(named(k - 1)).alias("previous_hash"),
        F.when(k % 19 == 3, 5).otherwise(1_600_000_000 + k).cast("long").alias("timestamp"),
    )


@query(CHAIN + """SELECT height + 1 AS from_height, next - 1 AS to_height FROM (SELECT *, lead(height) OVER o AS next, lead(previous_hash) OVER o AS names FROM b WINDOW o AS (ORDER BY height)) WHERE next > height + 1 OR (next = height + 1 AND names <> hash)""")
def block_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.gaps(_chain(spark, sf))


@query(CHAIN + """SELECT CASE WHEN hash = 'short' THEN 'hash' WHEN timestamp = 5 THEN 'timestamp' ELSE 'good' END AS reason, count(*) AS blocks, min(height) AS first FROM b GROUP BY 1""")
def refused_blocks(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = ingest.validated(_chain(spark, sf))
    return good.withColumn("reason", F.lit("good")).unionByName(bad).groupBy("reason").agg(F.count("*").alias("blocks"), F.min("height").alias("first"))


@query(CHAIN + "SELECT height, hash FROM b QUALIFY row_number() OVER (ORDER BY height DESC) <= 700")
def newest_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 700 blocks: the limit is the feature."""
    return live.retained(_chain(spark, sf), "height", 700).select("height", "hash")


@query(CHAIN + """, f AS (SELECT height, CASE WHEN height % 23 = 0 THEN 'other' ELSE hash END AS hash, previous_hash FROM b WHERE height % 2 = 0)
SELECT b.height, b.hash, f.hash AS now FROM b JOIN f USING (height) WHERE b.hash <> f.hash UNION ALL SELECT f.height, b.hash, f.previous_hash FROM f JOIN b ON f.height = b.height + 1 WHERE f.previous_hash <> b.hash""")
def reorganised_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Every second block is read again, and some have another hash now."""
    rows = _chain(spark, sf)
    fresh = rows.where("height % 2 = 0").withColumn("hash", F.when(F.col("height") % 23 == 0, "other").otherwise(F.col("hash")))
    return live.reorganised(rows, fresh).select("height", "hash", "now")


@query("""WITH s AS (SELECT l_orderkey AS height, l_linenumber AS size, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT height, CAST(sum(n) AS BIGINT) AS inputs, CAST(sum(n * size) AS BIGINT) AS members FROM s GROUP BY 1)
SELECT height, CASE WHEN height % 31 = 0 THEN 'incomplete' WHEN height % 7 = 0 THEN 'inputs' ELSE 'members' END AS reason FROM t WHERE height % 31 = 0 OR height % 7 = 0 OR height % 11 = 0""")
def unreconciled_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as rings, their line numbers as sizes; some blocks state other counts than their histogram has."""
    rows = live.ring_histogram(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("height"), F.col("l_linenumber").alias("size")))
    h = F.col("height")
    stated = rows.select(h, "ring_sizes", F.when(h % 31 == 0, "missing").otherwise("complete").alias("detail_status"), (F.col("inputs") + (h % 7 == 0).cast("long")).alias("ring_input_count"), (F.col("members") + (h % 11 == 0).cast("long")).alias("ring_member_count"))
    return live.unreconciled(stated)


@query("""SELECT kind, count(*) AS polls FROM (SELECT CASE WHEN event_type = 'error' OR user_id % 7 = 0 THEN CASE WHEN value >= 0 AND event_id % 3 = 0 THEN 'followup_failed' ELSE 'failed' END WHEN event_id % 3 <> 0 THEN 'partial' WHEN value >= 0 THEN 'complete' ELSE 'unknown' END AS kind FROM events) GROUP BY kind""")
def poll_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Events as polls."""
    rows = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", "error").otherwise("observing").alias("state"), F.when(F.col("user_id") % 7 == 0, "RPCError").alias("error_type"), (F.col("event_id") % 3 == 0).alias("pool_complete"), F.when(F.col("value") >= 0, F.col("value")).alias("pool_count"))
    return rows.groupBy(pool.poll_kind().alias("kind")).agg(F.count("*").alias("polls"))


@query("""WITH d AS (SELECT DISTINCT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS p FROM orders), s AS (SELECT p, p * 86400.0 AS seen, p * 86400.0 + CASE WHEN p % 50 >= 25 THEN 100 ELSE 0 END AS mono, p // 400 AS session FROM d),
l AS (SELECT *, lag(seen) OVER o AS ls, lag(mono) OVER o AS lm, lag(session) OVER o AS lx FROM s WINDOW o AS (ORDER BY p)), c AS (SELECT *, ls IS NULL OR seen - ls > 172845 OR abs((seen - ls) - (mono - lm)) > 5 OR session <> lx AS cold FROM l)
SELECT CAST(p AS BIGINT) AS poll_id, row_number() OVER (ORDER BY p) AS poll, CAST(sum(cold::INT) OVER (ORDER BY p) AS BIGINT) AS epoch, cold FROM c""")
def poll_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Order days as polls, with pauses, clocks that jump, and a session each 400 days."""
    p = F.col("p")
    polls = table(spark, sf, "orders").select(F.unix_date(F.to_date("o_orderdate")).alias("p")).distinct()
    polls = polls.select(p.cast("long").alias("poll_id"), (p * 86_400.0).alias("seen"), (p * 86_400.0 + F.when(p % 50 >= 25, 100).otherwise(0)).alias("monotonic_seen"), F.floor(p / 400).cast("string").alias("session"))
    return follow.marked(polls, pool.Settings(interval=86_400.0)).select("poll_id", "poll", "epoch", "cold")


@query("""WITH t AS (SELECT l_orderkey AS poll_id, count(*) AS n, bool_or(l_linenumber > 6 AND l_partkey % 5 = 0) AS bad, count(*) > count(DISTINCT l_partkey) AS again FROM lineitem GROUP BY 1)
SELECT poll_id, CAST(n AS INTEGER) AS transactions, CASE WHEN poll_id % 29 = 0 THEN 'status' WHEN n > 6 THEN 'limit' WHEN bad THEN 'entry' WHEN again THEN 'repeated' END AS reason FROM t""")
def pool_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as snapshots of the pool, their lines as transactions; some are refused as a whole."""
    fee = F.when((F.col("l_linenumber") > 6) & (F.col("l_partkey") % 5 == 0), F.lit("-1")).otherwise(F.col("l_suppkey").cast("string"))
    entry = F.struct(F.sha2(F.col("l_partkey").cast("string"), 256).alias("id_hash"), fee.alias("fee"), F.lit("7").alias("weight"), F.lit("0").alias("receive_time"))
    per = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("poll_id")).agg(F.collect_list(entry).alias("transactions"))
    status = F.when(F.col("poll_id") % 29 == 0, "BUSY").otherwise("OK").alias("status")
    polls, _ = pool.parsed(per.select("poll_id", F.to_json(F.struct(status, "transactions")).alias("json")), 6)
    return polls


@query(r"""WITH p AS (SELECT doc_id, 'd' || doc_id || '.md' AS path, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS words FROM documents), b AS (
SELECT path, 'front' AS kind, 0 AS depth, CAST(NULL AS BOOLEAN) AS done, 'a: 1' AS text FROM p UNION ALL SELECT path, 'heading', 2, NULL, 'D' || doc_id FROM p UNION ALL SELECT path, 'paragraph', 0, NULL, words || ' more' FROM p WHERE words <> '' UNION ALL SELECT path, 'paragraph', 0, NULL, 'more' FROM p WHERE words = ''
UNION ALL SELECT path, 'item', 0, NULL, 'one goes on' FROM p UNION ALL SELECT path, 'task', 1, doc_id % 2 = 0, 'T' || doc_id FROM p UNION ALL SELECT path, 'item', 2, NULL, 'deep' FROM p UNION ALL SELECT path, 'item', 0, NULL, 'two' FROM p
UNION ALL SELECT path, 'header', 0, NULL, 'x' || chr(9) || 'y' FROM p UNION ALL SELECT path, 'row', 0, NULL, doc_id || chr(9) || 'a|b' FROM p UNION ALL SELECT path, 'fence', 0, NULL, '# no' || chr(10) || '- no' FROM p UNION ALL SELECT path, 'quote', 0, NULL, 'said so' FROM p UNION ALL SELECT path, 'rule', 0, NULL, '' FROM p)
SELECT * FROM b""")
def document_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a page with blocks of each kind around its text."""
    id_ = F.col("doc_id").cast("string")
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    mark = F.when(F.col("doc_id") % 2 == 0, "x").otherwise(" ")
    body = F.concat(
        F.lit("---\na: 1\n---\n## D"), id_, F.lit(" ##\n"), words, F.lit("\nmore\n\n- one\n  goes on\n  - ["), mark, F.lit("] T"), id_, F.lit("\n      * deep\n- two\n\n| x | y |\n|---|:-:|\n| "), id_,
        F.lit(" | a\\|b |\n```py\n# no\n- no\n```\n> said\n> so\n\n***\n"),
    )
    pages = table(spark, sf, "documents").select(F.concat(F.lit("d"), id_, F.lit(".md")).alias("path"), body.alias("content"))
    return blocks.blocks(pages).select("path", "kind", "depth", "done", "text")


@query("SELECT url, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || regexp_extract(lower(url), '^https?://(?:[^/@]*@)?([^/?#]*)', 1) AS origin, count(*) AS pages FROM pages WHERE regexp_matches(url, '^https?://') GROUP BY ALL")
def page_origins(spark: SparkSession, sf: str) -> DataFrame:
    from evidara.functions import analytics as an

    rows = cut(table(spark, sf, "pages").select("url", an.origin(F.col("url")).alias("origin")).where("origin is not null"), "origins")
    return rows.groupBy("url", "origin").agg(F.count("*").alias("pages"))
