"""Registered queries of samples, comparisons and documents, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions import variants
from evidara.operators import audit, baselines, components, features, graph, ranges, summary
from evidara.operators import cascade as cas
from evidara.plans.lineage import cut, shared_dir
from evidara.plans.queries import CASCADE, FRAME, SPLIT, WITH, _cascade, _frame, _parts, query
from evidara.ringview import rings, table
from evidara.sources import documents, ingest, sinks, sqlite
from evidara.streaming import follow, live, pool

SAMPLE = CASCADE + """, o AS MATERIALIZED (SELECT category, amount, idx, min(key_image) AS key_image FROM (SELECT m.*, CASE WHEN r.key_image IS NULL THEN 'unresolved' ELSE 'resolved' END AS category FROM m LEFT JOIN res r USING (key_image)) GROUP BY ALL),
s AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY category) AS frame, sha256('42:' || category || ':' || amount || ':' || idx) AS priority FROM o),
k AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY category ORDER BY priority, amount, idx) <= 40)
"""


def _sample(spark: SparkSession, sf: str) -> tuple:
    r, c = _cascade(spark, sf)
    done = c.resolved.select("key_image").distinct().withColumn("category", F.lit("resolved"))
    categories = r.members.select("key_image").distinct().join(done, "key_image", "left").fillna("unresolved", ["category"])
    return r, cut(audit.origin_sample(r.members, categories, 40), "sample")


@query(SAMPLE + "SELECT category, amount, idx, key_image, priority, frame FROM k")
def origin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf)[1]


ORIGIN = ", x AS (SELECT k.*, ctx.height, f.first_height, CASE WHEN idx % 7 <> 0 THEN idx % 90 - 10 END AS origin_height FROM k JOIN ctx USING (key_image) LEFT JOIN (SELECT amount, idx, min(height) AS first_height FROM m JOIN ctx USING (key_image) GROUP BY 1, 2) f USING (amount, idx))"


@query(SAMPLE + ORIGIN + """SELECT category, count(*) AS contexts, count(DISTINCT (amount, idx)) AS outputs, count(origin_height) AS known, count(*) FILTER (origin_height > first_height) AS after_reference, min(height - origin_height) AS age_min, quantile_cont(height - origin_height, 0.5) AS age_median, max(height - origin_height) AS age_max, count(*) FILTER (height - origin_height > 15) AS over_15,
array_to_string(list_sort(list(DISTINCT amount)), ',') AS amounts FROM x GROUP BY category""")
def origin_ages(spark: SparkSession, sf: str) -> DataFrame:
    r, sample = _sample(spark, sf)
    rows = audit.contexts(sample, r.details())
    idx = F.col("idx")
    found = sample.where(idx % 7 != 0).select("amount", "idx", (idx % 90 - 10).alias("origin_height")).distinct()
    rows = audit.attached(rows, found)
    parts = [audit.ages(rows.where(F.col("category") == c), ("amount",)).withColumn("category", F.lit(c)) for c in ("resolved", "unresolved")]
    return parts[0].unionByName(parts[1]).withColumn("amounts", F.array_join("amount_values", ",")).drop("amount_values")


LABELLED = CASCADE + """, lb AS MATERIALIZED (SELECT m.*, u.reuse, (m.amount = r.amount AND m.idx = r.idx)::INT AS label, siz.n FROM m JOIN res r ON r.key_image = m.key_image JOIN siz ON siz.key_image = m.key_image JOIN (SELECT amount, idx, count(*) AS reuse FROM m GROUP BY 1, 2) u ON u.amount = m.amount AND u.idx = m.idx WHERE siz.n > 1),
sc AS MATERIALIZED (SELECT 'uniform' AS baseline, *, 1.0::DOUBLE / n AS score FROM lb UNION ALL SELECT 'highest_index', *, (idx = max(idx) OVER (PARTITION BY key_image))::DOUBLE FROM lb UNION ALL SELECT 'minimum_reuse', *, (reuse = min(reuse) OVER (PARTITION BY key_image))::DOUBLE FROM lb),
oc AS MATERIALIZED (SELECT baseline, key_image, min(idx) FILTER (top) AS pick, min_by(label, idx) FILTER (top) = 1 AS hit, count(*) FILTER (top) AS ties, bool_or(top AND label = 1) AS among, any_value(n) AS size FROM (SELECT *, score = max(score) OVER (PARTITION BY baseline, key_image) AS top FROM sc) GROUP BY ALL)
"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    r, c = _cascade(spark, sf)
    real = c.resolved.select("key_image", F.col("amount").alias("a"), F.col("idx").alias("i"))
    rows = features.reuse(r.members).join(real, "key_image").join(c.sizes.where("n > 1"), "key_image")
    return cut(rows.select("key_image", "amount", "idx", "reuse", ((F.col("amount") == F.col("a")) & (F.col("idx") == F.col("i"))).cast("int").alias("label")), "labelled")


@query(LABELLED + """SELECT baseline, count(*) AS rings, CAST(sum(size) AS BIGINT) AS candidates, count(*) FILTER (hit) AS correct, count(*) FILTER (ties > 1) AS tied, round(sum(CASE WHEN among THEN 1.0::DOUBLE / ties ELSE 0 END), 6) AS expected, round(count(*) FILTER (hit) / count(*), 6) AS agreement FROM oc GROUP BY baseline""")
def comparators(spark: SparkSession, sf: str) -> DataFrame:
    scored = cut(audit.comparators(_labelled(spark, sf)), "scored")
    parts = [audit.outcome_summary(audit.outcomes(scored.where(F.col("baseline") == b).drop("baseline"))).withColumn("baseline", F.lit(b)) for b in ("uniform", "highest_index", "minimum_reuse")]
    return parts[0].union(parts[1]).union(parts[2]).select("baseline", "rings", "candidates", "correct", "tied", F.round("expected", 6).alias("expected"), F.round("agreement", 6).alias("agreement"))


@query(LABELLED + "SELECT count(*) FILTER (a.hit AND b.hit) AS \"both\", count(*) FILTER (a.hit AND NOT b.hit) AS first_only, count(*) FILTER (NOT a.hit AND b.hit) AS second_only, count(*) FILTER (NOT a.hit AND NOT b.hit) AS neither, count(*) FILTER (b.hit) - count(*) FILTER (a.hit) AS net, count(*) FILTER (a.pick <> b.pick) AS changed FROM oc a JOIN oc b USING (key_image) WHERE a.baseline = 'highest_index' AND b.baseline = 'minimum_reuse'")
def paired_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    scored = cut(audit.comparators(_labelled(spark, sf)), "scored")
    of = lambda b: audit.outcomes(scored.where(F.col("baseline") == b).drop("baseline"))
    return baselines.contingency(of("highest_index"), of("minimum_reuse"))


@query(LABELLED + "SELECT key_image, CASE WHEN key_image % 20 = 0 THEN 'not_stated' WHEN key_image % 21 = 0 THEN 'ties' END AS reason FROM oc WHERE baseline = 'minimum_reuse' AND (key_image % 20 = 0 OR key_image % 21 = 0)")
def rederived_results(spark: SparkSession, sf: str) -> DataFrame:
    """A stated result with some rings left out and some ties wrong, against what its scores give."""
    scored = cut(audit.comparators(_labelled(spark, sf)).where("baseline = 'minimum_reuse'").drop("baseline"), "scored")
    key = F.col("key_image")
    stated = audit.outcomes(scored).where(key % 20 != 0).withColumn("ties", F.col("ties") + F.when(key % 21 == 0, 1).otherwise(0))
    return audit.rederived(scored, stated)


@query(SPLIT + """, tr AS (SELECT m.*, p.tx_hash FROM m JOIN parts p USING (key_image) WHERE part = 'train'), te AS (SELECT m.*, p.tx_hash, row_number() OVER (PARTITION BY key_image ORDER BY idx) = 1 AS real FROM m JOIN parts p USING (key_image) WHERE part = 'test'), a AS MATERIALIZED (SELECT DISTINCT amount, idx FROM tr), b AS MATERIALIZED (SELECT DISTINCT amount, idx FROM te)
SELECT (SELECT count(*) FROM a) AS train_outputs, (SELECT count(*) FROM b) AS test_outputs, (SELECT count(*) FROM a JOIN b USING (amount, idx)) AS shared_outputs, (SELECT count(DISTINCT key_image) FROM te JOIN a USING (amount, idx)) AS test_rings_sharing_output, (SELECT count(DISTINCT key_image) FROM te WHERE tx_hash IN (SELECT tx_hash FROM tr)) AS test_rings_sharing_transaction, (SELECT count(DISTINCT key_image) FROM te JOIN a USING (amount, idx) WHERE real) AS test_labels_in_train""")
def split_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    r, parts = _parts(spark, sf)
    first = F.min("idx").over(Window.partitionBy("key_image"))
    rows = r.members.join(parts.select("key_image", "tx_hash", "part"), "key_image").withColumn("label", (F.col("idx") == first).cast("int"))
    return audit.overlap(rows.where("part = 'train'"), rows.where("part = 'test'"))


@query(r"""WITH p AS (SELECT doc_id, 'd' || doc_id || '.md' AS path, text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM p) SELECT path, title, length FROM (SELECT path, 'd' || doc_id AS title, length(text) AS length FROM p)""")
def document_nodes(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return documents.nodes(pages).join(pages.select("path", F.length("content").cast("long").alias("length")), "path").select("path", "title", "length")


TASKS = """WITH s AS MATERIALIZED (SELECT DISTINCT CAST(ts AS DATE) AS seq, user_id AS id, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS done FROM events), o AS MATERIALIZED (SELECT seq, row_number() OVER (ORDER BY seq) AS place FROM (SELECT DISTINCT seq FROM s)),
w AS MATERIALIZED (SELECT s.*, place, lag(place) OVER q AS before, lag(done) OVER q AS was, lead(place) OVER q AS after FROM s JOIN o USING (seq) WINDOW q AS (PARTITION BY id ORDER BY place)),
ev AS MATERIALIZED (SELECT seq, id, kind FROM (SELECT seq, id, CASE WHEN before IS NULL THEN 'first_recorded' WHEN place > before + 1 THEN 'reintroduced' WHEN done AND NOT was THEN 'closed' WHEN NOT done AND was THEN 'reopened' END AS kind FROM w) WHERE kind IS NOT NULL UNION ALL SELECT o.seq, id, 'removed' FROM w JOIN o ON o.place = w.place + 1 WHERE after > w.place + 1 OR after IS NULL)
"""


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("seq"), F.col("user_id").alias("id")).agg(F.bool_or(F.col("event_type") == "purchase").alias("done"))


@query(TASKS + "SELECT seq, id, kind FROM ev")
def task_events(spark: SparkSession, sf: str) -> DataFrame:
    """Users as tasks, days as snapshots, a purchase as done."""
    return documents.events(_tasks(spark, sf))


@query(TASKS + "SELECT status, count(*) AS tasks, CAST(sum(changes) AS BIGINT) AS changes FROM (SELECT id, count(*) AS changes, CASE max_by(kind, seq) WHEN 'removed' THEN 'removed' ELSE CASE WHEN id IN (SELECT id FROM s WHERE done AND seq = (SELECT max(seq) FROM s)) THEN 'completed' ELSE 'open' END END AS status FROM ev GROUP BY id) GROUP BY status")
def task_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut(_tasks(spark, sf), "tasks")
    now = rows.join(rows.agg(F.max("seq").alias("seq")), "seq")
    return documents.history(documents.events(rows), now).groupBy("status").agg(F.count("*").alias("tasks"), F.sum("changes").alias("changes"))


@query("""WITH d AS MATERIALIZED (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 4 AS p, event_id % 400 AS id FROM events WHERE NOT (event_id % 50 = 0 AND date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 4 >= 3)),
f AS (SELECT id, p, lag(p) OVER (PARTITION BY id ORDER BY p) AS before FROM d), g AS (SELECT id, min(p) AS first, max(p) AS last, count(*) FILTER (p > before + 1) AS again FROM f GROUP BY id), e AS (SELECT max(p) AS final, min(p) AS start FROM d)
SELECT count(*) AS tracked, count(*) FILTER (id % 50 <> 0 AND last = final) AS pending, count(*) FILTER (id % 50 <> 0 AND last < final) AS disappeared, count(*) FILTER (id % 50 = 0) AS confirmed, count(*) FILTER (first = start) AS cold, count(*) FILTER (id % 50 = 0 AND first > start) AS eligible,
round(quantile_cont(CASE WHEN id % 50 = 0 AND first > start THEN 43200.0::DOUBLE * (5 - 2 * first) END, 0.5), 3) AS median_delay, CAST(sum(again) AS BIGINT) AS reappearances, true AS consistent FROM g, e""")
def pool_polls(spark: SparkSession, sf: str) -> DataFrame:
    """The pool job over a poll each four days, in two batches: events by the end of their number are transactions, and a block
    between the third and the fourth poll confirms some. Follow-up and retention are longer than the table."""
    number, poll = F.col("event_id") % 400, F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 4)
    seen = table(spark, sf, "events").where(~((number % 50 == 0) & (poll >= 3))).select(poll.alias("poll_id"), number.cast("string").alias("id"))
    at = (F.col("poll_id") * 86_400).cast("double")
    polls = cut(seen.groupBy("poll_id").agg(F.collect_set("id").alias("txs")).select(F.col("poll_id").cast("long").alias("poll_id"), at.alias("seen"), at.alias("monotonic_seen"), F.lit("s").alias("session"), F.when(F.col("poll_id") >= 3, 1).otherwise(0).cast("long").alias("tip"), "txs"), "polls")
    block = lambda s: s.createDataFrame([(1, 2.5 * 86_400, [str(50 * i) for i in range(8)])], "height long, observed double, tx_hashes array<string>")
    job = pool.PoolJob(shared_dir(spark, "pool"), block, pool.Settings(interval=86_400.0, follow_up=1e9, retention=1e9, tracked=1_000_000))
    job(polls.where("poll_id < 4"), 0)
    job(polls.where("poll_id >= 4"), 1)
    state = job.state(spark, 1)
    total = pool.consistent(pool.summary(state)).select("tracked", "pending", "disappeared", "confirmed", "cold", "eligible", F.round("median_delay", 3).alias("median_delay"), "consistent")
    return total.join(state.agg(F.sum("reappearances").alias("reappearances")))


@query(WITH + "SELECT size, count(*) AS rings FROM (SELECT count(*) AS size FROM m GROUP BY key_image) GROUP BY size")
def merged_ring_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Ring sizes of each block as a map, and the maps added up."""
    r = rings(spark, sf)
    sizes = r.members.groupBy("key_image").agg(F.count("*").alias("size")).join(r.context.select("key_image", "height"), "key_image")
    return live.merged_histograms(live.ring_histogram(sizes))


@query("""SELECT '"' || c_custkey || '","' || CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) || '","' || c_mktsegment || '"' AS line FROM customer""")
def safe_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    sinks.write_csv(table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"), "c_mktsegment"), path)
    return spark.read.option("lineSep", "\r\n").text(f"{path}/rows").select(F.col("value").alias("line"))


#: An order is seen in the pool of its day and of each day on which a part of it ships; of those that are fulfilled the last such
#: day is that of its block. Every such day has a poll.
FOLLOW = """WITH d AS MATERIALIZED (SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT l_orderkey, o_orderstatus, CAST(l_shipdate AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT *, status = 'F' AND day = max(day) OVER (PARTITION BY id) AND day > min(day) OVER (PARTITION BY id) AS block, date_diff('day', DATE '1970-01-01', day) AS n, dense_rank() OVER (ORDER BY day) AS poll FROM d),
e AS (SELECT *, max(n) OVER () AS final, min(n) OVER () AS start, min(n) OVER (PARTITION BY id) AS first, lag(poll) OVER (PARTITION BY id ORDER BY poll) AS before FROM x)
"""


def _followed(spark: SparkSession, sf: str) -> DataFrame:
    """(id, day, block): a row for each order and day, as FOLLOW says."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"))
    shipped = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("day"))
    days = orders.select("id", "status", "day").union(shipped.join(orders.select("id", "status"), "id").select("id", "status", "day")).distinct()
    own = Window.partitionBy("id")
    return days.select("id", "day", ((F.col("status") == "F") & (F.col("day") == F.max("day").over(own)) & (F.col("day") > F.min("day").over(own))).alias("block"))


@query(FOLLOW + """SELECT CAST(id AS VARCHAR) AS id, CASE WHEN bool_or(block) THEN 'confirmed' WHEN min(first) < max(final) - 800 THEN 'censored' WHEN max(n) = max(final) THEN 'pending' ELSE 'disappeared' END AS state, min(first) = max(start) AS cold,
min(first) < (CASE WHEN bool_or(block) THEN max(n) ELSE max(final) END) - 800 AS censored, count(*) FILTER (NOT block AND poll > before + 1 AND first >= n - 800) AS reappearances,
max(CASE WHEN block AND first > start AND first >= n - 800 THEN CAST((n - first) * 86400 AS DOUBLE) END) AS delay FROM e GROUP BY id""")
def pool_follow(spark: SparkSession, sf: str) -> DataFrame:
    """Every order followed in the state store of a stream, over files of ascending days, in two runs of which the second goes on
    where the first ended; the follow-up is 800 days, retention longer than the table."""
    day, settings = 86_400.0, pool.Settings(interval=86_400.0, follow_up=800 * 86_400.0, retention=1e10)
    rows = cut(_followed(spark, sf), "days")
    number = F.unix_date("day")
    polls = rows.select(number.cast("long").alias("poll_id"), (number * day).alias("seen"), (number * day).alias("monotonic_seen"), F.lit("s").alias("session")).distinct()
    polls = cut(follow.marked(polls, pool.Settings(interval=1e9)).withColumn("part", F.ntile(3).over(Window.orderBy("poll_id"))), "polls")  # a row a day
    events = rows.join(polls, number == F.col("poll_id")).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("block"), "block").otherwise("seen").alias("kind"), F.timestamp_seconds("seen").alias("at"), "poll", "epoch", "session", "cold", F.col("seen").alias("mono"),
        F.when(F.col("block"), number).otherwise(number - 1).cast("long").alias("height"), "part",
    )
    source, path = shared_dir(spark, "pool-in"), shared_dir(spark, "pool")
    events.write.partitionBy("part").parquet(source)
    for run in ("{1,2}", "*"):  # the second run finds the checkpoint of the first
        stream = spark.readStream.schema(follow.EVENT).option("maxFilesPerTrigger", 1_000_000).parquet(f"{source}/part={run}")
        follow.watch(stream, path, settings)
    last = polls.agg(F.max("seen")).first()[0]
    return follow.tracked(spark, path, last, settings).select("id", "state", "cold", "censored", "reappearances", "delay")


@query(FOLLOW + """SELECT CAST(id AS VARCHAR) AS id, CAST(n AS BIGINT) AS height, CAST((n - first) * 86400 AS DOUBLE) AS delay FROM e WHERE block AND n - first <= 800""")
def pool_confirmations(spark: SparkSession, sf: str) -> DataFrame:
    """Delays as a join of the stream of first sightings with the stream of blocks."""
    rows = cut(_followed(spark, sf), "days")
    source = shared_dir(spark, "streams")
    key = F.col("id").cast("string").alias("id")
    rows.groupBy(key).agg(F.min("day").cast("timestamp").alias("seen")).write.parquet(f"{source}/seen")
    rows.where("block").select(key, F.unix_date("day").cast("long").alias("height"), F.col("day").cast("timestamp").alias("observed")).write.parquet(f"{source}/blocks")
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{source}/{name}")
    met = follow.confirmations(read("seen", "id string, seen timestamp"), read("blocks", "id string, height long, observed timestamp"), "800 days", "10 days")
    out = met.writeStream.format("parquet").option("path", f"{source}/out").option("checkpointLocation", f"{source}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema("id string, height long, delay double").parquet(f"{source}/out")


@query("""SELECT l_orderkey AS key_image, l_returnflag AS flag, count(*) AS members, CAST(sum(l_linenumber) AS BIGINT) AS positions, max(l_extendedprice) AS top FROM lineitem WHERE l_returnflag >= 'N' AND l_linenumber IN (1, 2, 3, 5) AND l_quantity < 40 GROUP BY ALL""")
def sqlite_members(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as SQLite files, a file for each task, read back in ranges of row ids with filters that SQLite sees."""
    path = shared_dir(spark, "sqlite")
    sqlite.write(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice"), path, "members")
    rows = sqlite.table(spark, path, "members", "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double", 100_000)
    rows = rows.where("l_returnflag >= 'N' AND l_linenumber IN (1, 2, 3, 5) AND l_quantity < 40")
    return rows.groupBy(F.col("l_orderkey").alias("key_image"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("members"), F.sum("l_linenumber").alias("positions"), F.max("l_extendedprice").alias("top"))


@query("""SELECT o_orderpriority AS priority, count(*) AS n, round(quantile_cont(o_totalprice, 0.05), 3) AS p05, round(quantile_cont(o_totalprice, 0.5), 3) AS median, round(quantile_cont(o_totalprice, 0.999), 3) AS p999 FROM orders GROUP BY ALL""")
def price_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranges.quantiles(table(spark, sf, "orders"), "o_totalprice", {"p05": 0.05, "median": 0.5, "p999": 0.999}, ["o_orderpriority"])
    return rows.select(F.col("o_orderpriority").alias("priority"), "n", *(F.round(c, 3).alias(c) for c in ("p05", "median", "p999")))


@query("""SELECT o_orderkey AS height, count(*) AS intervals, min(l_partkey) AS first, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM orders JOIN lineitem ON o_orderkey BETWEEN l_orderkey - l_linenumber AND l_orderkey + CAST(l_quantity AS BIGINT) % 7 GROUP BY ALL""")
def interval_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as heights, held by an interval for each order line."""
    spans = table(spark, sf, "lineitem").select((F.col("l_orderkey") - F.col("l_linenumber")).alias("a"), (F.col("l_orderkey") + F.col("l_quantity").cast("long") % 7).alias("z"), "l_partkey", "l_linenumber")
    met = ranges.interval_join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("height")), spans, "height", "a", "z")
    return met.groupBy("height").agg(F.count("*").alias("intervals"), F.min("l_partkey").alias("first"), F.sum("l_linenumber").alias("lines"))


@query(CASCADE.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + """, dep AS MATERIALIZED (SELECT DISTINCT e.key_image, e.source AS ancestor FROM elim e SEMI JOIN res ON e.key_image = res.key_image),
walk AS (SELECT key_image, ancestor, 1 AS depth FROM dep UNION SELECT w.key_image, d.ancestor, w.depth + 1 FROM walk w JOIN dep d ON d.key_image = w.ancestor),
p AS (SELECT *, row_number() OVER (PARTITION BY key_image ORDER BY depth, ancestor) AS place FROM (SELECT key_image, ancestor, min(depth) AS depth FROM walk GROUP BY ALL))
SELECT key_image, count(*) FILTER (place <= 3) AS events, CAST(max(depth) FILTER (place <= 3) AS INTEGER) AS deepest, count(*) FILTER (place <= 3 AND ancestor % 10 = 0) AS missing, max(place) > 3 AS truncated, count(*) FILTER (place <= 3 AND ancestor % 10 = 0) = 0 AND max(place) <= 3 AS complete FROM p GROUP BY key_image""")
def trace_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Lineages of all resolved rings, three events listed, where every tenth event is lost."""
    r, c = _cascade(spark, sf)
    return graph.traces(cas.dependencies(c), c.resolved.where("key_image % 10 <> 0"), 3)


@query("""SELECT event_type, p.fullkey AS path, count(DISTINCT event_id) AS documents, count(*) AS leaves, count(*) FILTER (p.type IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS numeric, count(*) FILTER (p.type = 'VARCHAR') AS texts, count(*) FILTER (p.type = 'NULL') AS nulls,
min(TRY_CAST(p.atom AS DOUBLE)) AS least, max(TRY_CAST(p.atom AS DOUBLE)) AS most FROM events, json_tree(props) p WHERE p.type NOT IN ('OBJECT', 'ARRAY') GROUP BY ALL""")
def variant_coverage(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    found = variants.leaves(events, "event_id", "props").join(events.select("event_id", "event_type"), "event_id")
    return variants.coverage(found, "event_id", ["event_type"])


@query("""SELECT o_orderkey AS height, sha256('b' || o_orderkey) AS hash, CASE WHEN o_orderkey % 7 = 0 THEN 'hash' END AS reason, CAST(o_orderkey // 500 AS BIGINT) AS span FROM orders WHERE o_orderkey % 11 <> 3""")
def ingest_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as blocks, taken in overlapping batches, one of them twice, into ranges of 500 heights; a first try has other hashes,
    and blocks that a check refuses lie beside the table."""
    text = F.col("height").cast("string")
    blocks = table(spark, sf, "orders").where("o_orderkey % 11 <> 3").select(F.col("o_orderkey").alias("height"))
    hash_ = F.when(F.col("height") % 7 != 0, F.sha2(F.concat(F.lit("b"), text), 256)).otherwise(F.concat(F.lit("bad "), F.sha2(F.concat(F.lit("b"), text), 256)))
    blocks = cut(blocks.select("height", hash_.alias("hash"), F.lit(1_600_000_000).cast("long").alias("timestamp")), "blocks")
    last = blocks.agg(F.max("height")).first()[0]
    path, third = shared_dir(spark, "heights"), last // 3
    first = blocks.where(F.col("height") <= 2 * third).withColumn("hash", F.sha2(F.concat(F.lit("other"), "hash"), 256))
    ingest.overwrite_range(path, first, 0, 2 * third, span=500)
    for start, stop in ((0, third + 10), (third - 10, last), (third - 10, last)):
        ingest.overwrite_range(path, blocks.where(F.col("height").between(start, stop)), start, stop, span=500)
    good, bad = (spark.read.parquet(p) for p in (path, f"{path}-quarantine"))
    rows = good.select("height", "hash", F.lit(None).cast("string").alias("reason"), "span").unionByName(bad.select("height", F.substring("hash", 5, 64).alias("hash"), "reason", "span"))
    return rows.withColumn("span", F.col("span").cast("long"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + CAST(o_orderkey % 3 AS BIGINT)) % 1000003 AS b FROM orders), v AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), w(v, root) AS (SELECT a, a FROM v UNION SELECT v.b, w.root FROM w JOIN v ON v.a = w.v AND w.root < v.b)
SELECT v, min(root) AS root FROM w GROUP BY v""")
def customer_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components by large and small stars over the whole cluster, whatever the number of edges."""
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % 1_000_003).alias("b"))
    return components.stars(edges)


@query(FRAME.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + """, bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY priority, key_image) AS rank FROM (SELECT *, sha256('42:' || stratum || ':' || key_image) AS priority FROM fr WHERE reason IS NULL)) WHERE rank <= 40),
q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY rank, stratum, key_image) AS place FROM bk),
st AS (SELECT CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS key_image UNION ALL SELECT q.place, st.n + ok, st.used + ok * q.candidates, CASE WHEN ok = 1 THEN q.key_image END FROM (SELECT st.*, CASE WHEN st.n < 120 AND st.used + q.candidates <= 401 THEN 1 ELSE 0 END AS ok, st.place + 1 AS next FROM st JOIN q ON q.place = st.place + 1) st JOIN q ON q.place = st.next)
SELECT key_image, stratum, candidates FROM st JOIN q USING (place, key_image)""")
def budget_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Of 40 rings a stratum those that fit 120 rings and 401 candidates, in turns over the strata."""
    sample = baselines.bottom_k(_frame(spark, sf).where("reason is null"), "stratum", "key_image", 40)
    return baselines.within_budgets(cut(sample, "sample"), 120, 401).select("key_image", "stratum", "candidates")


@query(r"""WITH p AS (SELECT doc_id, 'd' || doc_id || '.md' AS path FROM documents)
SELECT path, path || '#T' || doc_id % 30 AS id, 'T' || doc_id % 30 AS code, 'T' || doc_id % 30 || ' — first' AS title, doc_id % 2 = 0 AS done FROM p
UNION ALL SELECT path, path || '#title-' || left(sha256('t' || doc_id % 30 || ' and more'), 16), NULL, 'T' || doc_id % 30 || ' and more', false FROM p""")
def document_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a page with a task that has a code, one whose title only looks like it, one in a fence, and its text
    in front matter, which is none."""
    code = F.concat(F.lit("T"), (F.col("doc_id") % 30).cast("string"))
    mark = F.when(F.col("doc_id") % 2 == 0, "x").otherwise(" ")
    head = F.concat(F.lit("---\nsummary: "), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "), F.lit("\n- [ ] T1 — none\n---\n"))
    body = F.concat(head, F.lit("- ["), mark, F.lit("] **"), code, F.lit(" — first** `now`\n\n```\n- [ ] T9 — fenced\n```\n  * [ ] "), code, F.lit(" and [more](a.md)\n- [y] no\n"))
    pages = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.alias("content"))
    return documents.tasks(pages).select("path", "id", "code", "title", "done")


@query("""WITH p AS (SELECT doc_id, (doc_id * 7 + 3) % 200 AS other FROM documents) SELECT DISTINCT 'd' || doc_id || '.md' AS path, 'd' || other || '.md' AS target FROM p WHERE doc_id <> other""")
def document_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a page with a link to a page, an image of another, a link outside and one in a fence."""
    to = lambda n: F.concat(F.lit("(./d"), n.cast("string"), F.lit(".md#top)"))
    other = (F.col("doc_id") * 7 + 3) % 200
    body = F.concat(F.lit("# T\n[see]"), to(other), F.lit(" ![pic]"), to(other + 1), F.lit(" [web](https://a.b/c.md)\n~~~\n[no]"), to(other + 2), F.lit("\n~~~\n[]"), to(other + 3))
    return documents.edges(table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.alias("content")))


@query("""SELECT CAST(o_orderkey // 100 AS BIGINT) AS span, count(*) AS blocks, max(o_orderkey) - min(o_orderkey) + 1 = count(*) AS contiguous, CASE WHEN count(*) FILTER (o_custkey % 97 = 0) = 0 THEN CAST(sum(o_custkey % 5) AS BIGINT) END AS ring_input_count, CASE WHEN count(*) FILTER (o_custkey % 97 = 0) = 0 THEN CAST(sum(o_custkey % 5 * 11) AS BIGINT) END AS ring_member_count FROM orders GROUP BY 1""")
def block_window_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as blocks, in windows of a hundred heights; some lack their details."""
    c = F.col("o_custkey")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("height"), F.when(c % 97 == 0, "missing").otherwise("complete").alias("detail_status"), (c % 5).alias("ring_input_count"), (c % 5 * 11).alias("ring_member_count"))
    return summary.window_totals(rows.withColumn("span", F.floor(F.col("height") / 100)), ["span"])
