"""Registered queries over stored evidence: claims and predictions beside the rings, with SQL that says the same.

The tables have no claims that an analysis didn't make, so a fixed rule adds some of every kind: hypotheses, claims outside
their ring, claims of rings that aren't there, and predictions, some of them outside their ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators import cascade as cas
from evidara.operators import eras, evidence, graph
from evidara.plans.lineage import cut
from evidara.plans.queries import CASCADE, _cascade, query
from evidara.ringview import rings, table

CLAIMS = CASCADE + """, open AS MATERIALIZED (SELECT m.key_image, min(m.amount) AS amount, min(m.idx) AS lo, max(m.idx) AS hi FROM m JOIN liv ON liv.key_image = m.key_image GROUP BY m.key_image),
claims AS MATERIALIZED (SELECT key_image, amount, idx, pass, 1.0::DOUBLE AS confidence FROM res UNION ALL SELECT key_image, amount, lo, -1, 0.99 FROM open WHERE key_image % 40 = 7 UNION ALL SELECT key_image, amount, hi + 1, 1, 1.0 FROM open WHERE key_image % 40 = 9
 UNION ALL SELECT key_image, key_image % 10, 1, 0, 1.0 FROM ctx WHERE key_image % 3 = 0 AND key_image NOT IN (SELECT key_image FROM siz)),
told AS MATERIALIZED (SELECT key_image, amount, CASE WHEN key_image % 100 = 3 THEN hi + 5 ELSE lo END AS idx FROM open WHERE key_image % 25 = 3),
own AS MATERIALIZED (SELECT amount, idx, count(*) AS owners, min(key_image) AS owner FROM claims SEMI JOIN m ON m.key_image = claims.key_image AND m.amount = claims.amount AND m.idx = claims.idx WHERE confidence = 1.0 AND pass >= 0 GROUP BY amount, idx)
"""
PER_RING = CLAIMS + """, pr AS MATERIALIZED (SELECT key_image, n, category, (claimed AND NOT inside) OR CASE WHEN sure AND inside THEN free_own ELSE free END = 0 OR (asked AND NOT told_inside) AS conflict FROM (
 SELECT s.key_image, s.n, c.key_image IS NOT NULL AS claimed, coalesce(c.confidence = 1.0 AND c.pass >= 0, false) AS sure, t.key_image IS NOT NULL AS asked,
 CASE WHEN c.confidence = 1.0 AND c.pass >= 0 THEN 'deterministic_resolutions' WHEN c.key_image IS NOT NULL THEN 'hypothesis_resolutions' WHEN coalesce(l.lft, s.n) < s.n THEN 'unresolved_reduced' ELSE 'unresolved_unchanged' END AS category, f.free, f.free_own, f.inside, f.told_inside
 FROM siz s LEFT JOIN claims c USING (key_image) LEFT JOIN told t USING (key_image) LEFT JOIN liv l USING (key_image) JOIN (SELECT m.key_image, count(*) FILTER (o.owners IS NULL OR (o.owners = 1 AND o.owner = m.key_image)) AS free, count(*) FILTER ((o.owners IS NULL OR (o.owners = 1 AND o.owner = m.key_image)) AND c.idx = m.idx) AS free_own,
  bool_or(coalesce(c.idx = m.idx, false)) AS inside, bool_or(coalesce(t.idx = m.idx, false)) AS told_inside FROM m LEFT JOIN own o ON o.amount = m.amount AND o.idx = m.idx LEFT JOIN claims c ON c.key_image = m.key_image LEFT JOIN told t ON t.key_image = m.key_image GROUP BY m.key_image) f USING (key_image)))
"""


def stored(spark: SparkSession, sf: str) -> tuple:
    """The ring view, the analysis, claims (key_image, amount, idx, pass, confidence) and predictions (key_image, amount, idx)."""
    r, c = _cascade(spark, sf)
    sized = c.live().select("key_image", "left")
    open_ = r.members.join(sized.select("key_image"), "key_image", "left_semi").groupBy("key_image").agg(F.min("amount").alias("amount"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    claim = lambda rows, idx, at, how: rows.select("key_image", "amount", idx.alias("idx"), F.lit(at).alias("pass"), F.lit(how).alias("confidence"))
    key = F.col("key_image")
    lost = r.context.where(key % 3 == 0).join(c.sizes.select("key_image"), "key_image", "left_anti").withColumn("amount", key % 10)
    claims = claim(c.resolved, F.col("idx"), 0, 1.0).drop("pass").join(c.resolved.select("key_image", "pass"), "key_image").select("key_image", "amount", "idx", "pass", "confidence")
    claims = claims.union(claim(open_.where(key % 40 == 7), F.col("lo"), -1, 0.99)).union(claim(open_.where(key % 40 == 9), F.col("hi") + 1, 1, 1.0)).union(claim(lost, F.lit(1).cast("long"), 0, 1.0))
    told = open_.where(key % 25 == 3).select("key_image", "amount", F.when(key % 100 == 3, F.col("hi") + 5).otherwise(F.col("lo")).alias("idx"))
    return r, c, cut(claims, "claims"), cut(told, "told")


def per_ring(r, c, claims: DataFrame, told: DataFrame) -> DataFrame:
    return evidence.rings(r.members, claims, c.live(), told)


@query(PER_RING + "SELECT key_image, n, category FROM pr WHERE conflict")
def conflict_rings(spark: SparkSession, sf: str) -> DataFrame:
    return per_ring(*stored(spark, sf)).where("conflict").drop("conflict")


COUNTS = """count(n) AS total_rings, count(*) FILTER (n = 1) AS original_singleton_rings, count(*) FILTER (n > 1) AS original_multimember_rings, count(*) FILTER (n = 1 AND category = 'deterministic_resolutions') AS deterministic_singleton_resolutions, count(*) FILTER (n > 1 AND category = 'deterministic_resolutions') AS deterministic_multimember_resolutions,
count(*) FILTER (category = 'deterministic_resolutions') AS deterministic_resolutions, count(*) FILTER (category = 'hypothesis_resolutions') AS hypothesis_resolutions, count(*) FILTER (category = 'unresolved_reduced') AS unresolved_reduced, count(*) FILTER (category = 'unresolved_unchanged') AS unresolved_unchanged, count(*) FILTER (conflict) AS conflict_rings"""
MORE = "deterministic_resolutions + hypothesis_resolutions AS fully_resolved, unresolved_reduced AS partially_reduced, unresolved_unchanged AS unreduced"
LOST = "(SELECT count(*) FROM claims WHERE key_image NOT IN (SELECT key_image FROM siz))"


@query(PER_RING + f"SELECT *, {MORE}, {LOST} AS orphan_resolution_claims, format('{{:.2f}}%', 100.0 * (deterministic_resolutions + hypothesis_resolutions) / total_rings) AS resolution_rate, format('{{:.2f}}%', 100.0 * deterministic_resolutions / total_rings) AS deterministic_resolution_rate, true AS reconciles FROM (SELECT {COUNTS} FROM pr)")
def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    r, c, claims, told = stored(spark, sf)
    return evidence.reconciles(evidence.summary(per_ring(r, c, claims, told), r.members, claims))


ERA = "CASE WHEN height IS NULL OR height < 0 THEN 'unknown' WHEN height <= 11 THEN 'first' WHEN height <= 29 THEN 'second' WHEN height <= 47 THEN 'third' WHEN height <= 65 THEN 'fourth' ELSE 'fifth' END"
ROLL = PER_RING + f""", rl AS MATERIALIZED (SELECT e.era, coalesce(blocks_scanned, 0) AS blocks_scanned, coalesce(transactions, 0) AS transactions, {", ".join(f"coalesce({f}, 0)::BIGINT AS {f}" for f in evidence.FIELDS[2:13])}, CASE WHEN e.era = 'unknown' THEN {LOST} ELSE 0 END AS orphan_resolution_claims
 FROM (SELECT unnest(['first', 'second', 'third', 'fourth', 'fifth', 'unknown']) AS era) e LEFT JOIN (SELECT {ERA} AS era, count(*) AS blocks_scanned FROM (SELECT DISTINCT height FROM ctx) GROUP BY 1) b USING (era) LEFT JOIN (SELECT {ERA} AS era, count(*) AS transactions FROM (SELECT DISTINCT tx_hash, height FROM ctx) GROUP BY 1) t USING (era)
 LEFT JOIN (SELECT {ERA} AS era, sum(rows)::BIGINT AS ring_members, {COUNTS} FROM pr LEFT JOIN ctx USING (key_image) JOIN (SELECT l_orderkey AS key_image, count(*) AS rows FROM lineitem GROUP BY 1) USING (key_image) GROUP BY 1) x USING (era))
"""


def _roll(spark: SparkSession, sf: str, total: bool = False) -> tuple:
    r, c, claims, told = stored(spark, sf)
    raw = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key_image")).join(r.context.select("key_image", "tx_hash", F.lit(0).alias("input_index"), "height"), "key_image", "left")
    rows = cut(per_ring(r, c, claims, told), "per_ring")
    txs = r.context.select("tx_hash", "height").distinct()
    roll = evidence.era_roll(evidence.eras_of_rings(raw, eras.MONTH_ERAS), rows, r.context.select("height").distinct(), txs, r.members, claims, eras.MONTH_ERAS, total)
    return roll, evidence.summary(rows, r.members, claims)


@query(ROLL + f"SELECT *, {MORE}, true AS valid FROM rl")
def era_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.valid_counts(_roll(spark, sf)[0])


@query(ROLL + f""", ry AS (SELECT *, {MORE} FROM rl), tt AS (SELECT *, {MORE}, {LOST} AS orphan_resolution_claims FROM (SELECT {COUNTS} FROM pr))
{" UNION ALL ".join(f"SELECT '{f}' AS field, CAST(sum({f}) AS BIGINT) AS era_total, {'NULL::BIGINT' if f in evidence.FIELDS[:3] else f'(SELECT {f} FROM tt)'} AS summary_total, sum({f}) IS NOT DISTINCT FROM {'NULL' if f in evidence.FIELDS[:3] else f'(SELECT {f} FROM tt)'} AS matches FROM ry" for f in evidence.FIELDS)}""")
def era_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.reconciliation(*_roll(spark, sf, True))


@query(ROLL + """SELECT CAST(sum(total_rings) FILTER (era <> 'unknown') AS BIGINT) AS classified_rings, CAST(sum(total_rings) FILTER (era = 'unknown') AS BIGINT) AS unknown_rings, CAST(sum(blocks_scanned) FILTER (era <> 'unknown') AS BIGINT) AS classified_blocks, CAST(sum(blocks_scanned) FILTER (era = 'unknown') AS BIGINT) AS unknown_blocks,
CAST(sum(transactions) FILTER (era <> 'unknown') AS BIGINT) AS classified_transactions, CAST(sum(transactions) FILTER (era = 'unknown') AS BIGINT) AS unknown_transactions FROM rl""")
def era_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.coverage(_roll(spark, sf)[0])


#: A ring of two orders of a customer is given both contexts, so that some rings lie in two eras, and some have no height.
CONTEXTS = f"""WITH d AS (SELECT o_orderkey - o_orderkey % 4 AS key_image, o_custkey AS tx_hash, CASE WHEN o_orderkey % 97 <> 0 THEN CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) END AS height FROM orders),
g AS (SELECT key_image, count(*) AS rows, count(DISTINCT (tx_hash, coalesce(height, -1))) AS contexts, bool_or(height IS NULL) AS bad, count(DISTINCT {ERA}) AS e FROM d GROUP BY 1)
SELECT coalesce(reason, 'known') AS reason, count(*) AS rings, CAST(sum(rows) AS BIGINT) AS rows, count(*) FILTER (contexts > 1) AS several_contexts FROM (SELECT *, CASE WHEN bad THEN 'missing_or_invalid_input_height' WHEN e > 1 THEN 'multiple_era_input_contexts' END AS reason FROM g) GROUP BY 1"""


@query(CONTEXTS)
def era_unknown_reasons(spark: SparkSession, sf: str) -> DataFrame:
    orders, key = table(spark, sf, "orders"), F.col("o_orderkey")
    month = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("long")
    details = orders.select((key - key % 4).alias("key_image"), F.col("o_custkey").alias("tx_hash"), F.lit(0).alias("input_index"), F.when(key % 97 != 0, month).alias("height"))
    placed = evidence.eras_of_rings(details, eras.MONTH_ERAS)
    return placed.groupBy(F.coalesce("reason", F.lit("known")).alias("reason")).agg(F.count("*").alias("rings"), F.sum("rows").alias("rows"), F.count_if(F.col("contexts") > 1).alias("several_contexts"))


@query(CLAIMS + """, src AS (SELECT claims.amount, claims.idx, claims.key_image AS source FROM claims SEMI JOIN m ON m.key_image = claims.key_image AND m.amount = claims.amount AND m.idx = claims.idx WHERE confidence = 1.0 AND pass >= 0),
b AS (SELECT m.*, (SELECT array_to_string(list_slice(list(source ORDER BY source), 1, 20), ',') FROM src WHERE src.amount = m.amount AND src.idx = m.idx AND source <> m.key_image) AS eliminated_by, (SELECT count(*) FROM src WHERE src.amount = m.amount AND src.idx = m.idx AND source <> m.key_image) AS eliminators,
 EXISTS (SELECT 1 FROM src WHERE src.amount = m.amount AND src.idx = m.idx AND source = m.key_image) AS is_claim FROM m)
SELECT key_image, amount, idx, coalesce(eliminated_by, '') AS eliminated_by, eliminators, is_claim, CASE WHEN eliminators > 0 THEN 'eliminated' WHEN bool_or(is_claim) OVER (PARTITION BY key_image) AND NOT is_claim THEN 'excluded' ELSE 'remaining' END AS state FROM b""")
def explain_ring(spark: SparkSession, sf: str) -> DataFrame:
    r, _, claims, _ = stored(spark, sf)
    return graph.explain(r.members, claims).withColumn("eliminated_by", F.array_join("eliminated_by", ","))


@query(CLAIMS + """, b AS (SELECT m.key_image, coalesce(o.owners, 0) - (c.key_image IS NOT NULL)::INT AS others, c.key_image IS NOT NULL AS mine FROM m LEFT JOIN own o ON o.amount = m.amount AND o.idx = m.idx LEFT JOIN (SELECT * FROM claims WHERE confidence = 1.0 AND pass >= 0) c ON c.key_image = m.key_image AND c.amount = m.amount AND c.idx = m.idx),
g AS (SELECT key_image, count(*) AS candidates, count(*) FILTER (others = 0 AND (mine OR NOT held)) AS remaining, bool_or(mine AND others > 0) AS shared FROM (SELECT *, bool_or(mine) OVER (PARTITION BY key_image) AS held FROM b) GROUP BY key_image)
SELECT key_image, candidates, remaining, array_to_string(list_filter([CASE WHEN key_image IN (SELECT c.key_image FROM claims c ANTI JOIN m ON m.key_image = c.key_image AND m.idx = c.idx) THEN 'resolution_outside_ring' END, CASE WHEN shared THEN 'claimed_by_another_ring' END,
 CASE WHEN key_image IN (SELECT c.key_image FROM told c ANTI JOIN m ON m.key_image = c.key_image AND m.idx = c.idx) THEN 'prediction_outside_ring' END, CASE WHEN remaining = 0 THEN 'no_candidate_remains' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM g""")
def explain_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    r, _, claims, told = stored(spark, sf)
    return graph.conflicts(graph.explain(r.members, claims), r.members, claims, told).withColumn("conflicts", F.array_join("conflicts", ","))


@query("""WITH b AS (SELECT o_orderkey AS height, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 6 ELSE 1 + CAST(o_orderkey // 2000 AS INTEGER) % 16 END AS version, (o_custkey % 30)::INTEGER AS tx, CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 13)::INTEGER END AS inputs, CASE WHEN o_orderkey % 13 <> 0 THEN 'complete' ELSE 'partial' END AS status, (o_custkey % 4)::INTEGER AS size FROM orders),
c AS (SELECT *, CASE WHEN height <= 2499 THEN 'a' WHEN height <= 4999 THEN 'b' ELSE 'c' END AS h, CASE WHEN version IN (1, 2) THEN 'a' WHEN version IN (3, 4, 5) THEN 'b' WHEN version IN (6, 7, 8) THEN 'c' END AS v FROM b)
SELECT coalesce(CASE WHEN version IS NOT NULL THEN v ELSE h END, 'unknown') AS era, count(*) AS blocks, CAST(sum(tx) AS BIGINT) AS transactions, CAST(sum(inputs) FILTER (status = 'complete') AS BIGINT) AS inputs, count(*) FILTER (inputs IS NOT NULL AND status = 'complete') AS complete_blocks,
coalesce(array_to_string(list_sort(list(DISTINCT size) FILTER (inputs IS NOT NULL AND status = 'complete' AND size > 0)), ','), '') AS ring_sizes, min(height) AS first_height, max(height) AS last_height, bool_or(coalesce(version IS NOT NULL AND v <> h, false)) AS mismatch FROM c GROUP BY 1""")
def live_eras(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    version = F.when(key % 5 == 0, F.lit(None)).when(key % 7 == 0, 6).otherwise(1 + F.floor(key / 2000) % 16).cast("int")
    blocks = table(spark, sf, "orders").select(
        key.alias("height"), version.alias("version"), (cust % 30).cast("int").alias("transaction_count"), F.when(key % 11 != 0, (cust % 13).cast("int")).alias("ring_input_count"), F.create_map((cust % 4).cast("int"), (cust % 4).cast("int")).alias("ring_sizes"), F.when(key % 13 != 0, "complete").otherwise("partial").alias("detail_status"),
    )
    three = (eras.Era("a", 0, 2499, (1, 2)), eras.Era("b", 2500, 4999, (3, 4, 5)), eras.Era("c", 5000, None, (6, 7, 8)))
    return eras.live_roll(blocks.union(blocks.where("height % 9 = 0")), three).withColumn("ring_sizes", F.array_join("ring_sizes", ","))


@query(CASCADE + """, ev AS MATERIALIZED (SELECT key_image, amount, idx, pass, row_number() OVER (ORDER BY pass, key_image) AS id FROM res)
SELECT e.id, e.key_image, e.amount, e.idx, e.pass, CASE WHEN e.pass = 0 THEN 'ring_size_one' ELSE 'cascade' END AS method, count(d.source) AS dependencies, coalesce(bool_and(s.id < e.id), true) AS ordered, s.n - 1 = count(d.source) OR s.n IS NULL AS accounted
FROM ev e LEFT JOIN elim d ON d.key_image = e.key_image LEFT JOIN (SELECT ev.key_image, ev.id, NULL::BIGINT AS n FROM ev) s ON s.key_image = d.source GROUP BY e.id, e.key_image, e.amount, e.idx, e.pass, s.n""")
def resolution_events(spark: SparkSession, sf: str) -> DataFrame:
    c = _cascade(spark, sf)[1]
    events, links = cas.events(c)
    later = links.join(events.select(F.col("id").alias("event_id"), "key_image"), "event_id").groupBy("event_id").agg(F.count("*").alias("dependencies"), F.bool_and(F.col("source_event_id") < F.col("event_id")).alias("ordered"))
    rows = events.join(later, events["id"] == later["event_id"], "left").join(c.sizes, "key_image")
    accounted = F.coalesce("dependencies", F.lit(0)) == F.col("n") - 1
    return rows.select("id", "key_image", F.col("real_amount").alias("amount"), F.col("real_output_index").alias("idx"), F.col("resolved_at_pass").alias("pass"), "method", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.coalesce("ordered", F.lit(True)).alias("ordered"), accounted.alias("accounted"))
