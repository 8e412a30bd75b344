"""Registered queries over the ring view and the event, document and page tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions import analytics as an
from evidara.operators import baselines, eras, features, graph, predict, ranges, summary
from evidara.operators import cascade as cas
from evidara.plans.lineage import cut, shared_dir
from evidara.ringview import rings, table
from evidara.sources import ingest
from evidara.streaming.replay import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RING = """m AS MATERIALIZED (SELECT DISTINCT l_orderkey AS key_image, l_orderkey % 10 AS amount, l_partkey AS idx FROM lineitem),
ctx AS MATERIALIZED (SELECT key_image, c * 1000 + height AS tx_hash, height FROM (SELECT o_orderkey AS key_image, o_custkey AS c, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS height FROM orders))"""


def _levels(n: int) -> str:
    parts = ["live0 AS MATERIALIZED (SELECT * FROM m)"]
    for p in range(n):
        parts += [
            f"f{p} AS MATERIALIZED (SELECT key_image, min(amount) AS amount, min(idx) AS idx FROM live{p} GROUP BY key_image HAVING count(*) = 1)",
            f"h{p} AS MATERIALIZED (SELECT l.key_image, l.amount, l.idx, s.source FROM live{p} l JOIN (SELECT amount, idx, min(key_image) AS source FROM f{p} GROUP BY amount, idx) s USING (amount, idx) WHERE l.key_image NOT IN (SELECT key_image FROM f{p}))",
            f"live{p + 1} AS MATERIALIZED (SELECT l.* FROM live{p} l ANTI JOIN f{p} ON l.key_image = f{p}.key_image ANTI JOIN h{p} ON l.key_image = h{p}.key_image AND l.amount = h{p}.amount AND l.idx = h{p}.idx)",
        ]
    union = lambda x, cols: " UNION ALL ".join(f"SELECT {cols}, CAST({p} AS INTEGER) AS pass FROM {x}{p}" for p in range(n))
    parts.append(f"res AS MATERIALIZED ({union('f', 'key_image, amount, idx')})")
    parts.append(f"elim AS MATERIALIZED ({union('h', 'key_image, amount, idx, source')})")
    parts.append("siz AS MATERIALIZED (SELECT key_image, count(*) AS n FROM m GROUP BY key_image)")
    parts.append("liv AS MATERIALIZED (SELECT s.key_image, s.n, s.n - coalesce(e.removed, 0) AS lft FROM siz s LEFT JOIN (SELECT key_image, count(*) AS removed FROM elim GROUP BY key_image) e USING (key_image) ANTI JOIN res ON s.key_image = res.key_image)")
    return ",\n".join(parts)


WITH = f"WITH {RING}\n"
CASCADE = f"WITH {RING},\n{_levels(12)}\n"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _cascade(spark: SparkSession, sf: str):
    r = rings(spark, sf)
    return r, cas.cascade(r.members)


@query(CASCADE + "SELECT key_image, amount, idx, pass FROM res")
def cascade_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return _cascade(spark, sf)[1].resolved.select("key_image", "amount", "idx", "pass")


@query(CASCADE + "SELECT key_image, amount, idx, pass FROM res")
def cascade_by_passes(spark: SparkSession, sf: str) -> DataFrame:
    """The way that large tables take: every pass over the cluster."""
    return cas.cascade(rings(spark, sf).members, one_task=0).resolved.select("key_image", "amount", "idx", "pass")


@query(CASCADE + "SELECT key_image, amount, idx, source, pass FROM elim")
def provenance_by_passes(spark: SparkSession, sf: str) -> DataFrame:
    return cas.cascade(rings(spark, sf).members, one_task=0).eliminated.select("key_image", "amount", "idx", "source", "pass")


@query(CASCADE + "SELECT pass, count(*) AS rings FROM res GROUP BY pass")
def cascade_pass_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _cascade(spark, sf)[1].resolved.groupBy("pass").agg(F.count("*").alias("rings"))


@query(CASCADE + "SELECT e.* FROM elim e SEMI JOIN (SELECT * FROM liv WHERE lft = 0) x ON e.key_image = x.key_image")
def cascade_empty_rings(spark: SparkSession, sf: str) -> DataFrame:
    return cas.empty_rings(_cascade(spark, sf)[1])


@query(CASCADE + "SELECT key_image, amount, idx, source, pass FROM elim")
def elimination_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return _cascade(spark, sf)[1].eliminated.select("key_image", "amount", "idx", "source", "pass")


@query(CASCADE + """SELECT CASE WHEN lft < n THEN 'partial' ELSE 'unreduced' END AS kind, lft AS size, count(*) AS rings FROM liv GROUP BY 1, 2
UNION ALL SELECT 'effective', lft, count(*) FROM liv WHERE lft <> 1 GROUP BY lft UNION ALL SELECT 'effective', 1, count(*) FROM res""")
def ring_size_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return summary.ring_sizes(_cascade(spark, sf)[1])


@query(CASCADE + """SELECT category, count(*) AS rings FROM (SELECT CASE WHEN s.n = 1 THEN 'deterministic_single' ELSE 'deterministic_multi' END AS category FROM res JOIN siz s USING (key_image)
UNION ALL SELECT CASE WHEN lft < n THEN 'reduced' ELSE 'unchanged' END FROM liv) GROUP BY category""")
def reduction_categories(spark: SparkSession, sf: str) -> DataFrame:
    return summary.reduction_categories(_cascade(spark, sf)[1])


@query(CASCADE + """SELECT * FROM (SELECT count(*) AS memberships, count(DISTINCT key_image) AS rings, count(DISTINCT (amount, idx)) AS outputs FROM m),
(SELECT count(DISTINCT tx_hash) AS transactions, count(DISTINCT height) AS blocks FROM ctx), (SELECT count(*) AS resolved, count(*) FILTER (pass >= 0) AS deterministic FROM res)""")
def brain_summary(spark: SparkSession, sf: str) -> DataFrame:
    r, c = _cascade(spark, sf)
    return summary.brain_summary(r.members, r.context, c.resolved)


@query(WITH + "SELECT (SELECT count(*) FROM orders) AS rows_orders, (SELECT count(*) FROM lineitem) AS rows_lineitem, (SELECT count(*) FROM m) AS memberships, (SELECT count(DISTINCT height) FROM ctx) AS blocks, (SELECT round(100.0 * count(DISTINCT height) / (max(height) + 1), 6) FROM ctx) AS coverage")
def db_stats(spark: SparkSession, sf: str) -> DataFrame:
    r = rings(spark, sf)
    blocks = r.context.agg(F.count_distinct("height").alias("blocks"), F.round(100.0 * F.count_distinct("height") / (F.max("height") + 1), 6).alias("coverage"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(table(spark, sf, "orders"), "rows_orders").join(one(table(spark, sf, "lineitem"), "rows_lineitem")).join(one(r.members, "memberships")).join(blocks)


@query(WITH + "SELECT amount, idx, count(*) AS reuse FROM m GROUP BY amount, idx")
def output_reuse(spark: SparkSession, sf: str) -> DataFrame:
    return rings(spark, sf).members.groupBy("amount", "idx").agg(F.count("*").alias("reuse"))


@query(WITH + "SELECT amount, max(idx) AS max_idx FROM m GROUP BY amount")
def amount_max_index(spark: SparkSession, sf: str) -> DataFrame:
    return features.amount_tips(rings(spark, sf).members)


OPB = "SELECT CASE WHEN max(idx) IS NOT NULL AND max(height) > 0 THEN greatest((max(idx) + 1) / max(height), 1e-9) ELSE 1.0 END AS per_block FROM m JOIN ctx USING (key_image) WHERE amount = 0"


@query(WITH + f"SELECT round(CAST(per_block AS DOUBLE), 6) AS per_block FROM ({OPB})")
def outputs_per_block(spark: SparkSession, sf: str) -> DataFrame:
    r = rings(spark, sf)
    return features.outputs_per_block(r.members, r.context).select(F.round("per_block", 6).alias("per_block"))


@query(WITH + """SELECT key_image, related, shared, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY key_image ORDER BY shared DESC, related) AS INTEGER) AS rank FROM
(SELECT a.key_image, b.key_image AS related, count(*) AS shared FROM m a JOIN m b ON a.amount = b.amount AND a.idx = b.idx AND a.key_image <> b.key_image GROUP BY 1, 2)) WHERE rank <= 20""")
def related_rings_topk(spark: SparkSession, sf: str) -> DataFrame:
    return graph.related(rings(spark, sf).members)


@query(CASCADE.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + """, dep AS MATERIALIZED (SELECT DISTINCT e.key_image, e.source AS ancestor FROM elim e SEMI JOIN res ON e.key_image = res.key_image),
walk AS (SELECT key_image, ancestor, 1 AS depth FROM dep UNION SELECT w.key_image, d.ancestor, w.depth + 1 FROM walk w JOIN dep d ON d.key_image = w.ancestor)
SELECT key_image, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY key_image, ancestor""")
def trace_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return graph.trace(cas.dependencies(_cascade(spark, sf)[1]))


@query(WITH + "SELECT tx_hash, count(DISTINCT key_image) AS rings, min(key_image) AS first, max(key_image) AS last FROM ctx GROUP BY tx_hash HAVING count(DISTINCT key_image) > 1")
def tx_groups(spark: SparkSession, sf: str) -> DataFrame:
    return graph.groups(rings(spark, sf).context, ["tx_hash"])


@query(WITH + "SELECT amount, idx, count(DISTINCT key_image) AS rings, min(key_image) AS first, max(key_image) AS last FROM m GROUP BY amount, idx HAVING count(DISTINCT key_image) > 1")
def output_groups(spark: SparkSession, sf: str) -> DataFrame:
    return graph.groups(rings(spark, sf).members, ["amount", "idx"])


@query("""WITH v AS (SELECT l_orderkey AS t, l_linenumber AS pos, l_partkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS p FROM lineitem)
SELECT t AS tx_hash, 1 AS input_index, 'k' || t AS key_image, t % 10 AS amount, CAST(p AS INTEGER) AS position, CAST(sum(o) OVER (PARTITION BY t ORDER BY p) AS BIGINT) AS global_output_index FROM v""")
def flattened_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Ring members out of transaction bodies, whose first input is coinbase and whose second is the ring, by relative offsets."""
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(order.alias("x"))
    key = F.struct((F.col("l_orderkey") % 10).alias("amount"), F.transform("x", lambda x: x["l_partkey"]).alias("key_offsets"), F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("k_image"))
    body = F.concat(F.lit('{"vin":[{"gen":{"height":1}},{"key":'), F.to_json(key), F.lit('}],"vout":[]}'))
    return ingest.flatten(lines.select(F.col("l_orderkey").alias("tx_hash"), body.alias("json")))


ERA = "CASE WHEN height IS NULL OR height < 0 THEN 'unknown' WHEN height <= 11 THEN 'first' WHEN height <= 29 THEN 'second' WHEN height <= 47 THEN 'third' WHEN height <= 65 THEN 'fourth' ELSE 'fifth' END"


@query(WITH + f"SELECT {ERA} AS era, count(*) AS rings, min(height) AS first_height, max(height) AS last_height FROM ctx GROUP BY 1")
def era_case_bucket(spark: SparkSession, sf: str) -> DataFrame:
    era = F.coalesce(eras.era_of("height", eras.MONTH_ERAS), F.lit("unknown"))
    return rings(spark, sf).context.groupBy(era.alias("era")).agg(F.count("*").alias("rings"), F.min("height").alias("first_height"), F.max("height").alias("last_height"))


FEATURE_SQL = WITH + f""", r AS MATERIALIZED (SELECT m.*, u.reuse, c.height, t.max_idx, o.per_block FROM m JOIN (SELECT amount, idx, count(*) AS reuse FROM m GROUP BY amount, idx) u USING (amount, idx) JOIN ctx c USING (key_image) JOIN (SELECT amount, max(idx) AS max_idx FROM m GROUP BY amount) t USING (amount), ({OPB}) o),
a AS (SELECT *, count(*) OVER k AS n, row_number() OVER o - 1 AS rank0, min(idx) OVER k AS lo, max(idx) OVER k AS hi, lead(idx) OVER o AS aft, lag(idx) OVER o AS bef, min(reuse) OVER k AS min_reuse, max(reuse) OVER k AS max_reuse, row_number() OVER (PARTITION BY key_image ORDER BY reuse, idx, amount) - 1 AS reuse0
 FROM r WINDOW k AS (PARTITION BY key_image), o AS (PARTITION BY key_image ORDER BY idx, amount)),
b AS (SELECT *, greatest(hi - lo, 1) AS span, greatest(n - 1, 1) AS n1, 120 * CASE WHEN amount = 0 THEN greatest(greatest(hi, height * per_block) - idx, 0) / per_block ELSE 15 * (hi - idx) / greatest(hi - lo, 1) END AS secs, CASE WHEN amount = 0 THEN 0.0 ELSE least(greatest((idx + 1) / (max_idx + 1), 0.0), 1.0) END AS progress FROM a),
c AS (SELECT *, coalesce((aft - idx) / span, 0.0) AS nxt, coalesce((idx - bef) / span, 0.0) AS prv, least(greatest(CASE WHEN secs <= 1800 THEN -ln(1800) ELSE {features.SHAPE - 1!r} * ln(ln(secs + 1200)) - ln(secs + 1200) * 1.61 - {features.SHAPE_LOG_SCALE!r} - {features.LOG_GAMMA_SHAPE!r} - ln(secs + 1200) END, -50.0), 0.0) AS ll FROM b),
d AS (SELECT *, CASE WHEN amount <> 0 THEN CAST(progress AS DOUBLE) ELSE exp(ll) END AS decoy FROM c),
e AS MATERIALIZED (SELECT *, max(greatest(nxt, prv)) OVER k AS max_gap, row_number() OVER (PARTITION BY key_image ORDER BY decoy, idx, amount) - 1 AS decoy0, max(decoy) OVER k AS max_decoy, avg(decoy) OVER k AS mean_decoy, stddev_pop(decoy) OVER k AS std_decoy FROM d WINDOW k AS (PARTITION BY key_image)),
feat AS MATERIALIZED (SELECT key_image, amount, idx, height, reuse, rank0 / n1 AS output_age_rank, (idx - lo) / span AS normalized_age, ln(1 + reuse) AS ring_reuse_count, (idx = hi)::DOUBLE AS is_newest_member, abs(rank0 / n1 - 0.75) AS age_matches_decoy_distribution, n::DOUBLE AS ring_size, nxt AS gap_to_next, prv AS gap_to_prev, (height - idx) / greatest(height, 1) AS distance_from_tx,
 reuse0 / n1 AS reuse_rank_in_ring, (reuse = min_reuse)::DOUBLE AS is_min_reuse, reuse / greatest(max_reuse, 1) AS reuse_count_raw, least(prv, nxt) / greatest(max_gap, 1e-9) AS gap_isolation, (greatest(prv, nxt) >= max_gap)::DOUBLE AS is_max_gap_member, ll AS gamma_decoy_log_likelihood, (secs <= 1800)::DOUBLE AS gamma_recent_window, -ll / 50 AS gamma_age_surprisal, progress AS legacy_triangular_likelihood, progress AS amount_bucket_progress,
 (amount <> 0)::DOUBLE AS is_legacy_amount, decoy0 / n1 AS decoy_likelihood_rank, (decoy = max_decoy)::DOUBLE AS is_most_decoy_like, max_decoy - decoy AS decoy_likelihood_gap, CASE WHEN std_decoy > 1e-12 THEN (decoy - mean_decoy) / std_decoy ELSE 0.0 END AS decoy_likelihood_zscore FROM e)
"""


def _feature_query(name: str, names: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = rings(spark, sf)
        return features.features(r.members, r.context).select("key_image", "amount", "idx", *(F.round(c, 6).alias(c) for c in names))

    run.__name__ = name
    query(FEATURE_SQL + "SELECT key_image, amount, idx, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in names) + " FROM feat")(run)


for _name, _names in {
    "features_age": ("output_age_rank", "normalized_age", "is_newest_member", "age_matches_decoy_distribution", "ring_size", "distance_from_tx"), "features_gaps": ("gap_to_next", "gap_to_prev", "gap_isolation", "is_max_gap_member"), "features_reuse": ("ring_reuse_count", "reuse_rank_in_ring", "is_min_reuse", "reuse_count_raw"),
    "features_gamma": ("gamma_decoy_log_likelihood", "gamma_recent_window", "gamma_age_surprisal"), "features_decoy": ("legacy_triangular_likelihood", "amount_bucket_progress", "is_legacy_amount", "decoy_likelihood_rank", "is_most_decoy_like", "decoy_likelihood_gap", "decoy_likelihood_zscore"),
}.items():
    _feature_query(_name, _names)


@query(WITH + """SELECT key_image, amount, idx, reuse, round(CASE WHEN n > 1 THEN (2 * low - 2 + peers - 1) / (2 * (n - 1)) ELSE 0.0 END, 6) AS midrank FROM (SELECT m.*, u.reuse, count(*) OVER (PARTITION BY key_image) AS n, rank() OVER (PARTITION BY key_image ORDER BY reuse) AS low, count(*) OVER (PARTITION BY key_image, reuse) AS peers
FROM m JOIN (SELECT amount, idx, count(*) AS reuse FROM m GROUP BY amount, idx) u USING (amount, idx))""")
def reuse_midrank(spark: SparkSession, sf: str) -> DataFrame:
    return features.midrank(features.reuse(rings(spark, sf).members)).select("key_image", "amount", "idx", "reuse", F.round("midrank", 6).alias("midrank"))


def _unpivot(names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT key_image, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM feat" for c in names)


PROFILED = ("output_age_rank", "normalized_age", "ring_reuse_count", "ring_size", "gap_to_next", "reuse_rank_in_ring", "reuse_count_raw", "gamma_age_surprisal", "amount_bucket_progress", "decoy_likelihood_gap")


@query(FEATURE_SQL + f""", p AS (SELECT feature, key_image, count(*) AS c, min(value) AS lo, max(value) AS hi, FROM ({_unpivot(PROFILED)}) GROUP BY feature, key_image)
SELECT feature, CAST(sum(c) AS BIGINT) AS finite, round(min(lo), 4) AS min, round(max(hi), 4) AS max, round(any_value(mean), 4) AS mean, round(any_value(variance), 4) AS variance, min(lo) = max(hi) AS constant, count(*) FILTER (c > 1) AS eligible_rings, count(*) FILTER (hi > lo) AS varying_rings
FROM p JOIN (SELECT feature, avg(value) AS mean, var_pop(value) AS variance FROM ({_unpivot(PROFILED)}) GROUP BY feature) USING (feature) GROUP BY feature""")
def feature_profile(spark: SparkSession, sf: str) -> DataFrame:
    r = rings(spark, sf)
    p = features.profile(features.features(r.members, r.context), PROFILED)
    return p.select("feature", "finite", *(F.round(c, 4).alias(c) for c in ("min", "max", "mean", "variance")), "constant", "eligible_rings", "varying_rings")


PAIRS = ", ".join(f"{{'left': '{a}', 'right': '{b}', 'same': bool_and({a} IS NOT DISTINCT FROM {b})}}" for i, a in enumerate(features.FEATURES) for b in features.FEATURES[i + 1 :])


@query(FEATURE_SQL + f"SELECT p.left, p.right FROM (SELECT unnest([{PAIRS}]) AS p FROM feat) WHERE p.same")
def duplicate_columns(spark: SparkSession, sf: str) -> DataFrame:
    r = rings(spark, sf)
    return features.duplicate_columns(features.features(r.members, r.context))


@query(WITH + "SELECT count(*) AS rings, count(*) FILTER (d < n) AS any_tie, count(*) FILTER (d = 1 AND n > 1) AS all_tied FROM (SELECT key_image, count(*) AS n, count(DISTINCT reuse) AS d FROM m JOIN (SELECT amount, idx, count(*) AS reuse FROM m GROUP BY amount, idx) u USING (amount, idx) GROUP BY key_image)")
def reuse_tie_summary(spark: SparkSession, sf: str) -> DataFrame:
    return features.reuse_ties(features.reuse(rings(spark, sf).members))


EXCLUDED = CASCADE + """, x AS MATERIALIZED (SELECT r.*, s.n, CASE WHEN s.n IS NULL THEN 'missing_members' WHEN c.height IS NULL THEN 'missing_context' WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.key_image = r.key_image AND m.amount = r.amount AND m.idx = r.idx) THEN 'invalid_label'
 WHEN t.claimed > 1 THEN 'conflicting_label' WHEN s.n < 2 THEN 'singleton' END AS reason FROM res r JOIN (SELECT amount, idx, count(*) AS claimed FROM res GROUP BY amount, idx) t USING (amount, idx) LEFT JOIN siz s USING (key_image) LEFT JOIN ctx c USING (key_image))"""


@query(EXCLUDED + "SELECT coalesce(reason, 'included') AS reason, count(*) AS claims FROM x GROUP BY 1")
def baseline_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    r, c = _cascade(spark, sf)
    return baselines.exclusions(r.details(), cut(c.resolved, "resolved")).groupBy(F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count("*").alias("claims"))


CREDITS = EXCLUDED + """, w AS (SELECT m.key_image, x.n, m.idx = x.idx AS real, true AS uniform, m.idx = max(m.idx) OVER k AS newest, m.idx = min(m.idx) OVER k AS oldest, u.reuse = min(u.reuse) OVER k AS minimum_reuse FROM m JOIN x ON x.key_image = m.key_image AND x.reason IS NULL
 JOIN (SELECT amount, idx, count(*) AS reuse FROM m GROUP BY amount, idx) u ON u.amount = m.amount AND u.idx = m.idx WINDOW k AS (PARTITION BY m.key_image)),
cr AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT key_image, n, '{b}' AS baseline, count(*) FILTER ({b}) AS ties, bool_or({b} AND real) AS hit FROM w GROUP BY key_image, n" for b in baselines.BASELINES) + ")\n"
METRICS = "count(*) AS rings, round(sum(CASE WHEN hit THEN 1.0::DOUBLE / ties ELSE 0 END), 6) AS expected, round(sum(CASE WHEN hit THEN 1.0::DOUBLE / ties ELSE 0 END) / count(*), 6) AS accuracy, count(*) FILTER (hit) AS contains, count(*) FILTER (ties = 1) AS \"unique\", count(*) FILTER (ties = 1 AND hit) AS unique_correct, count(*) FILTER (ties > 1) AS tied"
PARTS = "(SELECT {by}, string_agg(ties || ':' || c || ':' || h, ',' ORDER BY ties) AS parts FROM (SELECT {by}, ties, count(*) AS c, count(*) FILTER (hit) AS h FROM cr GROUP BY {by}, ties) GROUP BY {by})"


def _credits(spark: SparkSession, sf: str) -> DataFrame:
    r, c = _cascade(spark, sf)
    return baselines.credits(r.members, baselines.eligible(r.details(), cut(c.resolved.select("key_image", "amount", "idx"), "resolved")))


def _metrics(rows: DataFrame, *by: str) -> DataFrame:
    part = lambda p: F.concat_ws(":", *(p[k].cast("string") for k in ("ties", "rings", "hits")))
    return baselines.metrics(rows, by).withColumn("parts", F.array_join(F.transform("parts", part), ",")).withColumns({c: F.round(c, 6) for c in ("expected", "accuracy")})


@query(CREDITS + f"SELECT * FROM (SELECT baseline, {METRICS} FROM cr GROUP BY baseline) JOIN {PARTS.format(by='baseline')} USING (baseline)")
def baseline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(_credits(spark, sf), "baseline")


@query(CREDITS + f"SELECT * FROM (SELECT baseline, n, {METRICS} FROM cr GROUP BY baseline, n) JOIN {PARTS.format(by='baseline, n')} USING (baseline, n)")
def baseline_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(_credits(spark, sf), "baseline", "n")


QUARTILES = "SELECT key_image, height, CAST(4 * rank0 // total AS INTEGER) AS quartile FROM (SELECT key_image, height, row_number() OVER (ORDER BY height, tx_hash, key_image) - 1 AS rank0, count(*) OVER () AS total FROM {})"
TIME_ORDER = ["height", "tx_hash", "key_image"]


@query(WITH + QUARTILES.format("ctx"))
def chronological_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return baselines.quartiles(rings(spark, sf).context, TIME_ORDER).select("key_image", "height", "quartile")


@query(CREDITS + f", own AS (SELECT DISTINCT cr.key_image, ctx.height, ctx.tx_hash FROM cr JOIN ctx USING (key_image)), q AS ({QUARTILES.format('own')}) SELECT baseline, quartile, {METRICS} FROM cr JOIN q USING (key_image) GROUP BY baseline, quartile")
def baseline_by_quartile(spark: SparkSession, sf: str) -> DataFrame:
    credits = cut(_credits(spark, sf), "credits")
    own = rings(spark, sf).context.join(credits.select("key_image").distinct(), "key_image", "left_semi")
    return _metrics(credits.join(baselines.quartiles(own, TIME_ORDER).select("key_image", "quartile"), "key_image"), "baseline", "quartile").drop("parts")


SPLIT = WITH + """, cutoff AS MATERIALIZED (SELECT min(height) AS cutoff FROM (SELECT height, sum(count(*)) OVER (ORDER BY height) AS upto FROM ctx GROUP BY height), (SELECT count(*) AS total FROM ctx) WHERE upto > floor(0.8 * total)),
parts AS MATERIALIZED (SELECT ctx.*, CASE WHEN height < cutoff THEN 'train' ELSE 'test' END AS part FROM ctx, cutoff)
"""


def _parts(spark: SparkSession, sf: str):
    r = rings(spark, sf)
    return r, baselines.split(r.context, baselines.chronological_cutoff(r.context))


@query(SPLIT + "SELECT part, count(*) AS rings, min(height) AS first_height, max(height) AS last_height FROM parts GROUP BY part")
def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf)[1].groupBy("part").agg(F.count("*").alias("rings"), F.min("height").alias("first_height"), F.max("height").alias("last_height"))


@query(SPLIT + """SELECT (SELECT count(*) FROM (SELECT amount, idx FROM m JOIN parts USING (key_image) GROUP BY 1, 2 HAVING count(DISTINCT part) = 2)) AS outputs, (SELECT count(*) FROM (SELECT tx_hash FROM parts GROUP BY 1 HAVING count(DISTINCT part) = 2)) AS transactions,
(SELECT count(*) FROM (SELECT key_image FROM parts GROUP BY 1 HAVING count(DISTINCT part) = 2)) AS rings""")
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    r, parts = _parts(spark, sf)
    return baselines.overlap(r.members, parts)


COMPONENTS = SPLIT.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + """, past AS MATERIALIZED (SELECT * FROM parts WHERE part = 'train'), pm AS MATERIALIZED (SELECT m.* FROM m SEMI JOIN past ON past.key_image = m.key_image),
e AS MATERIALIZED (SELECT b.a, pm.key_image AS b FROM pm JOIN (SELECT amount, idx, min(key_image) AS a FROM pm GROUP BY amount, idx) b USING (amount, idx) UNION SELECT t.a, past.key_image FROM past JOIN (SELECT tx_hash, min(key_image) AS a FROM past GROUP BY tx_hash) t USING (tx_hash)), ee AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(v, root) USING KEY (v) AS (SELECT key_image, key_image FROM past UNION SELECT x.v, x.r FROM (SELECT ee.b AS v, min(cc.root) AS r FROM cc JOIN ee ON ee.a = cc.v GROUP BY ee.b) x JOIN recurring.cc AS old ON old.v = x.v WHERE x.r < old.root)
"""


@query(COMPONENTS + "SELECT v AS key_image, root FROM cc")
def past_components(spark: SparkSession, sf: str) -> DataFrame:
    r = rings(spark, sf)
    return graph.past_components(r.members, r.context, baselines.chronological_cutoff(r.context).first()[0])


@query(COMPONENTS + """, bad AS (SELECT root FROM cc JOIN pm ON pm.key_image = cc.v SEMI JOIN (SELECT amount, idx FROM m JOIN parts USING (key_image) WHERE part = 'test') t ON t.amount = pm.amount AND t.idx = pm.idx UNION SELECT root FROM cc JOIN past ON past.key_image = cc.v WHERE tx_hash IN (SELECT tx_hash FROM parts WHERE part = 'test'))
SELECT count(*) AS train, count(*) FILTER (root NOT IN (SELECT root FROM bad)) AS kept, count(DISTINCT root) AS components FROM cc""")
def component_purge(spark: SparkSession, sf: str) -> DataFrame:
    r, parts = _parts(spark, sf)
    cutoff = baselines.chronological_cutoff(r.context).first()[0]
    roots = graph.past_components(r.members, r.context, cutoff)
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    kept = baselines.purge(train, test, roots, r.members)
    return train.agg(F.count("*").alias("train")).join(kept.agg(F.count("*").alias("kept"))).join(roots.agg(F.count_distinct("root").alias("components")))


FRAME = CASCADE + """, fr AS MATERIALIZED (SELECT s.key_image, s.n, CASE WHEN r.key_image IS NULL THEN f.free ELSE s.n END AS candidates, CASE WHEN s.n < 2 THEN 'original_size_below_two' WHEN c.height IS NULL THEN 'ambiguous_or_missing_input_context' WHEN r.key_image IS NULL AND f.free < 2 THEN 'unresolved_survivors_below_two' END AS reason,
 CASE WHEN r.key_image IS NULL THEN 'unresolved_scoring' ELSE 'deterministic_training' END || '|' || CASE WHEN f.amount = 0 THEN 'amount_zero' ELSE 'legacy_nonzero' END || '|' || CASE WHEN s.n <= 2 THEN '2' WHEN s.n <= 4 THEN '3–4' WHEN s.n <= 8 THEN '5–8' WHEN s.n <= 16 THEN '9–16' WHEN s.n <= 32 THEN '17–32' ELSE '33+' END AS stratum
 FROM siz s LEFT JOIN ctx c USING (key_image) LEFT JOIN res r USING (key_image) JOIN (SELECT key_image, min(amount) AS amount, count(*) FILTER (NOT coalesce(named, false)) AS free FROM m LEFT JOIN (SELECT DISTINCT amount, idx, true AS named FROM res) USING (amount, idx) GROUP BY key_image) f USING (key_image))
"""


def _frame(spark: SparkSession, sf: str) -> DataFrame:
    r, c = _cascade(spark, sf)
    return baselines.sample_frame(r.details(), c.resolved.select("key_image", "amount", "idx", "pass", F.lit(1.0).alias("confidence")))


@query(FRAME + "SELECT coalesce(reason, stratum) AS \"group\", count(*) AS rings, CAST(sum(candidates) AS BIGINT) AS candidates FROM fr GROUP BY 1")
def sampling_frame(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, sf).groupBy(F.coalesce("reason", "stratum").alias("group")).agg(F.count("*").alias("rings"), F.sum("candidates").alias("candidates"))


@query(FRAME + "SELECT key_image, stratum, candidates, CAST(rank AS INTEGER) AS rank, priority FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY priority, key_image) AS rank FROM (SELECT *, sha256('42:' || stratum || ':' || key_image) AS priority FROM fr WHERE reason IS NULL)) WHERE rank <= 500")
def stratified_bottom_k(spark: SparkSession, sf: str) -> DataFrame:
    return baselines.bottom_k(_frame(spark, sf).where("reason is null"), "stratum", "key_image").select("key_image", "stratum", "candidates", "rank", "priority")


SCORED = WITH + ", sc AS MATERIALIZED (SELECT m.*, 1.0::DOUBLE / u.reuse AS score FROM m JOIN (SELECT amount, idx, count(*) AS reuse FROM m GROUP BY amount, idx) u USING (amount, idx))\n"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return predict.reuse_score(features.reuse(rings(spark, sf).members))


@query(SCORED + """SELECT key_image, amount, idx, round(score, 6) AS score, ties, size FROM (SELECT *, row_number() OVER (PARTITION BY key_image ORDER BY score DESC, idx, amount) AS place, count(*) OVER (PARTITION BY key_image, score) AS ties, count(*) OVER (PARTITION BY key_image) AS size FROM sc) WHERE place = 1""")
def scored_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return predict.argmax(_scored(spark, sf)).select("key_image", "amount", "idx", F.round("score", 6).alias("score"), "ties", "size")


@query(SCORED + "SELECT key_image, round(l[1], 6) AS top1, round(l[2], 6) AS top2, c AS candidates, round(l[1] - l[2], 6) AS margin FROM (SELECT key_image, list(score ORDER BY score DESC) AS l, count(*) AS c FROM sc GROUP BY key_image)")
def candidate_margin(spark: SparkSession, sf: str) -> DataFrame:
    return an.margin(_scored(spark, sf)).select("key_image", *(F.round(c, 6).alias(c) for c in ("top1", "top2", "margin")), "candidates")


PREDICTED = CASCADE + """, pk AS (SELECT * FROM (SELECT m.*, 1.0::DOUBLE / u.reuse AS score, count(*) OVER (PARTITION BY key_image) AS size, row_number() OVER (PARTITION BY key_image ORDER BY 1.0::DOUBLE / u.reuse DESC, idx, amount) AS place FROM m JOIN (SELECT amount, idx, count(*) AS reuse FROM m GROUP BY amount, idx) u USING (amount, idx)) WHERE place = 1 AND size > 1),
vf AS MATERIALIZED (SELECT pk.key_image, pk.score AS confidence, pk.size, pk.score >= 0.5 AS accepted, ctx.height AS scan_height, ctx.height - 1 + res.pass AS verified_height, CASE WHEN pk.score >= 0.5 AND res.key_image IS NOT NULL THEN res.amount = pk.amount AND res.idx = pk.idx END AS correct FROM pk JOIN ctx USING (key_image) LEFT JOIN res ON res.key_image = pk.key_image AND res.pass >= 0)
"""


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    r, c = _cascade(spark, sf)
    picks = predict.argmax(predict.reuse_score(features.reuse(r.members))).where("size > 1")
    records = cut(predict.save(picks, "run", "2024-01-01T00:00:00Z", 0.5).join(picks.select("key_image", "size"), "key_image").join(r.context.select("key_image", F.col("height").alias("scan_height")), "key_image"), "records")
    found = predict.verify(records, records.where("false"), c.resolved).select("key_image", "correct", "resolved_at_pass")
    return records.join(found, "key_image", "left").withColumn("verified", F.col("correct").isNotNull()).withColumn("verified_height", F.col("scan_height") - 1 + F.col("resolved_at_pass"))


@query(PREDICTED + "SELECT accepted, CASE WHEN correct THEN 'correct' WHEN NOT correct THEN 'wrong' ELSE 'pending' END AS outcome, count(*) AS predictions FROM vf GROUP BY 1, 2")
def verification_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("correct") == F.lit(True), "correct").when(F.col("correct") == F.lit(False), "wrong").otherwise("pending")
    return _verified(spark, sf).groupBy("accepted", outcome.alias("outcome")).agg(F.count("*").alias("predictions"))


@query(PREDICTED + "SELECT CASE WHEN correct IS NULL THEN 'unknown' WHEN verified_height > scan_height THEN 'later_scan' ELSE 'same_or_earlier_scan' END AS timing, count(*) AS predictions FROM vf GROUP BY 1")
def verification_timing(spark: SparkSession, sf: str) -> DataFrame:
    rows = _verified(spark, sf).withColumn("verified_height", F.when(F.col("verified"), F.col("verified_height")))
    return rows.groupBy(predict.timing("scan_height", "verified_height").alias("timing")).agg(F.count("*").alias("predictions"))


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return cas.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value")), ["user_id"], "event_id")


WILSON = "(h / n + {z2} / (2 * n) {s} {z} * sqrt(h / n * (1 - h / n) / n + {z2} / (4 * n * n))) / (1 + {z2} / n)"


@query(PREDICTED + "SELECT size, n AS verified, h AS correct, round(" + WILSON.format(z=an.Z, z2=an.Z**2, s="-") + ", 6) AS low, round(" + WILSON.format(z=an.Z, z2=an.Z**2, s="+") + ", 6) AS high FROM (SELECT size, count(*) FILTER (correct IS NOT NULL) AS n, count(*) FILTER (correct) AS h FROM vf GROUP BY size) WHERE n > 0")
def wilson_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    per = _verified(spark, sf).groupBy("size").agg(F.count_if("verified").alias("verified"), F.count_if(F.col("correct") == F.lit(True)).alias("correct")).where("verified > 0")
    low, high = an.wilson(F.col("correct"), F.col("verified"))
    return per.select("size", "verified", "correct", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(PREDICTED + "SELECT b AS bin, count(v.confidence) AS rows, round(avg(v.confidence), 6) AS mean FROM (SELECT CAST(range AS INTEGER) AS b FROM range(10)) x LEFT JOIN (SELECT *, CAST(least(9, floor(confidence * 10)) AS INTEGER) AS b FROM vf) v USING (b) GROUP BY b")
def score_bins(spark: SparkSession, sf: str) -> DataFrame:
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    per = _verified(spark, sf).groupBy(an.score_bin(F.col("confidence")).alias("bin")).agg(F.count("*").alias("rows"), F.round(F.avg("confidence"), 6).alias("mean"))
    return bins.join(per, "bin", "left").select("bin", F.coalesce("rows", F.lit(0)).alias("rows"), "mean")


@query(PREDICTED + """SELECT count(*) AS total, count(*) FILTER (confidence >= 0.5) AS retained, count(*) FILTER (confidence < 0.5) AS below, count(*) FILTER (confidence IS NULL) AS unknown_score, count(*) FILTER (confidence >= 0.5 AND correct) AS correct, count(*) FILTER (confidence >= 0.5 AND NOT correct) AS wrong,
count(*) FILTER (confidence >= 0.5 AND correct IS NULL) AS pending, CAST(0 AS BIGINT) AS unknown FROM vf""")
def threshold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return an.summary(_verified(spark, sf), 0.5)


@query("SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")
def timeline_deltas(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("day")))  # a row a day


@query("SELECT event_type, before, count(*) AS changes FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> event_type GROUP BY ALL")
def state_transitions(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_type", before.alias("before")).where("before <> event_type").groupBy("event_type", "before").agg(F.count("*").alias("changes"))


POOL = """WITH st AS MATERIALIZED (SELECT user_id, min(epoch_us(ts)) AS first_seen, max(epoch_us(ts)) AS last_seen, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) AS confirmed, count(*) AS sightings FROM events GROUP BY user_id),
states AS MATERIALIZED (SELECT *, CASE WHEN confirmed IS NOT NULL THEN 'confirmed' WHEN last_seen < (SELECT max(epoch_us(ts)) FROM events) - 86400000000 THEN 'disappeared' ELSE 'pending' END AS state, (confirmed - first_seen) / 1000000.0 AS delay FROM st)
"""


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    events = table(spark, sf, "events").select("user_id", "event_type", at.alias("us"))
    per = events.groupBy("user_id").agg(F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), F.min(F.when(F.col("event_type") == "purchase", F.col("us"))).alias("confirmed"), F.count("*").alias("sightings"))
    top = events.agg(F.max("us").alias("top"))
    state = F.when(F.col("confirmed").isNotNull(), "confirmed").when(F.col("last_seen") < F.col("top") - 86_400_000_000, "disappeared").otherwise("pending")
    return per.join(F.broadcast(top)).withColumn("state", state).withColumn("delay", (F.col("confirmed") - F.col("first_seen")) / 1e6)


@query(POOL + "SELECT state, count(*) AS transactions, CAST(sum(sightings) AS BIGINT) AS sightings FROM states GROUP BY state")
def pool_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).groupBy("state").agg(F.count("*").alias("transactions"), F.sum("sightings").alias("sightings"))


@query(POOL + "SELECT count(delay) AS eligible, round(quantile_cont(CAST(delay AS DOUBLE), 0.5), 3) AS median, round(quantile_cont(CAST(delay AS DOUBLE), 0.9), 3) AS p90 FROM states")
def delay_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = ranges.quantiles(_pool(spark, sf), "delay", {"median": 0.5, "p90": 0.9})
    return found.select(F.col("n").alias("eligible"), F.round("median", 3).alias("median"), F.round("p90", 3).alias("p90"))


@query(POOL + "SELECT b AS bin, count(delay) AS rows FROM (SELECT CAST(range AS INTEGER) AS b FROM range(5)) x LEFT JOIN (SELECT delay, CAST((delay >= 60)::INT + (delay >= 300)::INT + (delay >= 900)::INT + (delay >= 3600)::INT AS INTEGER) AS b FROM states WHERE delay IS NOT NULL) USING (b) GROUP BY b")
def delay_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return an.histogram(_pool(spark, sf).where("delay is not null"), an.fixed_bin(F.col("delay")), 5)


@query("SELECT user_id, epoch_us(before) AS from_us, epoch_us(ts) AS to_us FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE epoch_us(ts) - epoch_us(before) > 43200000000")
def observation_gaps(spark: SparkSession, sf: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = table(spark, sf, "events").select("user_id", F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("from_us"), us.alias("to_us"))
    return rows.where(F.col("to_us") - F.col("from_us") > 43_200_000_000)


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 100")
def retention_newest_n(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))
    return table(spark, sf, "events").withColumn("r", rank).where("r <= 100").select("event_type", "event_id")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM (SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(y.day, CAST(x.day + INTERVAL 1 DAY AS DATE)) AS day, x.n AS before, y.n AS after, CASE WHEN x.n IS NULL THEN 'added' WHEN y.n IS NULL THEN 'removed' WHEN x.n <> y.n THEN 'updated' ELSE 'same' END AS change FROM d x FULL JOIN d y ON x.user_id = y.user_id AND y.day = CAST(x.day + INTERVAL 1 DAY AS DATE))
WHERE day > (SELECT min(day) FROM d) AND day <= (SELECT max(day) FROM d)""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Every day's users against those of the day before."""
    days = cut(table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "days")
    both = days.select("user_id", F.date_add("day", 1).alias("day"), F.col("n").alias("before")).join(days.withColumnRenamed("n", "after"), ["user_id", "day"], "full_outer")
    span = F.broadcast(days.agg(F.min("day").alias("first"), F.max("day").alias("last")))
    b, a = F.col("before"), F.col("after")
    change = F.when(b.isNull(), "added").when(a.isNull(), "removed").when(b != a, "updated").otherwise("same")
    return both.join(span).where("day > first and day <= last").select("user_id", "day", "before", "after", change.alias("change"))


@query("SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY event_type")
def json_props_agg(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


@query("""SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return table(spark, sf, "pages").select("page_id", F.posexplode(links).alias("pos", "link"))


@query(POOL + "SELECT state, count(*) AS transactions, CAST(sum(sightings) AS BIGINT) AS sightings FROM states GROUP BY state")
def stream_state_machine(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark, 'events')}.parquet"
    table(spark, sf, "events").repartition(9).write.parquet(path)  # several batches, whose states are merged
    per = replay(spark, path)
    top = per.agg(F.max("last_seen").alias("top"))
    state = F.when(F.col("confirmed").isNotNull(), "confirmed").when(F.col("last_seen") < F.col("top") - 86_400_000_000, "disappeared").otherwise("pending")
    return per.join(F.broadcast(top)).groupBy(state.alias("state")).agg(F.count("*").alias("transactions"), F.sum("sightings").alias("sightings"))


@query()
def rf_holdout(spark: SparkSession, sf: str) -> DataFrame:
    r, c = _cascade(spark, sf)
    rows = cut(predict.known(r.members, r.context, c), "labelled")
    score = predict.forest(rows.where(predict.hash_split("key_image")))
    picks = predict.argmax(score(rows.where(~predict.hash_split("key_image"))))
    return picks.agg(F.count("*").alias("rings"), F.avg("label").alias("top1"))
