"""Questions about the graph of rings and outputs: related rings, explanations, lineage, groups, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.cascade import OUTPUT
from evidara.operators.components import components
from evidara.plans.lineage import cut, settings


def recall(members: DataFrame, context: DataFrame, resolved: DataFrame, key) -> DataFrame:
    """One ring's snapshot: its candidates in order, its context and its claim; filters reach the scans."""
    own = members.where(F.col("key_image") == key).groupBy("key_image").agg(F.sort_array(F.collect_set(F.struct(*OUTPUT))).alias("candidates"))
    return own.join(context.where(F.col("key_image") == key), "key_image", "left").join(resolved.where(F.col("key_image") == key).select("key_image", F.struct(*OUTPUT).alias("claim"), "pass"), "key_image", "left")


#: Rings of one output that meet in one place; an output of more is cut into parts that meet two by two.
PART = 512


def related(members: DataFrame, limit: int = 20, keys: DataFrame | None = None) -> DataFrame:
    """key_image, related, shared: for each ring (or those of keys) the rings that share the most outputs, ties by key.

    Outputs of one ring alone are dropped before the self-join. An output of many rings is dealt out by pairs of parts, so
    that no task has more than two parts' pairs; each pair of rings meets once for each shared output.
    """
    sizes = members.groupBy(*OUTPUT).agg(F.count("*").alias("m")).where("m > 1")
    shared = members.join(sizes, OUTPUT).withColumn("parts", F.ceil(F.col("m") / PART)).withColumn("part", F.pmod(F.xxhash64("key_image"), F.col("parts")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = shared.join(keys, "key_image", "left_semi") if keys is not None else shared
    left = left.select(*OUTPUT, "key_image", F.col("part").alias("x"), each.alias("y"))
    right = shared.select(*OUTPUT, F.col("key_image").alias("related"), each.alias("x"), F.col("part").alias("y"))
    pairs = left.join(right, [*OUTPUT, "x", "y"]).where("key_image <> related").groupBy("key_image", "related").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("key_image").orderBy(F.desc("shared"), "related"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit)


#: Claimants that are listed for an output (the count is always exact).
LISTED = 20


def related_of(members: DataFrame, key, limit: int = 20) -> DataFrame:
    """related, shared of one ring: filters reach the scan, and only its outputs are joined."""
    own = members.where(F.col("key_image") == key).select(*OUTPUT)
    shared = members.where(F.col("key_image") != key).join(F.broadcast(own), OUTPUT).groupBy(F.col("key_image").alias("related")).agg(F.count("*").alias("shared"))
    return shared.orderBy(F.desc("shared"), "related").limit(limit)


def explain(members: DataFrame, claims: DataFrame, keys: DataFrame | None = None, listed: int = LISTED) -> DataFrame:
    """Each candidate of the rings (or those of keys) with the rings whose deterministic claim speaks against it.

    claims: (key_image, amount, idx, pass, confidence). eliminated_by holds the first of them by key, eliminators counts
    all; a claim counts if its own ring holds the output. state: eliminated, remaining, or excluded (another candidate is
    the ring's own deterministic claim).
    """
    sure = (F.col("confidence") == 1.0) & F.coalesce(F.col("pass") >= 0, F.lit(False))
    valid = claims.where(sure).join(members, ["key_image", *OUTPUT], "left_semi").select(F.col("key_image").alias("source"), *OUTPUT)
    # One more than listed is kept of each output, so that a ring's own claim may fall out; a limit per group, before the shuffle.
    first = valid.withColumn("place", F.row_number().over(Window.partitionBy(*OUTPUT).orderBy("source"))).where(F.col("place") <= listed + 1)
    named = valid.groupBy(*OUTPUT).agg(F.count("*").alias("claims")).join(first.groupBy(*OUTPUT).agg(F.sort_array(F.collect_list("source")).alias("sources")), OUTPUT)
    own = claims.where(sure).select("key_image", F.struct(*OUTPUT).alias("claim"))
    inside = claims.where(sure).join(members, ["key_image", *OUTPUT], "left_semi").select("key_image", *OUTPUT, F.lit(1).alias("mine"))
    asked = members.join(keys, "key_image", "left_semi") if keys is not None else members
    rows = asked.join(named, OUTPUT, "left").join(inside, ["key_image", *OUTPUT], "left").join(own, "key_image", "left").withColumn("held", F.max("mine").over(Window.partitionBy("key_image")).isNotNull())
    others = (F.coalesce("claims", F.lit(0)) - F.coalesce("mine", F.lit(0))).cast("long")
    by = F.slice(F.filter(F.coalesce("sources", F.array().cast(first.select(F.array("source").alias("a")).schema["a"].dataType)), lambda x: x != F.col("key_image")), 1, listed)
    state = F.when(others > 0, "eliminated").when(F.col("held") & F.col("mine").isNull(), "excluded").otherwise("remaining")
    return rows.select("key_image", *OUTPUT, by.alias("eliminated_by"), others.alias("eliminators"), F.col("mine").isNotNull().alias("is_claim"), state.alias("state"))


def conflicts(explained: DataFrame, members: DataFrame, claims: DataFrame, predictions: DataFrame) -> DataFrame:
    """key_image, candidates, remaining, conflicts: what speaks against each ring's stored claim or prediction, in a fixed order."""
    sure = (F.col("confidence") == 1.0) & F.coalesce(F.col("pass") >= 0, F.lit(False))
    outside = lambda rows, name: rows.join(members, ["key_image", *OUTPUT], "left_anti").select("key_image", F.lit(True).alias(name)).distinct()
    rows = explained.groupBy("key_image").agg(F.count("*").alias("candidates"), F.count_if(F.col("state") == "remaining").alias("remaining"), F.bool_or(F.col("is_claim") & (F.col("eliminators") > 0)).alias("shared"))
    rows = rows.join(outside(claims, "claim_out"), "key_image", "left").join(outside(predictions, "told_out"), "key_image", "left")
    found = (("claim_out", "resolution_outside_ring"), ("shared", "claimed_by_another_ring"), ("told_out", "prediction_outside_ring"))
    listed = F.array(*(F.when(F.coalesce(F.col(c), F.lit(False)), name) for c, name in found), F.when(F.col("remaining") == 0, "no_candidate_remains"))
    return rows.select("key_image", "candidates", "remaining", F.filter(listed, lambda x: x.isNotNull()).alias("conflicts"))


def trace_of(events: DataFrame, dependencies: DataFrame, claims: DataFrame, key, most: int = 100) -> dict:
    """The lineage of one ring's current claim: root, events in breadth-first order, missing ids, complete, truncated.

    events: (id, key_image, real_amount, real_output_index, resolved_at_pass, confidence, method); dependencies: (event_id,
    eliminated_amount, eliminated_output_index, source_event_id). Each level is one filtered read of at most `most` ids. It
    is complete if all events are there, of known origin, and rest only on earlier ones.
    """
    if type(most) is not int or most < 0:
        raise ValueError("most must be a non-negative integer")
    fields = ("real_amount", "real_output_index", "resolved_at_pass", "confidence")
    none = {"root": None, "events": [], "missing": [], "complete": False, "truncated": False}
    claim, root = claims.where(F.col("key_image") == key).select(*fields).first(), events.where(F.col("key_image") == key).orderBy(F.desc("id")).select("id", *fields).first()
    if claim is None or root is None or tuple(claim) != tuple(root[1:]):
        return none
    pending, seen, out, missing, complete = [root["id"]], {root["id"]}, [], [], True
    while pending and len(out) + len(missing) < most:
        level, pending = pending[: most - len(out) - len(missing)], pending[most - len(out) - len(missing) :]
        found = {r["id"]: r for r in events.where(F.col("id").isin(level)).collect()}
        links: dict = {}
        for r in dependencies.where(F.col("event_id").isin(level)).orderBy("event_id", "eliminated_amount", "eliminated_output_index").collect():
            links.setdefault(r["event_id"], []).append((r["eliminated_amount"], r["eliminated_output_index"], r["source_event_id"]))
        for id_ in level:
            if id_ not in found:
                missing.append(id_)
                complete = False
                continue
            own = links.get(id_, [])
            out.append(found[id_].asDict() | {"dependencies": own})
            complete &= found[id_]["method"] != "legacy" and all(source < id_ for *_, source in own)
            for *_, source in own:
                if source not in seen:
                    seen.add(source)
                    pending.append(source)
    return {"root": root["id"], "events": out, "missing": missing, "complete": complete and not pending, "truncated": bool(pending)}


def trace(dependencies: DataFrame, most: int = 100, keys: DataFrame | None = None) -> DataFrame:
    """(key_image, ancestor, depth): all that a resolution rests on, at its least depth, up to depth most, as one recursive query.
    Pairs of one depth are put together at each level, so that paths don't multiply."""
    spark = dependencies.sparkSession
    edges = cut(dependencies.select("key_image", F.col("source").alias("ancestor")).distinct(), "edges")
    start = edges.join(keys, "key_image", "left_semi") if keys is not None else edges
    with settings(spark, {"spark.sql.cteRecursionLevelLimit": str(most + 2), "spark.sql.cteRecursionRowLimit": "-1"}):
        return cut(spark.sql(
            """WITH RECURSIVE walk(key_image, ancestor, depth) AS (
                SELECT key_image, ancestor, 1 FROM {start}
                UNION ALL
                SELECT DISTINCT w.key_image, e.ancestor, w.depth + 1 FROM walk w JOIN {edges} e ON e.key_image = w.ancestor WHERE w.depth < {most}
            ) SELECT key_image, ancestor, min(depth) AS depth FROM walk GROUP BY key_image, ancestor""",
            start=start, edges=edges, most=most,
        ), "trace")


def traces(dependencies: DataFrame, known: DataFrame, most: int = 100, depth: int = 100) -> DataFrame:
    """Of every ring with dependencies: key_image, events (ancestors that are listed), deepest, missing, truncated, complete.

    The first most ancestors by depth, then id, are listed; missing are those of them that known (key_image) doesn't hold;
    truncated is whether there are more.
    """
    here = known.select(F.col("key_image").alias("ancestor"), F.lit(True).alias("here")).distinct()
    place = F.row_number().over(Window.partitionBy("key_image").orderBy("depth", "ancestor"))
    rows = trace(dependencies, depth).withColumn("place", place).join(here, "ancestor", "left")
    listed = F.col("place") <= most
    out = rows.groupBy("key_image").agg(F.count_if(listed).alias("events"), F.max(F.when(listed, F.col("depth"))).alias("deepest"), F.count_if(listed & F.col("here").isNull()).alias("missing"), (F.max("place") > most).alias("truncated"))
    return out.withColumn("complete", (F.col("missing") == 0) & ~F.col("truncated"))


def local_graph(explained: DataFrame, picks: DataFrame, limit: int = 24, sources: int = 3) -> tuple[DataFrame, DataFrame]:
    """nodes (key_image, id, kind, place) and edges (key_image, source, target, kind) to draw each ring: its own node, its first
    candidates (the picked one first, then those that remain, then by eliminators), and the first rings that eliminate each.
    The limits are the feature; explained is as from explain, picks (key_image, amount, idx)."""
    name = F.concat_ws(":", F.lit("output"), F.col("amount").cast("string"), F.col("idx").cast("string"))
    rows = explained.join(picks.select("key_image", *OUTPUT, F.lit(1).alias("picked")), ["key_image", *OUTPUT], "left")
    order = (F.coalesce("picked", F.lit(0)).desc(), F.col("is_claim").desc(), (F.col("state") == "remaining").desc(), F.desc("eliminators"), "amount", "idx")
    place = F.row_number().over(Window.partitionBy("key_image").orderBy(*order))
    shown = rows.withColumn("place", place).where(F.col("place") <= limit).withColumn("id", name)
    by = shown.select("key_image", "id", F.explode(F.slice("eliminated_by", 1, sources)).alias("by")).withColumn("ring", F.concat(F.lit("ring:"), F.col("by").cast("string")))
    own = F.concat(F.lit("ring:"), F.col("key_image").cast("string"))
    nodes = shown.select("key_image", own.alias("id"), F.lit("ring").alias("kind"), F.lit(0).alias("place")).distinct().union(shown.select("key_image", "id", F.lit("candidate"), "place")).union(by.select("key_image", F.col("ring"), F.lit("eliminator"), F.lit(None).cast("int")).distinct())
    edges = shown.select("key_image", own.alias("source"), F.col("id").alias("target"), F.lit("candidate").alias("kind")).union(by.select("key_image", "ring", "id", F.lit("eliminates")))
    return nodes, edges


def groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Direct groups of more than one ring, never joined transitively."""
    return rows.groupBy(*by).agg(F.count_distinct("key_image").alias("rings"), F.min("key_image").alias("first"), F.max("key_image").alias("last")).where("rings > 1")


def pairs(rows: DataFrame, by: list[str], chunk: int = 256) -> DataFrame:
    """left, right, shared: pairs of rings that share a group, each once, with how many they share. For reports over few or
    chosen groups, as pairs grow with the square of a group; groups are cut into chunks that meet two by two, so that no
    task has more than two chunks' pairs."""
    own = rows.select(*by, "key_image").distinct()
    sizes = own.groupBy(*by).agg(F.count("*").alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / chunk)
    dealt = own.join(sizes, by).withColumn("part", F.pmod(F.xxhash64("key_image"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    met = dealt.select(*by, "key_image", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")).distinct()
    left, right = met.withColumnRenamed("key_image", "left").withColumnRenamed("part", "p"), met.withColumnRenamed("key_image", "right").withColumnRenamed("part", "q")
    # Two members of one part meet in every pair of chunks with it; only their own chunk counts them.
    once = F.when(F.col("p") == F.col("q"), (F.col("x") == F.col("p")) & (F.col("y") == F.col("p"))).otherwise(True)
    return left.join(right, [*by, "x", "y"]).where((F.col("left") < F.col("right")) & once).groupBy("left", "right").agg(F.count("*").alias("shared"))


def past_components(members: DataFrame, context: DataFrame, cutoff: int) -> DataFrame:
    """Components, blind to labels, of rings below a height that share an output or a transaction: key_image, root.

    Rings of one output, or of one transaction, are joined to the first of them, so edges are as many as memberships.
    """
    past = context.where(F.col("height") < cutoff)
    own = members.join(past.select("key_image"), "key_image", "left_semi")
    leads = own.join(own.groupBy(*OUTPUT).agg(F.min("key_image").alias("a")), OUTPUT).select("a", F.col("key_image").alias("b"))
    by_tx = past.join(past.groupBy("tx_hash").agg(F.min("key_image").alias("a")), "tx_hash").select("a", F.col("key_image").alias("b"))
    return components(leads.union(by_tx)).select(F.col("v").alias("key_image"), "root")
