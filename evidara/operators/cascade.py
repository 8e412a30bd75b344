"""The elimination cascade: a bulk-synchronous fixpoint over rings and outputs, with provenance and taint.

Each pass touches only rings that the newest resolutions hit. The membership table is scanned per pass, pruned and
without a shuffle as long as the frontier is small enough to broadcast; sizes are counted once; what is removed is
counted, and its exclusive or kept, for touched rings only. Amounts and indexes are whole numbers. State is written to the shared folder, so that plans stay short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.plans.lineage import cut

#: Memberships up to which one task runs all passes in numpy (some 100 bytes each); more go pass by pass over the cluster.
ONE_TASK = 2_000_000
#: Resolved outputs of one pass that may be broadcast.
FRONTIER = 1_000_000
OUTPUT = ["amount", "idx"]
_STATE = ["n", "all_amounts", "all_idx", "removed", "lost_amounts", "lost_idx"]


@dataclass(frozen=True)
class Cascade:
    """resolved: key_image, amount, idx, pass, method, soft. eliminated: key_image, amount, idx, pass, source.
    sizes: key_image, n. passes: as reported, with one that only empties rings counted too."""

    resolved: DataFrame
    eliminated: DataFrame
    sizes: DataFrame
    passes: int

    def live(self) -> DataFrame:
        """Unresolved rings with their original size and the candidates left: key_image, n, left."""
        removed = self.eliminated.groupBy("key_image").agg(F.count("*").alias("removed"))
        open_ = self.sizes.join(self.resolved.select("key_image"), "key_image", "left_anti")
        return open_.join(removed, "key_image", "left").select("key_image", "n", (F.col("n") - F.coalesce("removed", F.lit(0))).alias("left"))


def deterministic() -> F.Column:
    """A stored claim that is no hypothesis; confidence alone doesn't tell."""
    return (F.col("confidence") == 1.0) & F.coalesce(F.col("resolved_at_pass") >= 0, F.lit(False))


def cascade(members: DataFrame, stored: DataFrame | None = None, max_passes: int = 100, one_task: int | None = None) -> Cascade:
    """members: (key_image, amount, idx) without repeats. stored: earlier claims, as resolved_spends has them; claims of rings
    that the first phase resolves are ignored, the others eliminate too, and hypotheses taint what follows from them.

    Ties between eliminators of one output in one pass go to the smallest key image. one_task: memberships up to which one
    task runs all passes; both ways give the same rows.
    """
    members = cut(members.select("key_image", *OUTPUT), "members")
    if stored is None and members.count() <= (ONE_TASK if one_task is None else one_task):
        return _one_task(members, max_passes)
    sizes = cut(members.groupBy("key_image").agg(F.count("*").alias("n"), F.bit_xor("amount").alias("all_amounts"), F.bit_xor("idx").alias("all_idx")), "sizes")
    single = sizes.where("n = 1").select("key_image")
    first = members.join(single, "key_image").select("key_image", *OUTPUT, F.lit(0).alias("pass"), F.lit("ring_size_one").alias("method"), F.lit(False).alias("soft"))
    if stored is not None:
        claims = stored.select("key_image", F.col("real_amount").alias("amount"), F.col("real_output_index").alias("idx"), F.coalesce("resolved_at_pass", F.lit(-1)).cast("int").alias("pass"), F.lit("stored").alias("method"), (~deterministic()).alias("soft"))
        first = first.unionByName(claims.join(single, "key_image", "left_anti"))
    frontier = cut(first, "frontier")
    resolved: list[DataFrame] = [frontier]
    eliminated: list[DataFrame] = []
    # Of each touched ring: how many members it has lost, and the exclusive or of their amounts and indexes, which with that
    # of all members names the last one that is left. So no pass reads earlier eliminations, and writes two tables.
    state = frontier.select("key_image").distinct().select("key_image", *(F.lit(None).cast("long").alias(c) for c in _STATE), F.lit(False).alias("soft"), F.lit(True).alias("closed"))
    passes, size = 0, frontier.count()
    for number in range(1, max_passes + 1):
        if not size:
            break
        sources = frontier.groupBy(*OUTPUT).agg(F.min(F.struct("key_image", "soft")).alias("s")).select(*OUTPUT, F.col("s.key_image").alias("source"), F.col("s.soft").alias("soft"))
        hits = members.join(F.broadcast(sources) if size <= FRONTIER else sources, OUTPUT).join(state.where("closed").select("key_image"), "key_image", "left_anti")
        eliminated.append(cut(hits.select("key_image", *OUTPUT, F.lit(number - 1).alias("pass"), "source", "soft"), "hits"))
        delta = eliminated[-1].groupBy("key_image").agg(F.count("*").alias("removed"), F.bit_xor("amount").alias("lost_amounts"), F.bit_xor("idx").alias("lost_idx"), F.bool_or("soft").alias("soft"))
        delta = (F.broadcast(delta) if eliminated[-1].count() <= FRONTIER else delta).join(sizes, "key_image")  # so that the sizes of all rings aren't shuffled each pass
        both = state.select("key_image", *_STATE, "soft", "closed", F.lit(False).alias("touched")).unionByName(delta.withColumns({"closed": F.lit(False), "touched": F.lit(True)}))
        both = both.groupBy("key_image").agg(
            F.sum("removed").alias("removed"), F.bit_xor("lost_amounts").alias("lost_amounts"), F.bit_xor("lost_idx").alias("lost_idx"), *(F.max(c).alias(c) for c in ("n", "all_amounts", "all_idx")),
            *(F.bool_or(c).alias(c) for c in ("soft", "closed", "touched")),
        )
        left = F.col("n") - F.col("removed")
        ends = F.col("touched") & ~F.col("closed") & (left <= 1)
        last = lambda every, lost: F.when(ends & (left == 1), F.col(every).bitwiseXOR(F.col(lost)))
        state = cut(both.select("key_image", *_STATE, "soft", (F.col("closed") | ends).alias("closed"), ends.alias("ends"), last("all_amounts", "lost_amounts").alias("amount"), last("all_idx", "lost_idx").alias("idx")), "state")
        # A ring that lost all ends without a last member; it makes a pass.
        queued, size = state.where("ends").agg(F.count("*"), F.count("idx")).first()
        if not queued:
            break
        passes = number
        soft = F.col("soft")
        frontier = state.where("ends AND idx IS NOT NULL").select("key_image", *OUTPUT, F.when(soft, -2).otherwise(number).alias("pass"), F.when(soft, "soft_cascade").otherwise("cascade").alias("method"), "soft")
        resolved.append(frontier)
    empty = hits_schema(members)
    return Cascade(reduce(DataFrame.unionByName, resolved), reduce(DataFrame.unionByName, eliminated) if eliminated else empty, sizes.select("key_image", "n"), passes)


def passes_of(keys: np.ndarray, outputs: np.ndarray, n_keys: int, n_outputs: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The cascade over coded memberships: for each membership the pass that resolved its ring with it (-1: none), the pass
    that eliminated it (-1: none) and by which ring; the rings' sizes; the number of passes."""
    sizes = np.bincount(keys, minlength=n_keys)
    left, done, alive = sizes.copy(), np.zeros(n_keys, bool), np.ones(len(keys), bool)
    resolved, eliminated, source = np.full(len(keys), -1, np.int32), np.full(len(keys), -1, np.int32), np.zeros(len(keys), np.int64)
    new, passes = np.flatnonzero(sizes[keys] == 1), 0
    resolved[new] = 0
    for number in range(1, most + 1):
        if not len(new):
            break
        done[keys[new]] = True
        by = np.full(n_outputs, n_keys, np.int64)
        np.minimum.at(by, outputs[new], keys[new])
        hits = np.flatnonzero(alive & ~done[keys] & (by[outputs] < n_keys))
        eliminated[hits], source[hits], alive[hits] = number - 1, by[outputs[hits]], False
        left -= np.bincount(keys[hits], minlength=n_keys)
        touched = np.zeros(n_keys, bool)
        touched[keys[hits]] = True
        if not (touched & (left <= 1)).any():
            break
        passes = number
        new = np.flatnonzero(alive & (touched & (left == 1))[keys])
        resolved[new] = number
    return resolved, eliminated, source, sizes, passes


def _one_task(members: DataFrame, most: int) -> Cascade:
    kind = members.schema["key_image"].dataType.simpleString()
    names = ["what", "key_image", "amount", "idx", "pass", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches]
        if not parts:
            return
        key, amount, idx = (np.concatenate(x) for x in zip(*parts, strict=True))
        names_, keys = np.unique(key, return_inverse=True)
        order = np.lexsort((idx, amount))
        outputs = np.empty(len(key), np.int64)
        outputs[order] = np.cumsum(np.r_[False, (amount[order][1:] != amount[order][:-1]) | (idx[order][1:] != idx[order][:-1])])
        resolved, eliminated, source, sizes, passes = passes_of(keys, outputs, len(names_), len(key), most)
        a, b = np.flatnonzero(resolved >= 0), np.flatnonzero(eliminated >= 0)
        key_type = batches[0].schema.field(0).type
        kinds = [key_type, pa.int64(), pa.int64(), pa.int32(), key_type]
        zero = lambda n: np.zeros(n, np.int64)
        rows = [
            (0, key[a], amount[a], idx[a], resolved[a], key[a]), (1, key[b], amount[b], idx[b], eliminated[b], names_[source[b]]), (2, names_, zero(len(names_)), sizes, zero(len(names_)), names_), (3, names_[:1], zero(1), zero(1), np.array([passes]), names_[:1]),
        ]
        for what, *columns in rows:
            arrays = [pa.array(np.full(len(columns[0]), what), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = cut(members.coalesce(1).mapInArrow(run, f"what int, key_image {kind}, amount long, idx long, pass int, source {kind}"), "cascade")
    method = F.when(F.col("pass") == 0, "ring_size_one").otherwise("cascade")
    resolved = rows.where("what = 0").select("key_image", *OUTPUT, "pass", method.alias("method"), F.lit(False).alias("soft"))
    eliminated = rows.where("what = 1").select("key_image", *OUTPUT, "pass", "source", F.lit(False).alias("soft"))
    passes = rows.where("what = 3").select("pass").first()
    return Cascade(resolved, eliminated, rows.where("what = 2").select("key_image", F.col("idx").alias("n")), passes["pass"] if passes else 0)


def hits_schema(members: DataFrame) -> DataFrame:
    return members.where("false").select("key_image", *OUTPUT, F.lit(0).alias("pass"), F.col("key_image").alias("source"), F.lit(False).alias("soft"))


def empty_rings(result: Cascade) -> DataFrame:
    """Rings that lost every candidate, with the first eliminator of each: key_image, amount, idx, pass, source."""
    none = result.live().where("left = 0").select("key_image")
    return result.eliminated.join(none, "key_image", "left_semi").select("key_image", *OUTPUT, "pass", "source")


def dependencies(result: Cascade) -> DataFrame:
    """The lineage of resolutions: key_image, source, and the eliminated output."""
    return result.eliminated.join(result.resolved.select("key_image"), "key_image", "left_semi").select("key_image", "source", *OUTPUT)


METHODS = ("ring_size_one", "cascade", "ml_prediction", "soft_cascade", "legacy")


def events(result: Cascade, scan_height: int | None = None, after: int = 0) -> tuple[DataFrame, DataFrame]:
    """The resolutions as immutable events (id, key_image, real_amount, real_output_index, resolved_at_pass, confidence,
    method, scan_height), and the events that each rests on (event_id, eliminated_amount, eliminated_output_index,
    source_event_id). Ids go on after `after` by pass and ring, so that a source is always earlier."""
    from evidara.operators.baselines import ranked

    rows = ranked(result.resolved.where("method <> 'stored'").withColumn("order", F.when(F.col("pass") < 0, 1 << 30).otherwise(F.col("pass"))), ["order", "key_image"])
    rows = cut(rows.select((F.col("rank0") + 1 + after).alias("id"), "key_image", F.col("amount").alias("real_amount"), F.col("idx").alias("real_output_index"), F.col("pass").alias("resolved_at_pass"), F.lit(1.0).alias("confidence"), "method", F.lit(scan_height).cast("long").alias("scan_height")), "events")
    ids = rows.select("key_image", "id")
    found = dependencies(result).join(ids.withColumnRenamed("id", "event_id"), "key_image").join(ids.select(F.col("key_image").alias("source"), F.col("id").alias("source_event_id")), "source")
    return rows, found.select("event_id", F.col("amount").alias("eliminated_amount"), F.col("idx").alias("eliminated_output_index"), "source_event_id")


def broken(events: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """Events that break a rule, with the first rule broken: (id, rule). links are the dependencies of events."""
    sure = (F.col("confidence") == 1.0) & F.coalesce(F.col("resolved_at_pass") >= 0, F.lit(False))
    inside = members.select("key_image", F.col("amount").alias("real_amount"), F.col("idx").alias("real_output_index"), F.lit(True).alias("inside"))
    sizes = members.groupBy("key_image").agg(F.count("*").alias("n"))
    source = events.select(F.col("id").alias("source_event_id"), F.col("key_image").alias("other"), F.col("real_amount").alias("eliminated_amount"), F.col("real_output_index").alias("eliminated_output_index"), sure.alias("sure"))
    known = links.join(source, ["source_event_id", "eliminated_amount", "eliminated_output_index"], "left").join(events.select(F.col("id").alias("event_id"), "key_image", "method"), "event_id")
    member = members.select("key_image", F.col("amount").alias("eliminated_amount"), F.col("idx").alias("eliminated_output_index"), F.lit(True).alias("member"))
    known = known.join(member, ["key_image", "eliminated_amount", "eliminated_output_index"], "left")
    wrong = F.col("other").isNull() | (F.col("other") == F.col("key_image"))
    per = known.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("links"), F.bool_or(wrong).alias("wrong"), F.bool_or((F.col("method") == "cascade") & ~F.col("sure")).alias("soft"), F.count("member").alias("inner"))
    own = links.select(F.col("event_id").alias("id"), F.col("eliminated_amount").alias("real_amount"), F.col("eliminated_output_index").alias("real_output_index"), F.lit(True).alias("itself"))
    rows = events.join(per, "id", "left").join(inside, ["key_image", "real_amount", "real_output_index"], "left").join(sizes, "key_image", "left").join(own, ["id", "real_amount", "real_output_index"], "left")
    count, flag = F.coalesce("links", F.lit(0)), lambda c: F.coalesce(F.col(c), F.lit(False))
    told = F.col("method") != "legacy"
    rule = (
        F.when(~F.col("method").isin(*METHODS), "unknown_method").when(told & ~flag("inside"), "output_outside_ring").when((F.col("method") == "ring_size_one") & ((F.col("n") != 1) | (count > 0)), "not_a_single_member")
        .when(F.col("method").isin("cascade", "soft_cascade") & ((count != F.col("n") - 1) | (F.col("inner") != count)), "members_not_accounted_for").when(told & (F.col("method").isin("ring_size_one", "cascade") != sure), "method_and_confidence_differ")
        .when(flag("wrong"), "no_such_source").when(flag("soft"), "rests_on_a_hypothesis").when(flag("itself"), "eliminates_itself")
    )
    return rows.select("id", rule.alias("rule")).where("rule is not null")


def _stated(events: DataFrame, links: DataFrame) -> DataFrame:
    """What each event says, with its dependencies as one sorted list of source rings and outputs."""
    names = events.select(F.col("id").alias("source_event_id"), F.col("key_image").alias("source"))
    listed = links.join(names, "source_event_id", "left").groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("eliminated_amount", "eliminated_output_index", "source"))).alias("rests_on"))
    return events.join(listed, "id", "left")


def append_events(events: DataFrame, links: DataFrame, found: DataFrame, found_links: DataFrame) -> DataFrame:
    """Those of found that the last event of their ring doesn't already state: claim, pass, confidence, method and what it
    rests on. A legacy event is stated by any event with its claim."""
    fields = ["real_amount", "real_output_index", "resolved_at_pass", "confidence"]
    last = latest(_stated(events, links), ["key_image"], "id").select("key_image", *(F.col(f).alias(f"old_{f}") for f in fields), F.col("method").alias("old_method"), F.col("rests_on").alias("old_rests_on"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"old_{f}"))
    rows = _stated(found, found_links).join(last, "key_image", "left")
    known = same & ((F.col("method") == "legacy") | ((F.col("method") == F.col("old_method")) & F.col("rests_on").eqNullSafe(F.col("old_rests_on"))))
    return rows.where(F.col("old_method").isNull() | ~known).select(*found.columns)


def legacy(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (key_image, real_amount, real_output_index, resolved_at_pass, confidence) of unknown origin: no event of their ring,
    or the last one says something else."""
    fields = ["real_amount", "real_output_index", "resolved_at_pass", "confidence"]
    last = latest(events.select("key_image", "id", *fields), ["key_image"], "id").select("key_image", "id", *(F.col(f).alias(f"old_{f}") for f in fields))
    same = F.col("id").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"old_{f}"))
    return claims.join(last, "key_image", "left").where(~same).select("key_image", *fields, F.lit("legacy").alias("method"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key: new ones replace old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, "_new").drop("_new")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; one aggregate, no window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))
