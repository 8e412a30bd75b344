"""N-gram Jaccard join by prefix trees, and the classes that its links make.

Texts become sets of 64-bit shingle hashes, in the global order of the hashes; equal sets are one class from the start. For
prefixes, shingles that a fixed-size count sketch finds common come last, the others by hash. Two sets can only be similar
if they share a shingle in their prefixes, so sets meet in buckets by prefix shingle; and if each shares about half
of a prefix of twice that length, which most sets do with no other and go no further. Each bucket's sets are stored
in a compressed trie, and every set walks it, sharing the overlap of a common path and leaving subtrees whose remaining
lengths can't reach the needed overlap, or that hold only sets of its own class.

Before whole sets go to the buckets, bitmaps go there that rule out most pairs for certain. Buckets are bounded: those of a common shingle are cut into chunks that share a leader. Only where chunks did not grow
together into one class are the pairs of chunks compared too, so that a large group of near copies costs linear work
and no link between classes is lost. Links inside a class are counted afterwards, over all pairs of its sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import CHUNK as CHUNK_BYTES
from evidara.llm.common import NOT_SPACE, apart, column, groups, in_arrow, integral, mixed, utf8, words, written
from evidara.operators.components import components

SKETCH_BITS = 22
SKETCH_PARTS = 64
#: Prefix shingles in one range of the grouping step.
RANGE = 800_000
#: Sets in one bucket, and in one chunk of a larger one.
BUCKET, CHUNK_SETS = 512, 400
#: Bytes of sets that one task of the trie join holds.
TASK_BYTES = 16 << 20
#: Sets, and their bytes, in one part of a class when its links are counted.
PART_SETS, PART_BYTES = 2000, 4 << 20
#: Ids that may be broadcast (with four times as many bucket numbers).
SMALL = 500_000
#: Set ids that a task remembers, to handle copies once.
SEEN = 100_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, and where each text's begin."""
    hashes, firsts = words(data, offsets, NOT_SPACE)
    counts = np.diff(firsts)
    with np.errstate(over="ignore"):
        factors = mixed(np.arange(1, size + 1, dtype=np.uint64))
        full = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for k in range(size):
            full += hashes[k : k + len(full)] * factors[k]
        full = mixed(full)
        out, bounds = [], np.zeros(len(counts) + 1, np.int64)
        for i, n in enumerate(counts.tolist()):
            a = firsts[i]
            if n >= size:
                own = np.sort(full[a : a + n - size + 1])
                own = own[np.r_[True, own[1:] != own[:-1]]]
            elif n:
                own = mixed((hashes[a : a + n] * factors[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                own = hashes[:0]
            out.append(own)
            bounds[i + 1] = bounds[i] + len(own)
    return (np.concatenate(out) if out else hashes[:0]), bounds


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for the empty set only."""
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
        sizes = np.diff(bounds).astype(np.uint64)
        ids = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sizes * np.uint64(0x9E3779B97F4A7C15))
    ids[sizes == 0] = 0
    return ids.view(np.int64)


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(batches: Iterator[pa.RecordBatch], size: int, seen: set[int] | None = None) -> Iterator[tuple]:
    """Keys, ids, values and bounds of a few MB of texts, and which sets the task meets for the first time."""
    for batch in batches:
        data, offsets = utf8(column(batch, "t"))
        keys = column(batch, "k")
        for i, j in groups(offsets):
            values, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            ids = set_ids(values, bounds)
            fresh = np.zeros(len(ids), bool)
            if seen is not None:
                if len(seen) > SEEN:
                    seen.clear()
                for n, x in enumerate(ids.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        fresh[n] = True
            yield keys.slice(i, j - i), ids, values, bounds, fresh


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: each row's key, set id and size; kind 1: parts of a task's sketch of shingle counts (n: the part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for keys, ids, values, bounds, fresh in _sets(batches, size, set()):
            new = values[np.repeat(fresh, np.diff(bounds))]
            np.add.at(sketch, (new & np.uint64(len(sketch) - 1)).astype(np.int64), 1)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), keys, pa.array(ids), pa.array(np.diff(bounds)), pa.nulls(n, pa.binary())], names)
        if sketch.any():
            parts = [zlib.compress(x.astype(np.uint64).tobytes(), 1) for x in sketch.reshape(SKETCH_PARTS, -1)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.arange(n)), pa.array(parts, pa.binary())], names)

    names = ["kind", "k", "sid", "n", "blob"]
    return in_arrow(docs, run, "kind int, k long, sid long, n long, blob binary")


def _levels(profile: DataFrame) -> np.ndarray:
    """For each cell of the sketch 0, or how far its count stands out. Of fixed size, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(column(batch, "n").to_pylist(), column(batch, "blob"), strict=True):
                counts = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint64)
                sums[part] = sums[part] + counts if part in sums else counts
        for part, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["n", "blob"])

    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint64)
    # Tasks' parts are added up in many places first, so that no task reads what all others wrote. The result is of fixed size.
    kind = "n long, blob binary"
    first = in_arrow(profile.where("kind = 1").select("n", "blob").repartition(SKETCH_PARTS, "n", F.pmod(F.xxhash64("blob"), F.lit(16))), add, kind)
    for part, blob in in_arrow(first.repartition(SKETCH_PARTS // 4, "n"), add, kind).collect():
        out[part] += np.frombuffer(zlib.decompress(blob), np.uint64)
    out = out.ravel()
    floor = 2 * out.mean() + 32
    return np.where(out > floor, 1 + np.log2(np.maximum(out, 1) / floor), 0).astype(np.uint8)


def _grouped(docs: DataFrame, levels, size: int, percent: int, ranges: int) -> DataFrame:
    """Where sets meet, as rows (kind, bucket, sid, n, c).

    kind 0: bounded buckets of prefix shingles; kind 1: buckets of common shingles, with any number of sets; kind 2: no
    bucket. c counts a set's shingles, within twice its prefix, that another set of fitting size has there too.
    """
    names = ["r", "kind", "tokens", "sids", "sizes", "base"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for _, ids, values, bounds, fresh in _sets(batches, size, set()):
            tokens, sids, sizes, hots, base = [], [], [], [], []
            for i in np.flatnonzero(fresh):
                own = values[bounds[i] : bounds[i + 1]]
                lv = level[(own & np.uint64(len(level) - 1)).astype(np.int64)]
                n = len(own)
                p = prefix(n, percent)
                q = p - 1 + max(1, p - 1)
                if lv.any():
                    order = np.argsort(lv, kind="stable")[:q]
                    own, lv = own[order], lv[order]
                tokens.append(own[:q])
                hots.append(lv[:q] > 0)
                sids.append(np.full(q, ids[i]))
                sizes.append(np.full(q, n, np.int32))
                base.append(np.arange(q) < p)
            if not tokens:
                continue
            token, hot, sid, n, first = (np.concatenate(x) for x in (tokens, hots, sids, sizes, base))
            r = ((token >> np.uint64(24)) % np.uint64(ranges)).astype(np.int64)
            r[hot] = sid[hot] % ranges
            key = r * 2 + hot
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            rows = [(int(key[order[a]]), order[a:b]) for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
            out: list[list] = [[], [], [], []]
            for _, at in rows:  # each set's shingles are a run
                run = np.flatnonzero(np.r_[True, sid[at][1:] != sid[at][:-1]])
                for column_, x in zip(out, (token[at], sid[at][run], np.stack((np.diff(np.r_[run, len(at)]), n[at][run]), 1).astype(np.int32), first[at]), strict=True):
                    column_.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([k // 2 for k, _ in rows], pa.int32()), pa.array([k % 2 for k, _ in rows], pa.int32()), *(pa.array(x, pa.binary()) for x in out)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for r, kind, t, s, m, f in zip(*(column(batch, x) for x in names), strict=True):
                runs = np.frombuffer(m.as_buffer(), np.int32).reshape(-1, 2)
                sids = np.frombuffer(s.as_buffer(), np.int64)
                part = (np.frombuffer(t.as_buffer(), np.uint64), np.repeat(sids, runs[:, 0]), np.repeat(runs[:, 1], runs[:, 0]), np.frombuffer(f.as_buffer(), bool))
                if kind.as_py():
                    yield _rows(2, np.zeros(len(sids), np.int64), sids, runs[:, 1], runs[:, 0])
                    token, sid, n, first = part
                    yield _rows(1, token[first].view(np.int64), sid[first], n[first], np.zeros(first.sum(), np.int64))
                else:
                    held.setdefault(r.as_py(), []).append(part)
        for parts in held.values():
            token, sid, n, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((sid, n, token))
            token, sid, n, first = token[order], sid[order], n[order].astype(np.int64), first[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])]
            token, sid, n, first, sizes = _shared(token[new], sid[new], n[new], first[new], percent)
            if not len(token):
                continue
            own, at, c = np.unique(sid, return_index=True, return_counts=True)
            yield _rows(2, np.zeros(len(own), np.int64), own, n[at], c)
            token, sid, n, first, sizes = _shared(token[first], sid[first], n[first], first[first], percent)
            if not len(token):
                continue
            starts = np.cumsum(sizes) - sizes
            with np.errstate(over="ignore"):  # equal lists of sets are one bucket
                bucket = mixed(np.add.reduceat(mixed(sid.view(np.uint64)), starts) + sizes.astype(np.uint64)).view(np.int64)
            _, once = np.unique(bucket, return_index=True)
            keep = np.zeros(len(sizes), bool)
            keep[once] = True
            keep = np.repeat(keep, sizes)
            yield _rows(np.repeat((sizes > BUCKET).astype(np.int32), sizes)[keep], np.repeat(bucket, sizes)[keep], sid[keep], n[keep], np.zeros(keep.sum(), np.int64))

    spread = in_arrow(docs, cut, "r int, kind int, tokens binary, sids binary, sizes binary, base binary").repartition(ranges, "r")
    rows = in_arrow(spread, meet, "kind int, bucket long, sid long, n long, c long")
    return rows.groupBy("kind", "bucket", "sid", "n").agg(F.sum("c").alias("c"))


def _shared(token: np.ndarray, sid: np.ndarray, n: np.ndarray, first: np.ndarray, percent: int) -> tuple:
    """Of entries in order of shingle and size, those that meet another set of fitting size; and the sizes of the meetings."""
    if not len(token):
        return token, sid, n, first, n
    starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])])
    sizes = np.diff(np.r_[starts, len(token)])
    keep = np.repeat(sizes > 1, sizes)
    return token[keep], sid[keep], n[keep], first[keep], sizes[sizes > 1]


def _rows(kind, bucket: np.ndarray, sid: np.ndarray, n: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    kind = np.full(len(sid), kind, np.int32) if np.isscalar(kind) else kind
    return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x.astype(np.int64)) for x in (bucket, sid, n, c))], ["kind", "bucket", "sid", "n", "c"])


class Trie:
    """A compressed trie of integer sequences in ascending order of some global order, as flat arrays.

    rows are sorted; node k covers rows lo..hi, and its edge holds depths top..bottom of its first row.
    """

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows
        self.lengths = np.array([len(r) for r in rows], np.int64)
        m = len(rows)
        shared = np.zeros(m + 1, np.int64)
        for i in range(1, m):
            a, b = rows[i - 1], rows[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            shared[i] = differ[0] if len(differ) else k
        self.nodes: list[tuple[int, int, int, int]] = []
        self.children: list[list[int]] = []
        self.root = self._build(0, m, 0, shared)

    def _build(self, lo: int, hi: int, top: int, shared: np.ndarray) -> int:
        """Built with a stack, as a trie can be as deep as its sets are many."""
        todo = [(lo, hi, top, -1)]
        while todo:
            lo, hi, top, parent = todo.pop()
            bottom = int(self.lengths[lo]) if hi == lo + 1 else int(shared[lo + 1 : hi].min())
            node = len(self.nodes)
            self.nodes.append((lo, hi, top, bottom))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if hi > lo + 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(shared[lo + 1 : hi] == bottom)).tolist(), hi]
                todo += [(a, b, bottom, node) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return 0

    def walk(self, probe: int, percent: int, classes: np.ndarray, marks: np.ndarray) -> Iterator[int]:
        """Rows after the probe that are similar to it and not yet of its class when they are reached."""
        own = self.rows[probe]
        size = len(own)
        marks[own] = True
        todo = [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            lo, hi, top, bottom = self.nodes[node]
            if hi <= probe + 1 or (classes[max(lo, probe + 1) : hi] == classes[probe]).all():
                continue
            edge = self.rows[lo][top:bottom]
            overlap += int(np.count_nonzero(marks[edge]))
            lengths = self.lengths[lo:hi]
            short, long = int(lengths.min()), int(lengths.max())
            left = size - int(np.searchsorted(own, edge[-1], "right")) if len(edge) else size
            if (100 + percent) * (overlap + left) < percent * (size + short) or (100 + percent) * (overlap + long - bottom) < percent * (size + long):
                continue
            if hi == lo + 1:
                yield lo
            else:
                todo += [(child, overlap) for child in self.children[node]]
        marks[own] = False


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of some sets, each in the global order of shingle hashes, the first one of its class, where classes are the
    components of the links between them."""
    m = len(sets)
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)  # shorter names in the same order
    ends = np.cumsum([len(s) for s in sets])
    rows = [codes[e - len(s) : e] for e, s in zip(ends, sets, strict=True)]
    order = sorted(range(m), key=lambda i: rows[i].astype(">u4").tobytes())
    trie = Trie([rows[i] for i in order])
    classes, marks = np.arange(m), np.zeros(len(distinct), bool)
    for probe in range(m - 1):
        for found in trie.walk(probe, percent, classes, marks):
            if classes[found] != classes[probe]:
                a, b = sorted((classes[found], classes[probe]))
                classes[classes == b] = a
    out = np.empty(m, np.int64)
    place = np.array(order)
    first = np.full(m, m, np.int64)
    np.minimum.at(first, classes, place)
    out[place] = first[classes]
    return out


def bitmap(values: np.ndarray) -> np.ndarray:
    """One bit for each cell: whether an odd number of the set's shingles fall there. A power of two of cells by the set's
    size; halves laid over each other are the bitmap of half the cells."""
    cells = 1 << min(14, max(8, int(4 * len(values)).bit_length()))
    return np.packbits(np.bincount((values & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1)


def plausible(sizes: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of some sets the first of its class, where classes join pairs that sizes and bitmaps don't rule out: two sets
    differ in at least as many shingles as their bitmaps have different bits."""
    m = len(sizes)
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    width = np.array([len(maps[i]) for i in order])
    same = {w: np.stack([maps[i] for i in order[width == w]]).view(np.uint64) for w in np.unique(width)}
    half = {w: (x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]) for w, x in same.items() if w > 32}
    base = {w: int(np.searchsorted(width, w)) for w in same}
    classes = np.arange(m)
    ends = np.searchsorted(n, (100 * n) // percent, "right")
    for i in range(m - 1):
        own = same[width[i]][i - base[width[i]]]
        for w, of in ((width[i], same), (2 * width[i], half)):
            if w not in of:
                continue
            a, z = max(i + 1, base[w]), min(ends[i], base[w] + len(of[w]))
            if a >= z:
                continue
            at = np.arange(a, z)[classes[a:z] != classes[i]]
            if len(at):
                differ = np.bitwise_count(of[w][at - base[w]] ^ own).sum(1, dtype=np.int64)
                both = n[i] + n[at]
                fit = at[differ <= both - 2 * -(-percent * both // (100 + percent))]
                for c in np.unique(classes[fit]):
                    classes[classes == max(c, classes[i])] = min(c, classes[i])
    first = np.full(m, m, np.int64)
    np.minimum.at(first, classes, order)
    out = np.empty(m, np.int64)
    out[order] = first[classes]
    return out


def _sent(keyed: DataFrame, assigned: DataFrame, holders: DataFrame, size: int, exact: bool, deal: F.Column | None = None) -> DataFrame:
    """(bucket, sid, n, copies, blob) dealt by bucket, or by deal: each set of assigned (bucket, sid), made once from its holder's text; its
    shingles if exact, else its bitmap."""
    per_set = assigned.groupBy("sid").agg(F.collect_list("bucket").alias("buckets"))  # no more than the set's prefix is long
    wanted = written(per_set.join(holders, "sid").select(F.col("rep").alias("k"), "sid", "n", "copies", "buckets"), "wanted")
    volume, count, listed = wanted.agg(F.sum((F.col("n") * (8 if exact else 1) + 64) * F.size("buckets")), F.count("*"), F.sum(F.size("buckets"))).first()
    tasks = max(12, -(-(volume or 0) // TASK_BYTES))

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            data, offsets = utf8(column(batch, "t"))
            want, copies, buckets = (column(batch, c).to_pylist() for c in ("sid", "copies", "buckets"))
            for i, j in groups(offsets):
                values, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                out: list[tuple] = []
                held = 0
                for n, sid in enumerate(set_ids(values, bounds).tolist()):
                    if sid == want[i + n] and sid not in done:
                        done.add(sid)
                        own = values[bounds[n] : bounds[n + 1]]
                        blob = (own if exact else bitmap(own)).tobytes()
                        for bucket in buckets[i + n]:
                            out.append((bucket, sid, len(own), copies[i + n], blob))
                            held += len(blob)
                            if held > 4 * CHUNK_BYTES:
                                yield _blobs(out)
                                out, held = [], 0
                yield _blobs(out)

    ids = wanted.select("k", "sid", "copies", "buckets")
    texts = keyed.join(F.broadcast(ids) if count <= SMALL and (listed or 0) <= 4 * SMALL else ids, "k").select("t", "sid", "copies", "buckets")
    return in_arrow(texts, blobs, "bucket long, sid long, n long, copies long, blob binary").repartition(tasks, F.col("bucket") if deal is None else deal)


def _met(keyed: DataFrame, assigned: DataFrame, holders: DataFrame, size: int, percent: int, exact: bool) -> DataFrame:
    """Edges (a, b) that span the classes of each bucket: of links if exact, else of what bitmaps don't rule out.

    assigned: (bucket, sid).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, tuple]] = {}
        for batch in batches:
            for bucket, sid, n, blob in zip(*(column(batch, c).to_pylist() for c in ("bucket", "sid", "n")), column(batch, "blob"), strict=True):
                held.setdefault(bucket, {})[sid] = n, np.frombuffer(blob.as_buffer().to_pybytes(), np.uint64 if exact else np.uint8)
        a, b = [], []
        for own in held.values():
            if len(own) > 1:
                sids = sorted(own)
                sets = [own[s][1] for s in sids]
                firsts = linked(sets, percent) if exact else plausible(np.array([own[s][0] for s in sids]), sets, percent)
                for i, first in enumerate(firsts.tolist()):
                    if first != i:
                        a.append(sids[first])
                        b.append(sids[i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sent = _sent(keyed, assigned, holders, size, exact)
    return written(in_arrow(sent, run, "a long, b long"), "met")


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "sid", "n", "copies", "blob"])


def _links(keyed: DataFrame, buckets: DataFrame, holders: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that span the classes which the links inside the buckets (bucket, sid) make.

    First only bitmaps go to the buckets. What they don't rule out falls into classes; a class of few sets meets as a
    whole, so that each of its sets is sent once, a larger one meets in its part of each bucket.
    """
    near = components(_met(keyed, buckets, holders, size, percent, False)).select(F.col("v").alias("sid"), "root")
    near = written(near.join(holders, "sid").select("sid", "root", "n"), "near")
    sizes = near.groupBy("root").agg(((F.count("*") <= BUCKET // 2) & (F.sum("n") * 8 <= TASK_BYTES)).alias("few"))
    near = near.withColumn("key", apart(F.col("root"))).join(sizes.select(apart(F.col("root")).alias("key"), "few"), "key")
    many = buckets.join(near.where("not few").select("sid", "root"), "sid").select(F.xxhash64("bucket", "root").alias("bucket"), "sid")
    assigned = near.where("few").select(F.col("root").alias("bucket"), "sid").union(many)
    return _met(keyed, written(assigned, "assigned"), holders, size, percent, True)


def weights(sets: list[np.ndarray], copies: np.ndarray, percent: int, split: int = 0) -> np.ndarray:
    """For each of some sets the copies of the others linked to it; with split, of those on the other side of that place.

    Shingles that only one set has are left out; the others are bits of rows, or a flat list where that is shorter.
    """
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    _, codes, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[codes]
    rows = [x[x >= 0] for x in np.split(new, np.cumsum(sizes)[:-1])]
    width, bounds = int((count > 1).sum()), np.cumsum([0, *map(len, rows)])
    dense = m * -(-width // 64) <= 2 * bounds[-1]
    if dense:
        bits = np.zeros((m, -(-width // 64)), np.uint64)
        for i, own in enumerate(rows):
            np.bitwise_or.at(bits[i], own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
    else:
        flat, marks = np.concatenate(rows), np.zeros(width, bool)
    out = np.zeros(m, np.int64)
    for i in range(split or m - 1):
        a = split or i + 1
        if dense:
            both = np.bitwise_count(bits[a:] & bits[i]).sum(1, dtype=np.int64)
        else:
            marks[rows[i]] = True
            both = np.diff(np.r_[0, np.cumsum(marks[flat[bounds[a] :]])][bounds[a:] - bounds[a]])
            marks[rows[i]] = False
        found = a + np.flatnonzero((100 + percent) * both >= percent * (sizes[i] + sizes[a:]))
        out[i] += copies[found].sum()
        out[found] += copies[i]
    return out


def _counted(keyed: DataFrame, roots: DataFrame, holders: DataFrame, size: int, percent: int) -> DataFrame:
    """(sid, links): for the sets of classes (sid, root) the number of documents with another set that is linked to it.

    Linked sets are in one class and at most one step of sizes, a factor 100 / percent, apart. The sets of a class and step
    are dealt into parts of bounded number and bytes, and every two parts that may hold a link meet in one bucket, so that
    each pair of sets is compared once. Exact; the time goes by the pairs of sets of a class, as links may be as many.
    """
    width = F.log(F.lit(100 / percent)) * (1 + 1e-9)  # rounding must not put linked sets two steps apart
    rows = roots.join(holders, "sid").withColumn("step", F.floor(F.log(F.col("n").cast("double")) / width) if percent < 100 else F.col("n"))
    rows = written(rows, "classed")
    needed = F.greatest(F.ceil(F.count("*") / PART_SETS), F.ceil(F.sum("n") * 8 / PART_BYTES))
    few = rows.groupBy("root").agg((needed == 1).alias("few"))  # a class that is one part needs no steps
    rows = rows.withColumn("key", apart(F.col("root"))).join(few.select(apart(F.col("root")).alias("key"), "few"), "key").drop("key")
    rows = written(rows.withColumn("step", F.when(F.col("few"), F.lit(0).cast("long")).otherwise(F.col("step"))).drop("few"), "classed")
    parts = written(rows.groupBy("root", "step").agg(needed.alias("parts")), "parts")
    near = parts.join(parts.select("root", F.col("step").alias("other"), F.col("parts").alias("others")), "root").where("abs(other - step) <= 1")
    near = near.groupBy("root", "step").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("other", "others")).alias("near"))  # of at most three
    near = near.withColumn("key", F.xxhash64("root", "step")).drop("root", "step")
    rows = rows.withColumn("key", F.xxhash64("root", "step")).join(near, "key").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")))
    rows = rows.select("sid", "root", F.struct("step", "part").alias("own"), F.explode("near").alias("x"))
    rows = rows.select("sid", "root", "own", "x.other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x.others") - 1)).alias("p"))
    met = F.struct(F.col("other").alias("step"), F.col("p").alias("part"))
    side = F.when(F.col("own") == met, 0).when(F.col("own") < met, 1).otherwise(2)  # 0: a part with itself
    bucket = F.shiftleft(F.xxhash64("root", F.least("own", met), F.greatest("own", met)), 2).bitwiseOR(side.cast("long"))
    assigned = written(rows.select(bucket.alias("bucket"), "sid"), "assigned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for bucket, sid, copies, blob in zip(*(column(batch, c).to_pylist() for c in ("bucket", "sid", "copies")), column(batch, "blob"), strict=True):
                held.setdefault(bucket >> 2, []).append((bucket & 3, sid, copies, np.frombuffer(blob.as_buffer().to_pybytes(), np.uint64)))
        for own in held.values():
            own.sort(key=lambda x: x[:2])
            first = sum(x[0] == 1 for x in own)
            if len(own) > 1 and (own[0][0] == 0 or 0 < first < len(own)):
                links = weights([x[3] for x in own], np.array([x[2] for x in own]), percent, first)
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in own], pa.int64()), pa.array(links)], ["sid", "links"])

    sent = _sent(keyed, assigned, holders, size, True, F.shiftright("bucket", 2))
    return in_arrow(sent, run, "sid long, links long").groupBy("sid").agg(F.sum("links").alias("links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, links: bool = True) -> DataFrame:
    """key, n_shingles, component_id and n_links of every row; without links the last is left out.

    Words are `[^\\x20\\x09-\\x0D]+` of the A-Z lower-cased whole text; a set holds its distinct shingles of size words,
    with fewer words the whole sequence. Sets are linked if 100 * intersection >= percent * union; component_id is the
    smallest key reachable by links, n_links the number of other keys linked to the row's, those with an equal set too. A
    null or wordless text has 0 shingles and is alone; repeated rows are alike; a row
    with a null key has its n_shingles, no component and no n_links; an empty table gives no rows; other columns are ignored.
    Shingles and sets are told apart by 64-bit hashes.
    """
    integral(docs, key)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    profile = written(_profile(rows, size), "profile")
    members = profile.where("kind = 0").select("k", "sid", "n")
    holders = members.where("k is not null and n > 0").groupBy("sid", "n").agg(F.min("k").alias("rep"), F.count_distinct("k").alias("copies"))
    holders = written(holders, "holders")
    total = holders.agg(F.sum((F.col("n") * (100 - percent) / 100).cast("long") + 2)).first()[0] or 0
    levels = spark.sparkContext.broadcast(_levels(profile))
    keyed = rows.where("k is not null")
    met = written(_grouped(keyed, levels, size, percent, max(12, -(-2 * total // RANGE))), "met")
    # At most n - m of a set's shingles, m = ceil(n * percent / 100), are not in a linked set, so of the first n - m + l of
    # both as many as l are common; l is taken for the smallest set that can be linked.
    part = lambda n: F.floor((n * percent + 99) / 100)
    active = met.where("kind <> 1").groupBy("sid", "n").agg(F.sum("c").alias("c")).where(F.col("c") >= F.greatest(F.lit(1), part(F.col("n")) - part(part(F.col("n"))))).select("sid")
    met = written(met.where("kind < 2").select("kind", "bucket", "sid", "n").join(active, "sid", "left_semi"), "buckets")

    # Common shingles: where sizes differ too much for some pairs, sets meet by size too, in groups of neighbouring classes of
    # sizes a factor 100 / percent apart.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
    hot = met.where("kind = 1").select("bucket", "sid", "n")
    spans = hot.groupBy("bucket").agg((100 * F.min("n") >= percent * F.max("n")).alias("alike")).select(apart(F.col("bucket")).alias("key"), "alike")
    hot = hot.withColumn("key", apart(F.col("bucket"))).join(spans, "key")
    hot = hot.select(F.explode(F.when(F.col("alike"), F.array(F.lit(-1).cast("long"))).otherwise(F.array(step, step + 1))).alias("g"), "bucket", "sid", "n")
    hot = hot.select(F.xxhash64("bucket", "g").alias("bucket"), "sid", "n").distinct()
    counts = hot.groupBy("bucket").agg(F.count("*").alias("m"), F.min("sid").alias("leader")).where("m > 1")
    hot = written(hot.withColumn("key", apart(F.col("bucket"))).join(counts.select(apart(F.col("bucket")).alias("key"), "m", "leader"), "key").drop("key"), "hot")
    blocks = F.ceil(F.col("m") / CHUNK_SETS)
    chunk = F.pmod(F.xxhash64("sid"), blocks)
    chunked = hot.select(F.xxhash64("bucket", chunk).alias("bucket"), F.explode(F.array_distinct(F.array("sid", "leader"))).alias("sid")).distinct()
    small = written(met.where("kind = 0").select("bucket", "sid").union(chunked), "small")

    edges = spark.createDataFrame([], "a long, b long")
    if not small.isEmpty():
        edges = _links(keyed, small, holders, size, percent)
        # Where the chunks of one group did not become one class, every two of its chunks meet as well.
        large = hot.where(F.col("m") > CHUNK_SETS)
        if not large.isEmpty():
            classes = components(edges)
            large = large.join(classes.withColumnRenamed("v", "sid"), "sid", "left").withColumn("class", F.coalesce("root", "sid"))
            open_ = large.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select(apart(F.col("bucket")).alias("key"))
            large = large.withColumn("key", apart(F.col("bucket"))).join(open_, "key", "left_semi")
            other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
            pairs = large.select("bucket", "sid", chunk.alias("c"), other.alias("d")).where("c <> d")
            pairs = written(pairs.select(F.xxhash64("bucket", F.least("c", "d"), F.greatest("c", "d")).alias("bucket"), "sid").distinct(), "pairs")
            if not pairs.isEmpty():
                edges = edges.union(_links(keyed, pairs, holders, size, percent))
    roots = components(edges).withColumnRenamed("v", "sid")
    least = roots.join(holders, "sid").groupBy("root").agg(F.min("rep").alias("least"))
    moved = roots.join(least, "root").select("sid", "least")
    final = holders.join(moved, "sid", "left")
    if links:
        final = final.join(_counted(keyed, roots, holders, size, percent), "sid", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    counts = ["n_links"] if links else []
    final = final.select(apart(F.col("sid")).alias("key"), F.coalesce("least", "rep").alias("component_id"), *counts)
    out = members.withColumn("key", apart(F.when(F.col("k").isNotNull() & (F.col("n") > 0), F.col("sid")))).join(final, "key", "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("k").isNotNull(), F.coalesce("component_id", "k")).alias("component_id"), *(F.when(F.col("k").isNotNull(), F.coalesce(c, F.lit(0))).alias(c) for c in counts))
