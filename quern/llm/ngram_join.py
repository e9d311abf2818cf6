"""N-gram Jaccard join: every pair of documents whose word n-gram sets are similar.

Equal sets are one set from the start. The frequency of every n-gram is counted
exactly; a pair that is similar shares so many that sets with too few n-grams
of frequency two or more drop out, and that it meets in one of the rarest of
each that are left. Sets linked by such meetings form components. A component, or each pair of its stretches where it
is large, is joined in one task by a prefix tree: sets, ordered by one global
order, lie in a trie; a walk through it carries the partial overlaps of all
probing sets at once, and leaves a subtree as soon as what remains can't lift
any of them to the threshold. For classes and links a task tells no pairs, but
what they come to: a sum for each set, and the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, importable, partitions, remove, small_batches, table, written
from quern.llm.graphs import components
from quern.llm.grams import WORD, gram_set

N = 5
THRESHOLD = 0.4
#: N-grams of one component that are joined in one piece, and as how many a set counts at least; larger
#: components are joined by pairs of such stretches, so that a task's memory is bounded.
STRETCH, LEAST = 1 << 18, 1 << 9
#: Steps of the logarithm of a set's size, which says whether sets that meet can be similar.
LOG = 1000
#: Ranks between two of a probe's remaining counts.
STRIDE = 64
#: N-grams of a bucket in which their frequencies are counted, on average.
BUCKET_GRAMS = 1 << 20
#: Texts and n-grams that are worked on at a time; more only where one text has more.
SLICE_TEXTS, SLICE_GRAMS = 2000, 1 << 20
#: Rows up to this many, of eleven numbers each, are joined to the texts by broadcast.
BROADCAST_ROWS = 500_000
#: What a summed row ``(kind, a, b)`` says: sets a and b are of one class; a has b links more; both are marked and similar.
EDGE, LINKS, MARKED = 0, 1, 2


def needed(n: int, t: float) -> int:
    """How many n-grams a set of n shares with any similar one at least."""
    return max(1, int(np.ceil(t * n - 1e-9)))


def pack(keys: np.ndarray) -> bytes:
    """The five lower bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def fingerprint(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _grams(texts: Iterable[pa.StringScalar], n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The n-gram sets of the texts, in slices of ``SLICE_TEXTS`` and ``SLICE_GRAMS``: from which text on, and the sets."""
    first, own, size = 0, [], 0
    for i, text in enumerate(texts):
        g = gram_set(text.as_py(), n)
        if own and (len(own) == SLICE_TEXTS or size + len(g) > SLICE_GRAMS):
            yield first, own
            first, own, size = i, [], 0
        own.append(g)
        size += len(g)
    if own:
        yield first, own


def sets(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, mark, fp, n)`` of every row that has a word: mark is a hash of the text, fp of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [(first + i, fingerprint(g), len(g)) for first, own in _grams(b.column("text"), n) for i, g in enumerate(own) if len(g)]
            picked = b.select(["doc_id", "mark"]).take(pa.array([i for i, *_ in told], pa.int64()))
            yield pa.RecordBatch.from_arrays([
                picked.column(0).cast(pa.int64()), picked.column(1),
                pa.array([fp for _, fp, _ in told], pa.int64()), pa.array([size for *_, size in told], pa.int64()),
            ], names=["doc_id", "mark", "fp", "n"])

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id bigint, mark bigint, fp bigint, n bigint")


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, int)
    return start, np.diff(np.append(start, len(sorted_)))


def links(docs: DataFrame, n: int, t: float, grams: int) -> DataFrame:
    """``(a, b)``: fingerprints of sets that meet in a rare n-gram; every similar pair is connected by such links.

    ``grams`` tells how many n-grams all sets have; the buckets follow from it.
    """
    buckets = max(2 * partitions(docs.sparkSession), -(-grams // BUCKET_GRAMS))
    reach = int(np.ceil(LOG * np.log(1 / t))) + 1  # logarithms of the sizes of similar sets, cut to integers, differ by no more

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per slice and bucket of n-grams one row: keys, which of the sets, the sets' fingerprints."""
        for _, own in _grams((x for b in batches for x in b.column("text")), n):
            keys, which, fps, sizes, seen = [], [], [], [], set()
            for g in own:
                fp = fingerprint(g)
                if not len(g) or fp in seen:
                    continue
                seen.add(fp)
                keys.append(g)
                which.append(np.full(len(g), len(fps), np.uint32))
                fps.append(fp)
                sizes.append(len(g))
            if not fps:
                continue
            key, which = np.concatenate(keys), np.concatenate(which)
            fps, sizes = np.array(fps, np.int64), np.array(sizes, np.int64)
            bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            start, count = _runs(bucket[order])
            rows = []
            for s, c in zip(start, count):
                of = order[s : s + c]
                docs_here, idx = np.unique(which[of], return_inverse=True)
                kind = np.uint16 if len(docs_here) < 65536 else np.uint32
                rows.append((int(bucket[of[0]]), pack(key[of]), idx.astype(kind).tobytes(), fps[docs_here].tobytes()))
            owner = (fps.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            for o in np.unique(owner):  # the sizes go straight to where the sets are judged
                rows.append((int(-1 - o), b"", sizes[owner == o].tobytes(), fps[owner == o].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "keys", "idx", "fps"])

    def count(rows: pa.Table) -> pa.Table:
        """Per bucket of n-grams, those of frequency two or more, for the buckets of sets."""
        cols = rows.to_pydict()
        if not rows.num_rows:
            return pa.table({k: pa.array([], v) for k, v in (("owner", pa.int32()), ("bucket", pa.int32()), ("fps", pa.binary()), ("keys", pa.binary()), ("freq", pa.binary()))})
        here = cols["bucket"][0]
        if here < 0:  # sizes: passed on
            return pa.table({"owner": pa.array([-1 - here] * rows.num_rows, pa.int32()), "bucket": pa.array([-1] * rows.num_rows, pa.int32()), "fps": pa.array(cols["fps"], pa.binary()), "keys": pa.array(cols["idx"], pa.binary()), "freq": pa.array([b""] * rows.num_rows, pa.binary())})
        fps = [np.frombuffer(x, np.int64) for x in cols["fps"]]
        flat = np.concatenate(fps)
        first = np.zeros(len(flat), bool)
        first[np.unique(flat, return_index=True)[1]] = True  # a set that several batches hold counts once
        keys, owners, base = [], [], 0
        for k, i, f in zip(cols["keys"], cols["idx"], fps):
            idx = np.frombuffer(i, np.uint16 if len(f) < 65536 else np.uint32)
            ok = first[base + idx.astype(np.int64)]
            keys.append(unpack(k)[ok])
            owners.append(f[idx][ok])
            base += len(f)
        key, fp = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key)
        key, fp = key[order], fp[order]
        _, runs = _runs(key)
        freq = np.repeat(runs, runs)
        more = freq > 1
        key, fp, freq = key[more], fp[more], np.minimum(freq[more], 255).astype(np.uint8)
        owner = (fp.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        start, size = _runs(owner[order])
        cut = [order[s : s + c] for s, c in zip(start, size)]
        return pa.table({"owner": pa.array([int(owner[c[0]]) for c in cut], pa.int32()), "bucket": pa.array([here] * len(cut), pa.int32()), "fps": pa.array([fp[c].tobytes() for c in cut], pa.binary()), "keys": pa.array([pack(key[c]) for c in cut], pa.binary()), "freq": pa.array([freq[c].tobytes() for c in cut], pa.binary())})

    def judge(rows: pa.Table) -> pa.Table:
        """Per bucket of sets: which have enough n-grams of frequency two or more, and their rarest ones."""
        cols = rows.to_pydict()
        own = [i for i, b in enumerate(cols["bucket"]) if b >= 0]
        empty = pa.table({"bucket": pa.array([], pa.int32()), **{k: pa.array([], pa.binary()) for k in ("keys", "fps", "logs")}})
        if not own:
            return empty
        told = [i for i, b in enumerate(cols["bucket"]) if b < 0]
        known, at = np.unique(np.concatenate([np.frombuffer(cols["fps"][i], np.int64) for i in told]), return_index=True)
        sizes = np.concatenate([np.frombuffer(cols["keys"][i], np.int64) for i in told])[at]
        fp = np.concatenate([np.frombuffer(cols["fps"][i], np.int64) for i in own])
        key = np.concatenate([unpack(cols["keys"][i]) for i in own])
        freq = np.concatenate([np.frombuffer(cols["freq"][i], np.uint8) for i in own])
        bucket = np.concatenate([np.full(len(cols["freq"][i]), cols["bucket"][i], np.int32) for i in own])
        order = np.lexsort((bucket, key, freq, fp))
        start, c = _runs(fp[order])
        n_of = sizes[np.searchsorted(known, fp[order][start])]
        least = np.array([needed(int(k), t) for k in n_of])
        allowed = np.maximum(0, c - least + 1)
        rank = np.arange(len(fp)) - np.repeat(start, c)
        few = rank < np.repeat(allowed, c)
        kept, log = order[few], np.repeat((np.log(n_of) * LOG).astype(np.uint16), c)[few]
        if not len(kept):
            return empty
        by = np.argsort(bucket[kept], kind="stable")
        kept, log = kept[by], log[by]
        start, c = _runs(bucket[kept])
        cut = [kept[s : s + k] for s, k in zip(start, c)]
        return pa.table({"bucket": pa.array([int(bucket[x[0]]) for x in cut], pa.int32()), "keys": pa.array([pack(key[x]) for x in cut], pa.binary()), "fps": pa.array([fp[x].tobytes() for x in cut], pa.binary()), "logs": pa.array([log[s : s + k].tobytes() for s, k in zip(start, c)], pa.binary())})

    def meet(rows: pa.Table) -> pa.Table:
        """Per bucket of n-grams, each set linked to the least one that it meets, where a chain of sizes that similar sets can have leads to it."""
        cols = rows.to_pydict()
        key = np.concatenate([unpack(k) for k in cols["keys"]]) if rows.num_rows else np.zeros(0, np.uint64)
        fp, log = (np.concatenate([np.frombuffer(x, kind) for x in cols[k]]) if rows.num_rows else np.zeros(0, kind) for k, kind in (("fps", np.int64), ("logs", np.uint16)))
        order = np.lexsort((log, key))
        key, fp, log = key[order], fp[order], log[order].astype(np.int64)
        # A set between two similar ones in size is near enough to both, so that no similar pair is cut apart.
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(log) > reach)])) if len(fp) else np.zeros(0, int)
        a = np.repeat(np.minimum.reduceat(fp, start), np.diff(np.append(start, len(fp)))) if len(fp) else fp
        both = np.unique(np.stack([a, fp], 1)[a != fp], axis=0)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    posted = docs.select("text").mapInArrow(post, "bucket int, keys binary, idx binary, fps binary")
    counted = posted.groupBy("bucket").applyInArrow(count, "owner int, bucket int, fps binary, keys binary, freq binary")
    judged = counted.groupBy("owner").applyInArrow(judge, "bucket int, keys binary, fps binary, logs binary")
    return judged.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint").distinct()


class Trie:
    """Sets of ranks in ascending order, in a tree whose edges are runs of ranks."""

    def __init__(self, rows: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">u4").tobytes())
        self.rows, self.sizes = [rows[i] for i in self.order], sizes[self.order]
        flat = self.rows
        self.common = [_common(flat[i], flat[i + 1]) for i in range(len(flat) - 1)]

    def walk(self, member: np.ndarray, after: np.ndarray, probe_sizes: np.ndarray, t: float) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(probes, set, overlaps) of all pairs that reach the threshold.

        member[i, r]: probe i has rank r. after[i, c]: how many ranks from c * STRIDE on it has.
        """
        out = []
        stack = [(0, len(self.rows), 0, np.arange(len(member)), np.zeros(len(member), np.int64))]
        while stack:
            low, high, depth, active, overlap = stack.pop()
            own = self.rows[low]
            upto = min(self.common[low : high - 1], default=len(own)) if high - low > 1 else len(own)
            upto = max(upto, depth)
            if upto > depth:
                overlap = overlap + member[np.ix_(active, own[depth:upto])].sum(1)
            # Remaining-length bound: no set below can gain more than its own or the probe's remaining ranks.
            least, most = self.sizes[low:high].min(), max(len(r) for r in self.rows[low:high])
            rest = after[active, (own[upto - 1] + 1) // STRIDE] if upto else after[active, 0]
            best = overlap + np.minimum(rest, most - upto)
            size = probe_sizes[active]
            need = np.ceil(t / (1 + t) * (size + np.maximum(least, np.ceil(t * size - 1e-9))) - 1e-9)
            ok = (best >= need) & (best >= np.ceil(t * size - 1e-9))
            active, overlap = active[ok], overlap[ok]
            if not len(active):
                continue
            i = low
            while i < high and len(self.rows[i]) == upto:  # sets that end here
                size = probe_sizes[active]
                hit = overlap * (1 + t) >= t * (size + self.sizes[i]) - 1e-9
                if hit.any():
                    out.append((active[hit], self.order[i], overlap[hit]))
                i += 1
            while i < high:  # children: sets that go on with the same rank
                j = i + 1
                while j < high and self.common[j - 1] > upto:
                    j += 1
                stack.append((i, j, upto, active, overlap))
                i = j
        return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def join_block(left: list[np.ndarray], right: list[np.ndarray] | None, t: float) -> list[tuple[int, int, float]]:
    """(i, j, jaccard) of similar sets, i of left and j of right; or i < j of left alone.

    The global order: n-grams that more sets have come first, so that the
    trie shares as much as it can; ones that only one set has can't be shared
    and count in the sizes alone.
    """
    probes, kept = left, left if right is None else right
    every = np.concatenate([*probes, *kept] if right is not None else probes)
    grams, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    shared = shared[np.lexsort((grams[shared], -count[shared]))]
    rank = np.full(len(grams), -1, np.int64)
    rank[shared] = np.arange(len(shared))
    ranks, cut = rank[inverse], np.cumsum([0, *map(len, probes), *(map(len, kept) if right is not None else [])])
    rows = [np.sort(r[r >= 0]) for r in (ranks[a:b] for a, b in zip(cut, cut[1:]))]
    a, b = rows[: len(probes)], rows[len(probes) :] if right is not None else rows
    strides = len(shared) // STRIDE + 1
    member = np.zeros((len(a), strides * STRIDE), np.bool_)
    for i, r in enumerate(a):
        member[i, r] = True
    after = np.stack([np.cumsum(m.reshape(strides, STRIDE).sum(1)[::-1])[::-1] for m in member]) if len(a) else np.zeros((0, strides), np.int64)
    size_a, size_b = np.array([len(x) for x in probes]), np.array([len(x) for x in kept])
    found = []
    for who, j, overlap in Trie(b, size_b).walk(member, after, size_a, t):
        for i, o in zip(who.tolist(), overlap.tolist()):
            if right is not None or i < j:
                found.append((i, j, o / (size_a[i] + size_b[j] - o)))
    return found


def summed(pairs: list[tuple[int, int, float]], fps: np.ndarray, sizes: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(kind, a, b)`` of the pairs of one block: links of each set, edges that connect what pairs connect, pairs of marked sets."""
    i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    links = np.zeros(len(fps), np.int64)
    np.add.at(links, i, sizes[j])
    np.add.at(links, j, sizes[i])
    root = np.arange(len(fps))
    while True:
        lower = root.copy()
        np.minimum.at(lower, i, root[j])
        np.minimum.at(lower, j, root[i])
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    to, some, both = np.flatnonzero(root != np.arange(len(fps))), np.flatnonzero(links), marked[i] & marked[j]
    kind = np.repeat([EDGE, LINKS, MARKED], [len(to), len(some), int(both.sum())])
    return kind, np.concatenate([fps[to], fps[some], fps[i[both]]]), np.concatenate([fps[root[to]], links[some], fps[j[both]]])


def members_of(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, mark, fp, n)`` of ``sets``, written: which set each row with a word has."""
    importable(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return written(sets(docs, n), "members")[0]


def join(docs: DataFrame, members: DataFrame, n: int, t: float, sums: bool, marks: DataFrame | None = None) -> DataFrame:
    """Which of the distinct sets of ``members_of`` are similar.

    ``(a, b, jaccard)``: fingerprints with a < b, each pair once. With
    ``sums``, instead, ``(kind, a, b)`` as ``summed`` has them for each block,
    where a set has as many links to another as that one has ids, and
    ``marks`` (fp) are the marked sets.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        edges, at_edges = written(links(docs, n, t, members.agg(F.sum("n")).first()[0] or 0), "links")
    nodes, at_nodes = components(edges)
    remove(spark, at_edges)
    # One row of each set stands for it: that of the least mark, then id.
    first = members.join(nodes, members.fp == nodes.node).groupBy("fp", "comp", "n").agg(F.min(F.struct("mark", "doc_id")).alias("of"), (F.count_distinct("doc_id") if sums else F.lit(1)).cast("bigint").alias("size"))
    first = first.join(marks.select("fp", F.lit(True).alias("marked")), "fp", "left") if marks is not None else first.withColumn("marked", F.lit(False))
    # The sets of a component, in the order of their sizes, in stretches.
    upto = Window.partitionBy("comp").orderBy("n", "fp").rowsBetween(Window.unboundedPreceding, 0)
    chosen = first.select("fp", "comp", "n", "size", F.coalesce("marked", F.lit(False)).alias("marked"), F.col("of.mark").alias("mark"), F.col("of.doc_id").alias("of_id"), F.floor(F.sum(F.greatest("n", F.lit(LEAST))).over(upto) / STRETCH).cast("int").alias("part"))
    chosen, at_chosen = written(chosen, "chosen")
    parts = chosen.groupBy("comp", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = parts.select(F.col("comp").alias("comp2"), F.col("part").alias("part2"), "least")
    tasks = parts.select("comp", "part", "most").join(other, (F.col("comp") == F.col("comp2")) & (F.col("part") <= F.col("part2")) & (F.col("most") >= F.lit(t) * F.col("least") - 1e-6)).select("comp", "part", "part2")
    sides = tasks.select("comp", F.col("part").alias("part"), "part", F.col("part2").alias("other"), F.lit(0).alias("side")).toDF("comp", "part", "p1", "p2", "side").union(tasks.where("part <> part2").select("comp", "part2", "part", "part2", F.lit(1)))
    # A set of a large component is routed to each stretch that its own one meets.
    routed, at_routed = written(chosen.join(sides, ["comp", "part"]), "routed")
    if routed.count() <= BROADCAST_ROWS:
        routed = F.broadcast(routed)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    picked = texts.join(routed, "mark").where(F.col("doc_id").eqNullSafe(F.col("of_id"))).select("comp", "p1", "p2", "side", "fp", "size", "marked", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, own in _grams(b.column("text"), n):
                rows = b.slice(first, len(own))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(7)), pa.array([g.tobytes() for g in own], pa.binary())], names=["comp", "p1", "p2", "side", "fp", "size", "marked", "grams"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(group: dict[int, dict[int, tuple[np.ndarray, int, bool]]]) -> pa.RecordBatch:
            left, right = group[0], group[1]
            found = join_block([x[0] for x in left.values()], [x[0] for x in right.values()] if right else None, t) if left else []
            if sums:
                _, sizes, marked = zip(*left.values(), *right.values())
                offset = len(left) if right else 0
                kind, x, y = summed([(i, j + offset, s) for i, j, s in found], np.array([*left, *right], np.int64), np.array(sizes, np.int64), np.array(marked, bool))
                return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["kind", "a", "b"])
            fa, fb = list(left), list(right) if right else list(left)
            return pa.RecordBatch.from_arrays([
                pa.array([min(fa[i], fb[j]) for i, j, _ in found], pa.int64()), pa.array([max(fa[i], fb[j]) for i, j, _ in found], pa.int64()), pa.array([x for *_, x in found], pa.float64()),
            ], names=["a", "b", "jaccard"])

        key, group = None, {0: {}, 1: {}}
        for b in batches:
            c = b.to_pydict()
            for comp, p1, p2, side, fp, size, marked, raw in zip(*(c[k] for k in b.schema.names)):
                if (comp, p1, p2) != key:
                    if key is not None:
                        yield close(group)
                    key, group = (comp, p1, p2), {0: {}, 1: {}}
                group[side][fp] = np.frombuffer(raw, np.uint64), size, marked
        if key is not None:
            yield close(group)

    carried = picked.mapInArrow(grams, "comp bigint, p1 int, p2 int, side int, fp bigint, size bigint, marked boolean, grams binary")
    carried = carried.repartition(partitions(spark), "comp", "p1", "p2").sortWithinPartitions("comp", "p1", "p2", "side", "fp")
    with small_batches(spark):
        similar, _ = written(carried.mapInArrow(blocks, "kind int, a bigint, b bigint" if sums else "a bigint, b bigint, jaccard double"), "similar")
    remove(spark, at_chosen, at_routed, *at_nodes)
    return similar


def pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """``(doc_a, doc_b, jaccard)``, doc_a < doc_b: every pair of ids whose sets have a Jaccard index of at least t.

    Rows without a word (null and empty texts) and null ids are in no pair. An
    id that has several rows is paired by each of its texts, with the greatest
    index, and never with itself. Other columns don't matter. An empty table
    gives no pairs.
    """
    members = members_of(docs, n)
    similar = join(docs, members, n, t, sums=False)
    ids = members.where("doc_id IS NOT NULL")
    once = ids.groupBy("doc_id").agg(F.count_distinct("fp").alias("k")).where("k > 1").isEmpty()
    # Lists of ids travel, and are spread out at the end.
    lists = ids.groupBy("fp").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    a, b = lists.toDF("a", "ids_a"), lists.toDF("b", "ids_b")
    later = lists.where(F.size("ids") > 1).select("ids", F.posexplode("ids").alias("at", "doc_a"))
    same = later.select("doc_a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("doc_b"), F.lit(1.0).alias("jaccard"))
    x = similar.join(a, "a").join(b, "b").select(F.explode("ids_a").alias("x"), "ids_b", "jaccard").select("x", F.explode("ids_b").alias("y"), "jaccard")
    near = x.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    every = same.union(near)
    return every if once else every.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def one_of_each(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, of which each group of similar ones keeps one.

    A group is what a chain of similar pairs connects. It keeps the row of the
    least id (a null id comes last), then of the least hash of the text; of
    rows that agree in both, one. Rows without a word (null and empty texts)
    are all kept: nothing shows that they are copies.
    """
    members = members_of(docs, n)
    nodes, _ = components(join(docs, members, n, t, sums=True).where(F.col("kind") == EDGE).select("a", "b"))
    name, mark, id_, count = fresh(docs, "group", "mark", "id", "nth")
    group = members.join(nodes, members.fp == nodes.node, "left").select("doc_id", "mark", F.coalesce("comp", "fp").alias("g"))
    best = group.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("m"))
    stay = best.select(F.col("m.doc_id").alias(id_), F.col("m.mark").alias(mark)).distinct()
    wordless = docs.where(F.col("text").isNull() | ~F.lower("text").rlike("[a-z0-9]|[^\\x00-\\x7f]"))
    rows = docs.withColumns({mark: F.xxhash64("text"), id_: F.col("doc_id").cast("bigint")})
    kept = rows.alias("r").join(stay.alias("s"), (F.col(f"r.{mark}") == F.col(f"s.{mark}")) & F.col(f"r.{id_}").eqNullSafe(F.col(f"s.{id_}")), "left_semi")
    nth = Window.partitionBy(mark, id_).orderBy(*[F.col(f"`{c}`") for c in docs.columns if dict(docs.dtypes)[c] in ("string", "bigint", "int", "double")])
    kept = kept.withColumn(count, F.row_number().over(nth)).where(F.col(count) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(wordless)


def classes(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, links)``: one row for each id.

    links: how many other documents have a Jaccard index of at least t with it.
    Copies are counted, not spread out: no pair of documents is ever a row. An
    id that has several texts counts a link for each two of its own and
    another's. class_id: the least id that a chain of similar documents (and
    texts of one id) leads to. A document without a word (of a null or empty
    text) has no links and is a class of its own. Null ids give no row. Other
    columns don't matter. An empty table gives none.
    """
    members = members_of(docs, n)
    own = members.where("doc_id IS NOT NULL").select("doc_id", "fp").distinct()
    several = own.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("fp").alias("first")).where("k > 1")
    # Links between the texts of one id aren't links to others; they are few, as few ids have several texts.
    many, _ = written(own.join(several, "doc_id").select("doc_id", "fp", "first"), "several")
    told = join(docs, members, n, t, sums=True, marks=many.select("fp").distinct())
    around = told.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("fp")).agg(F.sum("b").alias("around"))
    size = own.groupBy("fp").agg(F.count("*").alias("size"))
    sets_ = size.join(around, "fp", "left").select("fp", (F.col("size") + F.coalesce("around", F.lit(0))).alias("reach"))
    marked = told.where(F.col("kind") == MARKED)
    both = marked.select("a", "b").union(marked.select("b", "a"))
    inner = many.select("doc_id", F.col("fp").alias("a")).join(both, "a").join(many.select("doc_id", F.col("fp").alias("b")), ["doc_id", "b"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("inner"))
    nodes, _ = components(told.where(F.col("kind") == EDGE).select("a", "b").union(many.where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))))
    placed = own.join(sets_, "fp").join(nodes, own.fp == nodes.node, "left").select("doc_id", "reach", F.coalesce("comp", "fp").alias("class"))
    each = placed.groupBy("doc_id").agg(F.sum(F.col("reach") - 1).cast("bigint").alias("links"), F.min("class").alias("class"))
    least = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    found = each.join(least, "class").join(inner, "doc_id", "left").select("doc_id", "class_id", (F.col("links") - F.coalesce("inner", F.lit(0))).alias("links"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - {N - 1}, 1)), lambda i: array_to_string(w[i:i + {N - 1}], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_a, doc_b FROM o JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE o >= {THRESHOLD} * (x.n + y.n - o) - 1e-9),
e AS MATERIALIZED (SELECT doc_a AS a, doc_b AS b FROM p UNION ALL SELECT doc_b, doc_a FROM p),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id)
SELECT d.doc_id, (SELECT min(to_id) FROM r WHERE r.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS links FROM documents d
"""
