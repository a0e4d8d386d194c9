"""N-gram Jaccard join: documents whose word n-gram sets are alike, by prefix filter and trie.

1. One pass gives each document the size of its set and a 128-bit signature.
   Equal sets form a class; only classes are compared, so copies cost nothing.
2. Grams that repeat within a partition are counted over all partitions. The
   most frequent ones go last in the global order (others by hash). The order
   decides the cost only; any order gives the same links.
3. Two sets with similarity t share a gram among the first n - ceil(t * n) + 1
   of each. These grams are packed by bucket, shuffled and sorted, each with its
   set's size and the largest partner that its place in the order still allows.
   The sets that share one are cut where no pair of sizes fits across, and each
   piece is put into the block of its smallest set.
4. Every set has a sketch: how many of its grams fall into each of 256 hash
   buckets. The sum of the smaller counts bounds an overlap from above, so members
   that can't reach the required overlap with any other of their block leave it
   before their grams are moved.
5. The sets of a block are stored in a path-compressed trie, and each is walked
   against it: partial overlaps are shared along a path, and a subtree is left
   once its remaining lengths can't reach the required overlap. Blocks with many
   rows are split into cells that cover every pair of their parts.
6. In blocks over a cell, members are first judged against a pivot alone: the block's
   smallest set, then the set that was most alike to the pivot before, which in a
   family of near copies is soon its common origin. Members that these links join to
   the first pivot need no judging among each other, so they only meet the rest: a
   large family costs linear work.
7. Each cell returns a spanning forest of its links; min-label rounds with
   pointer jumping over written tables give the components.

Classes have numbers of their own, written once, so a set that only rows without
doc_id hold links others like any set. Nothing is capped or sampled. Grams have 64
bits; a pair is judged on the grams of its own two sets. Null and empty texts have
an empty set and link with nothing. Repeated rows share a class. A row without
doc_id gets its group's smallest id, or null if none of the group has one. Only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._bytes import bytes_of, shingle_sets
from verdigris.llm._shared import materialize, ship, small_batches, table, text_key, unused

HEAVY_KEPT = 100_000
CELL_GRAMS = 200_000
CELL_ROWS = 200
PIVOT_ROUNDS = 3
SKETCH = 256
FULL = 65_535
LOG_STEPS = 4_000
MOST_PICKED = 400_000


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))


NAMES = ["doc_id", "key", "n", "sig", "sketch", "grams", "counts"]


def _summaries(width: int):
    """Batches to (doc_id, key, n, sig, sketch) and, once in a while, rows that carry the grams seen twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size, seen = [], 0, set()

        def heavy() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(pending), return_counts=True)
            often = counts >= 2
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([0], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()),
                                               pa.array([grams[often].view(np.int64)], kind), pa.array([counts[often]], kind)], NAMES)

        for batch in batches:
            sizes, sigs, sketches = [], [], []
            for grams in shingle_sets(*bytes_of(batch.column("body")), width):
                sig = xxhash.xxh3_128_digest(grams.tobytes())
                sizes.append(len(grams))
                sigs.append(sig)
                filled = np.bincount((grams >> np.uint64(12)).astype(np.int64) % SKETCH, minlength=SKETCH)
                sketches.append(np.minimum(filled, FULL).astype(np.uint16).tobytes())
                if sig not in seen:
                    seen.add(sig)
                    pending.append(grams)
                    size += len(grams)
                if size > 4_000_000:
                    yield heavy()
                    pending, size = [], 0
                    seen.clear()
            empty = pa.nulls(len(sizes), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary()), empty, empty], NAMES)
        if pending:
            yield heavy()

    return run


def _first_long(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "big", signed=True)


def _prefixes(width: int, num: int, den: int, buckets: int, heavy):
    """Batches to (bucket, grams, sets, sizes): the packed prefix grams of each distinct set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = heavy.value
        grams_of, sets_of, sizes_of, size, seen = [], [], [], 0, set()

        def packed() -> pa.RecordBatch:
            grams = np.concatenate(grams_of)
            owner = np.repeat(np.array(sets_of, np.int64), [len(g) for g in grams_of])
            bucket = (grams >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            ends = np.append(first[1:], len(order))
            sizes = np.concatenate(sizes_of)
            rows = [(int(b), *(c[order[i:j]].tobytes() for c in (grams, owner, sizes))) for b, i, j in zip(found, first, ends)]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "grams", "sets", "sizes"])

        for batch in batches:
            for grams in shingle_sets(*bytes_of(batch.column("body")), width):
                n = len(grams)
                sig = xxhash.xxh3_128_digest(grams.tobytes())
                if not n or sig in seen:
                    continue
                seen.add(sig)
                length = n - -(-num * n // den) + 1
                at = np.searchsorted(known, grams)
                often = known[np.minimum(at, len(known) - 1)] == grams if len(known) else np.zeros(n, bool)
                front = grams[~often][:length]
                if len(front) < length:
                    late = grams[often]
                    front = np.concatenate([front, late[np.argsort(rank[at[often]], kind="stable")][: length - len(front)]])
                grams_of.append(front)
                sets_of.append(_first_long(sig))
                sizes_of.append(_size_bounds(n, length, num, den))
                size += length
                if size > 2_000_000:
                    yield packed()
                    grams_of, sets_of, sizes_of, size = [], [], [], 0
                    seen.clear()
        if grams_of:
            yield packed()

    return run


def _size_bounds(n: int, length: int, num: int, den: int) -> np.ndarray:
    """Per prefix place: the size and the largest size of a partner whose first shared gram stands there, on a logarithmic scale, rounded outwards."""
    most = (n - np.arange(length)) * (num + den) / num - n
    scaled = np.minimum(np.ceil(np.log(np.maximum(most, 1)) * LOG_STEPS) + 1, 65535)
    return np.stack([np.full(length, min(int(np.log(n) * LOG_STEPS), 65535)), scaled], axis=1).astype(np.uint16)


def _pieces(first: np.ndarray, lens: np.ndarray, size: np.ndarray, most: np.ndarray, ratio: int) -> np.ndarray:
    """Which rows begin a piece. Rows stand by gram and size; no pair of sizes that could be alike lies across a cut."""
    n = len(size)
    run_end = np.repeat(first + lens, lens)
    small = np.repeat(lens <= 64, lens)
    reach = np.arange(n)
    at = np.flatnonzero(small & (run_end - reach > 1))
    d = 1
    while len(at):
        at = at[at + d < run_end[at]]
        fits = (size[at + d] <= size[at] + ratio) & (size[at + d] <= most[at]) & (size[at] <= most[at + d])
        reach[at[fits]] = at[fits] + d
        d += 1
    at = np.flatnonzero(~small & (run_end - np.arange(n) > 1))
    reach[at] = np.where(size[at + 1] <= size[at] + ratio, at + 1, at)
    return np.append(True, np.maximum.accumulate(reach)[:-1] < np.arange(1, n))


def _blocks(num: int, den: int):
    """All packed grams of a partition to distinct (block, member)."""
    ratio = int(np.ceil(np.log(den / num) * LOG_STEPS)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[], [], []]
        for batch in batches:
            for c, name, kind in zip(columns, ("grams", "sets", "sizes"), (np.uint64, np.int64, np.uint16)):
                c.extend(np.frombuffer(x.as_py(), kind) for x in batch.column(name))
        if not columns[0]:
            return
        grams, sets, bounds = (np.concatenate(c) for c in columns)
        columns.clear()
        bounds = bounds.reshape(-1, 2).astype(np.int32)
        order = np.lexsort((sets, bounds[:, 0], grams))
        grams, sets, bounds = grams[order], sets[order], bounds[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (sets[1:] != sets[:-1])
        grams, sets, bounds = grams[fresh], sets[fresh], bounds[fresh]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        cut = np.flatnonzero(_pieces(first, np.diff(np.append(first, len(grams))), bounds[:, 0], bounds[:, 1], ratio))
        lens = np.diff(np.append(cut, len(grams)))
        shared = np.repeat(lens > 1, lens)
        pairs = np.unique(np.stack([np.repeat(np.minimum.reduceat(sets, cut), lens)[shared], sets[shared]], axis=1), axis=0)
        for lo in range(0, len(pairs), 100_000):
            own = pairs[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())], ["block", "member"])

    return run


def possible_members(sizes: np.ndarray, sketches: np.ndarray, joined: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows could, by size and sketch, be alike to another row; two joined rows needn't be."""
    order = np.argsort(sizes, kind="stable")
    n, sk = sizes[order].astype(np.int64), sketches[order].astype(np.int32)
    sk[sk == FULL] = 1 << 30  # a full bucket may hold any number
    free = ~joined[order]
    found = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        end = int(np.searchsorted(n, n[i] * den // num, side="right"))
        if end > i + 1:
            for lo in range(i + 1, end, 512):
                hi = min(end, lo + 512)
                fits = (num + den) * np.minimum(sk[i], sk[lo:hi]).sum(1) >= num * (n[i] + n[lo:hi])
                if not free[i]:
                    fits &= free[lo:hi]
                if fits.any():
                    found[i] = True
                    found[lo:hi] |= fits
    out = np.zeros(len(n), bool)
    out[order] = found
    return out


def _sift(num: int, den: int):
    """Batches sorted by block and cell to the (block, rep, n, joined) that a sketch leaves possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, sizes, sketches, joins, out = None, [], [], [], [], []

        def close():
            if len(reps) > 1:
                keep = possible_members(np.array(sizes), np.stack([np.frombuffer(x, np.uint16) for x in sketches]), np.array(joins), num, den)
                out.extend((key[0], reps[k], sizes[k], joins[k]) for k in np.flatnonzero(keep))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["block", "rep", "n", "joined"])

        for batch in batches:
            for block, i, j, rep, n, joined, sketch in zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j", "rep", "n", "joined", "sketch"))):
                if (block, i, j) != key:
                    close()
                    key, reps, sizes, sketches, joins = (block, i, j), [], [], [], []
                    if len(out) > 50_000:
                        yield flush()
                        out = []
                reps.append(rep)
                sizes.append(n)
                sketches.append(sketch)
                joins.append(joined)
        close()
        yield flush()

    return run


def _cells(members: DataFrame, weight, most: int, keep: list[str]) -> DataFrame:
    """(block, i, j, *keep): blocks over `most` are dealt into parts of half of it, and a member goes to each cell of its part with another, so no cell holds much more than `most`.

    Joined members get parts of their own after the others', and no cells among these. A block of joined members has none.
    """
    free = F.when(~F.col("joined"), weight).otherwise(0)
    sized = members.groupBy("block").agg(F.sum(free).alias("free"), F.sum(weight).alias("total"), F.count("*").alias("members")).filter("members > 1 and free > 0")
    one = F.col("total") <= most
    sized = sized.select("block", F.when(one, 1).otherwise(F.ceil(2 * F.col("free") / most)).cast("int").alias("parts"), F.when(one, 0).otherwise(F.ceil(2 * (F.col("total") - F.col("free")) / most)).cast("int").alias("more"))
    sized = materialize(sized)  # written, so that the join can split hot blocks
    apart = F.col("joined") & (F.col("more") > 0)
    hashed = F.xxhash64("rep")
    part = F.when(apart, F.col("parts") + F.pmod(hashed, F.greatest("more", F.lit(1)))).otherwise(F.pmod(hashed, F.col("parts")))
    others = F.when(apart, F.col("parts")).otherwise(F.col("parts") + F.col("more"))
    dealt = members.join(sized, "block").withColumn("part", part.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return dealt.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), *keep)


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [g.tobytes() for g in shingle_sets(*bytes_of(batch.column("body")), width)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(bodies, pa.binary())], ["rep", "body"])

    return run


def _sets_of(body: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, body): the whole sets of the wanted reps, each from its class's picked row. Repeated rows without an id are folded before they move."""
    picked = classes.join(wanted.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("pick.doc_id").alias("p_id"), F.col("pick.key").alias("p_key"))
    picked = materialize(picked)
    if picked.count() <= MOST_PICKED:  # a checked size: the texts stay where they are
        picked = F.broadcast(picked)
    rows = body.join(picked, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("key") == F.col("p_key"))).select("rep", "body")
    return rows.mapInArrow(_full_sets(width), "rep long, body binary").dropDuplicates(["rep"])


def _pivot_links(num: int, den: int):
    """Batches sorted by block and part, the pivot first, to the links (block, a, b, alike) of members with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot, first = None, None, None
        for batch in batches:
            links = []
            for block, part, rep, body in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "rep", "body"))):
                grams = np.frombuffer(body, np.uint64)
                if (block, part) != key:
                    key, pivot, first = (block, part), rep, grams
                elif rep != pivot:
                    at = np.minimum(np.searchsorted(first, grams), len(first) - 1)
                    shared, both = int((first[at] == grams).sum()), len(first) + len(grams)
                    if (num + den) * shared >= num * both:
                        links.append((block, rep, pivot, shared / both))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], kind) for k, kind in enumerate(kinds)], ["block", "a", "b", "alike"])

    return run


def join_to_pivots(blocks: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, over: int = CELL_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(block, rep, n, joined) for all members, and the links found on the way, if there are blocks with more than `over` members.

    `sets_of` gives the (rep, body) of the reps in a table. A member that is alike to a pivot leaves the rounds; `joined` then says whether all links together put it into the
    component of its block's first pivot.
    """
    members = blocks.join(classes.select("member", "rep", "n"), "member").select("block", "rep", "n")
    buckets = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hubs, links, free = None, None, members
    for _ in range(PIVOT_ROUNDS):
        parts = F.ceil(F.col("free") / CELL_ROWS).cast("int").alias("parts")
        large = free.groupBy("block").agg(F.count("*").alias("free"), F.min(F.struct("n", "rep"))["rep"].alias("pivot")).filter(F.col("free") > over).select("block", parts, "pivot")
        if links is not None:  # what was most alike to the pivot before is closer to the middle of its family
            fresh = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
            middle = fresh.groupBy("block").agg(F.max_by("a", F.struct("alike", "a")).alias("next"))
            large = large.join(middle, "block").select("block", "parts", F.col("next").alias("pivot"))
        pivots = materialize(large)
        if pivots.isEmpty():
            break
        hubs = pivots.select("block", F.col("pivot").alias("hub")) if hubs is None else hubs
        chosen = materialize(free.join(pivots.select("block"), "block").groupBy("rep").agg(F.min("block").alias("block")))  # one pivot for each member
        mine = chosen.join(pivots, "block").select("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "rep")
        heads = pivots.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("pivot").alias("rep"))
        faced = materialize(mine.unionByName(heads))
        dealt = faced.join(sets_of(faced), "rep").repartition(buckets, "block", "part").sortWithinPartitions("block", "part", "role", "rep")
        found = materialize(dealt.select("block", "part", "rep", "body").mapInArrow(_pivot_links(num, den), "block long, a long, b long, alike double"))
        links = found if links is None else links.unionByName(found)
        free = members.join(links.select(F.col("a").alias("rep")).distinct(), "rep", "left_anti")
    if hubs is None:
        return members.withColumn("joined", F.lit(False)), None
    labels = components(links)
    homes = materialize(hubs.join(labels.withColumnRenamed("v", "hub"), "hub", "left").select("block", F.coalesce("component", "hub").alias("home")))
    named = members.join(labels.withColumnRenamed("v", "rep"), "rep", "left").join(homes, "block", "left")
    return materialize(named.select("block", "rep", "n", F.coalesce(F.coalesce("component", "rep") == F.col("home"), F.lit(False)).alias("joined"))), links.select("a", "b")


class Trie:
    """Sets as sorted id sequences in a path-compressed trie, laid out level by level."""

    def __init__(self, rows: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">i4").tobytes())
        self.order, self.sizes = np.array(order), sizes[order]
        rows = [rows[i] for i in order]
        common = [0] * (len(rows) + 1)
        for i in range(1, len(rows)):
            a, b = rows[i - 1], rows[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common[i] = int(differ[0]) if len(differ) else n
        self.rows, self.levels = rows, []
        spans = [(0, len(rows), 0, -1)]  # leaves lo to hi share the first depth ids
        while spans:
            nodes, below = [], []
            for lo, hi, depth, parent in spans:
                if hi - lo == 1:
                    end = len(rows[lo])
                else:
                    end = min(common[lo + 1 : hi])
                nodes.append((lo, hi, depth, end, parent))
                if hi - lo > 1:
                    cuts = [lo, *(i for i in range(lo + 1, hi) if common[i] == end), hi]
                    for a, b in zip(cuts, cuts[1:]):
                        below.append((a, b, end, len(nodes) - 1))
            lo, hi, start, end, parent = map(np.array, zip(*nodes))
            ids = [rows[a][s:e] for a, _, s, e, _ in nodes]
            self.levels.append((lo, hi, end, parent, np.concatenate(ids), np.cumsum([0, *map(len, ids)])))
            spans = below

    def links(self, num: int, den: int) -> Iterator[tuple[int, int]]:
        """All pairs of leaves (positions in the given list) with num / den similarity or more."""
        width = max((int(r.max()) + 1 for r in self.rows if len(r)), default=1)
        member = np.zeros(width, np.int32)
        # a leaf of n_y grams, r_y of them in its row, can still reach overlap got + r_y - depth; this is the best of a subtree's leaves
        reach = (num + den) * np.array([len(r) for r in self.rows]) - num * self.sizes
        best = [np.array([reach[a:b].max() for a, b in zip(level[0], level[1])]) for level in self.levels]
        for i, row in enumerate(self.rows[:-1]):
            member[row] = 1
            n = int(self.sizes[i])
            overlap, alive = None, None
            for (lo, hi, depth, parent, ids, at), most in zip(self.levels, best):
                keep = hi > i + 1
                if alive is not None:
                    keep &= alive[parent]
                if not keep.any():
                    break
                run = np.concatenate(([0], np.cumsum(member[ids])))
                got = run[at[1:]] - run[at[:-1]]
                if overlap is not None:
                    got = got + overlap[parent]
                alive = keep & ((num + den) * (got - depth) + most >= num * n)
                leaf = alive & (hi - lo == 1) & (lo > i)
                for k in np.flatnonzero(leaf):
                    if (num + den) * int(got[k]) >= num * (n + int(self.sizes[lo[k]])):
                        yield int(self.order[i]), int(self.order[lo[k]])
                overlap = got
            member[row] = 0


def set_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the given sets, as positions."""
    if len(sets) < 2:
        return []
    grams, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ids = np.empty(len(grams), np.int32)
    ids[np.lexsort((grams, -counts))] = np.arange(len(grams), dtype=np.int32)
    ends = np.cumsum([len(s) for s in sets])
    local = ids[inverse]
    shared = counts[inverse] > 1
    rows = [np.sort(local[e - len(s) : e][shared[e - len(s) : e]]) for s, e in zip(sets, ends)]
    top = list(range(len(sets)))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    forest = []
    for a, b in Trie(rows, np.array([len(s) for s in sets])).links(num, den):
        ra, rb = root(a), root(b)
        if ra != rb:
            top[max(ra, rb)] = min(ra, rb)
            forest.append((a, b))
    return forest


def _cell_links(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def out() -> pa.RecordBatch:
            found = set_links(sets, num, den)
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:  # sorted by block and cell
            for block, i, j, rep, body in zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j", "rep", "body"))):
                if (block, i, j) != key:
                    if len(ids) > 1:
                        yield out()
                    key, ids, sets = (block, i, j), [], []
                ids.append(rep)
                sets.append(np.frombuffer(body, np.uint64))
        if len(ids) > 1:
            yield out()

    return run


def components(links: DataFrame) -> DataFrame:
    """(v, component): the smallest id reachable by links (a, b). Rounds end when no label changes."""
    edges = materialize(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("r")).filter("x <> r").distinct())
    labels = materialize(edges.select(F.col("x").alias("v")).union(edges.select("r")).distinct().withColumn("label", F.col("v")))
    while True:
        down = edges.join(labels.withColumnRenamed("v", "r"), "r").select(F.col("x").alias("v"), "label")
        up = edges.join(labels.withColumnRenamed("v", "x"), "x").select(F.col("r").alias("v"), "label")
        heard = labels.union(down).union(up).groupBy("v").agg(F.min("label").alias("label"))
        jump = materialize(heard)
        jumped = jump.join(jump.select(F.col("v").alias("label"), F.col("label").alias("further")), "label", "left")
        fresh = materialize(jumped.select("v", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = fresh.join(labels.withColumnRenamed("label", "old"), "v").filter("label <> old").limit(1).count()
        labels = fresh
        if not changed:
            return labels.select("v", F.col("label").alias("component"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows (gram, n) with the highest counts, as many whole levels of n as stay within `most` rows. A histogram finds the level; nothing is sorted."""
    level = F.floor(F.log2("n") * 16)
    kept, cut = 0, None
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.level):  # at most 16 * 63 levels
        kept += row.rows
        if kept > most:
            break
        cut = row.level
    return counts.filter(level >= cut) if cut is not None else counts.limit(0)


def _grouped(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row's doc_id, key, n and sig; every non-empty class's sig, component, pick (doc_id, key of one of its rows) and least doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    body = _input(docs)
    summary = materialize(body.mapInArrow(_summaries(width), "doc_id long, key binary, n int, sig binary, sketch binary, grams array<long>, counts array<long>"))
    rows = summary.filter("sig is not null").select("doc_id", "key", "n", "sig")
    often = summary.filter("sig is null").select(F.explode(F.arrays_zip("grams", "counts")).alias("g")).groupBy(F.col("g.grams").alias("gram")).agg(F.sum("g.counts").alias("n"))
    top = most_frequent(materialize(often), HEAVY_KEPT).collect()  # bounded: only orders the grams
    top.sort(key=lambda r: (-r.n, r.gram))
    known = np.array([r.gram for r in top], np.int64).view(np.uint64)
    by_value = np.argsort(known)
    rank = (len(known) - np.arange(len(known)))[by_value]
    heavy = spark.sparkContext.broadcast((known[by_value], rank))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = body.mapInArrow(_prefixes(width, num, den, buckets, heavy), "bucket int, grams binary, sets binary, sizes binary")
    blocks = materialize(packed.repartition(buckets, "bucket").mapInArrow(_blocks(num, den), "block long, member long").distinct())
    first_long = F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")
    worded = summary.filter("sig is not null and n > 0")
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    classes = worded.groupBy("sig").agg(pick.alias("pick"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("member", first_long).withColumn("rep", F.monotonically_increasing_id()))  # numbers count once they are written
    members, first_links = join_to_pivots(blocks, classes, lambda wanted: _sets_of(body, classes, wanted, width), num, den)
    sifted = _cells(members, F.lit(1), CELL_ROWS, ["rep", "joined"]).join(classes.select("rep", "n", "sketch"), "rep")
    sifted = sifted.repartition(buckets, "block", "i", "j").sortWithinPartitions("block", "i", "j", "rep").mapInArrow(_sift(num, den), "block long, rep long, n long, joined boolean")
    possible = materialize(sifted.distinct())
    sets = materialize(_sets_of(body, classes, possible, width))
    filled = _cells(possible, F.greatest("n", F.lit(CELL_GRAMS // CELL_ROWS)), CELL_GRAMS, ["rep"]).join(sets, "rep")
    links = filled.repartition(buckets, "block", "i", "j").sortWithinPartitions("block", "i", "j", "rep").mapInArrow(_cell_links(num, den), "a long, b long")
    merged = components(links if first_links is None else links.unionByName(first_links))
    named = classes.join(merged.withColumnRenamed("v", "rep"), "rep", "left").select("sig", "pick", F.coalesce("component", "rep").alias("component"))
    return rows, materialize(named)


def similar_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links of similarity num / den or more."""
    rows, classes = _grouped(docs, width, num, den)
    least = classes.groupBy("component").agg(F.min("pick.doc_id").alias("least"))
    named = materialize(classes.join(least, "component").select("sig", "least"))
    return rows.join(named, "sig", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_per_component(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns stay, whatever their names.

    A group of rows without doc_id keeps the one whose text has the smallest key. Of rows repeated as a whole one
    stays. Texts without words link with nothing, and all of them stay.
    """
    rows, classes = _grouped(docs, width, num, den)
    k_id, k_key, k_copy, w_id, w_key = unused(docs, "k_id", "k_key", "k_copy", "w_id", "w_key")
    chosen = materialize(classes.groupBy("component").agg(F.min("pick").alias("pick")).select(F.col("pick.doc_id").alias(w_id), F.col("pick.key").alias(w_key)))
    again = rows.groupBy("doc_id", "key").count().filter("count > 1").select(F.col("doc_id").alias("a_id"), F.col("key").alias("a_key"))
    marked = chosen.join(again, (F.col(w_key) == F.col("a_key")) & F.col(w_id).eqNullSafe(F.col("a_id")), "left")
    chosen = materialize(marked.select(w_id, w_key, F.col("a_key").isNotNull().alias(k_copy)))
    keyed = docs.withColumns({k_id: F.col("doc_id").cast("long"), k_key: text_key()})
    bare = keyed.filter(~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    kept = keyed.join(chosen, F.col(k_id).eqNullSafe(F.col(w_id)) & (F.col(k_key) == F.col(w_key)))
    once = kept.filter(~F.col(k_copy)).unionByName(kept.filter(k_copy).dropDuplicates([k_id, k_key]))
    return once.select(*map(_quoted, docs.columns)).unionByName(bare.select(*map(_quoted, docs.columns)))


def _quoted(name: str) -> str:
    return f"`{name}`"


#: Overlaps of all pairs that share a shingle, and labels that settle on the smallest document.
ORACLE_SQL = r"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) AS g FROM worded, unnest(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) t(i)),
sizes AS MATERIALIZED (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN grams USING (doc_id) GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes u ON u.doc_id = y WHERE 100 * o >= 85 * (s.n + u.n - o)),
label(v, c) USING KEY (v) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT l.y, min(a.c) FROM label a JOIN links l ON l.x = a.v JOIN recurring.label r ON r.v = l.y WHERE a.c < r.c GROUP BY 1)
SELECT doc_id, n AS n_shingles, c AS component_id FROM sizes JOIN label ON v = doc_id"""


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


ship(__name__)
