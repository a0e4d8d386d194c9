"""MinHash near copies by a multi-index Hamming join.

1. One pass gives each document the size of its set of word shingles, a 128-bit digest
   of the set, and a signature: 60 minima under independent hash functions, each cut to
   16 bits. Equal sets form a class, and only classes are compared, so copies cost nothing.
2. Two sets of similarity s differ in a binomial number of the 60 symbols, with chance
   1 - s each. The threshold is the least distance that misses a pair at the wanted
   similarity with a chance under two in ten million (25 at 0.85).
3. The symbols are split into chunks, so many that of any pair within the threshold one
   chunk has at most one error (pigeonhole: 13 chunks of two possible errors at 25). The
   allowed errors are enumerated: a wrong symbol may hold any of 65,536 values, so a key
   leaves its place out and stands for all of them. Each signature has a key for every
   chunk and place left out, and every pair within the threshold shares a key.
4. The classes of a key go into the block of their least class. Members within the threshold
   of it are candidates. The others of a block are dealt into cells that cover every pair of
   its parts, and there the signatures are compared. Only classes with a partner within the
   threshold go on, and their full sets are built once.
5. A block's candidates are judged on their full sets against one pivot first, then against
   the class that was most alike to it; those that links join to the first pivot need no
   judging among each other. The rest is dealt into cells again, where pairs within the
   threshold are confirmed on their full sets. A cell returns a spanning forest of its links.
6. Min-label rounds with pointer jumping give the components.

No key, block or cell is capped. A key with very many classes is split by the join over
tasks, as its least class comes from an aggregate. Null and empty texts, and texts without
words, have an empty set and link with nothing. Repeated rows share a class. A row without
doc_id gets its group's smallest id, or null if none of the group has one; it is kept only
in the second case. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._bytes import bytes_of, mix, shingle_sets
from verdigris.llm._shared import materialize, ship, small_batches, table
from verdigris.llm.ngram_join import _cells, _input, _sets_of, components, join_to_pivots

SYMBOLS = 60
ERRORS = 1
MISS = 2e-7
#: Members of a cell of signatures; grams of a cell of full sets, and the least that a set counts there.
SIGNATURE_CELL = 1_000
SET_CELL = 400_000
LEAST_WEIGHT = 400
_RNG = np.random.default_rng(20250117)
FACTORS = _RNG.integers(1, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)


def distance_for(num: int, den: int, symbols: int = SYMBOLS, miss: float = MISS) -> int:
    """The least number of differing symbols that a pair of similarity num / den exceeds with a chance under `miss`."""
    p, left = 1 - num / den, 1.0
    for d in range(symbols):
        left -= comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
        if left < miss:
            return d
    return symbols


def chunks_for(distance: int, symbols: int = SYMBOLS, errors: int = ERRORS) -> list[tuple[int, ...]]:
    """The places that each key keeps. Of any `distance` wrong places, some chunk has at most `errors`."""
    count = distance // (errors + 1) + 1
    if symbols < count * (errors + 1):
        raise ValueError("too few symbols for this distance")
    cuts = [symbols * k // count for k in range(count + 1)]
    return [kept for lo, hi in zip(cuts, cuts[1:]) for kept in combinations(range(lo, hi), hi - lo - errors)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit symbols for each set; sets without grams have zeros."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    filled = [k for k, s in enumerate(sets) if len(s)]
    if filled:
        grams = (np.concatenate([sets[k] for k in filled]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(sets[k]) for k in filled[:-1])])
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(grams * FACTORS[k] + SHIFTS[k], starts)
            out[filled, k] = (mix(least.astype(np.uint64) + (np.uint64(k + 1) << np.uint64(32))) >> np.uint64(48)).astype(np.uint16)
    return out


def index_keys(marks: np.ndarray, kept: list[tuple[int, ...]]) -> np.ndarray:
    """A row of 64-bit keys for each signature, one key for each tuple of kept places."""
    out = np.empty((len(marks), len(kept)), np.uint64)
    for k, places in enumerate(kept):
        h = np.full(len(marks), k + 1, np.uint64)
        for lo in range(0, len(places), 4):
            packed = np.zeros(len(marks), np.uint64)
            for place in places[lo : lo + 4]:
                packed = packed << np.uint64(16) | marks[:, place].astype(np.uint64)
            h = mix(packed + mix(h))
        out[:, k] = h
    return out


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, marks, held, grams = [], [], [], [], 0
            for own in shingle_sets(*bytes_of(batch.column("body")), width):
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                held.append(own)
                grams += len(own)
                if grams > 300_000:
                    marks += [m.tobytes() for m in signatures(held)]
                    held, grams = [], 0
            marks += [m.tobytes() for m in signatures(held)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "key", "n", "sig", "marks"])

    return run


def _keyed(kept: list[tuple[int, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = index_keys(marks, kept).view(np.int64).ravel()
            reps = np.repeat(batch.column("rep").to_numpy(), len(kept))
            for lo in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 50_000]), pa.array(reps[lo : lo + 50_000])], ["key", "rep"])

    return run


def near_pairs(marks: np.ndarray, sizes: np.ndarray, joined: np.ndarray, distance: int, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row the later rows within the distance whose sizes fit, and their distances; two joined rows are no pair."""
    for i in range(len(marks) - 1):
        away = (marks[i + 1 :] != marks[i]).sum(axis=1)
        fits = (away <= distance) & (den * np.minimum(sizes[i + 1 :], sizes[i]) >= num * np.maximum(sizes[i + 1 :], sizes[i]))
        if joined[i]:
            fits &= ~joined[i + 1 :]
        found = np.flatnonzero(fits)
        yield i, found + i + 1, away[found]


def _groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """(block, rows) of each cell of batches that are sorted by cell."""
    key, rows = None, []
    for batch in batches:
        for block, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j", *columns))):
            if (block, i, j) != key:
                if len(rows) > 1:
                    yield key[0], rows
                key, rows = (block, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield key[0], rows


def _to_head(distance: int, num: int, den: int):
    """Members with their block's signature to (block, rep, n, joined): whether the member is within the distance of the block's head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, head = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("marks", "head_marks"))
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "head_n"))
            fits = ((own != head).sum(axis=1) <= distance) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("rep"), pa.array(n), pa.array(fits)], ["block", "rep", "n", "joined"])

    return run


def _near(distance: int, num: int, den: int):
    """Cells of signatures to the members that have a partner within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches, "rep", "n", "joined", "marks"):
            reps, sizes, joined, marks = zip(*rows)
            sizes, joined = np.array(sizes, np.int64), np.array(joined)
            hit = np.zeros(len(rows), bool)
            for i, others, _ in near_pairs(np.stack([np.frombuffer(m, np.uint16) for m in marks]), sizes, joined, distance, num, den):
                hit[i] |= len(others) > 0
                hit[others] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array([block] * int(hit.sum()), pa.int64()), pa.array(np.array(reps, np.int64)[hit]), pa.array(sizes[hit]), pa.array(joined[hit])], ["block", "rep", "n", "joined"])

    return run


def confirmed(sets: list[np.ndarray], joined: np.ndarray, distance: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets: pairs within the distance, counted on the full sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    grams, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for e, n in zip(ends, sizes)]
    mine, label, forest = np.zeros(len(grams), np.int64), np.arange(len(sets)), []
    for i, others, _ in near_pairs(signatures(sets), sizes, joined, distance, num, den):
        others = others[label[others] != label[i]]
        if len(others):
            mine[own[i]] = 1
            shared = np.add.reduceat(mine[np.concatenate([own[j] for j in others])], np.cumsum(sizes[others]) - sizes[others])
            mine[own[i]] = 0
            for j in others[(num + den) * shared >= num * (sizes[others] + sizes[i])].tolist():
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    forest.append((i, j))
    return forest


def _confirm(distance: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "rep", "joined", "body"):
            reps, joined, bodies = zip(*rows)
            found = confirmed([np.frombuffer(b, np.uint64) for b in bodies], np.array(joined), distance, num, den)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in found], pa.int64()), pa.array([reps[j] for _, j in found], pa.int64())], ["a", "b"])

    return run


def index_blocks(classes: DataFrame, kept: list[tuple[int, ...]]) -> DataFrame:
    """Distinct (block, member): every class that shares a key with others, under the key's least class."""
    keys = classes.select("rep", "marks").mapInArrow(_keyed(kept), "key long, rep long")
    heads = keys.groupBy("key").agg(F.min("rep").alias("block"), F.max("rep").alias("last")).filter("block < last").select("key", "block")
    return keys.join(heads, "key").select("block", F.col("rep").alias("member")).distinct()


def minhash_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links of similarity num / den or more), kept."""
    spark = docs.sparkSession
    small_batches(spark)
    distance = distance_for(num, den)
    body = _input(docs)
    rows = materialize(body.mapInArrow(_signed(width), "doc_id long, key binary, n int, sig binary, marks binary"))
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("pick")
    classes = rows.filter("n > 0").groupBy("sig").agg(pick, F.first("n").alias("n"), F.first("marks").alias("marks"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()).withColumn("member", F.col("rep")))  # numbers count once they are written
    blocks = materialize(index_blocks(classes, chunks_for(distance)))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = classes.select("rep", "n", "marks")
    heads = materialize(blocks.select("block").distinct().join(marks.withColumnsRenamed({"rep": "block", "n": "head_n", "marks": "head_marks"}), "block"))
    faced = blocks.filter("member <> block").withColumnRenamed("member", "rep").join(marks, "rep").join(heads, "block")
    near_head = materialize(faced.mapInArrow(_to_head(distance, num, den), "block long, rep long, n long, joined boolean"))
    dealt = _cells(near_head, F.lit(1), SIGNATURE_CELL, ["rep", "joined"]).join(marks, "rep")
    dealt = dealt.repartition(buckets, "block", "i", "j").sortWithinPartitions("block", "i", "j", "rep")
    others = dealt.mapInArrow(_near(distance, num, den), "block long, rep long, n long, joined boolean").select("block", "rep")
    met = near_head.filter("joined").select("block", "rep")
    own = met.select("block", F.col("block").alias("rep"))
    possible = materialize(met.unionByName(own).unionByName(others).distinct())
    sets = materialize(_sets_of(body, classes, possible, width))
    blocks = possible.withColumnRenamed("rep", "member")
    members, pivot_links = join_to_pivots(blocks, classes, lambda wanted: sets.join(wanted.select("rep").distinct(), "rep", "left_semi"), num, den, over=1)
    members = materialize(members)
    filled = _cells(members, F.greatest("n", F.lit(LEAST_WEIGHT)), SET_CELL, ["rep", "joined"]).join(sets, "rep")
    filled = filled.repartition(buckets, "block", "i", "j").sortWithinPartitions("block", "i", "j", "rep")
    links = filled.mapInArrow(_confirm(distance, num, den), "a long, b long")
    merged = components(links if pivot_links is None else links.unionByName(pivot_links))
    homes = classes.join(merged.withColumnRenamed("v", "rep"), "rep", "left").select("sig", "pick", F.coalesce("component", "rep").alias("component"))
    homes = materialize(homes)
    least = homes.groupBy("component").agg(F.min("pick.doc_id").alias("least"))
    named = materialize(homes.join(least, "component").select("sig", "least"))
    out = rows.join(named, "sig", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Overlaps of all pairs that share a shingle, and labels that settle on the smallest document.
ORACLE_SQL = r"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM worded, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) t(i)),
sizes AS MATERIALIZED (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN grams USING (doc_id) GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes u ON u.doc_id = y WHERE 100 * o >= 85 * (s.n + u.n - o)),
label(v, c) USING KEY (v) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT l.y, min(a.c) FROM label a JOIN links l ON l.x = a.v JOIN recurring.label r ON r.v = l.y WHERE a.c < r.c GROUP BY 1)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM sizes JOIN label ON v = doc_id"""


def op13_minhash_join(spark, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), width=5, num=85, den=100)


ship(__name__)
