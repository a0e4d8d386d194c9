"""Removal of repeated byte strings by suffix arrays.

A byte goes when a string of LENGTH bytes that covers it also starts anywhere
else in the corpus. Exact, and spread over Spark as follows.

1. Each window of LENGTH bytes has an anchor: the GRAM-byte string in it with the
   least hash (the leftmost of equals). Equal windows have equal anchors, so only
   strings at repeated anchors can repeat. Neighbouring windows with one anchor
   form a segment: their text, at most 2 * LENGTH bytes.
2. Equal segments are folded into one with a count. An anchor with a single
   distinct segment is settled by the count. The distinct segments of all others
   are cut from their documents and sent to the shard of their anchor.
3. A shard sorts the suffixes of its segments by Larsson-Sadakane refinement from
   an eight-byte start, takes common prefixes in the way of Kasai (a prefix is at
   least its left neighbour's less one, so comparisons resume there, a level of
   positions at a time), and marks windows whose run of common prefixes of LENGTH
   has a total count of two or more.
4. An anchor with more text than a shard holds is dealt over several shards. Each
   returns its windows' sorted digests; digest ranges of all these shards are then
   merged by binary search, which marks windows that occur in two of them.
5. Marks join the occurrences, and each document is cut.

Rows are known by 128 bits of doc_id and text, so rows without doc_id stay apart.
Segments are folded by 64-bit hash within a 64-bit anchor. A long text is cut into
pieces of PIECE windows, which overlap by a window's length, so memory doesn't grow
with it. Null and empty texts have nothing to remove; repeated rows repeat each
other. Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._bytes import BYTE_VALUES, bytes_of, mix, powers, slices
from verdigris.llm._shared import materialize, ship, small_batches, table

LENGTH = 200
GRAM = 32
SHARD_BYTES = 2_000_000
PLACE_BITS = np.uint64(28)
#: Windows of one text that are hashed at a time; their bytes stay far below 2 ** PLACE_BITS.
PIECE = 4 << 20


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor hash) of every segment; windows count from the document's start."""
    base = offsets[0]
    own, at = data[base : offsets[-1]], offsets - base
    empty = np.zeros(0, np.int64)
    n = len(own)
    if n < length:
        return empty, empty, empty, empty.view(np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[own] * up, out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    least = ((grams >> PLACE_BITS) << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    width = length - gram + 1
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    place = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    fits = np.zeros(n + 1, np.int64)
    long = np.diff(at) >= length
    np.add.at(fits, at[:-1][long], 1)
    np.add.at(fits, at[1:][long] - length + 1, -1)
    valid = np.cumsum(fits[: n - length + 1]) > 0
    start = valid.copy()
    start[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    start[at[:-1][long]] = True
    first = np.flatnonzero(start)
    closes = valid.copy()
    closes[:-1] &= start[1:] | ~valid[1:]
    last = np.flatnonzero(closes)
    doc = np.searchsorted(at, first, side="right") - 1
    return doc, first - at[doc], last - at[doc], grams[place[first]]


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """Offsets to work on and the windows that lie before them: all documents together, or one long document piece by piece."""
    n = int(offsets[-1] - offsets[0])
    if len(offsets) > 2 or n <= PIECE + length - 1:
        yield offsets, 0
        return
    for start in range(0, n - length + 1, PIECE):
        yield np.array([offsets[0] + start, min(offsets[-1], offsets[0] + start + PIECE + length - 1)]), start


def _occurrences(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("body"))
            view = memoryview(data)
            for lo, hi in slices(offsets):
                for at, skipped in pieces(offsets[lo : hi + 1], length):
                    doc, first, last, anchor = segments(data, at, length, gram)
                    if not len(doc):
                        continue
                    begin, end = (at[doc] + first).tolist(), (at[doc] + last + length).tolist()
                    folded = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin, end)], np.uint64).view(np.int64)
                    places = [pa.array((x + skipped).astype(np.int32)) for x in (first, last)]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(folded), batch.column("key").take(pa.array(lo + doc)), *places], ["anchor", "segment", "key", "first", "last"])

    return run


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the eight-byte words at each position. Only groups that are still tied are sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(words, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = words[order[1:]] != words[order[:-1]]
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))
    tied = ~(fresh & np.append(fresh[1:], True))
    act, h = np.flatnonzero(tied), 8
    while len(act):
        suffix = order[act]
        beyond = suffix + h
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], n - beyond - 1)
        key = rank[suffix] * (2 * n + h + 2) + second + n + h
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[act] = suffix[by]
        fresh = np.ones(len(act), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[order[act]] = np.maximum.accumulate(np.where(fresh, act, 0))
        act = act[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return order, words


def common_prefixes(order: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Per position in `order`, the common prefix with the suffix before it, up to `most`."""
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(n, np.int64)
    padded = np.concatenate([words, np.zeros(most + 16, np.uint64)])

    def extend(at: np.ndarray, known: np.ndarray) -> None:
        keep = before[at] >= 0
        at, length = at[keep], known[keep]
        while len(at):
            differ = padded[at + length] ^ padded[before[at] + length]
            same = (differ == 0) & (length + 8 < most)
            stop = ~same
            d, more = differ[stop], np.zeros(int(stop.sum()), np.int64)
            for j in range(1, 9):
                more += (d >> np.uint64(64 - 8 * j)) == 0
            ends = at[stop]
            prefix[ends] = np.minimum.reduce([length[stop] + more, np.full(len(ends), most), n - ends, n - before[ends]])
            at, length = at[same], length[same] + 8

    step = 64
    extend(np.arange(0, n, step), np.zeros(len(range(0, n, step)), np.int64))
    while step > 1:
        half = step // 2
        at = np.arange(half, n, step)
        extend(at, np.maximum(prefix[at - half] - half, 0))
        step = half
    return prefix[order]


def repeated_windows(texts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """Per text, which of its windows occur twice or more among all texts, each taken `counts` times."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    order, words = suffix_array(text)
    prefix = common_prefixes(order, words, length)
    run = np.cumsum(prefix < length)
    weight = np.zeros(len(text), np.int64)
    ends = np.cumsum([len(t) for t in texts])
    for end, t, c in zip(ends, texts, counts):
        weight[end - len(t) : end - length + 1] = c
    own = weight[order]
    total = np.bincount(run, weights=own, minlength=int(run[-1]) + 1)
    mark = np.zeros(len(text), bool)
    mark[order] = (total[run] >= 2) & (own > 0)
    return [mark[end - len(t) : end - length + 1] for end, t in zip(ends, texts)]


def _ranges(mark: np.ndarray) -> np.ndarray:
    """(start, end) pairs of the runs of True."""
    edge = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).astype(np.int32)


def _cut_segments(length: int):
    """Documents with all their wanted segments to (anchor, segment, n, text). A text comes once, whatever is cut from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, places = batch.column("body"), batch.column("places")
            for row in range(len(batch)):
                body, own = bodies[row].as_buffer(), places[row].values
                wanted = [own.field(c) for c in ("anchor", "segment", "n", "first", "last")]
                for lo in range(0, len(own), 20_000):
                    anchor, segment, n, first, last = (c.slice(lo, 20_000) for c in wanted)
                    texts = [body[a : b + length].to_pybytes() for a, b in zip(first.to_pylist(), last.to_pylist())]
                    yield pa.RecordBatch.from_arrays([anchor, segment, n, pa.array(texts, pa.binary())], ["anchor", "segment", "n", "text"])

    return run


RESULT = "anchor long, segment long, ranges binary, slot int, digests binary, starts binary, marked binary"


def _sort_shards(length: int):
    """Rows sorted by shard to marked ranges per segment; for an anchor dealt over several shards also to sorted digests by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            marks = repeated_windows([r[4] for r in rows], [r[3] for r in rows], length)
            found = [(r[1], r[2], _ranges(m).tobytes()) for r, m in zip(rows, marks) if m.any()]
            none = pa.nulls(len(found), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary()), pa.nulls(len(found), pa.int32()), none, none, none],
                                             ["anchor", "segment", "ranges", "slot", "digests", "starts", "marked"])
            parts = rows[0][0]
            if parts > 1:
                windows = [(xxhash.xxh3_128_digest(t[s : s + length]), seg, s, bool(m[s])) for (_, _, seg, _, t), m in zip(rows, marks) for s in range(len(m))]
                digest = np.array([w[0] for w in windows], "S16")
                owner = np.array([(w[1], w[2]) for w in windows], np.int64)
                marked = np.array([w[3] for w in windows])
                digest, first = np.unique(digest, return_index=True)
                owner, marked = owner[first], marked[first]
                slots = ((np.frombuffer(digest.tobytes(), ">u4").reshape(-1, 4)[:, 0].astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
                out = [[], [], [], [], []]
                for slot in np.unique(slots):
                    mine = slots == slot
                    for c, v in zip(out, (int(slot), digest[mine].tobytes(), owner[mine].tobytes(), marked[mine].tobytes(), rows[0][1])):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[4], pa.int64()), pa.nulls(len(out[0]), pa.int64()), pa.nulls(len(out[0]), pa.binary()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                                                 ["anchor", "segment", "ranges", "slot", "digests", "starts", "marked"])

        for batch in batches:
            for shard, parts, anchor, segment, n, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "parts", "anchor", "segment", "n", "text"))):
                if shard != key:
                    if rows:
                        yield from close()
                    key, rows = shard, []
                rows.append((parts, anchor, segment, n, text))
        if rows:
            yield from close()

    return run


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted digests of several shards, in rows sorted by anchor and slot, to the ranges of windows that two of them hold. A slot is held at a time: about a shard's digests."""
    key, runs = None, []

    def close() -> Iterator[pa.RecordBatch]:
        everything = np.sort(np.concatenate([r[0] for r in runs]))
        for digest, owner, marked in runs:
            often = np.searchsorted(everything, digest, "right") - np.searchsorted(everything, digest, "left") > 1
            new = owner[often & ~marked]
            if len(new):
                ranges = [np.array([[s, s + 1]], np.int32).tobytes() for s in new[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), key[0])), pa.array(new[:, 0].copy()), pa.array(ranges, pa.binary())], ["anchor", "segment", "ranges"])

    for batch in batches:
        for anchor, slot, d, s, m in zip(*(batch.column(c).to_pylist() for c in ("anchor", "slot", "digests", "starts", "marked"))):
            if (anchor, slot) != key:
                if runs:
                    yield from close()
                key, runs = (anchor, slot), []
            runs.append((np.frombuffer(d, "S16"), np.frombuffer(s, np.int64).reshape(-1, 2), np.frombuffer(m, bool)))
    if runs:
        yield from close()


def _removed(length: int):
    """Documents with their marked windows to the digest columns; a window range is (first + start, first + end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            bodies = batch.column("body")
            for i, marks in enumerate(batch.column("marks").to_pylist()):
                body = bodies[i].as_buffer()
                n = len(body)
                kept, spans, removed = [], 0, 0
                pairs = []
                for m in marks or []:
                    settled = m["ranges"] is None  # every window of the segment repeats
                    runs = np.array([[0, m["last"] - m["first"] + 1]]) if settled else np.frombuffer(m["ranges"], np.int32).reshape(-1, 2)
                    pairs.append(runs + m["first"])
                at = 0
                if pairs:
                    runs = np.concatenate(pairs)
                    runs = runs[np.argsort(runs[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(runs[:, 1] + length - 1)
                    begins = np.flatnonzero(np.append(True, runs[1:, 0] > reach[:-1]))
                    ends = np.append(begins[1:], len(runs)) - 1
                    for a, b in zip(runs[begins, 0].tolist(), reach[ends].tolist()):
                        kept.append(body[at:a])
                        removed += b - a
                        spans += 1
                        at = b
                kept.append(body[at:n])
                rest = b"".join(kept)
                for c, v in zip(out, (n, removed, spans, hashlib.sha256(rest).hexdigest(), rest)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) per document."""
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc = F.col("doc_id").cast("long")
    name = F.concat(F.coalesce(doc.cast("string"), F.lit("none")), F.lit("|"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = docs.select(doc.alias("doc_id"), F.unhex(F.md5(name.cast("binary"))).alias("key"), body.alias("body"))
    found = own.filter(F.length("body") >= length).mapInArrow(_occurrences(length, gram), "anchor long, segment long, key binary, first int, last int")
    found = materialize(found)
    # counts are written before they are joined: an aggregate next to the join would keep its hot keys from being split
    often = materialize(found.groupBy("anchor").agg(F.count("*").alias("total")).filter("total > 1").select("anchor"))
    repeated = materialize(found.join(often, "anchor"))
    place = F.struct("key", "first", "last")
    folded = materialize(repeated.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(place).alias("place")))
    kinds = materialize(folded.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("place.last") - F.col("place.first") + length).alias("bytes")))
    mixed = materialize(folded.join(kinds.filter("kinds > 1"), "anchor").select("anchor", "segment", "n", "place.*", "bytes"))
    parts = F.ceil(F.col("bytes") / SHARD_BYTES).cast("int")
    sizes = kinds.filter("kinds > 1").select("anchor", parts.alias("parts"), "bytes")
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = -(-total // SHARD_BYTES) or 1
    places = mixed.groupBy("key").agg(F.collect_list(F.struct("anchor", "segment", "n", "first", "last")).alias("places"))  # no more than a text has windows
    texts = own.join(places, "key").select("body", "places").mapInArrow(_cut_segments(length), "anchor long, segment long, n long, text binary")
    alone = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    dealt = F.xxhash64("anchor", F.pmod(F.xxhash64("segment"), F.col("parts")))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = texts.join(sizes.select("anchor", "parts"), "anchor").withColumn("shard", F.when(F.col("parts") > 1, dealt).otherwise(alone))
    sorted_shards = placed.repartition(buckets, "shard").sortWithinPartitions("shard").mapInArrow(_sort_shards(length), RESULT)
    sorted_shards = materialize(sorted_shards)
    crossing = sorted_shards.filter("slot is not null").select("anchor", "slot", "digests", "starts", "marked")
    crossing = crossing.repartition(buckets, "anchor", "slot").sortWithinPartitions("anchor", "slot").mapInArrow(_merge_shards, "anchor long, segment long, ranges binary")
    marked = sorted_shards.filter("slot is null").select("anchor", "segment", "ranges").unionByName(crossing)
    single = kinds.filter("kinds = 1").select("anchor")
    settled = repeated.join(single, "anchor").select("key", "first", "last", F.lit(None).cast("binary").alias("ranges"))
    judged = repeated.join(marked, ["anchor", "segment"]).select("key", "first", "last", "ranges")
    marks = settled.unionByName(judged).groupBy("key").agg(F.collect_set(F.struct("first", "last", "ranges")).alias("marks"))
    joined = own.join(marks, "key", "left").select("doc_id", "body", "marks")
    return joined.mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: Every window by its hash, then runs of repeated starts and the bytes between them.
ORACLE_SQL = """WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM d, unnest(range(1, octet_length(b) - 198)) t(i)),
again AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CAST(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200 AS INT) AS fresh FROM again)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM runs GROUP BY doc_id, coalesce(run, 0)),
pieces AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, count(*) AS n, sum(z - a + 1) AS gone, max(z) AS last, string_agg(CASE WHEN a > before + 1 THEN hex(b[before + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS head FROM pieces JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || CASE WHEN octet_length(b) > coalesce(last, 0) THEN hex(b[coalesce(last, 0) + 1:octet_length(b)]) ELSE '' END)) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ship(__name__)
