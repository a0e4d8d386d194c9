"""Ranked lexical search: an index by blocks of documents, searched by a hybrid of term-at-a-time and document-at-a-time.

1. One pass over the documents writes the index. A row of it is a block of documents (about
   4 MB of text, one document at least): their ids and lengths, the sorted terms of the
   block, and for each term its documents in order with their counts. Blocks don't depend on
   each other, so a term that stands in every document is spread over all of them.
2. Queries come in blocks that fit a broadcast (by their bytes; one block for any usual set).
   A pass over the index's terms counts in how many documents each query term stands.
3. Another pass searches each index block for each query. The shortest lists, up to an
   eighth of the block's documents together, are summed term at a time into accumulators.
   These become one list that is sorted by document and bounded by its largest sum. It is
   merged document at a time with the long lists: documents come from it, and from the long
   lists without which a document could still reach the query's k-th best score so far;
   the other long lists are only probed at those documents, largest bound first, and a
   document leaves once the bounds of what is left can't lift it to that score.
4. Each task keeps the k best documents of a query over all its blocks. These meet in two
   steps, by query and group of tasks and then by query.

A score is exact and equal for any division into blocks: nothing is capped, ties at the k-th
place go by doc_id, and bounds only skip what is strictly below. Terms go by 64-bit hashes.
Null and empty texts, and texts without terms, aren't counted and are never found. Repeated
documents rank each; a document without doc_id stands behind those of its score. Repeated
queries (equal id and text) count once; a query without known terms finds nothing. Only
doc_id and text, item_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._bytes import bytes_of, slices, word_hashes
from verdigris.llm._shared import materialize, ship, small_batches, table

BLOCK_BYTES = 4 << 20
QUERY_BYTES = 8 << 20
SHORT_SHARE = 8
TASK_GROUP = 256
#: Bytes between terms: of ASCII all but digits and letters.
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
INDEX = "named long, words long, ids binary, unnamed binary, sizes binary, terms binary, starts binary, docs binary, counts binary"


def index_block(ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> tuple:
    """A row of the index for the given documents."""
    hashes, at = word_hashes(data, offsets, BETWEEN)
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    terms, term = np.unique(hashes, return_inverse=True)
    code, counts = np.unique(term * np.int64(max(1, len(sizes))) + doc, return_counts=True)
    term, doc = np.divmod(code, max(1, len(sizes)))
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    unnamed = np.array([i is None for i in ids], bool)
    arrays = (np.array([i or 0 for i in ids], np.int64), unnamed, sizes.astype(np.int64), terms, starts.astype(np.int64), doc.astype(np.int32), counts.astype(np.int32))
    return (int((sizes > 0).sum()), int(sizes.sum()), *(a.tobytes() for a in arrays))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX.split(", ")]
    for batch in batches:
        ids, (data, offsets) = batch.column("doc_id").to_pylist(), bytes_of(batch.column("body"))
        for lo, hi in slices(offsets, BLOCK_BYTES):
            row = index_block(ids[lo:hi], data, offsets[lo : hi + 1])
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k < 2 else pa.binary()) for k, v in enumerate(row)], names)


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of docs (doc_id, text): one row per block of documents."""
    small_batches(docs.sparkSession, rows=4000)
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body")
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), body).mapInArrow(_indexed, INDEX))


def _counted(terms):
    """Index rows to (term, n): the documents of each wanted term, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist()):
                own, starts = np.frombuffer(own, np.uint64), np.frombuffer(starts, np.int64)
                if len(own):
                    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                    total += np.where(own[at] == wanted, starts[at + 1] - starts[at], 0)
        seen = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen].view(np.int64)), pa.array(total[seen])], ["term", "n"])

    return run


class Best:
    """The k best (score, document) of a query so far; equal scores by document id, unnamed ones last."""

    def __init__(self, k: int):
        self.k, self.rows = k, (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    def bar(self) -> int:
        """The score that a further document must reach."""
        return int(self.rows[0][-1]) if len(self.rows[0]) == self.k else 1

    def add(self, scores: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        merged = [np.concatenate(x) for x in zip(self.rows, (scores, unnamed, ids))]
        order = np.lexsort((merged[2], merged[1], -merged[0]))[: self.k]
        self.rows = tuple(x[order] for x in merged)


def search_block(lists: list[tuple[np.ndarray, np.ndarray, int]], documents: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents in order, scores) of all that reach `bar`, and perhaps none else.

    A list has its documents in order, the score that it gives each, and the largest of these.
    """
    lists = sorted(lists, key=lambda x: len(x[0]))
    held, short = 0, 0
    while short < len(lists) and held + len(lists[short][0]) <= max(1, documents // SHORT_SHARE):
        held += len(lists[short][0])
        short += 1
    acc_docs, acc = np.zeros(0, np.int32), np.zeros(0, np.int64)
    if short:  # term at a time
        acc_docs, place = np.unique(np.concatenate([x[0] for x in lists[:short]]), return_inverse=True)
        acc = np.zeros(len(acc_docs), np.int64)
        np.add.at(acc, place, np.concatenate([x[1] for x in lists[:short]]))
    long = sorted(lists[short:], key=lambda x: -x[2])
    left = np.append(np.cumsum([x[2] for x in long][::-1])[::-1], 0).astype(np.int64)  # what the lists from k on can still give
    top = int(acc.max(initial=0))
    if top + int(left[0]) < bar:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    needed = int(np.argmax(left < bar))  # a document only in the lists behind these can't reach the bar
    reach = acc + left[0] >= bar
    found = np.unique(np.concatenate([acc_docs[reach], *(x[0] for x in long[:needed])]))
    scores = np.zeros(len(found), np.int64)
    if len(acc_docs):
        at = np.minimum(np.searchsorted(acc_docs, found), len(acc_docs) - 1)
        scores = np.where(acc_docs[at] == found, acc[at], 0)
    for k, (docs, given, _) in enumerate(long):  # document at a time: probes at the documents that are left
        at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        scores = scores + np.where(docs[at] == found, given[at], 0)
        keep = scores + left[k + 1] >= bar
        if not keep.all():
            found, scores = found[keep], scores[keep]
            if not len(found):
                break
    return found, scores


def _searched(plan, k: int):
    """Index rows to (query, doc_id, score, tasks): the best documents of each query in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, queries, documents, words = plan.value
        best: dict[int, Best] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "unnamed", "sizes", "terms", "starts", "docs", "counts"))):
                kinds = (np.int64, bool, np.int64, np.uint64, np.int64, np.int32, np.int32)
                ids, unnamed, sizes, own, starts, docs, counts = (np.frombuffer(x, kind) for x, kind in zip(row, kinds))
                if not len(own):
                    continue
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                have = np.flatnonzero(own[at] == terms)
                m = 75 + 25 * sizes * documents // words
                lists = {}
                for t in have.tolist():
                    lo, hi = starts[at[t]], starts[at[t] + 1]
                    tf = counts[lo:hi].astype(np.int64)
                    given = weights[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs[lo:hi]]))
                    lists[t] = docs[lo:hi], given, int(given.max())
                for q, wanted in queries:
                    mine = [(lists[t][0], lists[t][1] * n, lists[t][2] * n) if n > 1 else lists[t] for t, n in wanted if t in lists]
                    if mine:
                        kept = best.setdefault(q, Best(k))
                        found, scores = search_block(mine, len(ids), kept.bar())
                        good = scores >= kept.bar()
                        if good.any():
                            kept.add(scores[good], unnamed[found[good]], ids[found[good]])
        group = TaskContext.get().partitionId() // TASK_GROUP if TaskContext.get() else 0
        for q, kept in best.items():
            scores, unnamed, ids = kept.rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=unnamed), pa.array(scores), pa.array(np.full(len(ids), group, np.int32))], ["query", "doc_id", "score", "tasks"])

    return run


def _terms(text: str | None) -> dict[int, int]:
    body = np.frombuffer((text or "").encode(), np.uint8)
    terms, n = np.unique(word_hashes(body, np.array([0, len(body)]), BETWEEN)[0], return_counts=True)
    return dict(zip(terms.tolist(), n.tolist()))


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the index with the highest scores over 0, for each of the items (item_id, text)."""
    spark = index.sparkSession
    small_batches(spark, rows=64, mb=8)
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    items = materialize(items.select("item_id", F.col("text").cast("string").alias("text")).distinct())
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first().n or 0
    parts = 1 + 2 * size // QUERY_BYTES
    totals = index.agg(F.sum("named").alias("documents"), F.sum("words").alias("words")).first()
    out = spark.createDataFrame([], schema)
    for part in range(parts if totals.words else 0):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # a block of queries, bounded by its bytes
        texts = [_terms(r.text) for r in rows]
        terms = np.array(sorted({t for own in texts for t in own}), np.uint64)
        if not len(terms):
            continue
        counts = index.select("terms", "starts").mapInArrow(_counted(spark.sparkContext.broadcast(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        found = {int(np.int64(r.term).view(np.uint64)): r.n for r in counts}
        place = {t: i for i, t in enumerate(terms.tolist())}
        weights = [floor(1000 * log((2 * totals.documents + 2) / (2 * found.get(t, 0) + 1))) for t in terms.tolist()]
        queries = [(q, [(place[t], n) for t, n in own.items() if t in found]) for q, own in enumerate(texts)]
        plan = spark.sparkContext.broadcast((terms, weights, queries, int(totals.documents), int(totals.words)))
        hits = index.select("ids", "unnamed", "sizes", "terms", "starts", "docs", "counts").mapInArrow(_searched(plan, k), "query int, doc_id long, score long, tasks int")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        near = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query", "tasks").orderBy(*order))).filter(F.col("rank") <= k)
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], f"query int, {schema.split(', ')[0]}")
        out = out.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


#: Integer division is //; the weight's logarithm is taken in doubles.
ORACLE_SQL = r"""WITH words AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
asked AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
postings AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM words SEMI JOIN asked USING (t) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY t),
scored AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score FROM asked JOIN weights USING (t) JOIN postings USING (t) JOIN sizes USING (doc_id), totals GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20"""


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ship(__name__)
