"""Ranked search against plain scoring of every document, over blocks and query blocks of any size, and edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_llm_operators import LOWER, SCHEMA, edge_rows, prose
from verdigris.llm import lexical_search
from verdigris.llm.lexical_search import build_index, op11_lexical_search, search, search_block

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_search(rows, items, k):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, words = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, c, n in docs:
            m = 100 - 25 + 25 * n * total // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if unnamed else doc, -s) for r, (s, unnamed, doc) in enumerate(sorted(scored)[:k])]
    return out


ITEMS = [(1, prose(30, 1)), (2, prose(8, 2) + " " + prose(8, 2)), (3, None), (4, ""), (5, "zzz unknown"), (6, "One one ONE ä€😀"), (6, "one"), (7, prose(600, 4)), (1, prose(30, 1))]


@pytest.mark.parametrize("block,query_bytes,k", [(4 << 20, 8 << 20, 20), (300, 8 << 20, 3), (2000, 1500, 20)])
def test_search_equals_plain_scoring(spark, monkeypatch, block, query_bytes, k):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", query_bytes)
    rows = [(r[0], r[1]) for r in edge_rows()] + [(1000 + i, prose(int(5 + i % 90), i)) for i in range(400)] + [(2000 + i, "one two") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = search(build_index(docs), spark.createDataFrame(ITEMS, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_search(rows, ITEMS, k)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_blocks_skip_only_what_is_below_the_bar():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, lists, full = int(rng.integers(1, 200)), [], Counter()
        for _ in range(rng.integers(1, 12)):
            docs = np.flatnonzero(rng.random(n) < rng.random() ** 3).astype(np.int32)
            if len(docs):
                given = rng.integers(0, 1000, len(docs))
                lists.append((docs, given, int(given.max())))
                full.update(dict(zip(docs.tolist(), given.tolist())))
        if lists:
            bar = int(rng.integers(1, 4000))
            docs, scores = search_block(lists, n, bar)
            got = {d: s for d, s in zip(docs.tolist(), scores.tolist()) if s >= bar}
            assert got == {d: s for d, s in full.items() if s >= bar}
            assert (np.diff(docs) > 0).all()


def test_long_lists_are_probed_and_not_read(monkeypatch):
    """With a bar that only documents of the rare term reach, the common list isn't walked."""
    common = (np.arange(100_000, dtype=np.int32), np.ones(100_000, np.int64), 1)
    rare = (np.array([5, 70_000], np.int32), np.array([50, 60]), 60)
    docs, scores = search_block([common, rare], 100_000, 40)
    assert docs.tolist() == [5, 70_000] and scores.tolist() == [51, 61]
    assert search_block([common, rare], 100_000, 62)[0].tolist() == []


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "one", 5)], "item_id int, text string, score int")
    assert search(build_index(none), items).collect() == []
    docs = spark.createDataFrame([(3, "One, two", 1, 2), (4, None, 1, 2)], "doc_id int, text string, query int, rank int")
    assert search(build_index(docs), items.limit(0)).collect() == []
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op11_lexical_search(spark, str(tmp_path))
    assert [(r.item_id, r["rank"], r.doc_id) for r in got.collect()] == [(1, 1, 3)] and got.schema["item_id"].dataType.simpleString() == "int"
