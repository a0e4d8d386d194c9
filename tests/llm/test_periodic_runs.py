"""Runs by recompression against plain loops, the grammar itself, and the operator's edge cases."""

import hashlib
import re

import numpy as np
import pytest

from tests.llm.test_llm_operators import SCHEMA, edge_rows
from verdigris.llm import periodic_runs
from verdigris.llm.periodic_runs import Grammar, collapse_runs, find_runs, made_periodic, op12_periodic_runs, runs_of


def plain_runs(words, shortest=6, exponent=4):
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(shortest, exponent * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, length, q) for (s, length), q in out.items())


def some_texts(rng):
    for _ in range(rng.integers(1, 8)):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(0, 120))
        if rng.random() < 0.6 and len(t) > 8:
            p, s = rng.integers(1, max(2, len(t) // 4)), rng.integers(0, len(t) // 2)
            t[s:] = t[s + np.arange(len(t) - s) % p]
        yield t.astype(np.int64)


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_plain_loops(seed):
    rng = np.random.default_rng(seed)
    for shortest, exponent in ((6, 4), (2, 2), (9, 3)):
        texts = list(some_texts(rng))
        found = [[] for _ in texts]
        for t, *run in zip(*runs_of(texts, shortest, exponent)):
            found[t].append(tuple(map(int, run)))
        assert found == [plain_runs(list(t), shortest, exponent) for t in texts]


@pytest.mark.parametrize("seed", range(10))
def test_grammar_extends_and_expands_exactly(seed):
    rng = np.random.default_rng(seed)
    texts = [*some_texts(rng), rng.integers(0, 3, 300), np.zeros(100, np.int64)]
    words, walls = [1000], [True]
    for k, t in enumerate(texts):
        words += [*t, 1001 + k]
        walls += [False] * len(t) + [True]
    words, walls = np.array(words), np.array(walls)
    grammar = Grammar(words, walls)
    assert not (~walls[:-1] & ~walls[1:]).any() or len(grammar.blocks) > 0
    inner = np.flatnonzero(~walls)
    i, j = rng.choice(inner, 500), rng.choice(inner, 500)
    i, j = i[i != j], j[i != j]
    ahead, behind = grammar.common(i, j), grammar.mirrored().common(len(words) - i, len(words) - j)
    for a, b, f, g in zip(i, j, ahead, behind):
        n = 0
        while words[a + n] == words[b + n]:
            n += 1
        assert n == f
        n = 0
        while words[a - n - 1] == words[b - n - 1]:
            n += 1
        assert n == g
    rule = {first + k: (block, a, b) for (first, left, right), block in zip(grammar.rules, grammar.blocks) for k, (a, b) in enumerate(zip(left.tolist(), right.tolist()))}

    def expand(symbol):
        if symbol not in rule:
            return [symbol]
        block, a, b = rule[symbol]
        return expand(a) * b if block else expand(a) + expand(b)

    assert [w for s in grammar.symbols[-1].tolist() for w in expand(s)] == words.tolist()
    assert len(rule) == sum(len(r[1]) for r in grammar.rules)


def test_a_long_text_of_one_word_and_a_long_periodic_one():
    stretch = np.arange(5000)
    texts = [np.zeros(200_000, np.int64), np.tile(stretch, 40), np.arange(300_000)]
    assert [tuple(map(int, r)) for r in zip(*runs_of(texts))] == [(0, 0, 200_000, 1), (1, 0, 200_000, 5000)]


def test_query_and_library_on_awkward_rows(spark, tmp_path):
    noisy = "la la la la la la la so we sing do re do re do re do re do"
    rows = edge_rows() + [(i, noisy, "en", "s1", None, 0.1, "s", 1, "k") for i in range(900, 960)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for row in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")
        at = made_periodic(row[0], len(words))
        words = words if at is None else [words[k] for k in at]
        runs = plain_runs(words) if len(words) < 1000 or at is not None else [tuple(map(int, r[1:])) for r in zip(*runs_of([periodic_runs.numbered(words)]))]
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        text = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((row[0], len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert any(made_periodic(r[0], 19) is not None for r in rows)
    runs = find_runs(docs.filter("doc_id = 901")).collect()
    assert [(r.start, r.length, r.period, r.repeated) for r in runs] == [(0, 7, 1, "la"), (10, 9, 2, "do re")]
    calm = collapse_runs(docs)
    assert calm.columns == docs.columns and calm.count() == len(rows)
    assert {r.text for r in calm.filter("doc_id between 900 and 959").collect()} == {"la so we sing do re"}
    assert calm.filter("doc_id = 3").first().text is None


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_periodic_runs(spark, str(tmp_path)).count() == 0 and find_runs(none).count() == 0 and collapse_runs(none).count() == 0
