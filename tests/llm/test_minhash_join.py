"""The multi-index Hamming join against brute force: its guarantee, its signatures, whole components and edge cases."""

import re

import numpy as np
import pytest

from tests.llm.test_llm_operators import LOWER, SCHEMA, edge_rows, prose
from verdigris.llm import minhash_join
from verdigris.llm.minhash_join import SYMBOLS, chunks_for, confirmed, distance_for, index_keys, minhash_components, signatures


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def plain_components(rows, width, num, den):
    """(doc_id, n_shingles, component_id, kept) of all rows, from all pairs."""
    sets = [shingles(r[1], width) for r in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = (min(ids) if ids else None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return out


@pytest.mark.parametrize("distance", [7, 19, 25])
def test_pairs_within_the_threshold_share_a_key(distance):
    rng, kept = np.random.default_rng(distance), chunks_for(distance)
    a = rng.integers(0, 1 << 16, (400, SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for k in range(len(b)):
        wrong = rng.choice(SYMBOLS, distance, replace=False) if k % 2 else np.arange(k % (SYMBOLS - distance), k % (SYMBOLS - distance) + distance)
        b[k, wrong] += 1
    assert (index_keys(a, kept) == index_keys(b, kept)).any(axis=1).all()
    assert len({k for row in index_keys(a, kept) for k in row.tolist()}) == 400 * len(kept)
    assert sorted({p for places in kept for p in places}) == list(range(SYMBOLS))


def test_distance_follows_similarity():
    rng = np.random.default_rng(5)
    assert distance_for(85, 100) == 25 and distance_for(4, 5) > 25 and distance_for(1, 1) == 0
    for alike in (0.5, 0.85, 0.95):
        away = []
        for _ in range(300):
            n = 200
            shared = round(alike * 2 * n / (1 + alike))
            grams = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
            s = signatures([np.sort(grams[:n]), np.sort(grams[n - shared : 2 * n - shared])])
            away.append((s[0] != s[1]).sum() / SYMBOLS)
        assert abs(np.mean(away) - (1 - alike)) < 0.02
    assert (signatures([np.zeros(0, np.uint64)]) == 0).all()


def test_cells_return_a_spanning_forest():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.append(np.delete(base, rng.choice(300, 8, replace=False)), rng.integers(0, 1 << 63, 8, dtype=np.uint64))) for _ in range(30)] + [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))]
    forest = confirmed(sets, np.zeros(31, bool), 25, 85, 100)
    assert len(forest) == 29 and {x for pair in forest for x in pair} == set(range(30))


def families():
    """Texts with families of all degrees of likeness, chains of versions and a family with a hot hub."""
    rng, rows = np.random.default_rng(11), []
    for f in range(12):
        words = prose(int(rng.integers(5, 200)), 100 + f).split()
        for v in range(12):
            if f % 3 == 0:  # a chain: each from the last one
                words = list(words)
            own = words if f % 3 == 0 else list(words)
            for _ in range(int(rng.integers(0, 1 + len(own) // 40 + f % 2))):
                own[rng.integers(len(own))] = f"w{rng.integers(9999)}"
            rows.append((len(rows) + 100, " ".join(own)))
    return rows


@pytest.mark.parametrize("width,num,den", [(5, 85, 100), (3, 4, 5)])
def test_components_equal_all_pairs(spark, width, num, den):
    rows = [(r[0], r[1]) for r in edge_rows()] + families()
    got = minhash_components(spark.createDataFrame(rows, "doc_id long, text string"), width, num, den)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = plain_components(rows, width, num, den)
    unnamed = lambda r: (r[0], r[1], r[2], r[0] == r[2])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(unnamed, want), key=str)


def test_large_family_is_split_over_cells(spark, monkeypatch):
    """A block of many cells whose members are no copies of one origin: two halves that only a few rows link."""
    monkeypatch.setattr(minhash_join, "SIGNATURE_CELL", 10)
    monkeypatch.setattr(minhash_join, "SET_CELL", 4_000)
    rng, words, rows = np.random.default_rng(4), prose(150, 77).split(), []
    for k in range(70):
        own = list(words)
        own[(2 * k) % 150] = f"x{k}"
        if k % 2:
            own[10:14] = ["p", "q", "r", "s"]
        rows.append((int(rng.integers(10**6)) * 100 + k, " ".join(own)))
    got = minhash_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 85, 100)
    assert sorted(map(tuple, got.collect())) == sorted(plain_components(rows, 5, 85, 100))


def test_empty_and_clashing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert minhash_join.op13_minhash_join(spark, str(tmp_path)).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y"), (3, None, 3, "z")], "doc_id int, text string, rep int, sig string")
    assert sorted(map(tuple, minhash_components(clash).collect())) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
