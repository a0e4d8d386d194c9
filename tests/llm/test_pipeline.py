"""The pipeline against a brute-force version of every stage."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_llm_operators import VOCABULARY, brute_components, brute_leaks, key, plain_score, prose
from verdigris.llm import mixture, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic documents, families of near copies, exact copies, benchmark passages, null and empty texts, rows without id, and a hot source."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(21)
    bench = [(i, prose(14, 700 + i)) for i in range(6)]
    rows, labels = [], []
    for i in range(240):
        words = prose(int(rng.integers(12, 60)), 1000 + i).split()
        if i % 12 == 5:
            words = str(rows[i - 1][1] or "").split() or words
            words = [*words, "again"] if i % 24 == 5 else words
        toxic = i % 5 == 2
        if toxic:
            words[int(rng.integers(0, len(words)))] = str(rng.choice(["nastytoken", "vilewordx"]))
        if i % 17 == 3:
            words += bench[i % 6][1].split()
        text = None if i == 60 else "" if i == 61 else " ".join(words)
        rows.append((i if i % 40 else None, text, "en", "hot" if i % 3 == 0 else f"s{i % 4}" if i % 7 else None, 0))
        labels.append((i, 1, int(toxic)))
    rows.append(rows[10])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: (key(r[0]), str(r[1:])))


def duck(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return [dict(zip(names, r)) for r in rel.fetchall()]


def test_every_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    everything = rows_of(docs)
    model = toxicity.fit_classifier(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    scores = {r: plain_score(model, r[1]) for r in everything}
    cut = model.thresholds.get("en", toxicity.CUT)
    assert all(abs(s - cut) > 1e-4 for s in scores.values())
    wanted = [r for r in everything if scores[r] < cut]
    assert by_key(rows_of(clean)) == by_key(wanted) and 150 < len(wanted) < 215

    groups = {}
    for (k, _, c), row in zip(brute_components([(i, r[1]) for i, r in enumerate(wanted)], 5, 4, 5), wanted):
        groups.setdefault(c if (row[1] or "").strip() else ("bare", k), []).append(row)
    single = stages["ngram_join"](spark, clean, folder)
    kept = rows_of(single)
    assert len(kept) == len(groups)
    for own in groups.values():
        named = sorted(r[0] for r in own if r[0] is not None)
        stays = [r for r in kept if r in own]
        assert len(stays) == 1 and (not named or stays[0][0] == named[0])

    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    held = {i for i, _ in brute_leaks([(i, r[1]) for i, r in enumerate(kept)], bench)}
    free = stages["decontamination"](spark, single, folder)
    assert by_key(rows_of(free)) == by_key([r for i, r in enumerate(kept) if i not in held]) and len(held) >= 5

    before = rows_of(free)
    mixed = stages["mixing"](spark, free, folder)
    take = {(r["doc_id"], r["size"]): r["taken"] for r in duck(before, mixture.ORACLE_SQL)}
    copies = []
    for r in before:
        n = len((r[1] or "").split())
        copies += [r] * (int(take[r[0], n] / n + 0.5) if n else 0)
    assert by_key(rows_of(mixed)) == by_key(copies)

    final = rows_of(mixed)
    found = [(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot) for r in stages["sharding"](spark, mixed, folder).collect()]
    names = ("doc_id", "size", "text_crc32", "law", "shard", "slot")
    assert sorted(found, key=str) == sorted((tuple(r[n] for n in names) for r in duck(final, sharding.ORACLE_SQL)), key=str)


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and {"shard", "slot", "size"} <= set(out.columns)
    rows = out.collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, rows)) == sorted(str(r) for r in docs.collect()) and 60 < len({r.text for r in rows}) < 200
    assert all(zlib.crc32(r.text.encode()) == r.text_crc32 for r in rows)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert len(VOCABULARY) == 400 and [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
