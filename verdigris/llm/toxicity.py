"""Toxicity: a convolutional text classifier trained in numpy and applied by Spark.

A word is the sum of hashed embeddings: the whole word and its prefixes of a
few lengths. Filters of several widths slide over the words; each filter's
maximum over the whole text feeds a logistic unit. The model is trained on the
driver from a bounded sample of labelled rows (`sample_rows`, at most
`sample_chars` characters each) and applied to every document by a pandas UDF.

Null and empty texts, and texts without words, get the score that the bias
gives. Repeated rows score alike. A labels table without both classes gives a
constant score below every threshold. Other columns of the input are never read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm._shared import ship, small_batches, table

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7, 8)
BUCKETS = 1 << 24
WIDTHS = (1, 2, 3)
DIM = 12
FILTERS = 8
CUT = 0.7


def word_features(word: str) -> list[int]:
    """Hash buckets of a word and of its prefixes."""
    return [zlib.crc32(b"w" + word.encode("utf-8", "replace")) % BUCKETS] + [
        zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "replace")) % BUCKETS for n in PREFIXES if len(word) >= n
    ]


@dataclass
class TextCNN:
    """Embedding rows exist for the sorted buckets `known` only; row 0 is zero and stands for all others."""

    known: np.ndarray
    emb: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Embedding rows per word, padded with row 0."""
        found = np.zeros((len(words), 1 + len(PREFIXES)), dtype=np.int32)
        if len(self.known) and words:
            feats = [word_features(w) for w in words]
            flat = np.array([b for f in feats for b in f], dtype=np.int64)
            at = np.searchsorted(self.known, flat)
            hit = self.known[np.minimum(at, len(self.known) - 1)] == flat
            row = np.where(hit, at + 1, 0)
            lens = np.array([len(f) for f in feats])
            start = np.concatenate(([0], np.cumsum(lens)[:-1]))
            owner = np.repeat(np.arange(len(words)), lens)
            found[owner, np.arange(len(flat)) - start[owner]] = row
        return found

    def score_texts(self, texts: list[str]) -> np.ndarray:
        """Calibrated scores; each text is read whole, a slice of documents at a time."""
        slot: dict[str, int] = {}
        ids, lens = [], []
        for t in texts:
            words = WORD.findall((t or "").lower())
            ids.extend([slot.setdefault(w, len(slot)) for w in words])
            lens.append(len(words))
        vectors = self.emb[self.rows_of(list(slot))].sum(1) if slot else np.zeros((0, DIM), np.float32)
        ids_a = np.array(ids, dtype=np.int64)
        ends = np.cumsum(lens)
        pooled = np.zeros((len(texts), FILTERS * len(WIDTHS)), dtype=np.float32)
        for k, width in enumerate(WIDTHS):
            parts = [vectors @ self.filters[width][o] for o in range(width)]
            for i, (end, n) in enumerate(zip(ends, lens)):
                if n:
                    own = ids_a[end - n : end]
                    z = parts[0][own]
                    for o in range(1, width):
                        z[: n - o] += parts[o][own[o:]]
                    pooled[i, k * FILTERS : (k + 1) * FILTERS] = np.maximum(z.max(0) + self.bias[width], 0)
        logit = (pooled @ self.out + self.out_bias) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def _vocabulary(texts: list[str], least: int) -> np.ndarray:
    seen: dict[int, int] = {}
    for t in texts:
        for b in {b for w in set(WORD.findall(t.lower())) for b in word_features(w)}:
            seen[b] = seen.get(b, 0) + 1
    return np.array(sorted(b for b, n in seen.items() if n >= least), dtype=np.int64)


def train(texts: list[str], toxic: np.ndarray, langs: list[str | None], seed: int = 7, updates: int = 450, batch: int = 32) -> TextCNN:
    """Fit by Adagrad on four fifths of the rows; scale, shift and thresholds come from the other fifth."""
    rng = np.random.default_rng(seed)
    y = np.asarray(toxic, dtype=np.float32)
    zero = TextCNN(np.zeros(0, np.int64), np.zeros((1, DIM), np.float32), {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS},
                   {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), -3.0)
    if len(texts) < 2 or y.min() == y.max():
        return zero
    order = rng.permutation(len(texts))
    n_val = len(texts) // 5
    val, fit = order[:n_val], order[n_val:]
    if len(val) < 20 or y[val].min() == y[val].max() or y[fit].min() == y[fit].max():
        val = fit = order
    m = zero
    m.known = _vocabulary([texts[i] for i in fit], max(2, len(fit) // 300))
    m.emb = np.concatenate([np.zeros((1, DIM)), rng.normal(0, 0.1, (len(m.known), DIM))]).astype(np.float32)
    for w in WIDTHS:
        m.filters[w] = rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32)
    m.out = rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32) * np.where(np.arange(FILTERS * len(WIDTHS)) % 2, -1, 1).astype(np.float32)
    m.out_bias = 0.0
    slot: dict[str, int] = {}
    docs = [np.array([slot.setdefault(w, len(slot)) for w in WORD.findall(texts[i].lower())], dtype=np.int64) for i in range(len(texts))]
    word_rows = m.rows_of(list(slot))
    grads = {"emb": np.full(m.emb.shape, 1e-6, np.float32), "out": np.full(m.out.shape, 1e-6, np.float32)} | {w: np.full(m.filters[w].shape, 1e-6, np.float32) for w in WIDTHS}
    rate = 0.08
    epochs = -(-updates * batch // max(batch, len(fit)))
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for lo in range(0, len(fit), batch):
            chosen = fit[lo : lo + batch]
            g_filter = {w: np.zeros_like(m.filters[w]) for w in WIDTHS}
            g_out, g_bias = np.zeros_like(m.out), 0.0
            emb_at, emb_by = [], []
            for i in chosen:
                own = docs[i]
                if not len(own):
                    continue
                x = m.emb[word_rows[own]].sum(1)
                pooled, where = [], []
                for w in WIDTHS:
                    z = x @ m.filters[w][0]
                    for o in range(1, w):
                        z[: len(own) - o] += x[o:] @ m.filters[w][o]
                    best = z.argmax(0)
                    top = z[best, np.arange(FILTERS)] + m.bias[w]
                    pooled.append(np.maximum(top, 0))
                    where.append((best, top > 0))
                h = np.concatenate(pooled)
                p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30)))
                d = np.float32(p - y[i])
                g_out += d * h
                g_bias += d
                for k, w in enumerate(WIDTHS):
                    best, on = where[k]
                    back = d * m.out[k * FILTERS : (k + 1) * FILTERS] * on
                    for o in range(w):
                        inside = best + o < len(own)
                        at = np.minimum(best + o, len(own) - 1)
                        b = back * inside
                        g_filter[w][o] += x[at].T * b
                        emb_at.append(own[at])
                        emb_by.append(m.filters[w][o].T * b[:, None])
            if not emb_at:
                continue
            rows = word_rows[np.concatenate(emb_at)]
            g = np.repeat(np.concatenate(emb_by), rows.shape[1], axis=0)
            uniq, back_to = np.unique(rows.ravel(), return_inverse=True)
            total = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(total, back_to, g)
            keep = uniq > 0
            uniq, total = uniq[keep], total[keep]
            grads["emb"][uniq] += total**2
            m.emb[uniq] -= rate * total / np.sqrt(grads["emb"][uniq])
            grads["out"] += g_out**2
            m.out -= rate * 0.5 * g_out / np.sqrt(grads["out"])
            m.out_bias -= 0.02 * float(g_bias) / len(chosen)
            for w in WIDTHS:
                grads[w] += g_filter[w] ** 2
                m.filters[w] -= rate * 0.5 * g_filter[w] / np.sqrt(grads[w])
        rate *= 0.25 ** (1 / epochs)
    raw = m.score_texts([texts[i] for i in val])
    logit = np.log(raw / (1 - raw))
    spread = float(np.std(logit)) or 1.0
    m.scale = min(4.0, 4.0 / spread)
    m.shift = float(np.log(CUT / (1 - CUT))) - m.scale * best_cut(logit, y[val])
    scores = 1 / (1 + np.exp(-np.clip(logit * m.scale + m.shift, -30, 30)))
    for lang in sorted({langs[i] for i in val if langs[i] is not None}):
        own = np.array([j for j, i in enumerate(val) if langs[i] == lang])
        if y[val][own].sum() >= 15:
            m.thresholds[lang] = float(np.clip(best_cut(scores[own], y[val][own]), 0.5, 0.95))
    return m


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The midpoint of the cut with the highest F1; ties go to the widest gap."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    below = np.append(s[1:], s[-1] - 1e-3)
    f1 = np.where(s > below, f1, -1)
    best = f1 >= f1.max() - 1e-9
    k = int(np.argmax(np.where(best, s - below, -1)))
    return float((s[k] + below[k]) / 2)


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_chars: int = 100_000) -> list:
    """At most sample_rows labelled rows, a third of them toxic if there are as many; longer texts than sample_chars aren't trained on."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64(F.lit("sample"), "doc_id")
    toxic = rows.filter("toxic = 1").orderBy(by_hash, "doc_id").limit(sample_rows // 3)
    clean = rows.filter("toxic = 0").orderBy(by_hash, "doc_id").limit(sample_rows - sample_rows // 3)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang")).filter(F.length("text") <= sample_chars)
    return own.join(F.broadcast(toxic.unionByName(clean)), "doc_id").dropDuplicates(["doc_id"]).collect()  # bounded: sample_rows


def fit_classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_chars: int = 100_000) -> TextCNN:
    rows = sorted(training_sample(docs, labels, sample_rows, sample_chars), key=lambda r: r.doc_id)
    return train([r.text for r in rows], np.array([r.toxic for r in rows]), [r.lang for r in rows])


def score_column(spark: SparkSession, model: TextCNN, text: str = "text") -> Column:
    """The model as a column of scores, over whole texts."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = [shared.value.score_texts(texts.iloc[i : i + 64].tolist()) for i in range(0, len(texts), 64)]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    small_batches(spark)
    return score(F.coalesce(F.col(text).cast("string"), F.lit("")))


def threshold_column(docs: DataFrame, model: TextCNN, lang: str = "lang", default: float = CUT) -> Column:
    """The threshold of a row's language; languages with too few labelled rows, and tables without languages, take the default."""
    found = F.lit(default)
    for name, cut in model.thresholds.items() if lang in docs.columns else ():
        found = F.when(F.col(lang) == name, F.lit(cut)).otherwise(found)
    return found


def drop_toxic(docs: DataFrame, model: TextCNN) -> DataFrame:
    """Rows whose score is under their language's threshold; all columns stay."""
    return docs.filter(score_column(docs.sparkSession, model) < threshold_column(docs, model))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_classifier(docs, table(spark, sf_dir, "labels"))
    score = docs.select("doc_id", score_column(spark, model).alias("score"), threshold_column(docs, model).alias("cut"))
    return score.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= F.col("cut")).cast("int").alias("flagged_by_lang"))


ship(__name__)
