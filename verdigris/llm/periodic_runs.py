"""Periodic runs: maximal stretches of repeating words, by recompression.

1. The words of a text get numbers of their own. The texts of a batch stand in one
   sequence with a wall before, between and behind them; walls are all different
   and never merge, so no match crosses a text.
2. Recompression turns the sequence into a run-length grammar. Blocks of one symbol
   become a symbol for (symbol, count); then each symbol falls on the left or on
   the right side, and every left-right pair becomes a symbol for (left, right).
   This goes on until no text has two symbols. Equal blocks and equal pairs get one
   name, found by sorting, so equal symbols stand for equal words and no hash is
   trusted. Every naming shortens the sequence, so all of them sort as many codes
   as there are words.
3. A stretch with period q and length l has l - q places i in a row where the words
   i and i + q are equal. So a grid of step max(6, 4q) - q has a place in every
   stretch that counts. Over all q these are about n * ln(n) / 3 candidates; those
   with unequal words, or without an equal neighbour, go first.
4. The grammar extends the others exactly, forwards and backwards, all of a batch at
   once: a query climbs while whole symbols agree, moves over at most one pair or one
   block a level, and descends where they differ. No suffix array is built.
5. One stretch can be found with several multiples of its period. The least one is
   its smallest period: a stretch of twice a period's length has no others.

Each text is judged as a whole in one row, so there is no shuffle, and a lost task
is run again alone. Memory grows with the longest text (about 40 bytes a byte), not
with the number of texts. Null and empty texts have no words and no runs. A row
without doc_id is treated like any other; the query doesn't make it periodic.
Repeated rows give repeated results. Only doc_id and text are read, whatever other
columns there are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._bytes import mix, slices
from verdigris.llm._shared import ship, small_batches, table, unused

MIN_LENGTH = 6
MIN_EXPONENT = 4
SLICE = 2 << 20
CANDIDATES = 1 << 20


class Grammar:
    """The levels of a sequence's recompression: symbols, where each symbol begins in the level below, and which symbol covers each place of it."""

    def __init__(self, words: np.ndarray, walls: np.ndarray):
        self.symbols, self.starts, self.covers, self.blocks = [words.astype(np.int32)], [], [], []
        self.rules: list[tuple[int, np.ndarray, np.ndarray]] = []  # first new symbol, and of each new one the two halves of its code
        fresh, salt = int(words.max(initial=-1)) + 1, 0
        while True:
            seq = self.symbols[-1]
            again = np.append(False, seq[1:] == seq[:-1])
            if again.any():
                starts = np.flatnonzero(~again)
                counts = np.diff(np.append(starts, len(seq)))
                walls, fresh = self._level(~again, starts, np.flatnonzero(counts > 1), counts[counts > 1], walls, fresh, True)
                seq = self.symbols[-1]
            inner = ~walls[:-1] & ~walls[1:]
            if not inner.any():
                return
            salt += 1
            side = mix(seq.astype(np.uint64) + np.uint64(salt << 32)) >> np.uint64(63) == 1
            rising, falling = ~side[:-1] & side[1:] & inner, side[:-1] & ~side[1:] & inner
            paired = rising if rising.sum() >= falling.sum() else falling
            if paired.any():
                heads = np.append(True, ~paired)
                starts = np.flatnonzero(heads)
                first = np.flatnonzero(np.append(paired, False)[starts])
                walls, fresh = self._level(heads, starts, first, seq[starts[first] + 1], walls, fresh, False)

    def _level(self, heads, starts, named, second, walls, fresh, block):
        seq = self.symbols[-1]
        own = seq[starts]
        codes = own[named].astype(np.int64) << 32 | second.astype(np.int64)
        names, place = np.unique(codes, return_inverse=True)
        self.rules.append((fresh, (names >> 32).astype(np.int32), (names & 0xFFFFFFFF).astype(np.int64)))
        own[named] = fresh + place
        self.symbols.append(own)
        self.starts.append(np.append(starts, len(seq)).astype(np.int32))
        self.covers.append((np.cumsum(heads) - 1).astype(np.int32))
        self.blocks.append(block)
        return walls[starts], fresh + len(names)

    def mirrored(self) -> Grammar:
        """The same grammar read from behind."""
        out = object.__new__(Grammar)
        out.symbols, out.blocks, out.rules = [s[::-1] for s in self.symbols], self.blocks, self.rules
        out.starts = [s[-1] - s[::-1] for s in self.starts]
        out.covers = [c[-1] - c[::-1] for c in self.covers]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols of the first level agree from the places i and j on, for each pair."""
        p, q, top = i.astype(np.int64), j.astype(np.int64), len(self.blocks)
        stop = np.zeros(len(p), np.int32)  # the level on which the symbols differ
        live = np.flatnonzero(self.symbols[0][p] == self.symbols[0][q])
        for k in range(top):  # the symbols at p and q agree on level k
            if not len(live):
                break
            starts, covers, above = self.starts[k], self.covers[k], self.symbols[k + 1]
            a, b = p[live], q[live]
            up, vp = covers[a], covers[b]
            inside = np.flatnonzero((starts[up] != a) | (starts[vp] != b))
            if len(inside):
                a_, b_ = a[inside], b[inside]
                step = np.minimum(starts[up[inside] + 1] - a_, starts[vp[inside] + 1] - b_) if self.blocks[k] else 1
                a[inside], b[inside] = a_ + step, b_ + step
                up[inside], vp[inside] = covers[a[inside]], covers[b[inside]]
            level = (starts[up] == a) & (starts[vp] == b)
            cut = live[~level]
            p[cut], q[cut], stop[cut] = a[~level], b[~level], k
            live, up, vp = live[level], up[level], vp[level]
            p[live], q[live] = up, vp
            differ = above[up] != above[vp]
            stop[live[differ]] = k + 1
            live = live[~differ]
        while len(live):
            p[live] += 1
            q[live] += 1
            stop[live] = top
            live = live[self.symbols[top][p[live]] == self.symbols[top][q[live]]]
        order = np.argsort(-stop, kind="stable")
        ends = np.searchsorted(-stop[order], -np.arange(top + 1), side="right")
        for k in range(int(stop.max(initial=0)), 0, -1):
            now = order[: ends[k]]
            starts, below = self.starts[k - 1], self.symbols[k - 1]
            up, vp = p[now], q[now]
            a, b = starts[up].astype(np.int64), starts[vp].astype(np.int64)
            step = np.minimum(starts[up + 1] - a, starts[vp + 1] - b) if self.blocks[k - 1] else 1
            step = np.where(below[a] == below[b], step, 0)
            p[now], q[now] = a + step, b + step
        return p - i


def _grid(lengths: np.ndarray, shortest: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the candidates, in slices."""
    most = np.where(lengths >= shortest, lengths // exponent, 0)
    text = np.repeat(np.arange(len(lengths)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(shortest, exponent * period) - period
    count = (lengths[text] - 1 - period) // step + 1
    ends = np.cumsum(count)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, side="right")))
        n = count[lo:hi]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[lo:hi], n), place * np.repeat(step[lo:hi], n), np.repeat(period[lo:hi], n)
        lo = hi


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """One of the (text, start, length, period) for each stretch."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))[: len(rows)]]


def runs_of(texts: list[np.ndarray], shortest: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of the given number sequences, by text, start and period."""
    if exponent < 2 or shortest < exponent:
        raise ValueError("a run has two periods at least, and no fewer words than its exponent")
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(lengths + 1) - lengths  # a wall stands before each text and behind the last
    words = np.empty(int(lengths.sum()) + len(texts) + 1, np.int64)
    walls = np.zeros(len(words), bool)
    walls[np.append(base - 1, len(words) - 1)] = True
    words[~walls] = np.concatenate([*texts, np.zeros(0, np.int64)])
    words[walls] = int(words[~walls].max(initial=-1)) + 1 + np.arange(len(texts) + 1)
    found = [np.zeros((0, 4), np.int64)]
    grammar = backward = None
    for text, place, period in _grid(lengths, shortest, exponent):
        i = base[text] + place
        j = i + period
        keep = np.flatnonzero(words[i] == words[j])
        i, j = i[keep], j[keep]
        near = (words[i + 1] == words[j + 1]) | (words[i - 1] == words[j - 1]) | (np.maximum(shortest, exponent * period[keep]) - period[keep] < 2)
        keep, i, j = keep[near], i[near], j[near]
        if not len(i):
            continue
        if grammar is None:
            grammar = Grammar(words, walls)
            backward = grammar.mirrored()
        ahead = grammar.common(i, j)
        behind = backward.common(len(words) - i, len(words) - j)
        start, end, period, text = i - behind, j + ahead, period[keep], text[keep]
        long = end - start >= np.maximum(shortest, exponent * period)
        found.append(_least_periods(np.stack([text[long], start[long] - base[text[long]], (end - start)[long], period[long]], axis=1)))
    rows = _least_periods(np.concatenate(found))
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change)[:n] > 0


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Ranges of rows with their words."""
    bodies = batch.column("body")
    offsets = np.cumsum([0, *(len(x) for x in bodies.to_pylist())]) if len(bodies) else np.zeros(1, np.int64)
    for lo, hi in slices(offsets, SLICE):
        yield lo, hi, [x.split() for x in bodies.slice(lo, hi - lo).to_pylist()]  # bytes split at 20 and 09 to 0D


def _by_text(count: int, text: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    at = np.searchsorted(text, np.arange(count + 1))
    for lo, hi in zip(at, at[1:]):
        yield tuple(c[lo:hi] for c in columns)


def _run_rows(shortest: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, words in _texts(batch):
                text, start, length, period = runs_of([numbered(w) for w in words], shortest, exponent)
                stretch = [b" ".join(words[t][s : s + q]).decode() for t, s, q in zip(text, start, period)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text + lo)), pa.array(start), pa.array(length), pa.array(period), pa.array(stretch, pa.string())], ["doc_id", "start", "length", "period", "repeated"])

    return run


def _body():
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body")


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, start, length, period, repeated): a row for each run of each text; words count from 0, and `repeated` is the run's first period."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _body()).mapInArrow(_run_rows(min_length, min_exponent), "doc_id long, start long, length long, period long, repeated string")


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """All columns of docs, with each run of the text cut to its first period. Texts without runs stay as they are, others have single spaces."""
    small_batches(docs.sparkSession)
    (name,) = unused(docs, "runs_text")

    def collapse(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            bodies = [(t or "").encode() for t in series]
            out = list(series)
            for lo, hi in slices(np.cumsum([0, *map(len, bodies)]), SLICE):
                words = [b.split() for b in bodies[lo:hi]]
                text, *run = runs_of([numbered(w) for w in words], min_length, min_exponent)
                for k, own in enumerate(_by_text(hi - lo, text, *run)):
                    if len(own[0]):
                        keep = np.flatnonzero(~dropped(len(words[k]), *own))
                        out[lo + k] = b" ".join([words[k][x] for x in keep]).decode()
            yield pd.Series(out, dtype=object)

    collapse.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    mend = F.pandas_udf(collapse, "string")
    return docs.withColumn(name, mend(F.col("text").cast("string"))).select(*[F.col(name).alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])


def made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word each of n words becomes in a row that the query makes periodic; None for the other rows."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.append(np.arange(a), a + np.arange(n - a) % p)


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for lo, hi, words in _texts(batch):
            for k in range(hi - lo):
                if (at := made_periodic(ids[lo + k], len(words[k]))) is not None:
                    words[k] = [words[k][x] for x in at]
            rows = []
            text, *run = runs_of([numbered(w) for w in words])
            for k, (start, length, period) in enumerate(_by_text(hi - lo, text, *run)):
                kept, best = words[k], [None] * 4
                if len(start):
                    kept = [words[k][x] for x in np.flatnonzero(~dropped(len(words[k]), start, length, period))]
                    x = np.lexsort((period, start, -length))[0]
                    best = [int(start[x]), int(length[x]), int(period[x]), 1000 * int(length[x]) // int(period[x])]
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start, length, period)).encode()
                rows.append((ids[lo + k], len(start), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], [c.split()[0] for c in DIGEST.split(", ")])

#: Equal words q apart, gathered into stretches; the least period of a stretch counts.
ORACLE_SQL = r"""WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
given AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM documents, crc),
planned AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS periodic, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS g8 FROM given),
texts AS MATERIALIZED (SELECT doc_id, n, CASE WHEN periodic THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g8)) + 1] END) ELSE w END AS w FROM planned),
words AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts),
equal AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM stretches GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS rows, arg_min({'s': s, 'l': l, 'q': q}, {'l': -l, 's': s, 'q': q}) AS best FROM runs GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s::BIGINT AS "start", best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(rows, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """One row per document: its runs after every tenth row has been made periodic, the longest run, and digests of the runs and of the collapsed text."""
    small_batches(spark)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), _body()).mapInArrow(_digests, DIGEST)


ship(__name__)
