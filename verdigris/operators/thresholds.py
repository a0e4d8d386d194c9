"""Joint choice of two confirmation thresholds by sums over the cells above both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.identity import written

SUMS = ["w", "wy", "n", "y"]
STRIP = 2_000
MOST_STRIPS = 512
MOST_GRID = 4_000_000
PAIRS_A_ROUND = 64
DIGITS = 12


def _above(table: np.ndarray) -> np.ndarray:
    """Sums over all places at or above each, on both axes."""
    return table[::-1, ::-1].cumsum(axis=0).cumsum(axis=1)[::-1, ::-1]


def _rank(rates: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [np.round(rates[k], DIGITS) for k in ("recall", "precision", "coverage", "unweighted")]


def _rated(sums: list[np.ndarray], totals: dict) -> dict[str, np.ndarray]:
    w, wy, n, y = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"recall": wy / totals["wy"], "precision": np.where(w > 0, wy / w, -1.0), "coverage": w / totals["w"], "unweighted": np.where(n > 0, y / n, -1.0)}


def _possible(sums: np.ndarray, gain: np.ndarray, bar: tuple, totals: dict) -> list[tuple[int, int]]:
    """Blocks (i, j) that may hold a better pair than `bar` (recall, precision), the most promising first. `sums` (4, B, C) and `gain` by block."""
    rows, columns = gain.shape
    whole, gained = np.stack([_above(s) for s in sums]), gain
    inner = np.zeros((4, rows + 1, columns + 1))
    inner[:, :rows, :columns] = whole
    base = inner[:, 1:, 1:]
    right = np.cumsum(gained[:, ::-1], axis=1)[:, ::-1]  # of the row's strip, at or above the column
    up = np.cumsum(gained[::-1], axis=0)[::-1]
    up = np.vstack([up[1:], np.zeros((1, columns))])  # of the column's strip, above the row
    most = base[1] - totals["objective"] * base[0] + right + up
    recall, precision = whole[1] / totals["wy"], np.minimum(1.0, whole[1] / np.maximum(np.maximum(base[0], whole[1]), 1e-300))
    open_ = (most >= -1e-9 * totals["w"]) & (whole[2] > 0) & ((recall > bar[0] + 1e-11) | (recall >= bar[0] - 1e-11) & (precision >= bar[1] - 1e-11))
    found = np.argwhere(open_)
    return [tuple(map(int, x)) for x in found[np.argsort(-recall[open_], kind="stable")]]


def best_pair(p: np.ndarray, m: np.ndarray, sums: np.ndarray, inside: tuple[np.ndarray, np.ndarray], base: np.ndarray, totals: dict, bar: tuple | None = None) -> tuple | None:
    """(recall, precision, coverage, unweighted precision, p, m), the best in a block, or None.

    `inside` says which cells lie in the block's strip of p and of m; the others lie above it there. `base` are the sums of
    the cells above in both, which aren't given. A block with a large grid is split again.
    """
    in_p, in_m = inside
    ps, ms = np.unique(p[in_p]), np.unique(m[in_m])
    if not len(ps) or not len(ms):
        return None
    row, column = np.where(in_p, np.searchsorted(ps, p), len(ps)), np.where(in_m, np.searchsorted(ms, m), len(ms))
    if len(ps) * len(ms) > MOST_GRID:
        return _split(p, m, sums, (row, column), (len(ps), len(ms)), base, totals, bar)
    above = []
    for s, b in zip(sums, base):
        table = np.zeros((len(ps) + 1, len(ms) + 1))
        np.add.at(table, (row, column), s)
        above.append(_above(table)[:-1, :-1] + b)
    rates = _rated(above, totals)
    good = (above[2] > 0) & (rates["precision"] + 1e-15 >= totals["objective"])
    for values in _rank(rates):
        if good.any():
            good &= values == values[good].max()
    if not good.any():
        return None
    i, j = max(map(tuple, np.argwhere(good)))
    return (*(float(v[i, j]) for v in _rank(rates)), float(ps[i]), float(ms[j]))


def _split(p, m, sums, place, shape, base, totals, bar):
    """best_pair over a block of up to 256 by 256 smaller ones."""
    cuts = [np.unique(np.linspace(0, n, 257).astype(np.int64))[:-1] for n in shape]
    at = [np.where(x < n, np.searchsorted(c, x, side="right") - 1, len(c)) for x, n, c in zip(place, shape, cuts)]
    size = (len(cuts[0]) + 1, len(cuts[1]) + 1)
    table = np.zeros((4, *size))
    for t, s in zip(table, sums):
        np.add.at(t, tuple(at), s)
    table[:, -1, -1] += base
    gain = np.zeros(size)
    np.add.at(gain, tuple(at), np.maximum(0, sums[1] - totals["objective"] * sums[0]))
    gain[-1, -1] += max(0.0, base[1] - totals["objective"] * base[0])
    best = None
    for i, j in _possible(table, gain, bar or (-1.0, -1.0), totals):
        if i == size[0] - 1 or j == size[1] - 1:
            continue
        floor = max(filter(None, [best, bar]), default=None)
        if floor and table[1, i:, j:].sum() / totals["wy"] < floor[0] - 1e-11:
            break
        own = (at[0] == i) & (at[1] >= j) | (at[1] == j) & (at[0] > i)
        found = best_pair(p[own], m[own], sums[:, own], (at[0][own] == i, at[1][own] == j), table[:, i + 1 :, j + 1 :].sum(axis=(1, 2)), totals, floor and floor[:2])
        best = max(filter(None, [best, found]), default=None)
    return best


def _solver(totals: dict):
    def solve(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        g = groups
        base = g[[f"b_{c}" for c in SUMS]].iloc[0].to_numpy(float)
        found = best_pair(g.p.to_numpy(), g.m.to_numpy(), g[SUMS].to_numpy(float).T, ((g.pb == g.a).to_numpy(), (g.mb == g.b).to_numpy()), base, totals)
        return pd.DataFrame([found] if found else [], columns=["recall", "precision", "coverage", "unweighted", "p", "m"], dtype=float)

    return solve


def _edges(cells: DataFrame, column: str, strips: int) -> np.ndarray:
    """Up to strips - 1 values that cut the cells into strips of about equal counts."""
    if strips == 1:
        return np.zeros(0)
    shares = [k / strips for k in range(1, strips)]
    return np.unique(np.array(cells.agg(F.percentile_approx(column, shares, 20 * strips)).first()[0], float))


def _strip(edges: np.ndarray, column: str) -> Column:
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(), side="right"), dtype="int32")

    place.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(place, "int")(column)


def fit_threshold_policy(df: DataFrame, p: str, margin: str, truth: str, weight: str, objective: float, eligible: Column | None = None, group: str | None = None, strip: int = STRIP) -> DataFrame:
    """One row: the (probability, margin) thresholds whose weighted precision reaches the objective and that are best by recall, precision, coverage, unweighted precision, p and margin; or none, and the state `infeasible`.

    Only samples that pass all gates (`eligible`) and have both values can be confirmed; recall and coverage are against
    all samples. The samples must have both classes and, by `group`, two independent groups at least. Samples collapse to
    distinct (p, margin) cells. Both axes are cut into strips of about `strip` cells (512 at most), and sums over blocks of
    strips, with those above them, bound what a pair inside of a block can reach. Only blocks that could beat the best one
    so far are solved, each from the cells of its two strips and the sum of all cells above both: no grid of all pairs is
    built, and a task holds two strips. Rates are compared to 12 digits.
    """
    gate = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    marked = df.withColumn("_ok", gate & F.col(p).isNotNull() & F.col(margin).isNotNull())
    w, positive = F.col(weight).cast("double"), F.when(F.col(truth), F.col(weight).cast("double")).otherwise(0.0)
    groups = F.min(group) != F.max(group) if group else F.lit(True)
    total = marked.agg(F.sum(w).alias("w"), F.sum(positive).alias("wy"), F.count("*").alias("n"), F.count_if(truth).alias("y"), F.count_if("_ok").alias("e"), groups.alias("groups")).first()
    if not 0 < total.y < total.n:
        raise ValueError("calibration needs samples of both classes")
    if not total.groups:
        raise ValueError("calibration needs two independent groups")
    known = marked.filter("_ok").select(F.col(p).cast("double").alias("p"), F.col(margin).cast("double").alias("m"), w.alias("w"), positive.alias("wy"), F.col(truth).alias("t"))
    cells = written(known.groupBy("p", "m").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"), F.count("*").alias("n"), F.count_if("t").alias("y")))
    count, n_p, n_m = cells.agg(F.count("*"), F.count_distinct("p"), F.count_distinct("m")).first()
    totals = {"w": total.w, "wy": total.wy, "n": total.n, "y": total.y, "objective": objective}
    best = _search(cells, count, totals, strip) if count else None
    names = "state string, state_reason string, p_threshold double, margin_threshold double, precision double, recall double, coverage double, unweighted_precision double, unweighted_recall double, unweighted_coverage double, samples long, eligible_samples long, positives long, negatives long, grid_cells long"
    counts = (total.n, total.e, total.y, total.n - total.y, n_p * n_m)
    if best is None:
        row = ("infeasible", "no_threshold_pair_meets_objective", *(None,) * 8, *counts)
    else:
        s = cells.filter((F.col("p") >= best[4]) & (F.col("m") >= best[5])).agg(*[F.sum(c).alias(c) for c in SUMS]).first()
        row = ("fitted", "objective_met", best[4], best[5], s.wy / s.w, s.wy / total.wy, s.w / total.w, s.y / s.n, s.y / total.y, s.n / total.n, *counts)
    return df.sparkSession.createDataFrame([row], names)


def _search(cells: DataFrame, count: int, totals: dict, strip: int) -> tuple | None:
    strips = min(MOST_STRIPS, -(-count // strip))
    edges = _edges(cells, "p", strips), _edges(cells, "m", strips)
    placed = cells.withColumns({"pb": _strip(edges[0], "p"), "mb": _strip(edges[1], "m")}) if strips > 1 else cells.withColumns({"pb": F.lit(0), "mb": F.lit(0)})
    placed = written(placed)
    gain = F.sum(F.greatest(F.lit(0.0), F.col("wy") - totals["objective"] * F.col("w"))).alias("gain")
    blocks = placed.groupBy("pb", "mb").agg(*[F.sum(c).alias(c) for c in SUMS], gain).toPandas()  # at most 512 * 512 rows
    table = np.zeros((4, len(edges[0]) + 1, len(edges[1]) + 1))
    gains = np.zeros(table.shape[1:])
    for t, c in zip(table, SUMS):
        t[blocks.pb, blocks.mb] = blocks[c]
    gains[blocks.pb, blocks.mb] = blocks.gain
    corners = np.stack([_above(t) for t in table])
    rates = _rated(list(corners), totals)
    reached = rates["recall"][(corners[2] > 0) & (rates["precision"] >= totals["objective"] + 1e-12)]
    best, seed, done = None, (float(reached.max(initial=-1.0)), -1.0), set()
    while True:
        open_ = [x for x in _possible(table, gains, max(seed, best[:2] if best else seed), totals) if x not in done][:PAIRS_A_ROUND]
        if not open_:
            return best
        done.update(open_)
        rows = [(k, a, b, *map(float, table[:, a + 1 :, b + 1 :].sum(axis=(1, 2)))) for k, (a, b) in enumerate(open_)]
        pairs = F.broadcast(cells.sparkSession.createDataFrame(rows, "pair int, a int, b int, b_w double, b_wy double, b_n double, b_y double"))
        own = placed.join(pairs, F.col("pb") == F.col("a")).filter("mb >= b").unionByName(placed.join(pairs, F.col("mb") == F.col("b")).filter("pb > a"))
        found = own.groupBy("pair").applyInPandas(_solver(totals), "recall double, precision double, coverage double, unweighted double, p double, m double").collect()  # at most a row a pair
        best = max([*map(tuple, found), *([best] if best else [])], default=None)
