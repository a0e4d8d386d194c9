"""Seeded sampling with inclusion weights, and estimates with intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.identity import link_groups, written


def seeded_rank(seed: str, *parts: str) -> Column:
    """SHA-256 of seed and parts: an order that no partitioning changes."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256)


def stratified_sample(df: DataFrame, stratum: str, item: str, takes: dict[str, int], default: int, seed: str) -> DataFrame:
    """The least rows by seeded hash of each stratum, as many as `takes` says, with inclusion probability n / N and weight N / n.

    Populations are counted by aggregation. The largest take is a constant, so that Spark keeps that many rows of a
    stratum per partition before the shuffle and no task sorts a whole stratum.
    """
    counts = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("population"))
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(seeded_rank(seed, item), item))).filter(F.col("_rn") <= max([default, *takes.values()]))
    take = reduce(lambda acc, kv: F.when(F.col(stratum) == kv[0], kv[1]).otherwise(acc), takes.items(), F.lit(default))
    n = F.least(take, "population")
    kept = ranked.filter(F.col("_rn") <= take).join(counts, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s", "_rn")
    return kept.withColumns({"inclusion_probability": n / F.col("population"), "sampling_weight": F.col("population") / n})


def stratum_receipts(df: DataFrame, sample: DataFrame, stratum: str) -> DataFrame:
    """Population and sample per stratum, with those of which nothing was taken."""
    taken = sample.groupBy(stratum).agg(F.count("*").alias("sampled"))
    return df.groupBy(stratum).agg(F.count("*").alias("population")).join(taken, stratum, "left").fillna(0, ["sampled"]).withColumn("zero_take", F.col("sampled") == 0)


def canonical_per_owner(df: DataFrame, owner: str, item: str, priority: Column, seed: str) -> DataFrame:
    """One row per owner: rare strata first, then seeded hash, then id."""
    values = [c for c in df.columns if c != owner]
    return df.groupBy(owner).agg(F.min_by(F.struct(*values), F.struct(priority, seeded_rank(seed, item), F.col(item))).alias("_r")).select(owner, "_r.*")


def one_per_group_seeded(df: DataFrame, group: str, item: str, seed: str) -> DataFrame:
    return canonical_per_owner(df, group, item, F.lit(0), seed)


def canonical_per_duplicate_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """The first item of each group and how many others it stands for."""
    return df.groupBy(group).agg(F.min(item).alias(item), (F.count_distinct(item) - 1).alias("omitted"))


def quota_select_sequential(df: DataFrame, item: str, quotas: list[tuple[str, Column, int]], seed: str) -> DataFrame:
    """Each stratum in turn takes its quota, by seeded hash, of the items not taken before."""
    taken = None
    for name, predicate, n in quotas:
        left = df.filter(predicate) if taken is None else df.filter(predicate).join(taken.select(item), item, "left_anti")
        own = left.orderBy(seeded_rank(seed, item), item).limit(n).select(item, F.lit(name).alias("quota"))
        taken = own if taken is None else taken.unionByName(own)
    return taken


def audit_strata_report(df: DataFrame, selected: Column, dimensions: list[str]) -> DataFrame:
    """Population against selected per dimension value, zero takes and representation, in one pass."""
    long = df.withColumn("_s", selected).select("_s", F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions])).alias("x")).select("_s", "x.*")
    out = long.groupBy("dimension", "value").agg(F.count("*").alias("population"), F.count_if("_s").alias("selected"))
    return out.withColumn("zero_take", F.col("selected") == 0).withColumn("rate", F.round(F.col("selected") / F.col("population"), 6))


def audit_cell_binding(df: DataFrame, cells: DataFrame, uncertainty: str, fine: str, coarse: str) -> DataFrame:
    """Cell by precision, then its coverage state by lookup."""
    bound = df.withColumn("cell_id", F.when(F.col(uncertainty) <= 20, F.col(fine)).otherwise(F.col(coarse)))
    return bound.join(cells, "cell_id", "left").withColumn("coverage_state", F.when(F.col("support").isNull(), "unsupported").when(F.col("support") > 0, "covered").otherwise("gap"))


def normalised_weights(df: DataFrame, stratum: str, declared: str, weight: str) -> DataFrame:
    return df.withColumn("normalised_weight", F.col(declared) * F.col(weight) / F.sum(weight).over(Window.partitionBy(stratum)))


def _wilson(p: Column, n: Column, z: float) -> tuple[Column, Column]:
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def _listed(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(rules.items())]))


def precision_wilson(df: DataFrame, positive: Column, by: list[str] = (), level: float = 0.95, inclusion: str | None = None) -> DataFrame:
    """Share of positive decisions with Wilson's interval; null with blockers without decisions or, given `inclusion`, with unknown or unequal probabilities of the sample."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    chance = F.col(inclusion) if inclusion else F.lit(1.0)
    out = df.groupBy(*by).agg(F.count(positive).alias("n"), F.count_if(positive).alias("k"), F.count_if(chance.isNull()).alias("_unknown"), (F.max(chance) - F.min(chance)).alias("_spread"))
    p, n = F.col("k") / F.col("n"), F.col("n")
    low, high = _wilson(p, n, z)
    out = out.withColumn("blockers", _listed({"decisive_sample_empty": n == 0, "inclusion_probability_missing": F.col("_unknown") > 0, "inclusion_probability_unequal": F.col("_spread") > 16 * 2.220446049250313e-16}))
    ok = F.size("blockers") == 0
    return out.select(*by, "n", "k", F.when(ok, F.round(p, 6)).alias("precision"), F.when(ok, F.round(low, 6)).alias("low"), F.when(ok, F.round(high, 6)).alias("high"), "blockers")


def precision_hajek(df: DataFrame, stratum: str, probability: str, positive: Column, declared: DataFrame, level: float = 0.95) -> DataFrame:
    """Weighted ratio with effective size (sum w)^2 / sum w^2 and Wilson's interval on it.

    A row weighs 1 / probability; a stratum with a population weight in `declared` (stratum, population_weight) shares that
    weight among its rows. Blocked by strata that are undeclared, without decisions or of a weight that isn't positive,
    by unknown probabilities, and without decisions at all.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    w, y = F.coalesce(1 / F.col(probability), F.lit(1.0)), positive
    on = y.isNotNull()
    per = df.groupBy(F.col(stratum).alias("stratum")).agg(F.sum(F.when(on, w)).alias("w"), F.coalesce(F.sum(F.when(y, w)), F.lit(0.0)).alias("wy"), F.sum(F.when(on, w * w)).alias("ww"), F.count_if(on).alias("n"), F.count_if(on & F.col(probability).isNull()).alias("unknown"))
    plan = declared.select(F.col("stratum").alias("_d"), "population_weight")
    both = per.join(plan, F.col("stratum") == F.col("_d"), "full_outer")
    factor = F.coalesce(F.col("population_weight") / F.col("w"), F.lit(1.0))
    drawn = F.coalesce("n", F.lit(0)) > 0
    total = both.agg(F.coalesce(F.sum(F.when(F.col("_d").isNotNull(), F.col("wy") * factor)), F.lit(0.0)).alias("wy"), F.sum(F.when(F.col("_d").isNotNull(), F.col("w") * factor)).alias("w"), F.sum(F.when(F.col("_d").isNotNull(), F.col("ww") * factor * factor)).alias("ww"),
                     F.count_if(F.col("_d").isNull()).alias("undeclared"), F.count_if(F.col("_d").isNotNull() & ~drawn).alias("missing_strata"), F.count_if(F.col("population_weight") <= 0).alias("wrong"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("_d").alias("plan"))
    c = F.col
    total = total.withColumn("blockers", _listed({"sampling_stratum_undeclared": c("undeclared") > 0, "sampling_strata_missing": (c("missing_strata") > 0) | (c("plan") == 0), "sampling_strata_invalid": c("wrong") > 0, "inclusion_probability_missing": c("unknown") > 0, "decisive_sample_empty": c("n") == 0}))
    p, n = c("wy") / c("w"), c("w") * c("w") / c("ww")
    low, high = _wilson(p, n, z)
    ok = F.size("blockers") == 0
    return total.select("n", F.when(ok, F.round(n, 6)).alias("effective_n"), F.when(ok, F.round(p, 6)).alias("precision"), F.when(ok, F.round(low, 6)).alias("low"), F.when(ok, F.round(high, 6)).alias("high"), "missing_strata", "blockers")


DESIGNS = ("simple_random", "stratified_random", "clustered_random")
FAN, LEAF_GROUPS = 16, 512


def _generator(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:16], "big"))


def _dealt(seed: str, depth: int):
    """Nodes with their draws and children to the children with theirs: a multinomial by the children's sizes, for each replicate."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s, node, draws, children in zip(f.s, f.node, f.draws, f.children):
                kids = sorted((c["node"], c["size"]) for c in children)
                sizes = np.array([n for _, n in kids], float)
                counts = _generator(seed, depth, s, node).multinomial(np.asarray(draws, np.int64), sizes / sizes.sum())
                rows += [(s, kid, counts[:, i]) for i, (kid, _) in enumerate(kids)]
            yield pd.DataFrame(rows, columns=["s", "node", "draws"])

    return deal


def _summed(seed: str):
    """The groups of a leaf and the leaf's draws to the sums of each replicate."""

    def add(groups: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        own = groups.sort_values("group_id")
        counts = np.asarray(draws.draws.iloc[0], np.int64)
        held = _generator(seed, "leaf", own.s.iloc[0], own.node.iloc[0]).multinomial(counts, np.full(len(own), 1 / len(own)))
        return pd.DataFrame({"replicate": np.arange(len(counts)), "w": held @ own.w.to_numpy(float), "wy": held @ own.wy.to_numpy(float)})

    return add


def split_draws(sums: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(replicate, w, wy): sums over as many draws with replacement of each stratum's groups (group_id, s, w, wy) as it has.

    The draws of a stratum go down a tree over its groups: each node deals its draws, an array with a number for each
    replicate, to at most FAN children by their sizes, and a leaf of about LEAF_GROUPS groups to its groups. So the counts
    are exactly multinomial, there is no row for a replicate's group, and no stratum is held in one task. A node's
    generator is seeded by the seed and the node alone, so any partitioning gives the same draws.
    """
    keyed = sums.select("group_id", F.coalesce(F.concat(F.lit("="), F.col("s").cast("string")), F.lit("")).alias("s"), F.col("w").cast("double").alias("w"), F.col("wy").cast("double").alias("wy"))
    sizes = written(keyed.groupBy("s").agg(F.count("*").alias("n")))
    most, depth = sizes.agg(F.max("n")).first()[0] or 0, 0
    while LEAF_GROUPS * FAN**depth < most:
        depth += 1
    placed = written(keyed.withColumn("node", F.pmod(F.xxhash64("group_id"), F.lit(FAN**depth))))
    leaves = written(placed.groupBy("s", "node").agg(F.count("*").alias("size")))
    draws = sizes.select("s", F.lit(0).cast("long").alias("node"), F.array_repeat("n", replicates).alias("draws"))
    for d in range(depth):
        level = leaves.groupBy("s", F.floor(F.col("node") / FAN ** (depth - d - 1)).cast("long").alias("node")).agg(F.sum("size").alias("size"))
        kids = level.groupBy("s", F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.collect_list(F.struct("node", "size")).alias("children"))  # FAN at most
        draws = draws.join(kids, ["s", "node"]).mapInPandas(_dealt(seed, d), "s string, node long, draws array<long>")
    parts = placed.groupBy("s", "node").cogroup(draws.groupBy("s", "node")).applyInPandas(_summed(seed), "replicate int, w double, wy double")
    return parts.groupBy("replicate").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))


def _hashed_draws(sums: DataFrame, replicates: int, seed: str) -> DataFrame:
    """The same with a row for each replicate and group: a draw's index is a hash of seed, stratum, draw and replicate."""
    within = Window.partitionBy("s")
    numbered = sums.withColumn("i", F.row_number().over(within.orderBy("group_id")) - 1).withColumn("n", F.count("*").over(within))
    draws = numbered.select("s", "n", F.col("i").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    code = F.md5(F.concat_ws("|", F.lit(seed), F.col("s").cast("string"), F.col("draw").cast("string"), F.col("replicate").cast("string")))
    draws = draws.select("s", "replicate", (F.conv(F.substring(code, 1, 8), 16, 10).cast("long") % F.col("n")).cast("int").alias("i"))
    return draws.join(numbered.select("s", "i", "w", "wy"), ["s", "i"]).groupBy("replicate").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))


def precision_bootstrap(df: DataFrame, stratum: str, item: str, keys: list[str], weight: str, positive: Column, replicates: int = 200, seed: str | None = "1", level: float = 0.95, design: str = "stratified_random", draws: str = "split") -> DataFrame:
    """Percentile interval from resampling groups within strata. Groups are the items that shared keys link, over any number of steps.

    A simple random design is one stratum. Blocked for other designs than DESIGNS, without a seed, if the confidence level
    isn't between 0 and 1, a group lies in several strata, and under two groups or 100 replicates. Each group is reduced to
    its sums first. `draws` is "split" (see split_draws) or "hash", whose draws SQL can repeat but which has a row for each
    replicate and group.
    """
    judged = df.filter(positive.isNotNull())
    groups = link_groups(judged, item, keys)
    rows = judged.join(groups, item)
    sums = rows.groupBy("group_id").agg(F.min(stratum).alias("s"), (F.min(stratum) != F.max(stratum)).alias("crosses"), F.sum(weight).alias("w"), F.sum(F.when(positive, F.col(weight)).otherwise(0.0)).alias("wy"))
    sums = written(sums)
    fixed = {"bootstrap_replicates_invalid": not isinstance(replicates, int) or replicates < 100, "bootstrap_seed_missing": not (seed or "").strip(), "confidence_level_invalid": not 0 < level < 1, "sampling_design_not_bootstrap_eligible": design not in DESIGNS}
    pool = sums.withColumn("s", F.lit("__all__")) if design == "simple_random" else sums
    resample = {"split": split_draws, "hash": _hashed_draws}[draws]
    unknown = F.lit(None).cast("double")
    if any(fixed.values()):
        bounds = df.sparkSession.range(1).select(unknown.alias("low"), unknown.alias("high"))
    else:
        tail = (1 - level) / 2
        per = resample(pool, replicates, seed.strip()).select((F.col("wy") / F.col("w")).alias("p"))  # a row for each replicate
        bounds = per.agg(F.percentile("p", tail).alias("low"), F.percentile("p", 1 - tail).alias("high"))
    point = sums.agg(F.count("*").alias("groups"), F.max("crosses").alias("crosses"), (F.sum("wy") / F.sum("w")).alias("p"))
    both = point.join(F.broadcast(bounds))  # one row each
    both = both.withColumn("blockers", _listed({"bootstrap_group_crosses_strata": F.col("crosses"), "bootstrap_groups_insufficient": F.col("groups") < 2, "decisive_sample_empty": F.col("groups") == 0, **{k: F.lit(v) for k, v in fixed.items()}}))
    ok = F.size("blockers") == 0
    return both.select("groups", F.lit(replicates).alias("replicates"), *[F.when(ok, F.round(c, 6)).alias(n) for c, n in (("p", "precision"), ("low", "low"), ("high", "high"))], "blockers")


def dimension_quality(df: DataFrame, dimensions: list[str], state: str, probability: str) -> DataFrame:
    """Per dimension value: decisive and positive counts, and precision weighted by inverse inclusion probability."""
    long = df.select(state, probability, F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions])).alias("x")).select(state, probability, "x.*")
    w, s = 1 / F.col(probability), F.col(state)
    decisive = F.sum(F.when(s.isin("supported", "rejected"), w))
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.count_if(s == "supported").alias("supported"), F.count_if(s == "rejected").alias("rejected"),
                                                  F.round(F.coalesce(F.sum(F.when(s == "supported", w)), F.lit(0.0)) / decisive, 6).alias("weighted_precision"))


def calibration_bins(df: DataFrame, p: str, truth: Column, weight: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of weighted mean probability against observed rate, gap, and the bin's share of the expected calibration error."""
    known = df.filter(F.col(p).isNotNull()).withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int"))
    w = F.col(weight)
    out = known.groupBy("bin").agg(F.count("*").alias("n"), F.sum(w).alias("w"), (F.sum(w * F.col(p)) / F.sum(w)).alias("mean_p"), (F.sum(F.when(truth, w).otherwise(0.0)) / F.sum(w)).alias("observed"))
    gap = F.abs(F.col("mean_p") - F.col("observed"))
    total = F.sum("w").over(Window.partitionBy())  # one row per bin
    return out.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("observed", 6).alias("observed"), F.round(gap, 6).alias("gap"), F.round(gap * F.col("w") / total, 6).alias("ece_term"))
