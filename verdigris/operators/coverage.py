"""Coverage of candidates against a baseline by cell, hierarchy rollups, contributions and ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered_distinct_counts(df: DataFrame, keys: list[str], item: str, predicates: dict[str, Column], latest: str | None = None) -> DataFrame:
    """Distinct items per key under each predicate, and the latest date. Rows with a null key are left out.

    One aggregation to (key, item) says which predicates an item meets, a second one counts: rows are never multiplied.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    dates = [F.max(latest).alias("latest_date")] if latest else []
    items = df.filter(known).groupBy(*keys, F.col(item).alias("_item")).agg(*[F.max(F.coalesce(p, F.lit(False))).alias(n) for n, p in predicates.items()], *dates)
    return items.groupBy(*keys).agg(*[F.count_if(F.col(n) & F.col("_item").isNotNull()).alias(n) for n in predicates], *([F.max("latest_date").alias("latest_date")] if latest else []))


def review_state_counts(df: DataFrame, keys: list[str], item: str, state: str, states: tuple[str, ...]) -> DataFrame:
    return filtered_distinct_counts(df, keys, item, {f"{s}_items": F.col(state) == s for s in states})


def full_outer_coverage(baseline: DataFrame, candidates: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Both sides, aggregated before, by key; counts of an absent side are 0."""
    return baseline.join(candidates, keys, "full_outer").fillna(0, counts)


def reconcile_full_outer(recomputed: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every key of either side with presence flags and the values that differ."""
    a = recomputed.select(*keys, F.struct(*values).alias("_r"))
    b = stored.select(*keys, F.struct(*values).alias("_s"))
    both = a.join(b, keys, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_r.{v}").eqNullSafe(F.col(f"_s.{v}")), F.lit(v)) for v in values]))
    return both.select(*keys, F.col("_r").isNotNull().alias("in_recomputed"), F.col("_s").isNotNull().alias("in_stored"), differ.alias("differing"), (F.size(differ) == 0).alias("consistent"))


def overlay_counts(stored: DataFrame, committed: DataFrame, fresh: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Stored less committed plus freshly computed counts per cell; other cells keep theirs. A negative count is an error for a rule."""
    out = stored.join(committed.select(*keys, F.col(column).alias("_old")), keys, "left").join(fresh.select(*keys, F.col(column).alias("_new")), keys, "left")
    return out.withColumn(column, F.col(column) - F.coalesce("_old", F.lit(0)) + F.coalesce("_new", F.lit(0))).drop("_old", "_new")


def hierarchy_rollup(df: DataFrame, levels: list[str], sums: list[str], flags: dict[str, Column], dates: list[str] = (), reasons: str | None = None) -> DataFrame:
    """One row per node of every level and a global one, by grouping sets. The level comes from grouping_id, never from nulls."""
    sets = [levels[:k] for k in range(len(levels) + 1)]
    flagged = df.withColumns({f"_{n}": c for n, c in flags.items()})
    aggregates = [F.sum(c).alias(c) for c in sums] + [F.count_if(f"_{n}").alias(f"{n}_cells") for n in flags] + [F.max(d).alias(d) for d in dates]
    if reasons:
        aggregates.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(reasons)))).alias("reasons"))
    gid = F.grouping_id(*levels)
    names = {(1 << (len(levels) - k)) - 1: (levels[k - 1] if k else "global") for k in range(len(levels) + 1)}
    level = reduce(lambda acc, kv: F.when(F.col("_gid") == kv[0], F.lit(kv[1])).otherwise(acc), names.items(), F.lit(None).cast("string"))
    rolled = flagged.groupingSets([[F.col(x) for x in s] for s in sets], *[F.col(x) for x in levels]).agg(gid.alias("_gid"), *aggregates)
    return rolled.withColumn("scope_level", level).drop("_gid")


def rollup_navigation(rollup: DataFrame, levels: list[str], level: str, value: str | None, order: str) -> DataFrame:
    """The selected scope first, then its children by the measure, nulls last."""
    names = ["global", *levels]
    child = names[names.index(level) + 1] if names.index(level) + 1 < len(names) else None
    own = rollup.filter((F.col("scope_level") == level) & (F.lit(True) if level == "global" else F.col(level) == value)).withColumn("position", F.lit(0))
    below = rollup.filter((F.col("scope_level") == child) & (F.lit(True) if level == "global" else F.col(level) == value)).withColumn("position", F.lit(1)) if child else own.limit(0)
    return own.unionByName(below).orderBy("position", F.desc_nulls_last(order), *levels)


def scope_ancestors(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """(node_id, ancestors nearest first) by a fixed number of self-joins; a chain that comes back to its node is a cycle, one that ends unknown an orphan."""
    parents = nodes.select(F.col("node_id").alias("_id"), F.col("parent_id").alias("_parent"))
    out = nodes.select("node_id", F.col("parent_id").alias("_at"), F.array_compact(F.array("parent_id")).alias("ancestors"))
    orphan = F.lit(False)
    for _ in range(depth):
        out = out.join(parents, F.col("_at") == F.col("_id"), "left")
        out = out.withColumn("_lost", (F.col("_at").isNotNull() & F.col("_id").isNull()) | (F.col("_lost") if "_lost" in out.columns else orphan))
        out = out.withColumn("ancestors", F.when(F.col("_parent").isNotNull(), F.array_append("ancestors", F.col("_parent"))).otherwise(F.col("ancestors"))).withColumn("_at", F.col("_parent")).drop("_id", "_parent")
    return out.select("node_id", "ancestors", F.array_contains("ancestors", F.col("node_id")).alias("cycle"), F.col("_lost").alias("orphan"))


def compare_scopes(rollup: DataFrame, left: Column, right: Column, measures: list[str]) -> DataFrame:
    """Two rollup rows side by side: (measure, left_value, right_value, difference)."""
    long = lambda cond, name: rollup.filter(cond).unpivot([], measures, "measure", name)
    return long(left, "left_value").join(long(right, "right_value"), "measure").withColumn("difference", F.col("left_value") - F.col("right_value"))


def temporal_contribution(candidate: str, baseline: str) -> dict[str, Column]:
    gap = F.date_diff(candidate, baseline)
    return {"day_gap": gap, "temporal_state": F.when(gap.isNull(), "data_deficient").when(gap > 0, "later").when(gap < 0, "earlier").otherwise("same")}


def coverage_contribution() -> Column:
    """Maturity of a cell beyond the baseline: release_ready within supported within potential."""
    extra = F.col("baseline_items") == 0
    return F.when(extra & (F.col("ready_items") > 0), "release_ready").when(extra & (F.col("supported_items") > 0), "human_supported").when(extra & (F.col("candidate_items") > 0), "potential").otherwise("none")


def coverage_uplift(cells: DataFrame) -> DataFrame:
    """Additional cells per occupied baseline cell in percent; without baseline the state says so and the value is null."""
    b, c = F.col("baseline_items"), F.col("candidate_items")
    occupied, extra = F.count_if(b > 0), F.count_if((b == 0) & (c > 0))
    return cells.agg(occupied.alias("baseline_cells"), extra.alias("additional_cells"), F.when(occupied > 0, F.round(extra * 100.0 / occupied, 6)).alias("uplift_percent"),
                     F.when(occupied > 0, "available").otherwise("zero_denominator").alias("uplift_state"))


def range_edge_state(distance: str, uncertainty: str, near: float = 25.0, far: float = 200.0) -> Column:
    d = F.col(distance)
    return F.when(d.isNull(), "unavailable").when(F.col(uncertainty) > d, "uncertain").when(d <= near, "within_range").when(d <= far, "range_edge").otherwise("beyond_range")


def metric_top_k(cells: DataFrame, metric: str, k: int, ties: list) -> DataFrame:
    """The k highest cells with a total order; a positive metric only. `omitted` counts the rest."""
    positive = cells.filter(F.col(metric) > 0)
    omitted = positive.agg((F.greatest(F.count("*") - k, F.lit(0))).alias("omitted"))
    return positive.orderBy(F.desc(metric), *ties).limit(k).join(F.broadcast(omitted))  # one row


def gap_cell_list(cells: DataFrame, scope: Column, order: list, k: int) -> DataFrame:
    return cells.filter(scope & (F.col("baseline_items") == 0) & (F.col("candidate_items") > 0)).orderBy(*order).limit(k)


def bubble_scale(df: DataFrame, metric: str, least: float, most: float, scale: str = "sqrt") -> DataFrame:
    """Radius from the global maximum, by square root or logarithm."""
    f = F.sqrt if scale == "sqrt" else F.log1p
    top = df.agg(F.max(metric).alias("_top"))
    share = F.when(F.col("_top") > 0, f(F.col(metric)) / f(F.col("_top"))).otherwise(0.0)
    return df.join(F.broadcast(top)).withColumn("radius", least + (most - least) * share).drop("_top")  # one row


def left_join_stats(df: DataFrame, stats: DataFrame, on: list[str], counts: list[str]) -> DataFrame:
    return df.join(stats, on, "left").fillna(0, counts)


def latest_by_key_join(items: DataFrame, snapshots: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Items with the latest snapshot of their key."""
    values = [c for c in snapshots.columns if c != key]
    latest = snapshots.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(at, tie)).alias("_s")).select(key, "_s.*")
    return items.join(latest, key)


def semi_join_membership(df: DataFrame, released: DataFrame, on: list[str], item: str) -> DataFrame:
    """How many distinct items are in a released set."""
    return df.join(released, on, "left_semi").agg(F.count_distinct(item).alias("n_items"))
