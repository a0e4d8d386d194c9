"""Deduplicated work, fan-back, yields, summaries and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from verdigris.operators.core import keep_first
from verdigris.operators.identity import written

def dedupe_any_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key with its least value and the row count."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.count("*").alias("n_rows"))


def fan_back(associations: DataFrame, keys: list[str], work) -> DataFrame:
    """Does `work` once per distinct key and joins the result to every association."""
    return associations.join(work(associations.select(*keys).distinct()), keys)


def compute_once_fan_back(df: DataFrame, content: str, inputs: list[str], work) -> DataFrame:
    """Runs `work` on one row per content id (its inputs are equal by the id's meaning), keyed by it, and joins the result to every row; inputs are not carried through the join."""
    one = df.filter(F.col(content).isNotNull()).groupBy(content).agg(*[F.any_value(c).alias(c) for c in inputs])
    return df.drop(*inputs).join(work(one), content, "left")


def anti_join_duplicates(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows that are first in their key; the repeats of a key are left out before the shuffle, task by task."""
    return keep_first(df, keys, order)


def work_avoided(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n_rows, n_distinct, avoided): avoided = sum of count - 1 over keys."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.col("n") - 1).alias("avoided"))


def query_yield(df: DataFrame, bucket: Column) -> DataFrame:
    """Rows, distinct items, terms and hashes per bucket. Each distinct count is a narrow aggregation of its own, so rows are never multiplied."""
    own = df.withColumn("bucket", bucket)
    count = lambda name, *cols: own.groupBy("bucket", *cols).agg(F.count("*").alias("n")).groupBy(F.col("bucket").alias(f"_{name}")).agg(F.count_if(~F.greatest(*[F.col(c).isNull() for c in cols], F.lit(False))).alias(name), F.sum("n").alias("n_rows"))
    out = count("items", "source", "item_id")
    for name, column in (("terms", "search_term"), ("hashes", "query_hash")):
        out = out.join(count(name, column).drop("n_rows"), F.col("_items").eqNullSafe(F.col(f"_{name}")))
    return out.select(F.col("_items").alias("bucket"), "n_rows", "items", "terms", "hashes")


def stage_row_counts(stages: dict[str, DataFrame], required: str) -> DataFrame:
    """(position, stage, n_rows, n_null) for each named stage."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        row = df.agg(F.lit(i).alias("position"), F.lit(name).alias("stage"), F.count("*").alias("n_rows"), F.count_if(F.col(required).isNull()).alias("n_null"))
        out = row if out is None else out.unionByName(row)
    return out


def evidence_funnel(counts: DataFrame, units: dict[str, str]) -> DataFrame:
    """Ordered stage counts with unit, status and conversion; none across different units."""
    unit = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])[F.col("stage")]
    w = Window.partitionBy().orderBy("position")  # one row per stage
    with_unit = counts.withColumn("unit", unit)
    same = F.lag("unit").over(w) == F.col("unit")
    ratio = F.when(same & (F.lag("n_rows").over(w) > 0), F.round(F.col("n_rows") / F.lag("n_rows").over(w), 6))
    return with_unit.withColumn("conversion", ratio).withColumn("status", F.when(F.col("n_rows") > 0, "available").otherwise("measured_zero"))


def count_mapping(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def workload_summary(df: DataFrame, cluster: str, prefix: str, flags: dict[str, Column]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(n) for n, c in flags.items()], F.count_distinct(F.when(F.col(cluster).startswith(prefix), F.col(cluster))).alias("prefixed_clusters"))


def candidate_set_summary(df: DataFrame, media: str, candidate: str, score: str) -> DataFrame:
    """Per media: distinct candidates, their sorted list, and the one that scores best."""
    return df.groupBy(media).agg(F.count_distinct(candidate).alias("n_candidates"), F.array_join(F.sort_array(F.collect_set(F.col(candidate).cast("string"))), ",").alias("candidates"),
                                 F.max_by(F.col(candidate), F.struct(F.col(score), F.col(candidate))).alias("target"))


def definition_summary(df: DataFrame, enabled: Column, source: str, rank: str) -> DataFrame:
    return df.groupBy(source).agg(F.count_if(enabled).alias("eligible"), F.count_if(~enabled).alias("disabled"), F.max(rank).alias("max_priority"))


def queue_summary(df: DataFrame, status: str, aliases: dict[str, str], media: str, priority: str) -> DataFrame:
    """Status buckets after aliases, with distinct media and the highest priority."""
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[F.lower(status)], F.lower(status))
    return df.groupBy(named.alias("status")).agg(F.count("*").alias("n"), F.count_distinct(media).alias("media"), F.max(priority).alias("max_priority"))


def readiness_summary(df: DataFrame, group: str, required: int, media: str) -> DataFrame:
    n = F.count_distinct(media)
    return df.groupBy(group).agg(n.alias("available"), F.greatest(F.lit(required) - n, F.lit(0)).alias("shortfall"), F.when(n >= required, "ready").otherwise("short").alias("status"))


def representative_record(df: DataFrame, record: str, ties: list[str]) -> DataFrame:
    """The record with most associations."""
    return df.groupBy(record).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *ties).limit(1)


def exact_quantile(df: DataFrame, group: str, value: str, q: float, most: int = 10_000) -> DataFrame:
    """(group, quantile): the exact quantile of the values that aren't null, between two neighbours by their distance.

    A group of up to `most` values is sorted in one aggregate. In a larger one a sketch gives two values around the wanted
    ranks. What lies below, at and between them is counted exactly: a rank at one of the two values is settled, and the next
    round looks strictly between them, where a half percent of the rows is at most. So no aggregate holds more than a
    sketch or `most` values, however often a value repeats.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    rank = (F.col("n") - 1) * F.lit(float(q))
    unknown = F.lit(None).cast("double")
    fields = {"low": F.floor(rank).cast("long"), "high": F.ceil(rank).cast("long"), "part": rank - F.floor(rank), "below": F.lit(0).cast("long"), "inside": F.col("n"), "low_v": unknown, "high_v": unknown}
    state = written(rows.groupBy("g").agg(F.count("*").alias("n")).select("g", *[c.alias(n) for n, c in fields.items()]))
    done, state = _picked(rows, state.filter(F.col("inside") <= most)), written(state.filter(F.col("inside") > most))
    lo, hi, v = F.col("s.lo"), F.col("s.hi"), F.col("r.v")
    above, under = lo.isNull() | (v > lo), hi.isNull() | (v < hi)  # no cut: the end of the range
    while (left := state.count()) > 0:
        near = lambda x: F.broadcast(x).alias("s") if left <= 10_000 else x.alias("s")  # noqa: E731, B023
        same = F.col("r.g").eqNullSafe(F.col("s.g"))
        sketch = rows.alias("r").join(near(state.select("g")), same).groupBy(F.col("s.g").alias("k_g")).agg(F.percentile_approx("v", [k / 1000 for k in range(1001)], 100_000).alias("cuts"))
        share = lambda c, off: (F.col(c) - F.col("below") + off) / F.col("inside") * 1000
        ends = state.join(sketch, F.col("g").eqNullSafe(F.col("k_g"))).select(*state.columns, F.get("cuts", (F.floor(share("low", -1)) - 1).cast("int")).alias("lo"), F.get("cuts", (F.ceil(share("high", 2)) + 1).cast("int")).alias("hi"))
        ends = written(ends)
        parts = rows.alias("r").join(near(ends), same).groupBy(F.col("s.g").alias("k_g")).agg(F.count_if(v < lo).alias("under"), F.count_if(v == lo).alias("at_lo"), F.count_if(above & under).alias("between"))
        first = F.col("below") + F.col("under") + F.col("at_lo")
        settled = lambda c: F.coalesce(F.col(f"{c}_v"), F.when(F.col(c) < F.col("below") + F.col("under"), F.lit(None)).when(F.col(c) < first, F.col("lo")).when(F.col(c) >= first + F.col("between"), F.col("hi")))
        counted = ends.join(parts, F.col("g").eqNullSafe(F.col("k_g"))).withColumns({"low_v": settled("low"), "high_v": settled("high"), "below": first, "inside": F.col("between")})
        counted = written(counted.select(*state.columns, "lo", "hi"))
        open_ = F.col("low_v").isNull() | F.col("high_v").isNull()
        done = done.unionByName(counted.filter(~open_).select("g", _between(F.col("low_v"), F.col("high_v")).alias("quantile")))
        rows = written(rows.alias("r").join(near(counted.filter(open_)), same).filter(above & under).select("r.*"))
        rest = counted.filter(open_).drop("lo", "hi")
        done = done.unionByName(_picked(rows, rest.filter(F.col("inside") <= most)))
        state = written(rest.filter(F.col("inside") > most))
    return done.select(F.col("g").alias(group), "quantile")


def _between(low: Column, high: Column) -> Column:
    return F.when(F.col("low") == F.col("high"), low).otherwise(low + (high - low) * F.col("part"))


def _picked(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The quantile of groups whose rows are few: (g, quantile)."""
    fields = ("low", "high", "part", "below", "low_v", "high_v")
    held = rows.alias("r").join(state.alias("s"), F.col("r.g").eqNullSafe(F.col("s.g"))).groupBy(F.col("s.g").alias("g")).agg(F.sort_array(F.collect_list("r.v")).alias("vs"), *[F.first(f"s.{c}").alias(c) for c in fields])
    at = lambda c: F.coalesce(F.col(f"{c}_v"), F.get("vs", (F.col(c) - F.col("below")).cast("int")))
    return held.select("g", _between(at("low"), at("high")).alias("quantile"))


def numeric_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, least, exact median and greatest of each group."""
    ends = df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most")).alias("a")
    median = exact_quantile(df, group, value, 0.5).alias("b")
    return ends.join(median, F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}")), "left").select(F.col(f"a.{group}").alias(group), "n", "least", F.col("quantile").alias("median"), "most")


CHUNK = 100_000


def _scanned(df: DataFrame, session: str, order: str, at: str, chunk: int) -> tuple[DataFrame, WindowSpec]:
    """(rows with their chunk and what surrounds it, the window of a chunk): a session is cut by its numbers into chunks of up to `chunk`.

    Each chunk gives its first and last mark, its size and its last time; one row a chunk carries these across, so that no
    window holds more than a chunk of events.
    """
    rows = df.withColumn("_chunk", F.coalesce(F.floor(F.col(order) / chunk).cast("long"), F.lit(-1).cast("long")))
    mark = F.when(F.col("kind") == "activity", F.struct("state", F.col(at).alias("at"), F.col(order).alias("number")))
    place = F.when(F.col("kind") == "activity", F.struct(order))
    ends = rows.groupBy(session, "_chunk").agg(F.min_by(mark, place).alias("_head"), F.max_by(mark, place).alias("_tail"), F.count("*").alias("_size"), F.max_by(F.struct(F.col(at).alias("at")), F.struct(order)).alias("_at"))
    w = Window.partitionBy(session).orderBy("_chunk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(session).alias("_session"), F.col("_chunk").alias("_number"), F.first("_head", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_then"), F.last("_tail", ignorenulls=True).over(before).alias("_since"),
                          F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_rows"), F.lag("_at").over(w).alias("_time"), F.lead("_chunk").over(w).isNull().alias("_ends"))
    met = rows.join(carried, F.col(session).eqNullSafe(F.col("_session")) & (F.col("_chunk") == F.col("_number")))
    return met, Window.partitionBy(session, "_chunk").orderBy(order)


CARRIED = ("_chunk", "_session", "_number", "_then", "_since", "_rows", "_time", "_ends")


def session_intervals(df: DataFrame, session: str, order: str, at: str, chunk: int = CHUNK) -> DataFrame:
    """Active time: each `active` mark to the session's next pause, whatever actions lie between. Events have kind (activity, action, completion) and state (active, paused).

    A session of any length is scanned in chunks of its numbers.
    """
    met, w = _scanned(df, session, order, at, chunk)
    following = F.coalesce(F.lead(F.struct("state", F.col(at).alias("at"), F.col(order).alias("number"))).over(w), F.col("_then"))
    marks = met.filter("kind = 'activity'").withColumn("_next", following).filter("state = 'active' AND _next.state = 'paused'")
    return marks.withColumns({"until": F.col("_next.at"), "until_order": F.col("_next.number")}).drop("_next", *CARRIED)


def session_violations(df: DataFrame, session: str, order: str, at: str, chunk: int = CHUNK) -> DataFrame:
    """(session, rule) of sessions whose events break a rule: numbers with gaps, times that go back, overlapping or open active time, a pause without active time, an action outside of it, not one final completion."""
    met, w = _scanned(df, session, order, at, chunk)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("kind") == "activity", F.col("state"))
    early = F.coalesce(F.lag(F.struct(F.col(at).alias("at"))).over(w), F.col("_time"))["at"]
    seen = met.withColumns({"_n": F.row_number().over(w) + F.col("_rows"), "_early": early, "_mode": F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.col("_since.state")), "_was": F.coalesce(F.last(mark, ignorenulls=True).over(before), F.col("_since.state")),
                            "_last": F.lead(F.struct(order)).over(w).isNull() & F.col("_ends")})
    active = lambda c: F.coalesce(F.col(c) == "active", F.lit(False))
    kind, state = F.col("kind"), F.col("state")
    rules = {"sequence_gap": F.col(order) != F.col("_n"), "not_chronological": F.col(at) < F.col("_early"), "overlapping_activity": (kind == "activity") & (state == "active") & active("_was"),
             "pause_without_activity": (kind == "activity") & (state == "paused") & ~active("_was"), "action_outside_activity": (kind == "action") & ~active("_was"), "activity_left_open": F.col("_last") & active("_mode"),
             "completion_not_final": (kind == "completion") != F.col("_last")}
    broken = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    return seen.select(session, broken.alias("rule")).distinct()


def session_activity_summary(df: DataFrame, session: str, order: str, at: str, target: str, chunk: int = CHUNK) -> DataFrame:
    """Active milliseconds, actions and the distinct targets of actions per session."""
    spans = session_intervals(df, session, order, at, chunk).groupBy(session).agg(F.sum(F.unix_millis("until") - F.unix_millis(at)).alias("active_ms"))
    action = F.col("kind") == "action"
    acts = df.groupBy(session).agg(F.count_if(action).alias("actions"), F.count_distinct(F.when(action, F.col(target))).alias("targets"))
    return acts.join(spans, session, "left").fillna(0, ["active_ms"])


def paired_deltas(df: DataFrame, pair: str, workflow: str, names: tuple[str, str], measure: str) -> DataFrame:
    """Absolute and relative difference of two workflows on the same pair."""
    side = lambda n, out: df.filter(F.col(workflow) == n).select(pair, F.col(measure).alias(out))
    both = side(names[0], "first").join(side(names[1], "second"), pair)
    return both.withColumn("delta", F.col("second") - F.col("first")).withColumn("relative", F.when(F.col("first") != 0, F.round(F.col("delta") / F.col("first"), 6)))
