"""Schemas, rules, checked joins, hashes, set operations, predicates and classifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table or a row breaks its contract."""


def conform_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Ordered select and cast to the contract."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df, if its names and types are the contract's, in order."""
    found, wanted = [(f.name, f.dataType) for f in df.schema.fields], [(f.name, f.dataType) for f in schema.fields]
    if found != wanted:
        raise ContractError(f"schema drift: found {found}, wanted {wanted}")
    return df


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row of violation counts, in one pass; a null rule counts as broken."""
    return df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def validate_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, if no row breaks a rule."""
    broken = {k: v for k, v in rule_violations(df, rules).first().asDict().items() if v}
    if broken:
        raise ContractError(f"broken rules: {broken}")
    return df


def attach_scope(df: DataFrame, scope: DataFrame, columns: list[str]) -> DataFrame:
    """Adds constant columns after proving that each has one value in `scope`."""
    found = scope.agg(*[F.struct(F.count_distinct(c).alias("n"), F.min(c).alias("v")).alias(c) for c in columns]).first()
    wrong = [c for c in columns if found[c]["n"] != 1]
    if wrong:
        raise ContractError(f"not single-valued: {wrong}")
    kinds = dict(scope.dtypes)
    return df.withColumns({c: F.lit(found[c]["v"]).cast(kinds[c]) for c in columns})


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join that fails first if a side's keys repeat against `validate` ("m:1" or "1:1")."""
    for side, df in (("right", right), *((("left", left),) if validate == "1:1" else ())):
        if not duplicate_keys(df, on).isEmpty():
            raise ContractError(f"{side} side repeats a key of {on}")
    return left.join(right, on, how)


def multi_key_enrich(df: DataFrame, facts: DataFrame, on: list[str], required: list[str]) -> DataFrame:
    """Checked left join; a row without its facts is an error."""
    out = join_checked(df, facts, on)
    missing = out.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])).limit(1).count()
    if missing:
        raise ContractError(f"rows without {required}")
    return out


def orphans(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key the other side doesn't know."""
    return df.join(known.select(*on).distinct(), on, "left_anti")


def orphan_check(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    if not orphans(df, known, on).isEmpty():
        raise ContractError(f"unknown keys in {on}")
    return df


def canonical_row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the row as JSON with sorted names; nulls stay."""
    names = sorted(columns or df.columns)
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def dataset_fingerprint(df: DataFrame, columns: list[str] | None = None, most: int = 4_096) -> DataFrame:
    """One row (n_rows, fingerprint) that does not depend on the order of rows, from all bits of every row's hash.

    A tree of hashes: the sorted row hashes of a bucket of common first digits are hashed, then those of 256 buckets, and
    so on to the root. There are 65,536 buckets up to `most` rows a bucket on average, and 256 times as many for every 256 times
    as many rows, so no list grows with the rows.
    """
    rows = df.select(canonical_row_hash(df, columns).alias("h"), F.lit(1).cast("long").alias("n"))
    count, digits = df.count(), 4
    while count > most * 16**digits:
        digits += 2
    level = rows
    for d in range(digits, -1, -2):
        level = level.groupBy(F.substring("h", 1, d).alias("b")).agg(F.array_join(F.sort_array(F.collect_list("h")), ",").alias("all"), F.sum("n").alias("n")).select(F.concat("b", F.sha2("all", 256)).alias("h"), "n")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


def symmetric_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, with multiplicity, marked by side."""
    return expected.exceptAll(actual).withColumn("side", F.lit("expected")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("actual")))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Also vertical_concat and candidate_union: rows of all frames under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def expected_key_union(keys: list[str], *sides: DataFrame) -> DataFrame:
    return union_by_name(*[s.select(*keys) for s in sides]).distinct()


def missing_provenance(columns: list[str]) -> Column:
    """Any of the columns is null or blank."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns])


def unpivot_precision_cells(df: DataFrame, ids: list[str], cells: dict[int, str]) -> DataFrame:
    """One row per (row, resolution) with cell and support status; unsupported cells stay null."""
    rows = F.array(*[F.struct(F.lit(r).cast("short").alias("spatial_resolution"), F.col(c).alias("spatial_cell_id")) for r, c in cells.items()])
    out = df.select(*ids, F.explode(rows).alias("x")).select(*ids, "x.*")
    return out.withColumn("cell_supported", F.col("spatial_cell_id").isNotNull()).withColumn("cell_support_status", F.when(F.col("cell_supported"), "supported").otherwise("unsupported_precision"))


def check_precision_support(long: DataFrame, support: DataFrame, quality: str = "coordinate_quality") -> DataFrame:
    """Rows whose cell presence differs from the table (quality, spatial_resolution, expected)."""
    return long.join(F.broadcast(support), [quality, "spatial_resolution"], "left").filter(~F.col("expected").eqNullSafe(F.col("cell_supported")))


def select_finest_supported(long: DataFrame, ids: list[str], requested: int) -> DataFrame:
    """Finest supported resolution per row, and whether the requested one is there."""
    ok = F.when(F.col("cell_supported"), F.col("spatial_resolution"))
    return long.groupBy(*ids).agg(F.max(ok).alias("finest_resolution"), F.max_by(F.when(F.col("cell_supported"), F.col("spatial_cell_id")), ok).alias("finest_cell_id"),
                                  F.when(F.max(F.when(F.col("cell_supported") & (F.col("spatial_resolution") == requested), 1)) == 1, "available").otherwise("blocked_precision").alias("requested_status"))


def scope_filter(level: str, value: str | None) -> Column:
    """Rows of a scope: global, or a value of the level's column."""
    if level == "global":
        return F.lit(True)
    if level not in ("continent", "country", "admin1"):
        raise ValueError(f"unknown level {level!r}")
    return F.col(level) == value


def evidence_mode_filter(mode: str) -> Column:
    b, c = F.col("baseline_items") > 0, F.col("candidate_items") > 0
    modes = {"comparison": b | c, "baseline": b, "candidates": c, "reviewed": F.col("supported_items") + F.col("rejected_items") > 0, "release_ready": F.col("ready_items") > 0}
    return modes[mode]


def classify_membership() -> dict[str, Column]:
    """Five flags of a coverage row."""
    b, c = F.col("baseline_items") > 0, F.col("candidate_items") > 0
    return {"baseline_only": b & ~c, "matched": b & c, "candidate_only": ~b & c, "reviewed_additional": ~b & (F.col("supported_items") > 0), "ready_additional": ~b & (F.col("ready_items") > 0)}


def deficiency_reasons(reasons: dict[str, Column]) -> tuple[Column, Column]:
    """(state, sorted list of the reasons that hold)."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in sorted(reasons.items())]))
    return F.when(F.size(found) > 0, "data_deficient").otherwise("sufficient"), found


def coverage_deficiency(baseline: str = "baseline_items", eligible: str = "eligible_items", duplicates: str = "unresolved_groups", preserved: str = "preserved_items", unknown: str = "unknown_uncertainty_items", issues: str = "issue_items",
                        latest: str = "baseline_latest", positive: str = "positive_items", quality: str = "quality_snapshot_id") -> dict[str, Column]:
    """The eight reasons why a cell's comparison says little, from its counts, its latest date and the id of its quality snapshot."""
    b, e = F.col(baseline), F.col(eligible)
    every = lambda c: (b > 0) & (F.col(c) == b)
    return {
        "no_baseline_rows_in_cell": b == 0, "no_range_inference_eligible_baseline": (b > 0) & (e == 0), "unresolved_provider_duplicates": F.col(duplicates) > 0, "preserved_specimen_or_fossil_only": every(preserved),
        "coordinate_uncertainty_unavailable_for_all_baseline_rows": every(unknown), "all_baseline_rows_have_geospatial_issues": every(issues), "credible_baseline_date_unavailable": (e > 0) & F.col(latest).isNull(),
        "reviewed_quality_snapshot_unavailable": (F.col(positive) > 0) & F.col(quality).isNull(),
    }


def licence_status(url: str, licence: str) -> Column:
    """allowed: https media with a licence that lets derivatives be made."""
    low = F.lower(F.coalesce(F.col(licence), F.lit("")))
    return F.when(F.lower(F.col(url)).startswith("https://") & (F.trim(low) != "") & ~low.contains("nd"), "allowed").otherwise("restricted")


def query_trust_tier(tier: str = "query_tier") -> Column:
    """T1 to T5 from "rank:confidence:field"."""
    part = F.split(F.col(tier), ":")
    rank, confidence = part[0].cast("int"), part[1]
    return F.when((rank <= 3) & (confidence == "A"), "T1").when((rank <= 6) & (confidence == "A"), "T2").when(rank <= 6, "T3").when(confidence == "A", "T4").otherwise("T5")


def score_bands(score: str, margin: str) -> dict[str, Column]:
    s, m = F.col(score), F.col(margin)
    return {"score_band": F.when(s.isNull(), "missing").when(s < 0.35, "low").when(s < 0.7, "middle").otherwise("high"),
            "margin_band": F.when(m.isNull(), "missing").when(m < 0, "negative").when(m < 0.02, "near_tie").when(m < 0.15, "small").otherwise("clear")}


def screening_strata(screening: Column, geography: Column) -> Column:
    return F.concat_ws("__", screening, geography)


def map_review_state(status: str = "status", outcome: str = "consensus_outcome", effective: str = "reviewers", decisive: str = "decisive") -> dict[str, Column]:
    """Consensus to review_state, reviewed and supported; an unknown combination is null, for a rule to catch."""
    s, o = F.col(status), F.col(outcome)
    done = s.isin("complete_agreement", "adjudicated") & (F.col(decisive) > 0)
    state = (F.when((F.col(effective) == 0) | (s == "pending"), "pending").when(done & (o == "yes"), "reviewed_target_positive").when(done & (o == "no"), "reviewed_non_target")
             .when(s.isin("unresolved_disagreement", "uncertain_only"), "uncertain").when(s.isin("media_failure", "deferred"), s))
    return {"review_state": state, "reviewed": state != "pending", "supported": state == "reviewed_target_positive"}


def stage_metric_coalesce(names: dict[str, list[str]]) -> list[Column]:
    """First present of the given metric names."""
    return [F.coalesce(*[F.col(c) for c in cols]).alias(out) for out, cols in names.items()]


def blind_projection(df: DataFrame, hidden: list[str], decided: Column) -> DataFrame:
    """Hidden columns stay null until a decision exists."""
    return df.withColumns({c: F.when(decided, F.col(c)) for c in hidden})


def actionable_review(bucket: str, reason: str, buckets: tuple[str, ...], settled: tuple[str, ...]) -> Column:
    return F.col(bucket).isin(*buckets) & ~F.coalesce(F.col(reason), F.lit("")).isin(*settled)


def numeric_alias_pick(df: DataFrame, identity: list[str], aliases: list[str], out: str = "score") -> DataFrame:
    """First non-null alias; rows without identity are skipped."""
    return df.filter(~missing_provenance(identity)).withColumn(out, F.coalesce(*[F.col(a).cast("double") for a in aliases]))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def group_invariance(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys inside which a column varies."""
    counts = df.groupBy(*keys).agg(*[F.count_distinct(c).alias(c) for c in columns])
    return counts.filter(reduce(lambda a, b: a | b, [F.col(c) > 1 for c in columns]))


def projection_completeness(df: DataFrame, keys: list[str], column: str, expected: list) -> DataFrame:
    """Keys whose values are not exactly the expected list."""
    found = df.groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias("found"))
    return found.filter(F.col("found") != F.array(*[F.lit(x) for x in sorted(expected)]))


def ordered_output(df: DataFrame, ranks: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """A total order in which enum columns follow a given order of values; unknown values come last."""
    rank = [reduce(lambda acc, iv, c=c: F.when(F.col(c) == iv[1], iv[0]).otherwise(acc), list(enumerate(values)), F.lit(len(values))) for c, values in ranks.items()]
    return df.orderBy(*rank, *keys)
