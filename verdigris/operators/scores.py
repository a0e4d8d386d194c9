"""Routing, boxes, scoring units, score fusion, evidence maxima and selective decision policies."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.thresholds import fit_threshold_policy  # noqa: F401



class Route(NamedTuple):
    """What a kind of detection leads to. A gated kind names its threshold, and its reasons without one, below it, and (after a label) with it switched off."""

    prompts: tuple[str, ...]
    labels: tuple[str, ...]
    route: str
    scoring: str | None
    action: str
    reason: str
    gate: str | None = None
    disabled: str = ""
    below: str = ""
    label_disabled: str = ""


class RouteTexts(NamedTuple):
    """Routes and reasons of rows that no rule takes, and what a label's reason begins with and ends with below a threshold."""

    nothing_route: str
    unknown_route: str
    no_detection: str
    status: str
    score: str
    prompt: str
    label: str
    label_prefix: str
    label_below: str


def _pick(key: Column, values: dict) -> Column:
    """The value of a key by a constant map; null for other keys."""
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("string"))]), key)


def route_rows(df: DataFrame, routes: list[Route], texts: RouteTexts, thresholds: dict[str, float | None], status: str = "detection_status", prompt: str = "prompt", label: str = "label", score: str = "score") -> DataFrame:
    """Adds detection_route, scoring_route, action (score, review, exclude), priority and reason.

    Only detected rows are routed, first by their prompt and, without one, by their older label. A gated kind takes its
    action from its threshold on (None: never); everything unknown, below a threshold or without a usable score is
    excluded. Rules are constant maps inside the plan, so nothing is joined.
    """
    words = lambda c, sep: F.array_join(F.filter(F.split(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))), r"\s+"), lambda w: w != ""), sep)
    state, s, by_prompt, older = words(status, "_"), F.col(score).cast("double"), F.col(prompt).isNotNull(), words(label, "_")
    usable = F.when((s >= 0) & (s <= 1), s)
    kind = F.when(by_prompt, _pick(words(prompt, " "), {x: i for i, r in enumerate(routes) for x in r.prompts})).otherwise(_pick(older, {x: i for i, r in enumerate(routes) for x in r.labels})).cast("int")
    of = lambda field: _pick(kind, {i: getattr(r, field) for i, r in enumerate(routes)})
    fallback = F.concat(F.lit(texts.label_prefix), F.when(older == "", "missing").otherwise(older))
    limit, gated = _pick(of("gate"), thresholds).cast("double"), of("gate").isNotNull()
    unknown = F.lit(texts.unknown_route)
    cases = [
        (state == "no_detection", F.lit(texts.nothing_route), F.lit(texts.no_detection)), (state != "detected", unknown, F.lit(texts.status)), (F.col(score).isNotNull() & usable.isNull(), unknown, F.lit(texts.score)),
        (kind.isNull(), unknown, F.when(by_prompt, texts.prompt).otherwise(texts.label)), (gated & limit.isNull(), unknown, F.when(by_prompt, of("disabled")).otherwise(F.concat(fallback, of("label_disabled")))),
        (gated & usable.isNull(), unknown, F.lit(texts.score)), (gated & (usable < limit), unknown, F.when(by_prompt, of("below")).otherwise(F.concat(fallback, F.lit(texts.label_below)))),
    ]
    taken = F.struct(of("route").alias("route"), of("scoring").alias("scoring"), of("action").alias("action"), F.when(by_prompt, of("reason")).otherwise(fallback).alias("reason"))
    left = lambda route, reason: F.struct(route.alias("route"), F.lit(None).cast("string").alias("scoring"), F.lit("exclude").alias("action"), reason.alias("reason"))
    routed = df.withColumn("_r", reduce(lambda acc, x: F.when(F.coalesce(x[0], F.lit(False)), left(x[1], x[2])).otherwise(acc), reversed(cases), taken))
    priority = _pick(F.col("_r.action"), {"score": "standard", "review": "low", "exclude": "none"})
    return routed.withColumns({"detection_route": F.col("_r.route"), "scoring_route": F.col("_r.scoring"), "action": F.col("_r.action"), "priority": priority, "reason": F.col("_r.reason")}).drop("_r")


def gate_rows(status: str, route: str, routes: tuple[str, ...]) -> dict[str, Column]:
    s, r = F.col(status), F.col(route)
    reason = F.when(s.isNull(), "no_detection").when(s != "ok", "bad_status").when(r.isNull() | ~r.isin(*routes), "route_not_scored").otherwise("eligible")
    return {"gate": F.when(reason == "eligible", "score").otherwise("exclude"), "gate_reason": reason}


def box_geometry(box: str, width: Column, height: Column) -> dict[str, Column]:
    """Corners clamped to the image, normalised corners, centre form and area share."""
    x1, y1, x2, y2 = (F.greatest(F.lit(0.0), F.least(F.get(box, i), w)) for i, w in enumerate((width, height, width, height)))
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "cx": (x1 + x2) / 2 / width, "cy": (y1 + y2) / 2 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height,
            "area_ratio": F.greatest(F.lit(0.0), (x2 - x1) * (y2 - y1)) / (width * height)}


def _suppress(iou: float, cap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["_rank", "score", "box_id"], ascending=[True, False, True])
        x1, y1, x2, y2 = (rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
        area = (x2 - x1) * (y2 - y1)
        identity = pd.factorize(rows["_identity"])[0]
        alive, kept = np.ones(len(rows), bool), []
        for i in range(len(rows)):
            if alive[i] and len(kept) < cap:
                kept.append(i)
                inter = np.maximum(0, np.minimum(x2, x2[i]) - np.maximum(x1, x1[i])) * np.maximum(0, np.minimum(y2, y2[i]) - np.maximum(y1, y1[i]))
                union = area + area[i] - inter
                alive &= ~((identity == identity[i]) & (union > 0) & (inter > iou * np.maximum(union, 0)))
        return rows.iloc[kept][["image_id", "box_id", "score"]]

    return run


def suppress_boxes(df: DataFrame, width: Column, height: Column, least_score: float = 0.35, least_share: float = 0.0, iou: float = 0.5, cap: int = 20) -> DataFrame:
    """Greedy suppression per image: boxes by action (score, review, exclude), then score; a box goes if it overlaps a kept one of the same route, action and scoring route.

    Score and share of the image's area are columns and run first. A group is one image's boxes, which a detector bounds.
    """
    share = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (width * height)
    rank = F.when(F.col("action") == "score", 0).when(F.col("action") == "review", 1).otherwise(2)
    identity = F.concat_ws("|", "detection_route", "action", F.coalesce("scoring_route", F.lit("")))
    kept = df.filter((F.col("score") >= least_score) & (share >= least_share)).select("image_id", "box_id", "x1", "y1", "x2", "y2", "score", rank.alias("_rank"), identity.alias("_identity"))
    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in ("image_id", "box_id", "score"))
    return kept.groupBy("image_id").applyInPandas(_suppress(iou, cap), schema)


def build_scoring_units(df: DataFrame, keys: list[str], route: str, member: str) -> DataFrame:
    """One unit per item and route, with its ordered members and hashed id."""
    members = F.sort_array(F.collect_set(F.col(member).cast("string")))
    out = df.groupBy(*keys, route).agg(members.alias("members"))
    return out.withColumn("unit_id", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], route, F.array_join("members", ",")), 256))


def fuse_scores(df: DataFrame, keys: list[str], target: str, kind: str, score: str, weights: dict[str, float], parts: int | None = None) -> DataFrame:
    """Linear pool per key and target: kind weight over the active total over the count of the kind; null if a weighted input is null; the spread of inputs flags disagreement.

    One aggregation with a count and a sum per kind, so no row is sorted or kept. `parts` deals the rows into so many tasks by key and
    target first, for large tables of mostly different ones, where summing before the shuffle only fills memory; see `fusion_parts`.
    """
    active = {k: float(w) for k, w in weights.items() if w > 0}
    used = df.filter(F.col(kind).isin(*active)).select(*keys, target, F.col(kind).alias("_kind"), F.col(score).alias("_score"))
    used = used.repartition(parts, *keys, target) if parts else used
    is_kind = {f"_{i}": F.col("_kind") == k for i, k in enumerate(active)}
    per = [x for n, on in is_kind.items() for x in (F.count_if(on).alias(f"{n}n"), F.sum(F.when(on, F.col("_score").cast("double"))).alias(f"{n}s"))]
    fused = used.groupBy(*keys, target).agg(F.count_if(F.col("_score").isNull()).alias("missing"), (F.max("_score") - F.min("_score")).alias("spread"), *per)
    total = lambda of: reduce(lambda a, b: a + b, [F.when(F.col(f"{n}n") > 0, of(n, w)).otherwise(0.0) for n, w in zip(is_kind, active.values())], F.lit(0.0))
    pooled = total(lambda n, w: w * F.col(f"{n}s") / F.col(f"{n}n")) / total(lambda n, w: F.lit(w))
    return fused.select(*keys, target, "missing", "spread", F.when(F.col("missing") == 0, pooled).alias("fused_score"), (F.col("spread") > 0.5).alias("strong_disagreement"))


FUSED_ROWS = 250_000


def fusion_parts(rows: int) -> int:
    """Tasks for `fuse_scores`, so that one holds about 250,000 rows however large the table is."""
    return max(1, -(-rows // FUSED_ROWS))


def best_competitor(df: DataFrame, keys: list[str], candidate: str, score: str, target: str) -> DataFrame:
    """Highest score that isn't the target's, ties by candidate, and the target's margin over it."""
    known = df.filter(F.col(score).isNotNull())
    other = F.col(candidate) != F.col(target)
    best = F.min_by(F.when(other, F.struct(candidate, score)), F.when(other, F.struct(-F.col(score), F.col(candidate))))
    out = known.groupBy(*keys).agg(best.alias("_b"), F.max(F.when(~other, F.col(score))).alias("target_score"))
    return out.select(*keys, "target_score", F.col(f"_b.{candidate}").alias("competitor"), F.col(f"_b.{score}").alias("competitor_score"), (F.col("target_score") - F.col(f"_b.{score}")).alias("margin"))


def nonmatch_maxima(df: DataFrame, query: str, kinds: list[str]) -> DataFrame:
    """Best calibrated and raw evidence per kind, and the target's margins over the others. Ties: raw score, then evidence id."""
    aggregates = []
    for k in kinds:
        own = F.col("evidence_kind") == k
        scored = own & F.col("calibrated").isNotNull()
        aggregates += [F.max(F.when(own, F.col("raw"))).alias(f"{k}_raw"), F.max(F.when(own, F.col("calibrated"))).alias(f"{k}_calibrated"),
                       F.max_by(F.when(scored, F.col("evidence_id")), F.when(scored, F.struct("calibrated", "raw", -F.col("evidence_id")))).alias(f"{k}_evidence")]
    out = df.groupBy(query).agg(*aggregates)
    return out.withColumns({f"margin_over_{k}": F.col(f"{kinds[0]}_calibrated") - F.col(f"{k}_calibrated") for k in kinds[1:]})


def apply_decision_policy(df: DataFrame, policy: DataFrame, competing: tuple[str, ...] = ("regional_competitor", "other_competitor", "domain_negative")) -> DataFrame:
    """Outcome, whether it abstains, and the reason. The first gate that holds decides; the policy is one row.

    Quality gates come first, then the margin over non-matches (at most 0: the leading competitor's outcome, if it is one
    of `competing`), the probability, the margin over the best competitor, and geography.
    """
    out = df.join(F.broadcast(policy.select("state", "p_threshold", "margin_threshold")))
    c = F.col
    behind, leads = c("nonmatch_margin") <= 0, c("leading_outcome").isin(*competing)
    named = c("negative_outcome").isNotNull()
    gates = [
        (c("state") != "fitted", "abstain", "decision_policy_infeasible"), (~c("route_ok"), "abstain", "incompatible_route"), (c("domain_negative") & named, c("negative_outcome"), None), (c("domain_negative"), "abstain", "domain_negative_without_supported_outcome"),
        (c("out_of_distribution"), "out_of_distribution", "out_of_distribution"), (~c("detail_ok"), "insufficient_visual_detail", "insufficient_visual_detail"), (~c("coverage_ok"), "insufficient_reference_coverage", "insufficient_reference_coverage"),
        (c("no_geo_fallback"), "no_geo_global_fallback", "no_geo_global_fallback"), (behind & leads, c("leading_outcome"), None), (behind, "abstain", "calibrated_non_target_dominates"), (c("p").isNull(), "abstain", "missing_calibrated_target_probability"),
        (c("p") < c("p_threshold"), "target_probable_review", "target_probability_below_threshold"), (c("margin").isNull(), "abstain", "missing_competitor_margin"), (c("margin") < c("margin_threshold"), "abstain", "competitor_margin_below_threshold"),
        (~c("geo_ok"), "target_probable_review", "weak_geographic_evidence"),
    ]
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    verdict = lambda outcome, reason: F.struct(text(outcome).alias("outcome"), text(reason).alias("reason"))
    found = reduce(lambda acc, g: F.when(F.coalesce(g[0], F.lit(False)), verdict(g[1], g[2])).otherwise(acc), reversed(gates), verdict("target_confirmed", None))
    return out.withColumn("_v", found).withColumns({"outcome": F.col("_v.outcome"), "abstained": F.col("_v.reason").isNotNull(), "reason": F.col("_v.reason")}).drop("_v", "state", "p_threshold", "margin_threshold")


def derive_score_ids(df: DataFrame, parent: str, evidence: str, fields: list[str]) -> DataFrame:
    """Each element of the evidence array with its hashed id; `mismatches` counts supplied ids that differ."""
    key = lambda x: F.sha2(F.concat_ws("|", F.col(parent).cast("string"), *[x[f].cast("string") for f in fields]), 256)
    with_ids = df.withColumn("derived_ids", F.transform(evidence, key))
    return with_ids.withColumn("mismatches", F.size(F.filter(F.arrays_zip(F.col("derived_ids").alias("d"), F.transform(evidence, lambda x: x["id"]).alias("s")), lambda z: z["s"].isNotNull() & (z["s"] != z["d"]))))


def explode_candidates(df: DataFrame, keep: list[str], evidence: str) -> DataFrame:
    return df.select(*keep, F.posexplode(evidence).alias("position", "_e")).select(*keep, "position", "_e.*")
