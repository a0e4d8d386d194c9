"""The review ledger: validation, latest events, consensus, agreement, labels, gates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECISIVE = ("yes", "no")


def not_superseded(events: DataFrame) -> DataFrame:
    gone = events.filter(F.col("supersedes_event_id").isNotNull()).select(F.col("supersedes_event_id").alias("event_id")).distinct()
    return events.join(gone, "event_id", "left_anti")


def _latest(events: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("reviewed_at", "review_round", F.col("reviewer_id").cast("string"), "event_id")).alias("_e")).select(*keys, "_e.*")


def reviewer_key() -> Column:
    """The trimmed reviewer; a blank one is "anonymous"."""
    known = F.trim(F.coalesce(F.col("reviewer_id").cast("string"), F.lit("")))
    return F.when(known == "", F.lit("anonymous")).otherwise(known)


def latest_event_per_reviewer(events: DataFrame) -> DataFrame:
    """Last live event per item and reviewer."""
    named = not_superseded(events).withColumn("reviewer_id", reviewer_key())
    values = [c for c in named.columns if c not in ("item_id", "reviewer_id")]
    return named.groupBy("item_id", "reviewer_id").agg(F.max_by(F.struct(*values), F.struct("reviewed_at", "review_round", "event_id")).alias("_e")).select("item_id", "reviewer_id", "_e.*")


def current_event_per_item(events: DataFrame) -> DataFrame:
    return _latest(not_superseded(events), ["item_id"])


def ledger_validation(events: DataFrame) -> DataFrame:
    """(rule, event_id) of each violation: repeated ids, gaps in a reviewer's rounds, double supersession, links that leave the item or point forward."""
    repeated = events.groupBy("event_id").count().filter("count > 1").select(F.lit("repeated_id").alias("rule"), "event_id")
    w = Window.partitionBy("item_id", "reviewer_id").orderBy("review_round", "event_id")
    gaps = events.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") != F.col("review_round")).select(F.lit("round_gap").alias("rule"), "event_id")
    links = events.filter(F.col("supersedes_event_id").isNotNull())
    twice = links.groupBy("supersedes_event_id").agg(F.count("*").alias("n"), F.max("event_id").alias("event_id")).filter("n > 1").select(F.lit("superseded_twice").alias("rule"), "event_id")
    old = events.select(F.col("event_id").alias("_id"), F.col("item_id").alias("_item"), F.col("reviewed_at").alias("_at"))
    joined = links.join(old, F.col("supersedes_event_id") == F.col("_id"), "left")
    bad = joined.filter(F.col("_id").isNull() | (F.col("_item") != F.col("item_id")) | (F.col("_at") > F.col("reviewed_at"))).select(F.lit("broken_link").alias("rule"), "event_id")
    return repeated.unionByName(gaps).unionByName(twice).unionByName(bad)


#: The fields of a decisive event that reviewers must agree on.
SIGNATURE = ("outcome", "non_target_category", "alternative_taxon", "life_stage", "visual_domain", "view")
#: What a field is if neither the event nor the item says it.
UNSTATED = {"life_stage": "unknown", "visual_domain": "ambiguous", "view": "unknown"}
OUTCOMES = ("yes", "no", "cant_tell", "cant_view", "skipped")
RESOLVED = ("complete_agreement", "adjudicated")


def _two_latest(decisive: Column) -> Column:
    """Aggregate: times and reviewers of the two latest decisive events of different reviewers. One row per reviewer is expected."""
    return F.slice(F.sort_array(F.collect_list(F.when(decisive, F.struct(F.col("reviewed_at").alias("at"), F.col("reviewer_id").alias("by")))), asc=False), 1, 2)


def _answered(top: str, at: Column, by: Column) -> Column:
    """A doubt at a time by a reviewer is answered by a later decisive event of another one."""
    return F.exists(top, lambda t: (t["at"] > at) & (t["by"] != by))


def stated(events: DataFrame, items: DataFrame | None) -> DataFrame:
    """Decisive events with every field of the signature stated: what the event corrects, else what its item (item_id, expected_life_stage, expected_visual_domain, expected_view) expects, else that nothing is known."""
    fields = [f for f in UNSTATED if f in events.columns]
    expected = [f for f in fields if items is not None and f"expected_{f}" in items.columns]
    if expected:
        known = items.select(F.col("item_id").alias("_item"), *[F.col(f"expected_{f}").alias(f"_{f}") for f in expected])
        events = events.join(known, F.col("item_id") == F.col("_item"), "left")
    value = {f: F.coalesce(f, *([F.col(f"_{f}")] if f in expected else []), F.lit(UNSTATED[f])) for f in fields}
    filled = events.withColumns({f: F.when(F.col("outcome").isin(*DECISIVE), v).otherwise(F.col(f)) for f, v in value.items()}) if fields else events
    return filled.drop("_item", *[f"_{f}" for f in expected])


def project_consensus(events: DataFrame, required: int = 2, second_review: str = "on_conflict", adjudication_campaign: bool = False, adjudicate_conflicts: bool = True, items: DataFrame | None = None) -> DataFrame:
    """Per item its status, by fixed precedence, from each reviewer's last live event.

    Adjudications that agree in their whole signature win, others reopen the item. Then: source reviews whose signatures
    differ, or that point at a conflict, are an unresolved disagreement; without any decisive review, a "can't tell" makes
    the item uncertain, a "can't view" a media failure, else it is deferred; an uncertainty of the whole history that no
    later decisive review of another reviewer answers, or too few decisive reviews, leave it pending; else it is agreed.
    `required` is two at least under the policy "always". Fields of the signature that the events lack are left out; a field
    that an event doesn't correct is what its item in `items` expects, so that saying it outright is no conflict.
    """
    events = stated(events, items)
    required = max(2, required) if second_review == "always" else required
    fields = [f for f in SIGNATURE if f in events.columns]
    optional = lambda name, kind: F.col(f"_e.{name}") if name in events.columns else F.lit(None).cast(kind)
    gone = events.filter(F.col("supersedes_event_id").isNotNull()).select(F.col("supersedes_event_id").alias("event_id"), F.lit(True).alias("_gone")).distinct()
    named = events.withColumn("reviewer_id", reviewer_key()).join(gone, "event_id", "left")
    live = F.col("_gone").isNull()
    values = [c for c in events.columns if c not in ("item_id", "reviewer_id")]
    doubt = F.when((F.col("event_type") == "review") & (F.col("outcome") == "cant_tell"), F.col("reviewed_at"))
    one = named.groupBy("item_id", "reviewer_id").agg(F.max_by(F.when(live, F.struct(*values)), F.when(live, F.struct("reviewed_at", "review_round", "event_id"))).alias("_e"), F.max(doubt).alias("doubt_at"))
    one = one.select("item_id", "reviewer_id", "doubt_at", *[F.col(f"_e.{c}").alias(c) for c in ("event_id", "event_type", "reviewed_at", *fields)],
                     optional("conflicts_with_decision_id", "string").isNotNull().alias("points"), F.coalesce(optional("duplicate_concern", "boolean"), F.lit(False)).alias("concern"),
                     F.coalesce(optional("captive_concern", "boolean"), F.lit(False)).alias("captive"))
    c = F.col
    known, source = c("event_id").isNotNull(), c("event_type") == "review"
    decisive = c("outcome").isin(*DECISIVE)
    sides = {"src": source & decisive, "adj": ~source}
    differs = {f"{side}_{f}": (F.min(F.when(on, F.coalesce(f, F.lit("")))) != F.max(F.when(on, F.coalesce(f, F.lit(""))))).alias(f"{side}_{f}") for side, on in sides.items() for f in fields}
    signature = {side: F.min(F.when(on, F.struct(*fields))).alias(f"{side}_signature") for side, on in sides.items()}
    ids = lambda on: F.array_sort(F.collect_set(F.when(on & (decisive | c("points")), c("event_id"))))
    per = one.groupBy("item_id").agg(
        F.count_if(known).alias("reviewers"), F.count_if(decisive).alias("decisive"), F.count_if(sides["src"]).alias("src_n"), F.count_if(source).alias("sources"), F.count_if(~source).alias("adjudications"),
        *[F.count_if(c("outcome") == o).alias(f"n_{o}") for o in OUTCOMES], F.count_if(source & (c("outcome") == "cant_tell")).alias("src_doubts"), F.count_if(source & (c("outcome") == "cant_view")).alias("src_unviewable"),
        *differs.values(), F.max(F.when(source, c("points"))).alias("src_points"), F.max(F.when(~source, c("points"))).alias("adj_points"), *signature.values(), ids(source).alias("src_ids"), ids(~source).alias("adj_ids"),
        _two_latest(sides["src"]).alias("top"), F.collect_list(F.when(c("doubt_at").isNotNull(), F.struct("doubt_at", "reviewer_id"))).alias("doubts"), F.max(F.when(decisive, c("concern"))).alias("duplicate_concern"), F.max(F.when(decisive, c("captive"))).alias("captive_concern"),
        F.max(F.when(source, c("reviewed_at"))).alias("src_at"), F.max(F.when(~source, c("reviewed_at"))).alias("adj_at"), F.max(F.when(sides["src"], c("reviewed_at"))).alias("decided_at"),
    )
    names = [*fields, "explicit_conflict_pointer"]
    conflicts = {s: F.array_compact(F.array(*[F.when(F.coalesce(c(f"{s}_points" if f == "explicit_conflict_pointer" else f"{s}_{f}"), F.lit(False)), F.lit(f)) for f in sorted(names)])) for s in sides}
    per = per.withColumn("unresolved_uncertainty", F.exists("doubts", lambda d: ~_answered("top", d["doubt_at"], d["reviewer_id"]))).withColumns({f"{s}_conflicts": x for s, x in conflicts.items()})
    judged = c("adjudications") > 0
    clash = F.when(judged, F.size("adj_conflicts") > 0).otherwise(F.size("src_conflicts") > 0)
    short = c("unresolved_uncertainty") | (c("src_n") < required)
    status = (F.when(clash, "unresolved_disagreement").when(judged, "adjudicated").when(c("sources") == 0, "pending").when((c("src_n") == 0) & (c("src_doubts") > 0), "uncertain_only")
              .when((c("src_n") == 0) & (c("src_unviewable") > 0), "media_failure").when(c("src_n") == 0, "deferred").when(short, "pending").otherwise("adjudicated" if adjudication_campaign else "complete_agreement"))
    out = per.withColumn("status", status)
    resolved, open_conflict = c("status").isin(*RESOLVED), c("status") == "unresolved_disagreement"
    sig = F.when(resolved, F.when(judged, c("adj_signature")).otherwise(c("src_signature")))
    second = F.when(open_conflict, True).when(c("status") == "uncertain_only", F.lit(second_review != "never")).otherwise((c("status") == "pending") & (c("sources") > 0))
    return out.select(
        "item_id", "status", sig["outcome"].alias("consensus_outcome"), "decisive", "reviewers", sig.alias("resolved_signature"),
        F.when(open_conflict, F.when(judged, c("adj_conflicts")).otherwise(c("src_conflicts"))).otherwise(F.array().cast("array<string>")).alias("conflicting_fields"),
        F.when(open_conflict, F.when(judged, c("adj_ids")).otherwise(c("src_ids"))).otherwise(F.slice("src_ids", 1, 0)).alias("conflict_event_ids"),
        second.alias("second_review_required"), (open_conflict & F.lit(adjudicate_conflicts)).alias("adjudication_required"), "unresolved_uncertainty", F.coalesce("duplicate_concern", F.lit(False)).alias("duplicate_concern"), F.coalesce("captive_concern", F.lit(False)).alias("captive_concern"),
        F.when(judged, c("adj_at")).when(resolved, c("decided_at")).otherwise(c("src_at")).alias("resolved_at"), *[f"n_{o}" for o in OUTCOMES],
    )


def support_eligibility(reviewed: DataFrame, applies: Column, provenance: Column, licence: Column, attribution: Column, domains: tuple[str, ...] = ("live_field", "pinned_specimen")) -> DataFrame:
    """Adds support_eligibility and its blockers to items with their consensus: not applicable, blocked, or prepared."""
    yes = F.col("status").isin(*RESOLVED)
    domain = F.col("resolved_signature.visual_domain")
    return _eligibility(reviewed, "support_eligibility", applies, "prepared", {
        "review_not_completed": ~yes, "not_verified": yes & (F.col("consensus_outcome") != "yes"), "visual_domain_not_support_eligible": yes & ~domain.isin(*domains),
        "source_provenance_missing": ~provenance, "licence_not_allowed": ~licence, "attribution_missing": F.trim(F.coalesce(attribution, F.lit(""))) == "", "duplicate_concern": F.col("duplicate_concern"), "captive_or_cultivated_concern": F.col("captive_concern"),
    })


def final_test_eligibility(reviewed: DataFrame, applies: Column, probability: Column, audit: bool = True, blind: bool = True) -> DataFrame:
    """Adds final_test_eligibility and its blockers to items with their consensus."""
    return _eligibility(reviewed, "final_test_eligibility", applies, "eligible", {
        "review_not_completed": ~F.col("status").isin(*RESOLVED), "not_probability_audit": F.lit(not audit), "inclusion_probability_missing": probability.isNull(), "review_not_blind": F.lit(not blind), "duplicate_concern": F.col("duplicate_concern"), "captive_or_cultivated_concern": F.col("captive_concern"),
    })


def _eligibility(df: DataFrame, name: str, applies: Column, good: str, rules: dict[str, Column]) -> DataFrame:
    blockers = F.array_compact(F.array(*[F.when(applies & F.coalesce(rule, F.lit(True)), F.lit(rule_name)) for rule_name, rule in sorted(rules.items())]))
    return df.withColumn(f"{name}_blockers", blockers).withColumn(name, F.when(~applies, "not_applicable").when(F.size(blockers) == 0, good).otherwise("blocked"))


def unresolved_uncertainty(events: DataFrame) -> DataFrame:
    """"Can't tell" reviews of the whole history, superseded ones too, that no later decisive review of another reviewer answers. Only each reviewer's last live event answers, and no adjudication."""
    decisive = F.col("outcome").isin(*DECISIVE) & (F.col("event_type") == "review")
    top = latest_event_per_reviewer(events).groupBy("item_id").agg(_two_latest(decisive).alias("top"))
    history = events.filter("outcome = 'cant_tell' AND event_type = 'review'").withColumn("_by", reviewer_key()).join(top, "item_id", "left")
    return history.filter(~F.coalesce(_answered("top", F.col("reviewed_at"), F.col("_by")), F.lit(False))).drop("top", "_by")


def verification_coverage(items: DataFrame, consensus: DataFrame, inspections: DataFrame | None = None) -> DataFrame:
    """One row of counts and ratios over all items; an item without events is pending. `inspections` holds (item_id, image_opened, image_verified, image_failure_reason)."""
    both = items.join(consensus, "item_id", "left")
    n, s, o = F.count("*"), F.coalesce("status", F.lit("pending")), F.col("consensus_outcome")
    done = s.isin(*RESOLVED)
    counts = {"attempted_items": F.col("reviewers") > 0, "decisive_items": done, "yes_items": done & (o == "yes"), "no_items": done & (o == "no"), "uncertain_items": s.isin("uncertain_only", "unresolved_disagreement"),
              "media_failure_items": s == "media_failure", "deferred_items": s == "deferred", "pending_items": s == "pending"}
    aggregates = [n.alias("items"), *[F.count_if(x).alias(k) for k, x in counts.items()], F.coalesce(F.sum("reviewers"), F.lit(0)).alias("reviews"), *[F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(f"{x}_reviews") for x in OUTCOMES]]
    if inspections is not None:
        opened, verified = F.coalesce("image_opened", F.lit(False)), F.coalesce("image_verified", F.lit(False))
        both = both.join(inspections, "item_id", "left")
        aggregates += [F.count_if(opened | verified | F.col("image_failure_reason").isNotNull()).alias("inspected_items"), F.count_if(opened & verified).alias("viewable_items")]
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    out = both.agg(*aggregates).withColumn("review_coverage", ratio("attempted_items", "items"))
    return out if inspections is None else out.withColumns({"inspection_coverage": ratio("inspected_items", "items"), "viewability_rate": ratio("viewable_items", "inspected_items")})


def _label_counts(df: DataFrame) -> DataFrame:
    """(item, label, n, total) for items with two ratings or more."""
    per = df.groupBy("item_id", "label").agg(F.count("*").alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.partitionBy("item_id"))).filter("total > 1")


def percent_agreement(df: DataFrame) -> DataFrame:
    """Agreeing rater pairs over pairs, from label counts; no pairs are made."""
    n, t = F.col("n"), F.col("total")
    item = _label_counts(df).groupBy("item_id", "total").agg(F.sum(n * (n - 1) / 2).alias("agreeing")).withColumn("pairs", t * (t - 1) / 2)
    return item.agg(F.count("*").alias("items"), F.sum("pairs").cast("long").alias("pairs"), F.round(F.sum("agreeing") / F.sum("pairs"), 6).alias("agreement"))


def krippendorff_alpha_nominal(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """1 - observed over expected disagreement, per `by` or over all; null with blockers under two overlapping items or without variation of labels."""
    by = list(by)
    per = df.groupBy(*by, "item_id", "label").agg(F.count("*").alias("n"))
    items = per.groupBy(*by, "item_id").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("same"), F.collect_list(F.struct("label", "n")).alias("labels"))  # a handful of labels
    pairs = items.withColumn("labels", F.explode("labels")).filter("total > 1").groupBy(*by, "labels.label").agg(F.sum("labels.n").alias("k")).groupBy(*by).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    t, over = F.col("total"), F.col("total") > 1
    sums = items.groupBy(*by).agg(F.coalesce(F.sum(F.when(over, t)), F.lit(0)).alias("m"), F.count_if(over).alias("overlapping_items"), F.sum(F.when(over, (t * t - F.col("same")) / (t - 1))).alias("do"))
    both = sums.join(pairs, by, "left") if by else sums.join(F.broadcast(pairs), how="left")  # one row each
    m = F.col("m")
    observed, expected = F.when(m > 0, F.col("do") / m), F.when(m > 1, (m * m - F.col("kk")) / (m * (m - 1)))
    out = both.withColumns({"_o": observed, "_x": expected}).withColumn("blockers", F.array_compact(F.array(F.when(F.coalesce(F.col("_x"), F.lit(0.0)) <= 2.220446049250313e-16, F.lit("label_variation_absent")), F.when(F.col("overlapping_items") < 2, F.lit("reviewer_overlap_insufficient")))))
    ok = F.size("blockers") == 0
    return out.select(*by, "overlapping_items", m.cast("long").alias("ratings"), F.when(ok, F.round("_o", 6)).alias("observed_disagreement"), F.when(ok, F.round("_x", 6)).alias("expected_disagreement"),
                      F.when(ok, F.round(1 - F.col("_o") / F.col("_x"), 6)).alias("alpha"), "blockers")


def control_performance(events: DataFrame, truth: DataFrame) -> DataFrame:
    """Per reviewer on items with known truth: accuracy, false positive and negative rate, unviewable share."""
    both = events.join(truth, "item_id")
    o, t = F.col("outcome"), F.col("truth")
    decided = o.isin(*DECISIVE)
    rate = lambda a, b: F.when(F.count_if(b) > 0, F.round(F.count_if(a) / F.count_if(b), 6))
    return both.groupBy("reviewer_id").agg(F.count("*").alias("n"), rate(decided & (o == t), decided).alias("accuracy"), rate((o == "yes") & (t == "no"), decided & (t == "no")).alias("false_positive_rate"),
                                           rate((o == "no") & (t == "yes"), decided & (t == "yes")).alias("false_negative_rate"), rate(o == "cant_view", F.lit(True)).alias("unviewable_rate"))


def reviewed_labels(events: DataFrame) -> DataFrame:
    """Effective decision per item: conflict, uncertain, yes or no, with the events that it rests on."""
    latest = latest_event_per_reviewer(events)
    o = F.col("outcome")
    per = latest.groupBy("item_id").agg(F.count_if(o == "yes").alias("yes"), F.count_if(o == "no").alias("no"), F.array_sort(F.collect_set("event_id")).alias("effective_event_ids"), F.max("reviewed_at").alias("reviewed_at"))
    level = F.when((F.col("yes") > 0) & (F.col("no") > 0), "conflict").when(F.col("yes") > 0, "yes").when(F.col("no") > 0, "no").otherwise("uncertain")
    return per.select("item_id", level.alias("label_level"), F.when(level.isin("yes", "no"), level == "yes").alias("target_present"), "reviewed_at", "effective_event_ids")


def decision_import_rows(events: DataFrame) -> DataFrame:
    """Live events with a scientific outcome as import rows."""
    decision = F.when(F.col("outcome") == "yes", "accept").when(F.col("outcome") == "no", "reject").when(F.col("outcome") == "cant_tell", "uncertain")
    return not_superseded(events).withColumn("decision", decision).filter(F.col("decision").isNotNull()).select("event_id", "item_id", F.col("reviewer_id").cast("string").alias("reviewer"), "decision", "reviewed_at")


def project_cell_review(consensus: DataFrame, bindings: DataFrame) -> DataFrame:
    """Items' review states by the cells that they are bound to; an item without events is pending."""
    s, o = F.coalesce("status", F.lit("pending")), F.col("consensus_outcome")
    states = {"reviewed_target_positive": s.isin(*RESOLVED) & (o == "yes"), "reviewed_non_target": s.isin(*RESOLVED) & (o == "no"), "uncertain": s.isin("unresolved_disagreement", "uncertain_only"),
              "media_failure": s == "media_failure", "skipped": s == "deferred", "pending": s == "pending"}
    return bindings.join(consensus, "item_id", "left").groupBy("cell_id").agg(F.count("*").alias("items"), *[F.count_if(x).alias(k) for k, x in states.items()], F.count_if(s.isin(*RESOLVED)).alias("decisively_reviewed"))


def milestone_gate(counts: DataFrame, milestones: list[int], evaluated: list[int]) -> DataFrame:
    """Per row: release is evaluated only if the decisive count is a declared milestone not evaluated before; missed ones are listed."""
    declared, done, n = F.array(*map(F.lit, milestones)), F.array(*map(F.lit, evaluated)).cast("array<int>"), F.col("decisive")
    hit = F.array_contains(declared, n.cast("int")) & ~F.array_contains(done, n.cast("int"))
    missed = F.filter(F.array_except(declared, done), lambda m: m < n)
    return counts.withColumn("status", F.when(hit, "evaluate").otherwise("wait")).withColumn("missed", missed)


def quality_gate(estimates: DataFrame, least_precision: float, least_decisive: int) -> DataFrame:
    """A release decision with its blockers, from a row of precision, decisive count and open conflicts."""
    blockers = F.array_compact(F.array(F.when(F.col("precision").isNull(), F.lit("precision_unavailable")), F.when(F.col("precision") < least_precision, F.lit("precision_low")),
                                       F.when(F.col("decisive") < least_decisive, F.lit("too_few_decisive")), F.when(F.col("conflicts") > 0, F.lit("open_conflicts"))))
    return estimates.withColumn("blockers", blockers).withColumn("decision", F.when(F.size(blockers) == 0, "release").otherwise("hold"))


def milestone_import_check(batch: DataFrame, events: DataFrame, least: int = 20) -> DataFrame:
    """One row: size, source events that are unknown, and whether the batch is large enough."""
    unknown = batch.select(F.explode("source_event_ids").alias("event_id")).join(events.select("event_id"), "event_id", "left_anti").agg(F.count("*").alias("unknown_events"))
    return batch.agg(F.count("*").alias("n"), F.sum("weight").alias("weighted_total")).join(F.broadcast(unknown)).withColumn("accepted", (F.col("n") >= least) & (F.col("unknown_events") == 0))


def release_violations(decisions: DataFrame, consensus: DataFrame, gates: list[str]) -> DataFrame:
    """Ready rows that fail a gate, lack a date, or differ from the consensus: (item_id, problems)."""
    joined = decisions.filter("ready").join(consensus, "item_id", "left")
    problems = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(g), F.lit(False)), F.lit(g)) for g in gates], F.when(F.col("event_date").isNull(), F.lit("undated")),
                                       F.when(~F.coalesce(F.col("consensus_outcome") == "yes", F.lit(False)), F.lit("no_consensus"))))
    return joined.withColumn("problems", problems).filter(F.size("problems") > 0).select("item_id", "problems")


def priority_ranking(df: DataFrame, signals: dict[str, Column], item: str, seed: str, n: int) -> DataFrame:
    """Weighted sum of flags, doubling from the last; ties by seeded hash; rows without a signal are dropped."""
    weights = [1 << (len(signals) - 1 - i) for i in range(len(signals))]
    score = sum(F.when(c, w).otherwise(0) for w, c in zip(weights, signals.values()))
    return df.withColumn("priority", score).filter("priority > 0").orderBy(F.desc("priority"), F.sha2(F.concat_ws("|", F.lit(seed), F.col(item).cast("string")), 256)).limit(n)


def review_batch(df: DataFrame, objective: Column, order: list, n: int) -> DataFrame:
    return df.filter(objective).orderBy(*order).limit(n)
