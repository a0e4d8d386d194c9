"""Queries of the ledger and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import core as C
from verdigris.operators import ledger as L
from verdigris.operators import sampling as S
from verdigris.plans import roles as R
from verdigris.plans.registry import query

LIVE = f"SELECT * FROM ({R.LEDGER}) WHERE event_id NOT IN (SELECT supersedes_event_id FROM ({R.LEDGER}) WHERE supersedes_event_id IS NOT NULL)"
LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, reviewer_id ORDER BY reviewed_at DESC, review_round DESC, event_id DESC) AS rn FROM ({LIVE})) WHERE rn = 1"


@query(f"SELECT item_id, CAST(reviewer_id AS VARCHAR) AS reviewer_id, event_id, outcome FROM ({LATEST})")
def latest_event_per_reviewer(spark, d):
    return L.latest_event_per_reviewer(R.ledger(spark, d)).select("item_id", "reviewer_id", "event_id", "outcome")


@query(f"SELECT item_id, event_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY reviewed_at DESC, review_round DESC, CAST(reviewer_id AS VARCHAR) DESC, event_id DESC) AS rn FROM ({LIVE})) WHERE rn = 1")
def current_event_per_item(spark, d):
    return L.current_event_per_item(R.ledger(spark, d)).select("item_id", "event_id", "outcome")


@query(f"""WITH led AS (SELECT * REPLACE (CASE WHEN event_id % 501 = 0 THEN review_round + 1 ELSE review_round END AS review_round, CASE WHEN event_id % 300 = 0 THEN 5 ELSE supersedes_event_id END AS supersedes_event_id) FROM ({R.LEDGER}))
 SELECT 'round_gap' AS rule, event_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id, reviewer_id ORDER BY review_round, event_id) AS n FROM led) WHERE n <> review_round
 UNION ALL SELECT 'superseded_twice', max(event_id) FROM led WHERE supersedes_event_id IS NOT NULL GROUP BY supersedes_event_id HAVING count(*) > 1
 UNION ALL SELECT 'broken_link', a.event_id FROM led a LEFT JOIN led b ON a.supersedes_event_id = b.event_id WHERE a.supersedes_event_id IS NOT NULL AND (b.event_id IS NULL OR a.item_id <> b.item_id OR b.reviewed_at > a.reviewed_at)""")
def ledger_validation(spark, d):
    e = R.ledger(spark, d)
    broken = e.withColumns({"review_round": F.when(F.col("event_id") % 501 == 0, F.col("review_round") + 1).otherwise(F.col("review_round")), "supersedes_event_id": F.when(F.col("event_id") % 300 == 0, F.lit(5).cast("long")).otherwise(F.col("supersedes_event_id"))})
    return L.ledger_validation(broken)


FIELDS = ("outcome", "non_target_category", "alternative_taxon", "life_stage", "visual_domain", "view")
CONSENSUS = f"""WITH led AS MATERIALIZED ({R.LEDGER}), live AS (SELECT * FROM led WHERE event_id NOT IN (SELECT supersedes_event_id FROM led WHERE supersedes_event_id IS NOT NULL)),
 latest AS MATERIALIZED (SELECT *, event_type = 'review' AS src, outcome IN ('yes','no') AS dec FROM live QUALIFY row_number() OVER (PARTITION BY item_id, reviewer_id ORDER BY reviewed_at DESC, review_round DESC, event_id DESC) = 1),
 doubts AS (SELECT DISTINCT item_id FROM led u WHERE event_type = 'review' AND outcome = 'cant_tell' AND NOT EXISTS (SELECT 1 FROM latest x WHERE x.item_id = u.item_id AND x.src AND x.dec AND x.reviewer_id <> u.reviewer_id AND x.reviewed_at > u.reviewed_at)),
 per AS (SELECT item_id, count(*) AS reviewers, count(CASE WHEN dec THEN 1 END) AS decisive, count(CASE WHEN src AND dec THEN 1 END) AS sd, count(CASE WHEN src THEN 1 END) AS ns, count(CASE WHEN NOT src THEN 1 END) AS na,
  count(CASE WHEN src AND outcome = 'cant_tell' THEN 1 END) AS ct, count(CASE WHEN src AND outcome = 'cant_view' THEN 1 END) AS cv, {", ".join(f"count(CASE WHEN outcome = '{o}' THEN 1 END) AS n_{o}" for o in L.OUTCOMES)},
  {", ".join(f"count(DISTINCT CASE WHEN src AND dec THEN coalesce({f}, '') END) > 1 AS s_{f}, count(DISTINCT CASE WHEN NOT src THEN coalesce({f}, '') END) > 1 AS a_{f}" for f in FIELDS)},
  bool_or(src AND conflicts_with_decision_id IS NOT NULL) AS s_explicit_conflict_pointer, bool_or(NOT src AND conflicts_with_decision_id IS NOT NULL) AS a_explicit_conflict_pointer, max(CASE WHEN src AND dec THEN outcome END) AS s_out, max(CASE WHEN NOT src THEN outcome END) AS a_out,
  list_sort(list(event_id) FILTER (src AND (dec OR conflicts_with_decision_id IS NOT NULL))) AS s_ids, list_sort(list(event_id) FILTER (NOT src)) AS a_ids, coalesce(bool_or(dec AND duplicate_concern), false) AS duplicate_concern, coalesce(bool_or(dec AND event_id % 43 = 0), false) AS captive_concern FROM latest GROUP BY 1),
 named AS (SELECT *, item_id IN (SELECT item_id FROM doubts) AS unresolved_uncertainty, {", ".join("concat_ws(',', " + ", ".join(f"CASE WHEN {side}_{f} THEN '{f}' END" for f in sorted((*FIELDS, "explicit_conflict_pointer"))) + f") AS {side}_fields" for side in "sa")} FROM per),
 judged AS (SELECT *, CASE WHEN na > 0 AND a_fields <> '' THEN 'unresolved_disagreement' WHEN na > 0 THEN 'adjudicated' WHEN ns = 0 THEN 'pending' WHEN s_fields <> '' THEN 'unresolved_disagreement' WHEN sd = 0 AND ct > 0 THEN 'uncertain_only' WHEN sd = 0 AND cv > 0 THEN 'media_failure'
  WHEN sd = 0 THEN 'deferred' WHEN unresolved_uncertainty OR sd < 2 THEN 'pending' ELSE 'complete_agreement' END AS status FROM named)
 SELECT *, CASE WHEN status = 'adjudicated' THEN a_out WHEN status = 'complete_agreement' THEN s_out END AS consensus_outcome FROM judged"""


@query(f"""SELECT item_id, status, consensus_outcome, decisive, reviewers, CASE WHEN status <> 'unresolved_disagreement' THEN '' WHEN na > 0 THEN a_fields ELSE s_fields END AS conflicting_fields,
 CASE WHEN status <> 'unresolved_disagreement' THEN '' WHEN na > 0 THEN array_to_string(a_ids, ',') ELSE array_to_string(s_ids, ',') END AS conflict_event_ids, status IN ('unresolved_disagreement', 'uncertain_only') OR (status = 'pending' AND ns > 0) AS second_review_required,
 status = 'unresolved_disagreement' AS adjudication_required, unresolved_uncertainty FROM ({CONSENSUS})""")
def project_consensus(spark, d):
    out = L.project_consensus(R.ledger(spark, d)).withColumns({"conflicting_fields": F.array_join("conflicting_fields", ","), "conflict_event_ids": F.array_join(F.col("conflict_event_ids").cast("array<string>"), ",")})
    return out.select("item_id", "status", "consensus_outcome", "decisive", "reviewers", "conflicting_fields", "conflict_event_ids", "second_review_required", "adjudication_required", "unresolved_uncertainty")


@query(f"SELECT item_id, status, consensus_outcome, CASE WHEN status <> 'unresolved_disagreement' THEN '' WHEN na > 0 THEN a_fields ELSE s_fields END AS conflicting_fields FROM ({CONSENSUS})")
def consensus_expected_values(spark, d):
    """Reviewers leave out what they find as expected, now and then; the items say what was expected, and nothing changes."""
    n, ledger = F.col("event_id"), R.ledger(spark, d)
    usual = {"life_stage": ("adult", 2), "visual_domain": ("live_field", 3), "view": ("dorsal", 5)}
    silent = ledger.withColumns({f: F.when((F.col(f) != v) | (n % k > 0), F.col(f)) for f, (v, k) in usual.items()})
    items = ledger.select("item_id").distinct().withColumns({f"expected_{f}": F.lit(v) for f, (v, _) in usual.items()})
    out = L.project_consensus(silent, items=items)
    return out.select("item_id", "status", "consensus_outcome", F.array_join("conflicting_fields", ",").alias("conflicting_fields"))


ELIGIBLE = """SELECT item_id, CASE WHEN NOT support THEN '' ELSE concat_ws(',', CASE WHEN terms = '' THEN 'attribution_missing' END, CASE WHEN captive_concern THEN 'captive_or_cultivated_concern' END, CASE WHEN duplicate_concern THEN 'duplicate_concern' END, CASE WHEN NOT licence THEN 'licence_not_allowed' END, CASE WHEN done AND consensus_outcome <> 'yes' THEN 'not_verified' END,
 CASE WHEN NOT done THEN 'review_not_completed' END, CASE WHEN NOT known THEN 'source_provenance_missing' END, CASE WHEN done AND dom <> 'live_field' THEN 'visual_domain_not_support_eligible' END) END AS support_blockers,
 CASE WHEN support THEN '' ELSE concat_ws(',', CASE WHEN captive_concern THEN 'captive_or_cultivated_concern' END, CASE WHEN duplicate_concern THEN 'duplicate_concern' END, CASE WHEN p IS NULL THEN 'inclusion_probability_missing' END, CASE WHEN NOT done THEN 'review_not_completed' END) END AS final_blockers, support
 FROM (SELECT item_id, c_custkey % 2 = 0 AS support, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS terms, c_mktsegment <> 'BUILDING' AS licence, c_nationkey <> 3 AS known, CASE WHEN c_custkey % 5 <> 0 THEN 0.5 END AS p, status IN ('complete_agreement', 'adjudicated') AS done, consensus_outcome, duplicate_concern, captive_concern, dom
 FROM ({c}) JOIN customer ON item_id = c_custkey LEFT JOIN (SELECT item_id, min(CASE WHEN (event_type <> 'review') = (na > 0) THEN visual_domain END) AS dom FROM ({t}) JOIN (SELECT item_id, na FROM ({c})) USING (item_id) WHERE outcome IN ('yes','no') GROUP BY 1) USING (item_id))"""


@query(f"""SELECT item_id, CASE WHEN NOT support THEN 'not_applicable' WHEN support_blockers = '' THEN 'prepared' ELSE 'blocked' END AS support_eligibility, support_blockers, CASE WHEN support THEN 'not_applicable' WHEN final_blockers = '' THEN 'eligible' ELSE 'blocked' END AS final_test_eligibility, final_blockers FROM ({ELIGIBLE.format(c=CONSENSUS, t=LATEST)})""")
def consensus_eligibility(spark, d):
    """Blockers of use as reference support and in the final test, for items that are customers."""
    items = R.table(spark, d, "customer").withColumn("item_id", F.col("c_custkey"))
    rows = L.project_consensus(R.ledger(spark, d).withColumn("captive_concern", F.col("event_id") % 43 == 0)).join(items, "item_id")
    even = F.col("c_custkey") % 2 == 0
    out = L.support_eligibility(rows, even, F.col("c_nationkey") != 3, F.col("c_mktsegment") != "BUILDING", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")))
    out = L.final_test_eligibility(out, ~even, F.when(F.col("c_custkey") % 5 != 0, 0.5))
    return out.select("item_id", "support_eligibility", F.array_join("support_eligibility_blockers", ",").alias("support_blockers"), "final_test_eligibility", F.array_join("final_test_eligibility_blockers", ",").alias("final_blockers"))


@query(f"""SELECT event_id, item_id FROM ({R.LEDGER}) a WHERE outcome = 'cant_tell' AND event_type = 'review' AND NOT EXISTS (SELECT 1 FROM ({LATEST}) b WHERE b.item_id = a.item_id AND b.event_type = 'review' AND b.outcome IN ('yes','no') AND b.reviewed_at > a.reviewed_at AND b.reviewer_id <> a.reviewer_id)""")
def unresolved_uncertainty(spark, d):
    return L.unresolved_uncertainty(R.ledger(spark, d)).select("event_id", "item_id")


@query(f"""SELECT count(*) AS items, count(CASE WHEN reviewers > 0 THEN 1 END) AS attempted_items, count(CASE WHEN status IN ('complete_agreement','adjudicated') THEN 1 END) AS decisive_items, count(CASE WHEN consensus_outcome = 'yes' THEN 1 END) AS yes_items, count(CASE WHEN consensus_outcome = 'no' THEN 1 END) AS no_items,
 count(CASE WHEN status IN ('uncertain_only','unresolved_disagreement') THEN 1 END) AS uncertain_items, count(CASE WHEN status = 'media_failure' THEN 1 END) AS media_failure_items, count(CASE WHEN status = 'deferred' THEN 1 END) AS deferred_items, count(CASE WHEN coalesce(status, 'pending') = 'pending' THEN 1 END) AS pending_items,
 CAST(sum(reviewers) AS BIGINT) AS reviews, {", ".join(f"CAST(sum(n_{o}) AS BIGINT) AS {o}_reviews" for o in L.OUTCOMES)}, count(CASE WHEN opened OR verified THEN 1 END) AS inspected_items, count(CASE WHEN opened AND verified THEN 1 END) AS viewable_items,
 round(count(reviewers) * 1.0 / count(*), 6) AS review_coverage, round(count(CASE WHEN opened OR verified THEN 1 END) * 1.0 / count(*), 6) AS inspection_coverage, round(count(CASE WHEN opened AND verified THEN 1 END) * 1.0 / count(CASE WHEN opened OR verified THEN 1 END), 6) AS viewability_rate
 FROM (SELECT c_custkey AS item_id, c_acctbal > 0 AS opened, c_acctbal > 500 AS verified FROM customer) LEFT JOIN ({CONSENSUS}) USING (item_id)""")
def verification_coverage(spark, d):
    items = R.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"))
    seen = R.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), (F.col("c_acctbal") > 0).alias("image_opened"), (F.col("c_acctbal") > 500).alias("image_verified"), F.lit(None).cast("string").alias("image_failure_reason"))
    return L.verification_coverage(items, L.project_consensus(R.ledger(spark, d)), seen)


RATINGS = f"SELECT item_id, reviewer_id, outcome AS label FROM ({LATEST}) WHERE outcome IN ('yes','no','cant_tell')"


def _ratings(spark, d):
    return L.latest_event_per_reviewer(R.ledger(spark, d)).filter("outcome IN ('yes','no','cant_tell')").select("item_id", F.col("outcome").alias("label"), "reviewer_id")


@query(f"""SELECT count(DISTINCT item_id) AS items, count(*) AS pairs, round(sum(CASE WHEN la = lb THEN 1.0 ELSE 0 END) / count(*), 6) AS agreement FROM (SELECT a.item_id, a.label AS la, b.label AS lb FROM ({RATINGS}) a JOIN ({RATINGS}) b ON a.item_id = b.item_id AND a.reviewer_id < b.reviewer_id)""")
def percent_agreement(spark, d):
    return L.percent_agreement(_ratings(spark, d))


@query(f"""WITH r AS (SELECT item_id // 3 AS campaign, item_id, label FROM ({RATINGS})), c AS (SELECT campaign, item_id, label, n, sum(n) OVER (PARTITION BY item_id) AS t FROM (SELECT campaign, item_id, label, count(*) AS n FROM r GROUP BY 1, 2, 3)), p AS (SELECT * FROM c WHERE t > 1),
 o AS (SELECT campaign, count(*) AS items, sum(t) AS m, sum((t * (t - 1) - s) * 1.0 / (t - 1)) AS dis FROM (SELECT campaign, item_id, any_value(t) AS t, sum(n * (n - 1)) AS s FROM p GROUP BY 1, 2) GROUP BY 1), k AS (SELECT campaign, sum(x * x) AS kk FROM (SELECT campaign, label, sum(n) AS x FROM p GROUP BY 1, 2) GROUP BY 1),
 j AS (SELECT campaign, coalesce(items, 0) AS items, coalesce(m, 0) AS m, dis / m AS ob, (m * m - kk) * 1.0 / (m * (m - 1)) AS ex FROM (SELECT DISTINCT campaign FROM r) LEFT JOIN o USING (campaign) LEFT JOIN k USING (campaign))
 SELECT campaign, items AS overlapping_items, CAST(m AS BIGINT) AS ratings, CASE WHEN b = '' THEN round(ob, 6) END AS observed_disagreement, CASE WHEN b = '' THEN round(ex, 6) END AS expected_disagreement, CASE WHEN b = '' THEN round(1 - ob / ex, 6) + 0.0::DOUBLE END AS alpha, b AS blockers
 FROM (SELECT *, concat_ws(',', CASE WHEN ex IS NULL OR ex = 0 THEN 'label_variation_absent' END, CASE WHEN items < 2 THEN 'reviewer_overlap_insufficient' END) AS b FROM j)""")
def krippendorff_alpha_nominal(spark, d):
    return L.krippendorff_alpha_nominal(_ratings(spark, d).withColumn("campaign", F.floor(F.col("item_id") / 3)), ["campaign"]).withColumn("blockers", F.array_join("blockers", ","))


@query(f"""SELECT reviewer_id, count(*) AS n, round(count(CASE WHEN outcome = truth THEN 1 END) * 1.0 / nullif(count(CASE WHEN outcome IN ('yes','no') THEN 1 END), 0), 6) AS accuracy,
 round(count(CASE WHEN outcome = 'yes' AND truth = 'no' THEN 1 END) * 1.0 / nullif(count(CASE WHEN outcome IN ('yes','no') AND truth = 'no' THEN 1 END), 0), 6) AS false_positive_rate,
 round(count(CASE WHEN outcome = 'no' AND truth = 'yes' THEN 1 END) * 1.0 / nullif(count(CASE WHEN outcome IN ('yes','no') AND truth = 'yes' THEN 1 END), 0), 6) AS false_negative_rate, round(count(CASE WHEN outcome = 'cant_view' THEN 1 END) * 1.0 / count(*), 6) AS unviewable_rate
 FROM ({R.LEDGER}) JOIN (SELECT c_custkey AS item_id, CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS truth FROM customer) USING (item_id) GROUP BY 1""")
def control_performance(spark, d):
    truth = R.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.when(F.col("c_acctbal") > 0, "yes").otherwise("no").alias("truth"))
    return L.control_performance(R.ledger(spark, d), truth)


@query(f"""SELECT item_id, level AS label_level, CASE WHEN level IN ('yes','no') THEN level = 'yes' END AS target_present, array_to_string(ids, ',') AS effective_event_ids FROM (SELECT item_id, CASE WHEN count(CASE WHEN outcome = 'yes' THEN 1 END) > 0 AND count(CASE WHEN outcome = 'no' THEN 1 END) > 0 THEN 'conflict'
 WHEN count(CASE WHEN outcome = 'yes' THEN 1 END) > 0 THEN 'yes' WHEN count(CASE WHEN outcome = 'no' THEN 1 END) > 0 THEN 'no' ELSE 'uncertain' END AS level, list_sort(list(DISTINCT event_id)) AS ids FROM ({LATEST}) GROUP BY 1)""")
def reviewed_labels(spark, d):
    return L.reviewed_labels(R.ledger(spark, d)).select("item_id", "label_level", "target_present", F.array_join(F.col("effective_event_ids").cast("array<string>"), ",").alias("effective_event_ids"))


@query(f"SELECT event_id, item_id, CAST(reviewer_id AS VARCHAR) AS reviewer, CASE outcome WHEN 'yes' THEN 'accept' WHEN 'no' THEN 'reject' ELSE 'uncertain' END AS decision FROM ({LIVE}) WHERE outcome IN ('yes','no','cant_tell')")
def decision_import_rows(spark, d):
    return L.decision_import_rows(R.ledger(spark, d)).drop("reviewed_at")


@query(f"""SELECT cell_id, count(*) AS items, count(CASE WHEN consensus_outcome = 'yes' THEN 1 END) AS reviewed_target_positive, count(CASE WHEN consensus_outcome = 'no' THEN 1 END) AS reviewed_non_target, count(CASE WHEN status IN ('unresolved_disagreement','uncertain_only') THEN 1 END) AS uncertain,
 count(CASE WHEN status = 'media_failure' THEN 1 END) AS media_failure, count(CASE WHEN status = 'deferred' THEN 1 END) AS skipped, count(CASE WHEN coalesce(status, 'pending') = 'pending' THEN 1 END) AS pending, count(consensus_outcome) AS decisively_reviewed FROM (SELECT c_custkey AS item_id, c_mktsegment AS cell_id FROM customer) LEFT JOIN ({CONSENSUS}) USING (item_id) GROUP BY 1""")
def project_cell_review(spark, d):
    bindings = R.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("cell_id"))
    return L.project_cell_review(L.project_consensus(R.ledger(spark, d)), bindings)


@query(f"""SELECT item_id, decisive, CASE WHEN decisive IN (2, 4) THEN 'evaluate' ELSE 'wait' END AS status, concat_ws(',', CASE WHEN decisive > 2 THEN '2' END, CASE WHEN decisive > 4 THEN '4' END) AS missed FROM (SELECT item_id, count(*) AS decisive FROM ({R.LEDGER}) WHERE outcome IN ('yes','no') GROUP BY 1)""")
def milestone_gate(spark, d):
    n = R.ledger(spark, d).filter("outcome IN ('yes','no')").groupBy("item_id").agg(F.count("*").alias("decisive"))
    return L.milestone_gate(n, [1, 2, 4], [1]).withColumn("missed", F.array_join(F.col("missed").cast("array<string>"), ","))


@query(f"""SELECT lang, n, precision, low, CASE WHEN precision >= 0.85 AND n >= 20 THEN 'release' ELSE 'hold' END AS decision FROM (SELECT lang, count(*) AS n, round(count(CASE WHEN truth THEN 1 END) * 1.0 / count(*), 6) AS precision,
 round((count(CASE WHEN truth THEN 1 END) * 1.0 / count(*) + 1.959963984540054 * 1.959963984540054 / (2.0 * count(*)) - 1.959963984540054 * sqrt(count(CASE WHEN truth THEN 1 END) * 1.0 / count(*) * (1 - count(CASE WHEN truth THEN 1 END) * 1.0 / count(*)) / count(*) + 1.959963984540054 * 1.959963984540054 / (4.0 * count(*) * count(*)))) / (1 + 1.959963984540054 * 1.959963984540054 / count(*)), 6) AS low FROM ({R.DECISIONS}) GROUP BY 1)""")
def quality_gate(spark, d):
    est = S.precision_wilson(R.decisions(spark, d), F.col("truth"), ["lang"]).withColumn("decisive", F.col("n")).withColumn("conflicts", F.lit(0))
    return L.quality_gate(est, 0.85, 20).select("lang", "n", "precision", "low", "decision")


@query(f"""SELECT (SELECT count(DISTINCT item_id) FROM ({R.LEDGER})) AS n, CAST((SELECT count(*) FROM ({LIVE})) AS DOUBLE) AS weighted_total, (SELECT count(*) FROM ({LIVE}) WHERE event_id NOT IN (SELECT event_id FROM events WHERE value > 5)) AS unknown_events, false AS accepted""")
def milestone_import_check(spark, d):
    batch = L.not_superseded(R.ledger(spark, d)).groupBy("item_id").agg(F.collect_list("event_id").alias("source_event_ids"), F.count("*").cast("double").alias("weight"))
    every = R.ledger(spark, d).select("item_id").distinct().join(batch, "item_id", "left")
    return L.milestone_import_check(every, R.table(spark, d, "events").filter("value > 5"))


@query(f"""SELECT item_id, concat_ws(',', CASE WHEN NOT g1 THEN 'g1' END, CASE WHEN NOT g2 THEN 'g2' END, CASE WHEN consensus_outcome IS DISTINCT FROM 'yes' THEN 'no_consensus' END) AS problems FROM (SELECT c_custkey AS item_id, c_acctbal > 0 AS g1, c_mktsegment <> 'BUILDING' AS g2 FROM customer WHERE c_nationkey < 10)
 LEFT JOIN ({CONSENSUS}) USING (item_id) WHERE NOT g1 OR NOT g2 OR consensus_outcome IS DISTINCT FROM 'yes'""")
def release_gate(spark, d):
    rows = R.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), (F.col("c_nationkey") < 10).alias("ready"), (F.col("c_acctbal") > 0).alias("g1"), (F.col("c_mktsegment") != "BUILDING").alias("g2"), F.current_date().alias("event_date"))
    return L.release_violations(rows, L.project_consensus(R.ledger(spark, d)), ["g1", "g2"]).withColumn("problems", F.array_join("problems", ","))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 4 ELSE 0 END + CASE WHEN quality = 0 THEN 2 ELSE 0 END + CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END AS priority FROM documents JOIN labels USING (doc_id)
 WHERE toxic = 1 OR quality = 0 OR n_chars > 5000 ORDER BY priority DESC, sha256('s|' || doc_id) LIMIT 50""")
def priority_ranking(spark, d):
    rows = R.table(spark, d, "documents").join(R.table(spark, d, "labels"), "doc_id")
    signals = {"toxic": F.col("toxic") == 1, "poor": F.col("quality") == 0, "long": F.col("n_chars") > 5000}
    return L.priority_ranking(rows, signals, "doc_id", "s", 50).select("doc_id", "priority")


@query(f"SELECT item_id, event_date FROM ({R.CANDIDATES}) WHERE state = 'pending' ORDER BY event_date, item_id LIMIT 40")
def review_batch(spark, d):
    return L.review_batch(R.candidates(spark, d), F.col("state") == "pending", ["event_date", "item_id"], 40).select("item_id", "event_date")


@query(f"""SELECT item_id, stratum, round(least(n, pop) * 1.0 / pop, 6) AS inclusion_probability, round(pop * 1.0 / least(n, pop), 6) AS sampling_weight FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS pop, row_number() OVER (PARTITION BY stratum ORDER BY sha256('seed|' || item_id), item_id) AS rn,
 CASE WHEN stratum = 'en' THEN 60 ELSE 30 END AS n FROM ({R.POPULATION})) WHERE rn <= n""")
def stratified_sample(spark, d):
    out = S.stratified_sample(R.population(spark, d), "stratum", "item_id", {"en": 60}, 30, "seed")
    return out.select("item_id", "stratum", F.round("inclusion_probability", 6).alias("inclusion_probability"), F.round("sampling_weight", 6).alias("sampling_weight"))


@query(f"SELECT stratum, count(*) AS population, CAST(least(count(*), CASE WHEN stratum = 'fr' THEN 0 ELSE 25 END) AS BIGINT) AS sampled, stratum = 'fr' AS zero_take FROM ({R.POPULATION}) GROUP BY 1")
def stratum_receipts(spark, d):
    p = R.population(spark, d)
    return S.stratum_receipts(p, S.stratified_sample(p, "stratum", "item_id", {"fr": 0}, 25, "seed"), "stratum")


@query(f"SELECT item_id, sha256('seed|' || item_id) AS rank_hash FROM ({R.POPULATION})")
def seeded_rank(spark, d):
    return R.population(spark, d).select("item_id", S.seeded_rank("seed", "item_id").alias("rank_hash"))


@query(f"SELECT source, item_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN stratum = 'es' THEN 0 ELSE 1 END, sha256('seed|' || item_id), item_id) AS rn FROM ({R.POPULATION})) WHERE rn = 1")
def canonical_per_owner(spark, d):
    return S.canonical_per_owner(R.population(spark, d), "source", "item_id", F.when(F.col("stratum") == "es", 0).otherwise(1), "seed").select("source", "item_id")


@query(f"SELECT group_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sha256('seed|' || item_id), item_id) AS rn FROM ({R.POPULATION})) WHERE rn = 1")
def one_per_group_seeded(spark, d):
    return S.one_per_group_seeded(R.population(spark, d), "group_id", "item_id", "seed").select("group_id", "item_id")


@query(f"SELECT group_id, min(item_id) AS item_id, count(DISTINCT item_id) - 1 AS omitted FROM ({R.POPULATION}) GROUP BY 1")
def canonical_per_duplicate_group(spark, d):
    return S.canonical_per_duplicate_group(R.population(spark, d), "group_id", "item_id")


@query(f"""WITH p AS (SELECT *, sha256('seed|' || item_id) AS h FROM ({R.POPULATION})), a AS (SELECT item_id FROM p WHERE toxic = 1 ORDER BY h, item_id LIMIT 20), b AS (SELECT item_id FROM p WHERE quality = 0 AND item_id NOT IN (SELECT item_id FROM a) ORDER BY h, item_id LIMIT 20),
 c AS (SELECT item_id FROM p WHERE stratum = 'en' AND item_id NOT IN (SELECT item_id FROM a) AND item_id NOT IN (SELECT item_id FROM b) ORDER BY h, item_id LIMIT 30) SELECT item_id, 'toxic' AS quota FROM a UNION ALL SELECT item_id, 'poor' FROM b UNION ALL SELECT item_id, 'english' FROM c""")
def quota_select_sequential(spark, d):
    quotas = [("toxic", F.col("toxic") == 1, 20), ("poor", F.col("quality") == 0, 20), ("english", F.col("stratum") == "en", 30)]
    return S.quota_select_sequential(R.population(spark, d), "item_id", quotas, "seed")


@query(f"""SELECT dimension, value, count(*) AS population, count(CASE WHEN s THEN 1 END) AS selected, count(CASE WHEN s THEN 1 END) = 0 AS zero_take, round(count(CASE WHEN s THEN 1 END) * 1.0 / count(*), 6) AS rate FROM (SELECT quality IS NOT NULL AS s, unnest(['stratum', 'source', 'split']) AS dimension, unnest([stratum, source, split]) AS value FROM ({R.POPULATION})) GROUP BY 1, 2""")
def audit_strata_report(spark, d):
    return S.audit_strata_report(R.population(spark, d), F.col("quality").isNotNull(), ["stratum", "source", "split"])


@query("""SELECT p_partkey, cell_id, CASE WHEN n IS NULL THEN 'unsupported' WHEN n > 0 THEN 'covered' ELSE 'gap' END AS coverage_state FROM (SELECT p_partkey, CASE WHEN p_size <= 20 THEN p_type ELSE p_brand END AS cell_id FROM part) LEFT JOIN (SELECT p_brand AS cell_id, count(CASE WHEN p_retailprice > 1900 THEN 1 END) AS n FROM part GROUP BY 1) USING (cell_id)""")
def audit_cell_binding(spark, d):
    p = R.table(spark, d, "part")
    cells = p.groupBy(F.col("p_brand").alias("cell_id")).agg(F.count_if(F.col("p_retailprice") > 1900).alias("support"))
    return S.audit_cell_binding(p, cells, "p_size", "p_type", "p_brand").select("p_partkey", "cell_id", "coverage_state")


@query("SELECT p_partkey, round(0.25 * p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 9) AS normalised_weight FROM part")
def normalised_weights(spark, d):
    return S.normalised_weights(R.table(spark, d, "part").withColumn("declared", F.lit(0.25)), "p_brand", "declared", "p_retailprice").select("p_partkey", F.round("normalised_weight", 9).alias("normalised_weight"))


WILSON = "(({p} + {z}*{z}/(2*{n}) {s} {z}*sqrt({p}*(1-{p})/{n} + {z}*{z}/(4*{n}*{n}))) / (1 + {z}*{z}/{n}))"
Z = "1.959963984540054"


@query(f"""SELECT lang, n, k, CASE WHEN b = '' THEN round(p, 6) END AS precision, CASE WHEN b = '' THEN round({WILSON.format(p='p', n='n::DOUBLE', z=Z, s='-')}, 6) END AS low, CASE WHEN b = '' THEN round({WILSON.format(p='p', n='n::DOUBLE', z=Z, s='+')}, 6) END AS high, b AS blockers
 FROM (SELECT *, concat_ws(',', CASE WHEN n = 0 THEN 'decisive_sample_empty' END, CASE WHEN unknown THEN 'inclusion_probability_missing' END, CASE WHEN unequal THEN 'inclusion_probability_unequal' END) AS b FROM (SELECT lang, count(truth) AS n, count(CASE WHEN truth THEN 1 END) AS k, count(CASE WHEN truth THEN 1 END) * 1.0::DOUBLE / nullif(count(truth), 0) AS p,
 bool_or(chance IS NULL) AS unknown, count(DISTINCT chance) > 1 AS unequal FROM (SELECT lang, truth, CASE WHEN lang = 'de' THEN 0.25 WHEN lang = 'fr' AND sample_id % 2 = 0 THEN NULL WHEN lang = 'es' THEN 1 / (2.0 + sample_id % 2) ELSE 0.5 END AS chance FROM ({R.DECISIONS})) GROUP BY 1))""")
def precision_wilson(spark, d):
    n = F.col("sample_id")
    chance = F.when(F.col("lang") == "de", 0.25).when((F.col("lang") == "fr") & (n % 2 == 0), None).when(F.col("lang") == "es", 1 / (2.0 + n % 2)).otherwise(0.5)
    return S.precision_wilson(R.decisions(spark, d).withColumn("chance", chance), F.col("truth"), ["lang"], inclusion="chance").withColumn("blockers", F.array_join("blockers", ","))


@query(f"""WITH r AS (SELECT coalesce(lang, '') AS lang, truth, weight::DOUBLE AS w FROM ({R.DECISIONS})), s AS (SELECT lang, sum(w) AS sw FROM r GROUP BY 1), a AS (SELECT truth, CASE lang WHEN 'en' THEN 0.5 * w / sw WHEN 'de' THEN 0.25 * w / sw ELSE w END AS w FROM r JOIN s USING (lang)),
 t AS (SELECT count(*) AS n, sum(CASE WHEN truth THEN w ELSE 0 END) / sum(w) AS p, sum(w) * sum(w) / sum(w * w) AS e FROM a)
 SELECT n, round(e, 6) AS effective_n, round(p, 6) AS precision, round({WILSON.format(p='p', n='e', z=Z, s='-')}, 6) AS low, round({WILSON.format(p='p', n='e', z=Z, s='+')}, 6) AS high, 0 AS missing_strata, '' AS blockers FROM t""")
def precision_hajek(spark, d):
    rows = R.decisions(spark, d).withColumns({"lang": F.coalesce("lang", F.lit("")), "chance": 1 / F.col("weight")})
    plan = rows.select(F.col("lang").alias("stratum")).distinct().withColumn("population_weight", F.when(F.col("stratum") == "en", 0.5).when(F.col("stratum") == "de", 0.25))
    return S.precision_hajek(rows, "lang", "chance", F.col("truth"), plan).withColumn("blockers", F.array_join("blockers", ","))


#: Groups by hand: `owner` joins pairs of samples and `place` runs of ten, so a group is a run of ten; samples of one parity are one stratum.
BOOTSTRAP = f"""WITH r AS (SELECT sample_id % 2 AS s, sample_id // 20 AS g, truth, weight::DOUBLE AS w FROM ({R.DECISIONS})), g AS (SELECT s, g, sum(w) AS w, sum(CASE WHEN truth THEN w ELSE 0 END) AS wy, min(id) AS id FROM (SELECT *, row_number() OVER () AS id FROM r) GROUP BY 1, 2),
 n AS (SELECT s, w, wy, row_number() OVER (PARTITION BY s ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM g), x AS (SELECT rep, sum(b.wy) / sum(b.w) AS p FROM (SELECT s, rep, CAST('0x' || substr(md5('1|' || s || '|' || i || '|' || rep), 1, 8) AS BIGINT) % n AS i FROM n, range(1, 101) t(rep)) a JOIN n b ON a.s = b.s AND a.i = b.i GROUP BY 1)
 SELECT (SELECT count(*) FROM g) AS groups, 100 AS replicates, round((SELECT sum(wy) / sum(w) FROM g), 6) AS precision, round(quantile_cont(p, 0.025), 6) AS low, round(quantile_cont(p, 0.975), 6) AS high, '' AS blockers FROM x"""


@query(BOOTSTRAP)
def precision_bootstrap(spark, d):
    n = F.col("sample_id")
    parity = (n % 2).cast("string")
    rows = R.decisions(spark, d).withColumns({"s": n % 2, "owner": F.concat_ws(":", parity, F.floor(n / 4).cast("string")), "place": F.concat_ws(":", parity, F.floor(n / 20).cast("string"))})
    return S.precision_bootstrap(rows, "s", "sample_id", ["owner", "place"], "weight", F.col("truth"), replicates=100, draws="hash").withColumn("blockers", F.array_join("blockers", ","))


@query()
def precision_bootstrap_split(spark, d):
    """The same with 400 replicates whose draws are split down a tree of groups; numpy's generators decide them, so tests and not SQL hold the interval."""
    n = F.col("sample_id")
    parity = (n % 2).cast("string")
    rows = R.decisions(spark, d).withColumns({"s": n % 2, "owner": F.concat_ws(":", parity, F.floor(n / 4).cast("string"))})
    return S.precision_bootstrap(rows, "s", "sample_id", ["owner"], "weight", F.col("truth"), replicates=400).withColumn("blockers", F.array_join("blockers", ","))


@query(f"""SELECT dimension, value, count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS supported, count(CASE WHEN quality = 0 THEN 1 END) AS rejected, round(coalesce(sum(CASE WHEN quality = 1 THEN w END), 0) / sum(CASE WHEN quality IS NOT NULL THEN w END), 6) AS weighted_precision FROM
 (SELECT quality, 1 / (CASE WHEN stratum = 'en' THEN 0.5 ELSE 0.25 END::DOUBLE) AS w, unnest(['stratum', 'source']) AS dimension, unnest([stratum, source]) AS value FROM ({R.POPULATION})) GROUP BY 1, 2""")
def dimension_quality(spark, d):
    p = R.population(spark, d).withColumns({"state": F.when(F.col("quality") == 1, "supported").when(F.col("quality") == 0, "rejected"), "probability": F.when(F.col("stratum") == "en", 0.5).otherwise(0.25)})
    return S.dimension_quality(p, ["stratum", "source"], "state", "probability")


@query(f"""SELECT bin, n, round(mp, 6) AS mean_p, round(ob, 6) AS observed, round(abs(mp - ob), 6) AS gap, round(abs(mp - ob) * w / sum(w) OVER (), 6) AS ece_term FROM (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, sum(weight)::DOUBLE AS w, sum(weight * p)::DOUBLE / sum(weight) AS mp, sum(CASE WHEN truth THEN weight ELSE 0 END)::DOUBLE / sum(weight) AS ob FROM (SELECT * REPLACE (weight::DOUBLE AS weight, p::DOUBLE AS p) FROM ({R.DECISIONS})) WHERE p IS NOT NULL GROUP BY 1)""")
def calibration_and_slices(spark, d):
    return S.calibration_bins(R.decisions(spark, d), "p", F.col("truth"), "weight")


@query(f"""SELECT item_id, state AS review_state, state <> 'pending' AS reviewed, state = 'reviewed_target_positive' AS supported FROM (SELECT item_id, CASE WHEN status = 'pending' THEN 'pending' WHEN consensus_outcome = 'yes' THEN 'reviewed_target_positive' WHEN consensus_outcome = 'no' THEN 'reviewed_non_target'
 WHEN status IN ('uncertain_only','unresolved_disagreement') THEN 'uncertain' ELSE status END AS state FROM ({CONSENSUS}))""")
def map_review_state(spark, d):
    return L.project_consensus(R.ledger(spark, d)).withColumns(C.map_review_state()).select("item_id", "review_state", "reviewed", "supported")
