"""Hand-made fixtures for rules that fail closed, estimators and spatial edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.operators import core as C
from verdigris.operators import coverage as V
from verdigris.operators import identity as I
from verdigris.operators import ledger as L
from verdigris.operators import replay as R
from verdigris.operators import sampling as S
from verdigris.operators import scores as P
from verdigris.operators import spatial as G
from verdigris.plans.routing import ROUTES, TEXTS, THRESHOLDS
from verdigris.sources import tables as X
from verdigris.streaming import ledger as stream


def test_join_checked_refuses_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(C.ContractError):
        C.join_checked(left, right, ["k"])
    with pytest.raises(C.ContractError):
        C.join_checked(left, right.limit(1), ["k"], validate="1:1")
    assert C.join_checked(left, right.limit(1), ["k"]).count() == 3


def test_schema_and_rules_fail_closed(spark):
    df = spark.createDataFrame([(1, None), (-1, "x")], "n int, s string")
    with pytest.raises(C.ContractError):
        C.assert_schema(df, T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType())]))
    with pytest.raises(C.ContractError):
        C.validate_rules(df, {"positive": F.col("n") > 0, "named": F.col("s") != ""})
    assert C.rule_violations(df, {"positive": F.col("n") > 0, "named": F.col("s") != ""}).first().asDict() == {"positive": 1, "named": 1}
    with pytest.raises(C.ContractError):
        C.attach_scope(df, df, ["n"])
    with pytest.raises(C.ContractError):
        C.orphan_check(df, df.filter("n > 0"), ["n"])


def test_fingerprint_does_not_depend_on_order(spark):
    df = spark.range(200).withColumn("v", F.col("id") % 7)
    a = C.dataset_fingerprint(df).first()
    assert a == C.dataset_fingerprint(df.repartition(7, "v")).first()
    assert a != C.dataset_fingerprint(df.filter("id <> 3")).first()


def test_symmetric_diff_counts_multiplicity(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert sorted(map(tuple, C.symmetric_diff(a, b).collect())) == [(1, "expected"), (2, "actual")]


def test_rollup_level_comes_from_grouping_id(spark):
    df = spark.createDataFrame([("A", None, 1), ("A", "x", 2)], "continent string, country string, n int")
    out = V.hierarchy_rollup(df, ["continent", "country"], ["n"], {})
    assert sorted((r.scope_level, r.n) for r in out.collect()) == [("continent", 3), ("country", 1), ("country", 2), ("global", 3)]


def test_uplift_without_baseline_is_null(spark):
    row = V.coverage_uplift(spark.createDataFrame([(0, 5)], "baseline_items int, candidate_items int")).first()
    assert row.uplift_percent is None and row.uplift_state == "zero_denominator"


def test_scope_ancestors_find_cycles_and_orphans(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "zz"), ("d", None)], "node_id string, parent_id string")
    out = {r.node_id: (r.cycle, r.orphan) for r in V.scope_ancestors(df).collect()}
    assert out["a"][0] and out["b"][0] and out["c"] == (False, True) and out["d"] == (False, False)


def test_url_rules(spark):
    cases = {"HTTP://A.Example:80/x?y=1#z": "http://a.example/x?y=1", "https://b.example": "https://b.example/", "https://u:p@b.example/": None, "ftp://c.example/": None, "http://d.example:8080/": "http://d.example:8080/"}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", I.normalize_url(F.col("u")).alias("n"))
    assert {r.u: r.n for r in df.collect()} == cases


def test_link_groups_crosses_many_hops(spark):
    rows = [(i, f"k{i // 2}", f"m{(i + 1) // 2}") for i in range(40)] + [(100, None, None)]
    out = {r.i: r.group_id for r in I.link_groups(spark.createDataFrame(rows, "i int, a string, b string"), "i", ["a", "b"]).collect()}
    assert {out[i] for i in range(40)} == {0} and out[100] == 100


def test_link_groups_equal_a_search_and_shrink(spark, monkeypatch):
    """Random links, long chains and stars against a search; each round writes less than the one before."""
    sizes = []
    keep = I.written
    monkeypatch.setattr(I, "written", lambda df: (lambda out: (sizes.append((set(out.columns), out.count())), out)[1])(keep(df)))
    rng = np.random.default_rng(5)
    rows = [(int(i), f"a{rng.integers(150)}", f"b{rng.integers(150)}" if rng.random() < 0.3 else None) for i in rng.permutation(200)]
    chain = [int(x) for x in rng.permutation(120)]
    rows += [(1000 + x, f"c{k // 2}", f"d{(k + 1) // 2}") for k, x in enumerate(chain)] + [(5000 + i, "hub", None) for i in range(50)] + [(9000, None, None)]
    out = {r.i: r.group_id for r in I.link_groups(spark.createDataFrame(rows, "i int, a string, b string"), "i", ["a", "b"]).collect()}
    top = {r[0]: r[0] for r in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    first = {}
    for i, *keys in rows:
        for k in filter(None, keys):
            a, b = root(first.setdefault(k, i)), root(i)
            top[max(a, b)] = min(a, b)
    assert out == {i: root(i) for i in top}
    links = [n for columns, n in sizes if columns == {"a", "b"}]
    assert len(links) > 2 and all(x >= y for x, y in zip(links, links[1:])) and links[-1] == 0


def test_contradictions_are_counted_without_pairs(spark):
    rng = np.random.default_rng(14)
    rows = [(i, f"k{i % 3}" if i % 10 else None, *[None if rng.random() < 0.2 else str(rng.integers(3)) for _ in range(2)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, k string, f string, g string")
    summary, values = I.contradictions(df, "k", "id", ["f", "g"])
    pairs = {(r.k, r.field): (r["values"], r.rows, r.pairs) for r in summary.collect()}
    wanted, listed = {}, set()
    for x in rows:
        for y in rows:
            if x[1] and x[1] == y[1] and x[0] < y[0]:
                wrong = [n for n, a, b in (("f", x[2], y[2]), ("g", x[3], y[3])) if a is not None and b is not None and a != b]
                for n in wrong:
                    wanted[x[1], n] = wanted.get((x[1], n), 0) + 1
                if wrong:
                    listed.add((x[0], y[0], ",".join(wrong)))
    assert {k: v[2] for k, v in pairs.items()} == wanted and values.count() == sum(v[0] for v in pairs.values())
    classes, members = I.value_classes(df, "k", "id", ["f", "g"])
    home = {}
    for r in members.collect():
        home.setdefault((r.k, r.member), []).append(r.id)
    expanded = {(min(a, b), max(a, b), ",".join(r.contradictions)) for r in I.expand_contradictions(classes, "k", ["f", "g"]).collect() for a in home[r.k, r.left_member] for b in home[r.k, r.right_member]}
    assert expanded == listed
    some = I.expand_contradictions(classes, "k", ["f", "g"], spark.createDataFrame([("k1",)], "k string"))
    assert {r.k for r in some.collect()} == {"k1"}


EVENT = "event_id int, item_id int, reviewer_id string, outcome string, reviewed_at timestamp, review_round int, supersedes_event_id int, event_type string"


def _events(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(i, item, who, o, datetime(2024, 1, 1, i // 60, i % 60), rnd, sup, kind) for i, item, who, o, rnd, sup, kind in rows], EVENT)


def test_consensus_precedence(spark):
    e = _events(spark, [(1, 1, "a", "yes", 1, None, "review"), (2, 1, "b", "no", 1, None, "review"), (3, 1, "c", "yes", 1, None, "adjudication"), (4, 2, "a", "yes", 1, None, "review"), (5, 2, "b", "no", 1, None, "review"), (6, 2, "b", "yes", 2, 5, "review"),
                        (7, 3, "a", "yes", 1, None, "adjudication"), (8, 3, "b", "no", 1, None, "adjudication"), (9, 4, " ", "skipped", 1, None, "review"), (10, 5, "a", "cant_tell", 1, None, "review"), (11, 6, "a", "cant_view", 1, None, "review"), (12, 6, "b", "skipped", 1, None, "review"),
                        (13, 7, "a", "yes", 1, None, "review"), (14, 7, "b", "yes", 1, None, "review"), (15, 7, "c", "cant_tell", 1, None, "review"), (16, 8, "c", "cant_tell", 1, None, "review"), (17, 8, "a", "yes", 1, None, "review"), (18, 8, "b", "yes", 1, None, "review"),
                        (19, 9, "a", "yes", 1, None, "review"), (20, 10, "a", "yes", 1, None, "review"), (21, 10, "b", "no", 1, None, "review")])
    rows = {r.item_id: r for r in L.project_consensus(e).collect()}
    assert {k: (r.status, r.consensus_outcome) for k, r in rows.items()} == {
        1: ("adjudicated", "yes"), 2: ("complete_agreement", "yes"), 3: ("unresolved_disagreement", None), 4: ("deferred", None), 5: ("uncertain_only", None), 6: ("media_failure", None),
        7: ("pending", None), 8: ("complete_agreement", "yes"), 9: ("pending", None), 10: ("unresolved_disagreement", None)}
    assert rows[7].unresolved_uncertainty and not rows[8].unresolved_uncertainty and rows[10].conflicting_fields == ["outcome"] and rows[10].conflict_event_ids == [20, 21]
    assert [rows[i].second_review_required for i in (1, 3, 4, 5, 6, 7, 9)] == [False, True, False, True, False, True, True] and rows[3].adjudication_required
    assert {r.event_id for r in L.unresolved_uncertainty(e).collect()} == {10, 15}
    strict = {r.item_id: r.status for r in L.project_consensus(e, required=1, second_review="always").collect()}
    assert strict[9] == "pending" and {r.item_id: r.status for r in L.project_consensus(e, required=1).collect()}[9] == "complete_agreement"


def test_consensus_compares_the_whole_signature(spark):
    e = _events(spark, [(1, 1, "a", "no", 1, None, "review"), (2, 1, "b", "no", 1, None, "review"), (3, 2, "a", "yes", 1, None, "review"), (4, 2, "b", "yes", 1, None, "review"), (5, 3, "a", "yes", 1, None, "review"), (6, 3, "b", "skipped", 1, None, "review")])
    e = e.withColumns({"life_stage": F.when(F.col("event_id") == 2, "larva").otherwise("adult"), "visual_domain": F.when(F.col("item_id") == 2, "artwork").otherwise("live_field"), "conflicts_with_decision_id": F.when(F.col("event_id") == 6, 5), "duplicate_concern": F.lit(False)})
    out = L.project_consensus(e)
    rows = {r.item_id: r for r in out.collect()}
    assert rows[1].conflicting_fields == ["life_stage"] and rows[2].status == "complete_agreement" and rows[3].conflicting_fields == ["explicit_conflict_pointer"] and rows[3].conflict_event_ids == [5, 6]
    yes = F.lit(True)
    support = {r.item_id: (r.support_eligibility, r.support_eligibility_blockers) for r in L.support_eligibility(out, F.col("item_id") < 3, yes, yes, F.lit("somebody")).collect()}
    assert support == {1: ("blocked", ["review_not_completed"]), 2: ("blocked", ["visual_domain_not_support_eligible"]), 3: ("not_applicable", [])}
    final = {r.item_id: r.final_test_eligibility for r in L.final_test_eligibility(out, yes, F.lit(0.5)).collect()}
    assert final == {1: "blocked", 2: "eligible", 3: "blocked"}


def test_ledger_rules(spark):
    e = _events(spark, [(1, 1, "a", "yes", 1, None, "review"), (2, 1, "a", "no", 3, 1, "review"), (3, 2, "b", "no", 1, 1, "review")])
    found = {(r.rule, r.event_id) for r in L.ledger_validation(e).collect()}
    assert found == {("round_gap", 2), ("superseded_twice", 3), ("broken_link", 3)}


def test_agreement_and_alpha(spark):
    rows = [(1, "y"), (1, "y"), (2, "y"), (2, "n"), (3, "n"), (3, "n"), (4, "y")]
    df = spark.createDataFrame(rows, "item_id int, label string")
    assert L.percent_agreement(df).first().agreement == pytest.approx(2 / 3, abs=1e-6)
    do, de = 2 / 6, (36 - 9 - 9) / (6 * 5)
    row = L.krippendorff_alpha_nominal(df).first()
    assert row.alpha == pytest.approx(1 - do / de, abs=1e-6) and row.observed_disagreement == pytest.approx(do, abs=1e-6) and row.overlapping_items == 3
    assert L.krippendorff_alpha_nominal(df.filter("item_id = 2")).first().blockers == ["reviewer_overlap_insufficient"]
    assert L.krippendorff_alpha_nominal(df.filter("label = 'y' AND item_id <> 2")).first().blockers == ["label_variation_absent", "reviewer_overlap_insufficient"]
    assert L.krippendorff_alpha_nominal(df.filter("false")).first().alpha is None


def test_intervals(spark):
    df = spark.createDataFrame([(i, i < 8, 1.0) for i in range(10)], "i int, y boolean, w double")
    row = S.precision_wilson(df, F.col("y")).first()
    assert (row.precision, row.low, row.high) == (0.8, pytest.approx(0.490162, abs=1e-6), pytest.approx(0.943318, abs=1e-6))
    assert S.precision_wilson(df.filter("false"), F.col("y")).first().blockers == ["decisive_sample_empty"]
    assert S.precision_wilson(df.withColumn("q", 1 / (F.col("i") + 1)), F.col("y"), inclusion="q").first().blockers == ["inclusion_probability_unequal"]
    two = df.withColumns({"s": F.when(F.col("i") == 0, "b").otherwise("a"), "q": 1 / F.col("w")})
    plan = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "stratum string, population_weight double")
    row = S.precision_hajek(two, "s", "q", F.col("y"), plan).first()
    assert row.precision == pytest.approx((3 + 7 / 9) / 4, abs=1e-6) and row.blockers == []
    silent = two.withColumn("y", F.when(F.col("i") > 0, F.col("y")))
    assert S.precision_hajek(silent, "s", "q", F.col("y"), plan).first().blockers == ["sampling_strata_missing"]
    assert S.precision_hajek(two, "s", "q", F.col("y"), plan.filter("stratum = 'a'")).first().blockers == ["sampling_stratum_undeclared"]


def test_bootstrap_links_groups_and_is_the_same_under_any_partitioning(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("string").alias("s"), F.col("id"), F.lit(1.0).alias("w"), (F.col("id") % 4 > 0).alias("y"), F.concat_ws("-", F.col("id") % 3, F.floor(F.col("id") / 6)).alias("k"))
    run = lambda x, *keys: S.precision_bootstrap(x, "s", "id", list(keys), "w", F.col("y"), 100).first()
    one, two = run(df, "k"), run(df.repartition(9), "k")
    assert one == two and one.groups == 30 and one.low < 0.75 < one.high and one.blockers == []
    assert run(df.withColumn("all", F.lit("x")), "k", "all").blockers == ["bootstrap_group_crosses_strata", "bootstrap_groups_insufficient"]


def test_threshold_policy_states(spark):
    rows = [(0.9, 0.5, True), (0.8, 0.4, True), (0.7, 0.1, False), (None, 0.2, True)]
    df = spark.createDataFrame(rows, "p double, m double, t boolean").withColumn("w", F.lit(1.0))
    fit = P.fit_threshold_policy(df, "p", "m", "t", "w", 1.0).first()
    assert (fit.state, fit.p_threshold, fit.margin_threshold, fit.precision, fit.eligible_samples, fit.positives) == ("fitted", 0.8, 0.4, 1.0, 3, 3)
    gated = P.fit_threshold_policy(df, "p", "m", "t", "w", 1.0, F.col("p") > 0.85).first()
    assert (gated.p_threshold, gated.recall, gated.eligible_samples) == (0.9, pytest.approx(1 / 3), 1)
    assert P.fit_threshold_policy(df.withColumn("p", F.when(~F.col("t"), 0.95)), "p", "m", "t", "w", 1.0).first().state == "infeasible"
    with pytest.raises(ValueError, match="both classes"):
        P.fit_threshold_policy(df.withColumn("t", F.lit(False)), "p", "m", "t", "w", 1.0)
    with pytest.raises(ValueError, match="two independent groups"):
        P.fit_threshold_policy(df.withColumn("g", F.lit("one")), "p", "m", "t", "w", 1.0, group="g")


def _dense_best(rows, objective):
    """The rule on all pairs of values: (p, m), or None."""
    weight, positive = sum(r[3] for r in rows), sum(r[3] for r in rows if r[2])
    best = None
    for p in {r[0] for r in rows}:
        for m in {r[1] for r in rows}:
            held = [r for r in rows if r[0] >= p and r[1] >= m]
            if held:
                w, wy = sum(r[3] for r in held), sum(r[3] for r in held if r[2])
                if wy / w + 1e-15 >= objective:
                    best = max(filter(None, [best, (wy / positive, wy / w, w / weight, sum(r[2] for r in held) / len(held), p, m)]))
    return best and best[4:]


@pytest.mark.parametrize("seed,strip,grid", [(1, 2000, 10**6), (2, 7, 10**6), (3, 20, 10**6), (4, 2000, 30), (5, 30, 40), (6, 10, 10**6)])
def test_threshold_policy_equals_the_dense_rule(spark, monkeypatch, seed, strip, grid):
    from verdigris.operators import thresholds

    monkeypatch.setattr(thresholds, "MOST_GRID", grid)
    monkeypatch.setattr(thresholds, "PAIRS_A_ROUND", 5)
    rng = np.random.default_rng(seed)
    p, m = rng.integers(0, 40, 150) / 40, rng.integers(-20, 20, 150) / 20
    truth = rng.random(150) < (p + m + 0.4 * rng.random(150)) / 1.5
    rows = [(float(a), float(b), bool(t), float(w)) for a, b, t, w in zip(p, m, truth, rng.integers(1, 4, 150))]
    df = spark.createDataFrame(rows, "p double, m double, t boolean, w double")
    for objective in (0.0, 0.6, 0.8, 0.95, 1.0):
        fit = P.fit_threshold_policy(df, "p", "m", "t", "w", objective, strip=strip).first()
        assert (fit.state == "fitted" and (fit.p_threshold, fit.margin_threshold) or None) == _dense_best(rows, objective)


def test_threshold_policy_on_values_that_are_all_distinct(spark):
    """300,000 distinct values of both: their grid would have 9 * 10**10 pairs."""
    df = spark.range(300_000).select(F.rand(5).alias("p"), (F.rand(6) - 0.5).alias("m"), F.lit(1.0).alias("w")).withColumn("t", F.rand(7) < F.col("p") * 0.7 + F.col("m") * 0.5 + 0.2)
    fit = P.fit_threshold_policy(df, "p", "m", "t", "w", 0.8).first()
    held = df.filter((F.col("p") >= fit.p_threshold) & (F.col("m") >= fit.margin_threshold)).agg(F.count_if("t") / F.count("*"), F.count_if("t")).first()
    assert fit.grid_cells > 10**10 and held[0] >= 0.8 and held[1] / fit.positives == pytest.approx(fit.recall)


def test_decision_gates_stand_in_order(spark):
    base = {"p": 0.9, "margin": 0.5, "nonmatch_margin": 0.3, "leading_outcome": None, "negative_outcome": None, "route_ok": True, "domain_negative": False, "out_of_distribution": False, "detail_ok": True, "coverage_ok": True, "no_geo_fallback": False, "geo_ok": True}
    cases = [({}, "target_confirmed", None), ({"geo_ok": False}, "target_probable_review", "weak_geographic_evidence"), ({"margin": 0.1, "geo_ok": False}, "abstain", "competitor_margin_below_threshold"), ({"p": 0.1}, "target_probable_review", "target_probability_below_threshold"),
             ({"nonmatch_margin": 0.0, "p": 0.1}, "abstain", "calibrated_non_target_dominates"), ({"nonmatch_margin": -0.1, "leading_outcome": "regional_competitor"}, "regional_competitor", None), ({"domain_negative": True}, "abstain", "domain_negative_without_supported_outcome"),
             ({"domain_negative": True, "negative_outcome": "domain_negative", "out_of_distribution": True}, "domain_negative", None), ({"route_ok": False, "domain_negative": True}, "abstain", "incompatible_route"), ({"p": None}, "abstain", "missing_calibrated_target_probability")]
    kinds = ", ".join(f"{k} {'double' if k in ('p', 'margin', 'nonmatch_margin') else 'string' if 'outcome' in k else 'boolean'}" for k in base)
    df = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _, _) in enumerate(cases)], f"i int, {kinds}")
    policy = spark.createDataFrame([("fitted", 0.5, 0.2)], "state string, p_threshold double, margin_threshold double")
    assert [(r.outcome, r.reason) for r in P.apply_decision_policy(df, policy).orderBy("i").collect()] == [(o, w) for _, o, w in cases]
    assert {r.reason for r in P.apply_decision_policy(df, policy.withColumn("state", F.lit("infeasible"))).collect()} == {"decision_policy_infeasible"}


def test_routes_by_prompt_then_label(spark):
    rows = [(1, "detected", " Adult  Butterfly ", "pupa", None, "adult_butterfly_field", "score"), (2, "detected", None, "pupa", 0.9, "pupa_or_chrysalis", "exclude"), (3, "detected", "lepidoptera", None, 0.35, "adult_butterfly_field", "score"), (4, "detected", "lepidoptera", None, 0.34, "ambiguous_visual_domain", "exclude"),
            (5, "detected", "insect", None, 0.9, "ambiguous_visual_domain", "review"), (6, "detected", "insect", None, None, "ambiguous_visual_domain", "exclude"), (7, "detected", "robot", "pupa", 0.9, "ambiguous_visual_domain", "exclude"), (8, "No Detection", "larva", None, 0.9, "no_relevant_organism", "exclude"),
            (9, None, "larva", None, 0.9, "ambiguous_visual_domain", "exclude"), (10, "detected", "larva", None, 1.2, "ambiguous_visual_domain", "exclude"), (11, "detected", None, None, 0.9, "ambiguous_visual_domain", "exclude")]
    df = spark.createDataFrame(rows, "id int, detection_status string, prompt string, label string, score double, want string, wanted string")
    assert [(r.detection_route, r.action) for r in P.route_rows(df, ROUTES, TEXTS, THRESHOLDS).orderBy("id").collect()] == [(r[5], r[6]) for r in rows]
    off = {r.id: (r.action, r.reason) for r in P.route_rows(df, ROUTES, TEXTS, dict.fromkeys(THRESHOLDS)).collect()}
    assert off[3][0] == off[5][0] == "exclude"
    own = P.route_rows(df, [P.Route(("larva",), (), "young", "young", "score", "it is young")], TEXTS, {}).filter("id = 1").first()
    assert own.reason in ("it is young", TEXTS.prompt, TEXTS.label)
    cases = [("lepidoptera", None, 0.2, "possible_adult_route_below_threshold"), ("lepidoptera", None, 0.5, "possible_adult_prompt_above_threshold"), ("insect", None, 0.2, "ambiguous_insect_review_below_threshold"), (None, "insect_like", 0.2, "legacy_detector_label_fallback:insect_like:below_threshold"),
             (None, "insect like", 0.5, "legacy_detector_label_fallback:insect_like"), (None, None, 0.5, "unknown_detector_label_fallback"), ("ufo", "pupa", 0.5, "unknown_detector_prompt"), ("pupa", None, None, "pupa_prompt_no_bioclip_route")]
    named = spark.createDataFrame([(i, "detected", *c[:3]) for i, c in enumerate(cases)], "id int, detection_status string, prompt string, label string, score double")
    assert [r.reason for r in P.route_rows(named, ROUTES, TEXTS, THRESHOLDS).orderBy("id").collect()] == [c[3] for c in cases]
    never = {r.id: r.reason for r in P.route_rows(named, ROUTES, TEXTS, {}).collect()}
    assert (never[0], never[2], never[4]) == ("possible_adult_route_disabled", "ambiguous_insect_review_disabled", "legacy_detector_label_fallback:insect_like:review_disabled")


def test_session_time_runs_to_the_pause(spark):
    rows = [("s", 1, 0, "activity", "active"), ("s", 2, 10, "action", None), ("s", 3, 100, "activity", "paused"), ("s", 4, 150, "activity", "active"), ("s", 5, 160, "activity", "paused"), ("s", 6, 170, "completion", None),
            ("t", 1, 0, "action", None), ("t", 3, 5, "activity", "active"), ("t", 4, 4, "activity", "active")]
    df = spark.createDataFrame(rows, "session string, n int, sec int, kind string, state string").select("*", F.timestamp_seconds("sec").alias("at"), F.lit("x").alias("target"))
    out = {r.session: (r.active_ms, r.actions, r.targets) for r in R.session_activity_summary(df, "session", "n", "at", "target").collect()}
    assert out == {"s": (110_000, 1, 1), "t": (0, 1, 1)}
    broken = {(r.session, r.rule) for r in R.session_violations(df, "session", "n", "at").collect()}
    assert broken == {("t", x) for x in ("action_outside_activity", "sequence_gap", "overlapping_activity", "not_chronological", "activity_left_open", "completion_not_final")}


def test_equal_numbers_of_two_providers_stay_apart(spark):
    rows = [(1, "east", "77", None), (2, "west", "77", None), (3, "east", " 77 ", None), (4, "east", None, "http://a.example/x"), (5, "west", None, "http://a.example/x"), (6, "west", None, None)]
    df = spark.createDataFrame(rows, "id int, source string, number string, url string").withColumns({"delivery": F.lit("d"), "ns": F.lit(None).cast("string"), "who": F.lit(None).cast("string")})
    out = I.resolve_identity(df, [("number", F.col("source"))], ("ns", "who"), "url", ["who"], "id")
    rows = {r.id: r for r in out.collect()}
    assert rows[1].canonical_id == rows[3].canonical_id != rows[2].canonical_id and rows[4].canonical_id != rows[5].canonical_id
    assert [rows[i].identity_priority for i in (1, 4, 6)] == [1, 4, 7]
    same = spark.createDataFrame([(1, "k", "x"), (2, "k", "x"), (3, "k", "y")], "id int, k string, f string")
    classes, members = I.value_classes(same, "k", "id", ["f"])
    pairs = I.expand_contradictions(classes, "k", ["f"])
    assert [tuple(r)[1:5] for r in pairs.collect()] == [(1, 3, 2, 1)] and {(r.id, r.member) for r in members.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_distinct_counts_are_two_aggregations(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("a", 2, None), ("a", None, True), (None, 3, True)], "k string, i int, p boolean")
    out = V.filtered_distinct_counts(df, ["k"], "i", {"all_items": F.lit(True), "p_items": F.col("p")})
    assert list(map(tuple, out.collect())) == [("a", 2, 1)]
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_suppression_compares_route_action_and_scoring_route(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.8, "a", "score", "x"), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.7, "a", "score", "x"), (1, 3, 1.0, 1.0, 10.0, 10.0, 0.7, "b", "score", "x"), (1, 4, 1.0, 1.0, 10.0, 10.0, 0.9, "a", "review", "x"), (1, 5, 1.0, 1.0, 10.0, 10.0, 0.6, "a", "score", None),
            (1, 6, 50.0, 50.0, 60.0, 60.0, 0.1, "a", "score", "x"), (1, 7, 90.0, 90.0, 91.0, 92.0, 0.9, "a", "score", "x"), (1, 8, 80.0, 80.0, 81.0, 81.0, 0.9, "a", "score", "x")]
    df = spark.createDataFrame(rows, "image_id int, box_id int, x1 double, y1 double, x2 double, y2 double, score double, detection_route string, action string, scoring_route string")
    run = lambda **more: [r.box_id for r in P.suppress_boxes(df, F.lit(100.0), F.lit(100.0), least_share=0.0002, **more).collect()]
    assert sorted(run()) == [1, 3, 4, 5, 7] and run(cap=2) == [7, 1]


def test_point_in_polygon_edges_and_holes(spark):
    rows = [("f", [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]]), ("g", [[(8.0, 8.0), (12.0, 8.0), (12.0, 12.0), (8.0, 12.0), (8.0, 8.0)]])]
    features = spark.createDataFrame(rows, "feature_id string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 4.0, 5.0), (4, 0.0, 5.0), (5, 9.0, 9.0), (6, 11.0, 11.0), (7, -1.0, 0.0)], "point_id int, lon double, lat double")
    out = {r.point_id: r.feature_id for r in G.point_in_polygon_join(points, G.boundary_edges(features), 3).collect()}
    assert out == {1: "f", 2: None, 3: None, 4: "f", 5: None, 6: "g", 7: None}


def test_nearest_across_date_line_and_pole(spark):
    c = spark.createDataFrame([(1, 0.0, 179.9), (2, 89.9, 0.0), (3, None, 1.0), (4, -60.0, 20.0)], "id int, lat double, lon double")
    e = spark.createDataFrame([(10, 0.0, -179.9), (11, 89.9, 180.0), (12, 0.0, 170.0)], "e_id int, e_lat double, e_lon double")
    out = {r.id: (r.nearest_id, r.status) for r in G.nearest_neighbour_join(c, e, 1).collect()}

    def km(a, b):
        (la, lo), (lb, lp) = a, b
        h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
        return math.asin(math.sqrt(h))

    far = min((km((-60.0, 20.0), p), i) for i, p in ((10, (0.0, -179.9)), (11, (89.9, 180.0)), (12, (0.0, 170.0))))[1]
    assert out == {1: (10, "available"), 2: (11, "available"), 3: (None, "not_applicable"), 4: (far, "available")}
    assert {r.status for r in G.nearest_neighbour_join(c, e.filter("false")).collect()} == {"unavailable", "not_applicable"}


def test_no_overwrite_and_changed_files(spark, tmp_path):
    df = spark.range(10)
    path = str(tmp_path / "t")
    X.write_parquet_atomic(df, path)
    with pytest.raises(Exception, match="exists"):
        X.write_parquet_atomic(df, path)
    manifest = spark.createDataFrame(X.file_digests(spark, path).collect())
    assert X.verify_files(spark, path, manifest).isEmpty()
    assert X.verify_files(spark, path, manifest.withColumn("sha256", F.lit("x"))).count() == 2 * manifest.count()


def test_stream_keeps_late_events_and_drops_late_repeats(spark, tmp_path):
    e = _events(spark, [(i, i % 3, "a", "yes", 1, None, "review") for i in range(20)]).withColumn("reviewed_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 40_000))
    late = e.filter("event_id < 6")
    for k, part in enumerate((e.filter("event_id >= 4"), late.union(late), e)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.start_ingest(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        stored = spark.read.parquet(str(tmp_path / "out"))
        assert tuple(stream.audit(e, stored).first()) == (20, 16 if k == 0 else 20, 4 if k == 0 else 0, 0)
    assert {r.batch: r["count"] for r in stored.groupBy("batch").count().collect()} == {0: 16, 1: 4}


def test_stream_consensus_reads_what_its_items_have(spark, tmp_path):
    """Ten batches: each reads the events of its own items, and the end equals the consensus of all events."""
    rng, rows, total = np.random.default_rng(6), [], {}
    for n in range(120):
        rows.append((n, int(rng.integers(0, 12)) if n % 12 < 8 else n % 12 + 100 * (n // 12), f"r{rng.integers(4)}", str(rng.choice(["yes", "no", "cant_tell"])), 1, None, "review"))
    e = _events(spark, rows)
    for k in range(10):
        part = e.filter(F.floor(F.col("event_id") / 12) == k)
        part.union(part.limit(2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.start_consensus(spark, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        touched = {r[1] for r in rows[12 * k : 12 * k + 12]}
        for r in rows[12 * k : 12 * k + 12]:
            total[r[1]] = total.get(r[1], 0) + 1
        read = stream.versions(spark, str(tmp_path / "out")).filter(F.col("batch") == k).agg(F.sum("events_read"), F.count("*")).first()
        assert tuple(read) == (sum(total[i] for i in touched), len(touched))
    columns = ["item_id", "status", "consensus_outcome", "decisive", "resolved_at"]
    assert sorted(map(str, stream.current_consensus(spark, str(tmp_path / "out")).select(columns).collect())) == sorted(map(str, L.project_consensus(e).select(columns).collect()))


def test_stream_consensus_keeps_its_state_without_python(spark, tmp_path):
    """Both states are Spark's own; a repeat that says something else changes nothing, and without new events there is no new version."""
    first = _events(spark, [(1, 1, "a", "yes", 1, None, "review"), (2, 1, "b", "yes", 1, None, "review"), (1, 2, "a", "no", 1, None, "review")])
    later = _events(spark, [(1, 1, "a", "no", 1, None, "review"), (2, 1, "b", "yes", 1, None, "review"), (4, 2, "b", "no", 1, None, "review"), (1, 2, "a", "yes", 1, None, "review")])
    sent = lambda: spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    for part in (first, later):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.start_consensus(spark, sent(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = stream.versions(spark, str(tmp_path / "out")).select("batch", "item_id", "events_read", "consensus_outcome").collect()
    assert sorted(map(tuple, found), key=str) == [(0, 1, 2, "yes"), (0, 2, 1, None), (1, 2, 2, "no")]
    assert {r.item_id: r.consensus_outcome for r in stream.current_consensus(spark, str(tmp_path / "out")).collect()} == {1: "yes", 2: "no"}
    assert "Pandas" not in stream.histories(sent())._jdf.queryExecution().logical().toString()


def test_repartitioning_changes_nothing(spark):
    df = spark.range(300).select((F.col("id") % 20).cast("int").alias("item_id"), F.concat(F.lit("r"), F.col("id") % 3).alias("reviewer_id"), F.col("id").alias("event_id"), F.when(F.col("id") % 4 > 0, "yes").otherwise("no").alias("outcome"),
                                 F.timestamp_seconds(F.col("id")).alias("reviewed_at"), F.lit(1).alias("review_round"), F.lit(None).cast("long").alias("supersedes_event_id"), F.lit("review").alias("event_type"))
    a, b = (sorted(map(str, L.project_consensus(x).collect())) for x in (df, df.repartition(11)))
    assert a == b


def test_images_stay_small_and_many_files_are_verified(spark, tmp_path, monkeypatch):
    from verdigris.plans import catalogue, scores, storage

    spark.range(1000).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.rand(3).cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    boxes = scores._boxes(spark, str(tmp_path))
    assert boxes.groupBy("image_id").count().agg(F.max("count")).first()[0] == 50
    assert catalogue.QUERIES["suppress_boxes"](spark, str(tmp_path)).select("image_id").distinct().count() == 20
    spark.range(0, 100, 1, 4).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(storage, "_place", lambda _: str(tmp_path / "copy"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        assert tuple(catalogue.QUERIES["verify_files"](spark, str(tmp_path)).first()) == (0, 1)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list((tmp_path / "copy").glob("*.parquet"))) == 4


def test_exact_quantiles_of_large_groups(spark):
    """Groups over the bound, with ties at the ranks, all values equal, nulls and infinite values, against numpy."""
    rng = np.random.default_rng(3)
    groups = {"spread": rng.normal(0, 1e6, 5000), "ties": rng.integers(0, 3, 5000).astype(float), "one": np.full(4000, 7.5), "halves": np.repeat([1.0, 9.0], 2000), "steep": 10.0 ** rng.uniform(-200, 200, 3001), "small": rng.random(10), "single": np.array([4.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), (None, 3.0), (None, 5.0), ("small", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for q in (0.5, 0.0, 0.9, 1.0):
        found = {r.g: r.quantile for r in R.exact_quantile(df, "g", "v", q, most=100).collect()}
        for g, vs in groups.items():
            assert found.pop(g) == pytest.approx(np.quantile(vs, q), rel=1e-12)
        assert found == {None: pytest.approx(3.0 + 2 * q)}
    summary = {r.g: (r.n, r.least, r.median, r.most) for r in R.numeric_summary(df, "g", "v").collect()}
    assert summary["halves"] == (4000, 1.0, 5.0, 9.0) and summary["none"] == (0, None, None, None)


def test_set_digests_of_large_sets(spark):
    """A set over many lists has one id under any partitioning and with repeats, another one for another set, and no list over the bound."""
    df = spark.range(5000).select(F.lit("k").alias("k"), F.concat(F.lit("m"), "id").alias("m"))
    one = lambda x: I.duplicate_groups(x, "k", "m")[0].first()
    first = one(df)
    assert (first.members, len(first.group_id)) == (5000, 64)
    assert one(df.union(df).repartition(5, "m")) == first
    assert one(df.filter("m <> 'm17'")).group_id != first.group_id
    groups, membership = I.duplicate_groups(df.unionByName(spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a"), (None, "x"), (None, "y")], "k string, m string")), "k", "m")
    assert {r.k: r.members for r in groups.collect()} == {"k": 5000, "s": 2} and membership.count() == 5002
    keys = spark.range(1000).select(F.lit(1).alias("a"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(2, 10), (2, 9), (3, 5), (4, None)], "a int, v long"))
    found = {r.a: r.set_key for r in I.identity_set_keys(keys.union(keys), ["a"], "v").collect()}
    import hashlib

    assert found[2] == hashlib.sha256(b'["9","10"]').hexdigest() and found[3] == "5" and found[4] is None and len(found[1]) == 64
    small = spark.range(500).select(F.col("id").alias("v"))
    assert C.dataset_fingerprint(small, most=0.001).first() == C.dataset_fingerprint(small.repartition(9), most=0.001).first()


def test_duplicate_groups_of_large_sets_equal_their_sql(spark, tmp_path):
    """Sets at the bound, over it and of two tree levels, with repeated rows and rows without text or id."""
    import duckdb
    import pandas as pd

    from verdigris.plans import catalogue

    sizes = {"a": 2, "b": 256, "c": 257, "d": 65537, "e": 1}
    rows = [(i, t) for t, n in sizes.items() for i in range(n)]
    pd.DataFrame(rows + rows[:300] + [(7, None), (8, None), (None, "e"), (None, "c")], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}).to_parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["duplicate_groups"](spark, str(tmp_path)).select("h", "member", "members", "group_id").toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert sorted(found.itertuples(index=False, name=None)) == sorted(con.execute(catalogue.ORACLES["duplicate_groups"]).fetchall())
    assert sorted(found.groupby("h").members.first()) == [2, 256, 257, 65537]


def test_fused_scores_are_one_aggregation_in_tasks_of_bounded_size(spark):
    """Against the rule in plain Python, with several inputs of a kind, missing scores and kinds without weight; nothing is sorted for a window, and tasks grow in number with the rows."""
    rng, weights = np.random.default_rng(12), {"A": 2.0, "R": 1.0, "N": 0.5, "Z": 0.0}
    rows = [(int(rng.integers(0, 30)) or None, int(rng.integers(0, 3)), str(rng.choice(["A", "R", "N", "Z", "other"])), float(rng.random()) if rng.random() < 0.9 else None) for _ in range(600)] + [(100, 0, None, 0.5), (101, 0, "Z", 0.5), (102, 0, "A", None)]
    groups = {}
    for item, target, kind, score in rows:
        if weights.get(kind, 0) > 0:
            groups.setdefault((item, target), []).append((kind, score))
    df = spark.createDataFrame(rows, "item int, target int, kind string, score double")
    for parts in (None, 1, 5):
        fused = P.fuse_scores(df, ["item"], "target", "kind", "score", weights, parts)
        found = {(r.item, r.target): r for r in fused.collect()}
        assert found.keys() == groups.keys()
        for g, inputs in groups.items():
            n = {k: sum(x == k for x, _ in inputs) for k, _ in inputs}
            known = [s for _, s in inputs if s is not None]
            assert found[g].missing == len(inputs) - len(known)
            if found[g].missing:
                assert found[g].fused_score is None
            else:
                assert found[g].fused_score == pytest.approx(sum(weights[k] / n[k] * s for k, s in inputs) / sum(weights[k] for k in n), rel=1e-12)
            assert found[g].spread == (max(known) - min(known) if known else None)
        plan = fused.select("*")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange ") == 1
        assert parts != 5 or ", 5), REPARTITION_BY_NUM" in plan
    assert P.fuse_scores(df, ["item"], "target", "kind", "score", {}).isEmpty()
    assert [P.fusion_parts(n) for n in (0, 1, P.FUSED_ROWS, P.FUSED_ROWS + 1, 864 * P.FUSED_ROWS)] == [1, 1, 1, 2, 864]


def test_sessions_are_the_same_in_chunks_of_any_size(spark):
    rng = np.random.default_rng(9)
    rows = []
    for session in range(6):
        number, when = 0, 1000
        for _ in range(int(rng.integers(1, 60))):
            number += 1 + (rng.random() < 0.05)
            when += int(rng.integers(-1, 40))
            kind = str(rng.choice(["activity", "action", "completion"], p=[0.5, 0.47, 0.03]))
            rows.append((session if session else None, int(number), when, kind, str(rng.choice(["active", "paused"])) if kind == "activity" else None, f"t{rng.integers(5)}"))
    df = spark.createDataFrame(rows, "session int, n long, ms long, kind string, state string, target string").withColumn("at", F.timestamp_millis("ms"))
    results = []
    for chunk in (100_000, 7, 1):
        intervals = R.session_intervals(df, "session", "n", "at", chunk)
        assert intervals.columns == [*df.columns, "until", "until_order"]
        summary = R.session_activity_summary(df, "session", "n", "at", "target", chunk)
        results.append([sorted(map(str, x.collect())) for x in (intervals, R.session_violations(df, "session", "n", "at", chunk), summary)])
    assert results[0] == results[1] == results[2] and all(map(len, results[0]))


def test_missing_corrections_are_what_the_item_expects(spark):
    rows = [(1, 1, "a", "yes", None), (2, 1, "b", "yes", "larva"), (3, 2, "a", "yes", None), (4, 2, "b", "yes", "adult"), (5, 3, "a", "yes", None), (6, 3, "b", "yes", "unknown"), (7, 4, "a", "yes", None), (8, 4, "b", "cant_tell", "adult"), (9, 4, "c", "yes", "adult")]
    e = spark.createDataFrame(rows, "event_id long, item_id int, reviewer_id string, outcome string, life_stage string").withColumns({"reviewed_at": F.timestamp_seconds("event_id"), "review_round": F.lit(1), "supersedes_event_id": F.lit(None).cast("long"), "event_type": F.lit("review"), "captive_concern": F.col("event_id") == 4})
    items = spark.createDataFrame([(1, "larva"), (2, "larva"), (3, None), (4, "adult")], "item_id int, expected_life_stage string")
    out = {r.item_id: r for r in L.project_consensus(e, items=items).collect()}
    assert {i: r.status for i, r in out.items()} == {1: "complete_agreement", 2: "unresolved_disagreement", 3: "complete_agreement", 4: "complete_agreement"}
    assert out[2].conflicting_fields == ["life_stage"] and out[1].resolved_signature.life_stage == "larva" and out[3].resolved_signature.life_stage == "unknown"
    assert {i: r.captive_concern for i, r in out.items()} == {1: False, 2: True, 3: False, 4: False}
    blocked = L.final_test_eligibility(L.project_consensus(e, items=items), F.lit(True), F.lit(0.5))
    assert {r.item_id: r.final_test_eligibility_blockers for r in blocked.collect()}[2] == ["captive_or_cultivated_concern", "review_not_completed"]
    assert {r.item_id: r.status for r in L.project_consensus(e).collect()}[1] == "unresolved_disagreement"


def test_provider_ids_that_must_be_whole_numbers(spark):
    df = spark.createDataFrame([(1, "007"), (2, " 7 "), (3, None), (4, ""), (5, "12")], "n int, pid string").withColumns({c: F.lit(None).cast("string") for c in ("ns", "occ", "url", "by")}).withColumns({"source": F.lit("s"), "delivery": F.lit("d")})
    run = lambda x: {r.n: (r.identity_method, r.canonical_id) for r in I.resolve_identity(x, [("pid", F.lit("p"), "positive_integer")], ("ns", "occ"), "url", ["by"], "n").collect()}
    out = run(df)
    assert out[1] == out[2] and out[1][0] == out[5][0] == "provider_identity" and out[1] != out[5] and out[3][0] == out[4][0] == "singleton"
    for wrong in ("0", "-3", "x7"):
        with pytest.raises(Exception, match="no positive integer"):
            run(df.withColumn("pid", F.lit(wrong)))


def test_bootstrap_splits_its_draws_down_a_tree(spark, monkeypatch):
    """Multinomial counts: totals are exact, each group is drawn once on average with a binomial's variance, and partitioning changes nothing."""
    monkeypatch.setattr(S, "LEAF_GROUPS", 4)
    monkeypatch.setattr(S, "FAN", 3)
    sums = spark.range(130).select(F.col("id").alias("group_id"), F.when(F.col("id") < 90, "a").when(F.col("id") < 120, "b").alias("s"), F.lit(1.0).alias("w"), (F.col("id") == 17).cast("double").alias("wy"))
    out = sorted(map(tuple, S.split_draws(sums, 2000, "x").collect()))
    assert out == sorted(map(tuple, S.split_draws(sums.repartition(9, "wy"), 2000, "x").collect())) and out != sorted(map(tuple, S.split_draws(sums, 2000, "y").collect()))
    assert [r[0] for r in out] == list(range(2000)) and all(r[1] == 130.0 for r in out)
    drawn = np.array([r[2] for r in out])
    assert abs(drawn.mean() - 1) < 0.1 and abs(drawn.var() - 89 / 90) < 0.15
    rows = spark.range(400).select("id", (F.col("id") % 2).alias("s"), F.lit(1.0).alias("w"), (F.col("id") % 4 == 0).alias("y"), F.col("id").cast("string").alias("k"))
    run = lambda **x: S.precision_bootstrap(rows, "s", "id", ["k"], "w", F.col("y"), **{"replicates": 1000, **x}).first()
    split, hashed = run(), run(draws="hash")
    assert abs(split.low - hashed.low) < 0.012 and abs(split.high - hashed.high) < 0.012 and split.precision == 0.25
    one = run(design="simple_random")
    assert one.high - one.low > (split.high - split.low) * 1.1  # half of the variance lies between the strata
    assert run(design="census", seed=" ", level=1.0, replicates=50).blockers == ["bootstrap_replicates_invalid", "bootstrap_seed_missing", "confidence_level_invalid", "sampling_design_not_bootstrap_eligible"]


@pytest.mark.parametrize("cells", [1, 5, 16])
def test_points_in_star_shapes_with_holes(spark, cells):
    """Ragged rings of all sizes, with holes, against the plain rule; points in inner cells meet no edge."""
    rng = np.random.default_rng(cells)

    def ring(cx, cy, r, n):
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        out = [(float(cx + r * (0.5 + 0.5 * rng.random()) * np.cos(t)), float(cy + r * (0.5 + 0.5 * rng.random()) * np.sin(t))) for t in turn]
        return [*out, out[0]]

    features = []
    for k in range(14):
        cx, cy, r = rng.uniform(-50, 50), rng.uniform(-50, 50), 10 ** rng.uniform(-2, 1.5)
        features.append((k, [ring(cx, cy, r, 40)] + ([ring(cx, cy, r * 0.3, 12)] if k % 2 else [])))
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-70, 70, (300, 2)))]
    for k, rings in features:
        c = np.mean(rings[0], axis=0)
        size = np.ptp(rings[0], axis=0).max()
        points += [(1000 * (k + 1) + i, float(x), float(y)) for i, (x, y) in enumerate(c + rng.uniform(-0.7, 0.7, (60, 2)) * size)]
        points.append((1000 * (k + 1) + 500, *rings[0][3]))

    def odd(points, x, y):
        return sum(((b > y) != (d > y)) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in zip(points, points[1:])) % 2 == 1

    wanted = {}
    for i, x, y in points:
        held = [k for k, rings in features if ((x, y) in rings[0] or odd(rings[0], x, y)) and not any(odd(h, x, y) for h in rings[1:])]
        wanted[i] = held[0] if len(held) == 1 else None
    edges = G.boundary_edges(spark.createDataFrame([(k, [[{"x": a, "y": b} for a, b in r] for r in rings]) for k, rings in features], "feature_id int, rings array<array<struct<x:double,y:double>>>"))
    out = {r.point_id: r.feature_id for r in G.point_in_polygon_join(spark.createDataFrame(points, "point_id int, lon double, lat double"), edges, cells).collect()}
    assert out == wanted and len(set(wanted.values())) > 8
    cover, _ = G.cell_cover(edges, cells)
    assert cover.groupBy("feature_id").count().agg(F.max("count")).first()[0] <= (2 * cells + 2) ** 2
    assert cells < 16 or cover.filter("inner").count() > 50
