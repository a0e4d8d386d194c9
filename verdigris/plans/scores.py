"""Queries of the score and spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import scores as S
from verdigris.operators import spatial as G
from verdigris.plans import roles as R
from verdigris.plans.registry import query
from verdigris.plans.routing import ROUTES, TEXTS, THRESHOLDS

SHOWN = ["Adult  Butterfly", "lepidoptera", "larva", "pupa", "pinned butterfly", "moth", "insect", "tattoo", "person", "spaceship"]
OLDER = ["adult_butterfly", "possible adult butterfly", "caterpillar", "pupa", "pinned_specimen", "moth_like", "insect_like", "hard_negative", "no_organism", "robot", ""]


def _detections(spark, d):
    """Events as detections: a prompt on two of three, else an older label; some without score, some with a wrong one."""
    n, at = F.col("event_id"), lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values)).cast("int") + 1)
    status = F.when(n % 19 == 0, "No detection").when(n % 23 == 0, "failed").otherwise("detected")
    return R.table(spark, d, "events").select("event_id", status.alias("detection_status"), F.when(n % 3 != 0, at(SHOWN)).alias("prompt"), at(OLDER).alias("label"), F.when(n % 7 == 0, None).when(n % 29 == 0, 1.5).otherwise(F.col("value") / 500).alias("score"))


def _text_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


DETECTIONS = f"""SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'no_detection' WHEN event_id % 23 = 0 THEN 'failed' ELSE 'detected' END AS st, CASE WHEN event_id % 3 <> 0 THEN regexp_replace(lower({_text_list(SHOWN)}[CAST(event_id % {len(SHOWN)} AS INT) + 1]), ' +', ' ') END AS prompt,
 replace({_text_list(OLDER)}[CAST(event_id % {len(OLDER)} AS INT) + 1], ' ', '_') AS label, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 1.5 ELSE value / 500 END AS score FROM events"""
KIND_ROWS = ", ".join(f"('{x}', {i}, {by})" for i, r in enumerate(ROUTES) for by, xs in (("true", r.prompts), ("false", r.labels)) for x in xs)
KIND_FACTS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in (i, r.route, r.scoring, r.action, r.reason, r.gate, r.below)) + ")" for i, r in enumerate(ROUTES))
ROUTED = f"""SELECT event_id, CASE WHEN bad IN ('low', 'score', 'unknown', 'status') THEN 'ambiguous_visual_domain' WHEN bad = 'none' THEN 'no_relevant_organism' ELSE route END AS detection_route, CASE WHEN bad IS NULL THEN scoring END AS scoring_route, CASE WHEN bad IS NULL THEN act ELSE 'exclude' END AS action,
 CASE WHEN bad IS NOT NULL OR act = 'exclude' THEN 'none' WHEN act = 'review' THEN 'low' ELSE 'standard' END AS priority, CASE bad WHEN 'none' THEN 'detector_reported_no_detection' WHEN 'status' THEN 'detection_status_not_routable' WHEN 'score' THEN 'invalid_detector_score'
 WHEN 'unknown' THEN CASE WHEN prompt IS NULL THEN 'unknown_detector_label_fallback' ELSE 'unknown_detector_prompt' END WHEN 'low' THEN CASE WHEN prompt IS NULL THEN older || ':below_threshold' ELSE below END ELSE CASE WHEN prompt IS NULL THEN older ELSE why END END AS reason
 FROM (SELECT *, CASE WHEN st = 'no_detection' THEN 'none' WHEN st <> 'detected' THEN 'status' WHEN score > 1 THEN 'score' WHEN kind IS NULL THEN 'unknown' WHEN gate IS NOT NULL AND score IS NULL THEN 'score' WHEN gate IS NOT NULL AND score < 0.35 THEN 'low' END AS bad, 'legacy_detector_label_fallback:' || CASE label WHEN '' THEN 'missing' ELSE label END AS older
  FROM (SELECT d.*, k.kind, f.route, f.scoring, f.act, f.why, f.gate, f.below FROM ({DETECTIONS}) d LEFT JOIN (VALUES {KIND_ROWS}) k(x, kind, by_prompt) ON k.x = coalesce(prompt, label) AND k.by_prompt = (prompt IS NOT NULL) LEFT JOIN (VALUES {KIND_FACTS}) f(kind, route, scoring, act, why, gate, below) ON f.kind = k.kind))"""


@query(ROUTED)
def route_rows(spark, d):
    return S.route_rows(_detections(spark, d), ROUTES, TEXTS, THRESHOLDS).select("event_id", "detection_route", "scoring_route", "action", "priority", "reason")


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND status = 'ok' THEN 'score' ELSE 'exclude' END AS gate, CASE WHEN status IS NULL THEN 'no_detection' WHEN status <> 'ok' THEN 'bad_status' WHEN event_type NOT IN ('view', 'click') THEN 'route_not_scored' ELSE 'eligible' END AS gate_reason
 FROM (SELECT *, CASE WHEN value < 1 THEN NULL WHEN value < 5 THEN 'failed' ELSE 'ok' END AS status FROM events)""")
def gate_rows(spark, d):
    e = R.table(spark, d, "events").withColumn("status", F.when(F.col("value") < 1, None).when(F.col("value") < 5, "failed").otherwise("ok"))
    return e.select("event_id", *[c.alias(n) for n, c in S.gate_rows("status", "event_type", ("view", "click")).items()])


BOXES_AN_IMAGE = 50


def _boxes(spark, d):
    """Embeddings as boxes; consecutive ones share an image, so that an image stays small in a large table."""
    e = R.table(spark, d, "embeddings")
    v = lambda i: F.element_at("embedding", i).cast("double")
    x, y = F.round(50 + v(1) * 200, 3), F.round(50 + v(2) * 200, 3)
    return e.select(F.floor(F.col("vec_id") / BOXES_AN_IMAGE).alias("image_id"), F.col("vec_id").alias("box_id"), x.alias("x1"), y.alias("y1"), (x + F.round(30 + v(3) * 60, 3)).alias("x2"), (y + F.round(30 + v(4) * 60, 3)).alias("y2"), F.round(0.5 + v(5), 4).alias("score"),
                    F.when(v(6) > 0, "a").otherwise("b").alias("detection_route"), F.when(F.col("vec_id") % 7 == 0, "review").otherwise("score").alias("action"), F.when(v(7) > 0, "x").alias("scoring_route"))


BOXES = f"""SELECT vec_id // {BOXES_AN_IMAGE} AS image_id, vec_id AS box_id, x AS x1, y AS y1, x + round(30 + embedding[3]::DOUBLE * 60, 3) AS x2, y + round(30 + embedding[4]::DOUBLE * 60, 3) AS y2, round(0.5 + embedding[5]::DOUBLE, 4) AS score, CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END AS rank, (embedding[6] > 0) || '|' || (embedding[7] > 0) AS kind FROM (SELECT *, round(50 + embedding[1]::DOUBLE * 200, 3) AS x, round(50 + embedding[2]::DOUBLE * 200, 3) AS y FROM embeddings)"""


@query(f"""SELECT box_id, round((a1 + a2) / 2 / 100, 6) AS cx, round((b1 + b2) / 2 / 100, 6) AS cy, round(greatest(0, (a2 - a1) * (b2 - b1)) / 10000, 6) AS area_ratio FROM (SELECT box_id, greatest(0.0, least(x1, 100.0)) AS a1, greatest(0.0, least(y1, 100.0)) AS b1, greatest(0.0, least(x2, 100.0)) AS a2, greatest(0.0, least(y2, 100.0)) AS b2 FROM ({BOXES}))""")
def box_geometry(spark, d):
    b = _boxes(spark, d).withColumn("box", F.array("x1", "y1", "x2", "y2"))
    g = S.box_geometry("box", F.lit(100.0), F.lit(100.0))
    return b.select("box_id", F.round(g["cx"], 6).alias("cx"), F.round(g["cy"], 6).alias("cy"), F.round(g["area_ratio"], 6).alias("area_ratio"))


SUPPRESSED = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rank, score DESC, box_id) AS i, rank || '|' || kind AS who, (x2 - x1) * (y2 - y1) AS area FROM ({BOXES}) WHERE score >= 0.35 AND (x2 - x1) * (y2 - y1) / 10000 >= 0.05),
 pairs AS (SELECT a.image_id, b.i, a.i AS earlier, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, a.area + b.area AS areas FROM b a JOIN b ON a.image_id = b.image_id AND a.i < b.i AND a.who = b.who),
 clash AS MATERIALIZED (SELECT b.image_id, b.i, b.box_id, b.score, coalesce(list(p.earlier) FILTER (p.inter > 0.5 * (p.areas - p.inter)), []) AS hits FROM b LEFT JOIN pairs p ON p.image_id = b.image_id AND p.i = b.i GROUP BY ALL),
 walk(image_id, i, kept) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[] FROM b UNION ALL SELECT w.image_id, c.i, CASE WHEN len(w.kept) < 20 AND NOT list_has_any(w.kept, c.hits) THEN list_append(w.kept, c.i) ELSE w.kept END FROM walk w JOIN clash c ON c.image_id = w.image_id AND c.i = w.i + 1)
 SELECT c.image_id, c.box_id, c.score FROM clash c JOIN (SELECT image_id, arg_max(kept, i) AS kept FROM walk GROUP BY 1) k ON k.image_id = c.image_id WHERE list_contains(k.kept, c.i)"""


@query(SUPPRESSED)
def suppress_boxes(spark, d):
    return S.suppress_boxes(_boxes(spark, d), F.lit(100.0), F.lit(100.0), least_share=0.05)


@query("""SELECT l_orderkey, l_returnflag, array_to_string(m, ',') AS members, sha256(l_orderkey || '|' || l_returnflag || '|' || array_to_string(m, ',')) AS unit_id FROM (SELECT l_orderkey, l_returnflag, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS m FROM lineitem GROUP BY 1, 2)""")
def build_scoring_units(spark, d):
    return S.build_scoring_units(R.table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_partkey").withColumn("members", F.array_join("members", ","))


@query("""SELECT l_orderkey, l_suppkey, CASE WHEN miss = 0 THEN round(s, 6) END AS fused_score, round(spread, 6) AS spread, spread > 0.5 AS strong_disagreement FROM (SELECT l_orderkey, l_suppkey, sum(w / n / tot * score) AS s, count(CASE WHEN score IS NULL THEN 1 END) AS miss, max(score) - min(score) AS spread FROM (
 SELECT *, sum(w / n) OVER (PARTITION BY l_orderkey, l_suppkey) AS tot FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_suppkey, l_returnflag) AS n FROM (SELECT l_orderkey, l_suppkey, l_returnflag, CASE l_returnflag WHEN 'A' THEN 2.0::DOUBLE WHEN 'R' THEN 1.0 ELSE 0.5 END AS w, CASE WHEN l_quantity < 49 THEN l_quantity / 50 END AS score FROM lineitem))) GROUP BY 1, 2)""")
def fuse_scores(spark, d):
    li = R.table(spark, d, "lineitem")
    scored = li.withColumn("score", F.when(F.col("l_quantity") < 49, F.col("l_quantity") / 50))
    out = S.fuse_scores(scored, ["l_orderkey"], "l_suppkey", "l_returnflag", "score", {"A": 2.0, "R": 1.0, "N": 0.5}, S.fusion_parts(li.count()))
    return out.select("l_orderkey", "l_suppkey", F.round("fused_score", 6).alias("fused_score"), F.round("spread", 6).alias("spread"), "strong_disagreement")


@query("""SELECT o_custkey, t AS target_score, k AS competitor, s AS competitor_score, round(t - s, 2) AS margin FROM (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN p END) AS t FROM (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS p FROM orders GROUP BY 1, 2) GROUP BY 1) LEFT JOIN
 (SELECT o_custkey, o_orderpriority AS k, p AS s FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, o_orderpriority) AS rn FROM (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS p FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2)) WHERE rn = 1) USING (o_custkey)""")
def best_competitor(spark, d):
    per = R.table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("p")).withColumn("target", F.lit("1-URGENT"))
    return S.best_competitor(per, ["o_custkey"], "o_orderpriority", "p", "target").withColumn("margin", F.round("margin", 2))


@query("""SELECT user_id, t AS target_calibrated, c AS competitor_calibrated, tr AS target_raw, te AS target_evidence, round(t - c, 6) AS margin_over_competitor FROM (SELECT user_id, max(CASE WHEN k = 'target' THEN cal END) AS t, max(CASE WHEN k = 'competitor' THEN cal END) AS c, max(CASE WHEN k = 'target' THEN value END) AS tr,
 arg_max(CASE WHEN k = 'target' THEN event_id END, CASE WHEN k = 'target' AND cal IS NOT NULL THEN (cal, value, -event_id) END) AS te FROM (SELECT *, CASE event_type WHEN 'view' THEN 'target' WHEN 'click' THEN 'competitor' ELSE 'generic' END AS k, CASE WHEN value < 200 THEN floor(value) / 100 END AS cal FROM events) GROUP BY 1)""")
def nonmatch_maxima(spark, d):
    e = R.table(spark, d, "events").select("user_id", F.col("event_id").alias("evidence_id"), F.when(F.col("event_type") == "view", "target").when(F.col("event_type") == "click", "competitor").otherwise("generic").alias("evidence_kind"),
                                           F.col("value").alias("raw"), F.when(F.col("value") < 200, F.floor("value") / 100).alias("calibrated"))
    out = S.nonmatch_maxima(e, "user_id", ["target", "competitor", "generic"])
    return out.select("user_id", "target_calibrated", "competitor_calibrated", "target_raw", "target_evidence", F.round("margin_over_competitor", 6).alias("margin_over_competitor"))


OBJECTIVE = 0.7
GATES = "route_ok AND coverage_ok AND geo_ok AND NOT domain_negative AND NOT out_of_distribution AND detail_ok AND NOT no_geo_fallback"
FITTED = f"""WITH k AS MATERIALIZED (SELECT p::DOUBLE AS p, margin::DOUBLE AS m, weight::DOUBLE AS w, truth, p IS NOT NULL AND margin IS NOT NULL AND {GATES} AS ok FROM ({R.DECISIONS})), g AS (SELECT * FROM k WHERE ok), cells AS (SELECT * FROM (SELECT DISTINCT p FROM g) a, (SELECT DISTINCT m FROM g) b),
 s AS (SELECT c.p, c.m, sum(g.w) AS w, sum(CASE WHEN truth THEN g.w ELSE 0 END) AS wy, count(*) AS n, count(CASE WHEN truth THEN 1 END) AS y FROM cells c JOIN g ON g.p >= c.p AND g.m >= c.m GROUP BY 1, 2),
 t AS (SELECT sum(w) AS tw, sum(CASE WHEN truth THEN w ELSE 0 END) AS twy, count(*) AS tn, count(CASE WHEN truth THEN 1 END) AS ty, count(CASE WHEN ok THEN 1 END) AS te FROM k),
 best AS (SELECT p, m, wy / w AS precision, wy / twy AS recall, w / tw AS coverage, y * 1.0::DOUBLE / n AS up, y * 1.0::DOUBLE / ty AS ur, n * 1.0::DOUBLE / tn AS uc FROM s, t WHERE wy / w + 1e-15 >= {OBJECTIVE} ORDER BY recall DESC, precision DESC, coverage DESC, up DESC, p DESC, m DESC LIMIT 1)
 SELECT CASE WHEN p IS NULL THEN 'infeasible' ELSE 'fitted' END AS state, p AS p_threshold, m AS margin_threshold, precision, recall, coverage, up, ur, uc, tn, te, ty, (SELECT count(*) FROM cells) AS cells FROM t LEFT JOIN best ON true"""


def _policy(spark, d):
    return S.fit_threshold_policy(R.decisions(spark, d), "p", "margin", "truth", "weight", OBJECTIVE, F.expr(GATES), group="sample_id")


@query(f"""SELECT state, p_threshold, margin_threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coverage, 6) AS coverage, round(up, 6) AS unweighted_precision, round(ur, 6) AS unweighted_recall, round(uc, 6) AS unweighted_coverage,
 tn AS samples, te AS eligible_samples, ty AS positives, tn - ty AS negatives, cells AS grid_cells FROM ({FITTED})""")
def fit_threshold_policy(spark, d):
    return _policy(spark, d).drop("state_reason").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "coverage", "unweighted_precision", "unweighted_recall", "unweighted_coverage")})


@query(f"""SELECT sample_id, outcome, reason IS NOT NULL AS abstained, reason FROM (SELECT sample_id, split_part(v, '|', 1) AS outcome, nullif(split_part(v, '|', 2), '') AS reason FROM (SELECT sample_id, CASE WHEN state <> 'fitted' THEN 'abstain|decision_policy_infeasible' WHEN NOT route_ok THEN 'abstain|incompatible_route'
 WHEN domain_negative THEN coalesce(negative_outcome || '|', 'abstain|domain_negative_without_supported_outcome') WHEN out_of_distribution THEN 'out_of_distribution|out_of_distribution' WHEN NOT detail_ok THEN 'insufficient_visual_detail|insufficient_visual_detail'
 WHEN NOT coverage_ok THEN 'insufficient_reference_coverage|insufficient_reference_coverage' WHEN no_geo_fallback THEN 'no_geo_global_fallback|no_geo_global_fallback' WHEN nonmatch_margin <= 0 THEN CASE leading_outcome WHEN 'regional_competitor' THEN 'regional_competitor|' ELSE 'abstain|calibrated_non_target_dominates' END
 WHEN p IS NULL THEN 'abstain|missing_calibrated_target_probability' WHEN p < p_threshold THEN 'target_probable_review|target_probability_below_threshold' WHEN margin IS NULL THEN 'abstain|missing_competitor_margin' WHEN margin < margin_threshold THEN 'abstain|competitor_margin_below_threshold'
 WHEN NOT geo_ok THEN 'target_probable_review|weak_geographic_evidence' ELSE 'target_confirmed|' END AS v FROM ({R.DECISIONS}), ({FITTED})))""")
def apply_decision_policy(spark, d):
    return S.apply_decision_policy(R.decisions(spark, d), _policy(spark, d)).select("sample_id", "outcome", "abstained", "reason")


def _evidence(spark, d):
    li = R.table(spark, d, "lineitem")
    e = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").cast("string").alias("name"), F.when(F.col("l_linenumber") == 1, F.sha2(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")), 256)).when(F.col("l_quantity") > 49, "wrong").alias("id"))))
    return li.groupBy("l_orderkey").agg(e.alias("evidence"))


@query("""SELECT l_orderkey, array_to_string(list(sha256(l_orderkey || '|' || l_linenumber || '|' || l_suppkey) ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)), ',') AS ids, CAST(count(CASE WHEN l_quantity > 49 AND l_linenumber <> 1 THEN 1 END) AS INT) AS mismatches FROM lineitem GROUP BY 1""")
def derive_score_ids(spark, d):
    return S.derive_score_ids(_evidence(spark, d), "l_orderkey", "evidence", ["l_linenumber", "name"]).select("l_orderkey", F.array_join("derived_ids", ",").alias("ids"), "mismatches")


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) - 1 AS INT) AS position, l_linenumber, CAST(l_suppkey AS VARCHAR) AS name FROM lineitem")
def explode_candidates(spark, d):
    return S.explode_candidates(_evidence(spark, d), ["l_orderkey"], "evidence").drop("id")


KM = "round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))), 9)"


@query(f"""SELECT id, nearest_id, round(km, 6) AS distance_km, CASE WHEN lat IS NULL THEN 'not_applicable' ELSE 'available' END AS status FROM (SELECT point_id AS id, CASE WHEN label <> 3 THEN lat END AS lat FROM ({R.POINTS}) WHERE label <> 0) LEFT JOIN (SELECT id, arg_min(e_id, (km, e_id)) AS nearest_id, min(km) AS km FROM (
 SELECT a.point_id AS id, b.point_id AS e_id, {KM.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} AS km FROM ({R.POINTS}) a, ({R.POINTS}) b WHERE a.label NOT IN (0, 3) AND b.label = 0) GROUP BY 1) USING (id)""")
def nearest_neighbour_join(spark, d):
    p = R.points(spark, d)
    candidates = p.filter("label <> 0").select(F.col("point_id").alias("id"), F.when(F.col("label") != 3, F.col("lat")).alias("lat"), "lon")
    eligible = p.filter("label = 0").select(F.col("point_id").alias("e_id"), F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon"))
    return G.nearest_neighbour_join(candidates, eligible).select("id", "nearest_id", F.round("distance_km", 6).alias("distance_km"), "status")


@query(f"SELECT point_id AS id, round({KM.format(a='5.0', b='lat', c='5.0', d='lon')}, 6) AS distance_km FROM ({R.POINTS}) ORDER BY CASE WHEN point_id = 7 THEN 0 ELSE 1 END, 2, 1 LIMIT 12")
def nearby_top_k(spark, d):
    return G.nearby_top_k(R.points(spark, d).withColumnRenamed("point_id", "id"), 5.0, 5.0, 12, "7").select("id", "distance_km")


@query(f"""SELECT point_id, '2:' || CAST(r AS BIGINT) || ':' || CAST(c AS BIGINT) AS cell_id, (r + 0.5) * 2 - 90 AS cell_lat, '4:' || CAST(floor(r / 2) AS BIGINT) || ':' || CAST(floor(c / 2) AS BIGINT) AS parent_cell_id FROM (SELECT point_id, floor((lat + 90) / 2) AS r, floor((lon + 180) / 2) AS c FROM ({R.POINTS}))""")
def cell_centroids(spark, d):
    g = G.grid_cell(F.col("lat"), F.col("lon"), 2.0)
    return R.points(spark, d).select("point_id", *[g[c].alias(c) for c in ("cell_id", "cell_lat", "parent_cell_id")])


BOX = "SELECT n_nationkey AS id, (n_nationkey % 5) * 6.0 - 15 AS x1, floor(n_nationkey / 5) * 5.0 - 12.5 AS y1, (n_nationkey % 5) * 6.0 - 15 + 7 AS x2, floor(n_nationkey / 5) * 5.0 - 12.5 + 4 AS y2 FROM nation"


def _features(spark, d):
    n = R.table(spark, d, "nation")
    x, y = (F.col("n_nationkey") % 5) * 6.0 - 15, F.floor(F.col("n_nationkey") / 5) * 5.0 - 12.5
    ring = lambda a, b, c, e: F.array(*[F.struct(u.alias("x"), v.alias("y")) for u, v in ((a, b), (c, b), (c, e), (a, e), (a, b))])
    hole = ring(x + 2, y + 1, x + 3, y + 2)
    rings = F.when(F.col("n_nationkey") == 12, F.array(ring(x, y, x + 7, y + 4), hole)).otherwise(F.array(ring(x, y, x + 7, y + 4)))
    return n.select(F.col("n_nationkey").alias("feature_id"), rings.alias("rings"))


@query(f"""SELECT point_id, CASE WHEN n = 1 THEN f END AS feature_id FROM (SELECT point_id, count(id) AS n, max(id) AS f FROM ({R.POINTS}) LEFT JOIN ({BOX}) ON lon BETWEEN x1 AND x2 AND lat BETWEEN y1 AND y2 AND NOT (id = 12 AND lon BETWEEN x1 + 2 AND x1 + 3 AND lat BETWEEN y1 + 1 AND y1 + 2) GROUP BY 1)""")
def point_in_polygon_join(spark, d):
    return G.point_in_polygon_join(R.points(spark, d), G.boundary_edges(_features(spark, d)))


@query(f"""SELECT id AS feature_id, 0 AS ring, count(*) AS n_edges, min(x1) AS west, max(x2) AS east FROM (SELECT *, unnest([1, 2, 3, 4]) FROM ({BOX})) GROUP BY 1 UNION ALL SELECT 12, 1, 4, x1 + 2, x1 + 3 FROM ({BOX}) WHERE id = 12""")
def boundary_edges(spark, d):
    return G.boundary_edges(_features(spark, d)).groupBy("feature_id", "ring").agg(F.count("*").alias("n_edges"), F.min("x1").alias("west"), F.max("x1").alias("east"))


@query(f"""WITH f AS (SELECT n_name AS country, r_name AS continent, x1, y1, x2, y2 FROM ({BOX}) JOIN nation ON id = n_nationkey JOIN region ON n_regionkey = r_regionkey), b AS (SELECT 'country' AS level, country AS node_id, continent AS parent_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM f GROUP BY 2, 3
 UNION ALL SELECT 'continent', continent, 'world', min(x1), min(y1), max(x2), max(y2) FROM f GROUP BY 2 UNION ALL SELECT 'global', 'world', NULL, min(x1), min(y1), max(x2), max(y2) FROM f) SELECT *, (x1 + x2) / 2 AS label_x, (y1 + y2) / 2 AS label_y FROM b""")
def boundary_hierarchy(spark, d):
    e = G.boundary_edges(_features(spark, d)).groupBy("feature_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x1").alias("x2"), F.max("y1").alias("y2"))
    return G.boundary_hierarchy(R.nations(spark, d).join(e, F.col("n_nationkey") == F.col("feature_id")).select("country", "continent", "x1", "y1", "x2", "y2"))
