"""Queries of the core and coverage operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.operators import core as C
from verdigris.operators import coverage as V
from verdigris.operators import identity as I
from verdigris.plans import roles as R
from verdigris.plans.registry import query

COUNTS = ["baseline_items", "eligible_items", "candidate_items", "supported_items", "rejected_items", "pending_items", "uncertain_items", "ready_items"]


KEYS = ["nation", "segment", "month"]


def _cells(spark, d):
    """Both sides by narrow keys, each aggregated before they meet; names are attached to cells, not to rows."""
    b = V.filtered_distinct_counts(R.baseline_rows(spark, d), KEYS, "item_id", {"baseline_items": F.lit(True), "eligible_items": F.col("eligible")}, "event_date").withColumnRenamed("latest_date", "baseline_latest")
    states = {f"{s}_items": F.col("state") == s for s in ("supported", "rejected", "pending", "uncertain")}
    c = V.filtered_distinct_counts(R.candidate_rows(spark, d), KEYS, "item_id", {"candidate_items": F.lit(True), **states, "ready_items": (F.col("state") == "supported") & F.col("ready")}, "event_date").withColumnRenamed("latest_date", "candidate_latest")
    return R.with_cells(V.full_outer_coverage(b, c, KEYS, COUNTS), spark, d).select("continent", "country", "cell_id", *COUNTS, "baseline_latest", "candidate_latest")


CELLS = f"""SELECT coalesce(b.continent, c.continent) AS continent, coalesce(b.country, c.country) AS country, coalesce(b.cell_id, c.cell_id) AS cell_id,
 coalesce(baseline_items, 0) AS baseline_items, coalesce(eligible_items, 0) AS eligible_items, baseline_latest, coalesce(candidate_items, 0) AS candidate_items, coalesce(supported_items, 0) AS supported_items,
 coalesce(rejected_items, 0) AS rejected_items, coalesce(pending_items, 0) AS pending_items, coalesce(uncertain_items, 0) AS uncertain_items, coalesce(ready_items, 0) AS ready_items, candidate_latest
 FROM (SELECT continent, country, cell_id, count(DISTINCT item_id) AS baseline_items, count(DISTINCT CASE WHEN eligible THEN item_id END) AS eligible_items, max(event_date) AS baseline_latest
  FROM ({R.BASELINE}) GROUP BY ALL) b
 FULL OUTER JOIN (SELECT continent, country, cell_id, count(DISTINCT item_id) AS candidate_items, count(DISTINCT CASE WHEN state = 'supported' THEN item_id END) AS supported_items,
  count(DISTINCT CASE WHEN state = 'rejected' THEN item_id END) AS rejected_items, count(DISTINCT CASE WHEN state = 'pending' THEN item_id END) AS pending_items, count(DISTINCT CASE WHEN state = 'uncertain' THEN item_id END) AS uncertain_items,
  count(DISTINCT CASE WHEN state = 'supported' AND ready THEN item_id END) AS ready_items, max(event_date) AS candidate_latest FROM ({R.CANDIDATES}) GROUP BY ALL) c
 ON b.continent = c.continent AND b.country = c.country AND b.cell_id = c.cell_id"""


@query(f"""SELECT *, baseline_items > 0 AND candidate_items = 0 AS baseline_only, baseline_items > 0 AND candidate_items > 0 AS matched, baseline_items = 0 AND candidate_items > 0 AS candidate_only,
 baseline_items = 0 AND supported_items > 0 AS reviewed_additional, baseline_items = 0 AND ready_items > 0 AS ready_additional FROM ({CELLS})""")
def full_outer_coverage(spark, d):
    return _cells(spark, d).withColumns(C.classify_membership()).orderBy("cell_id")


@query(f"""SELECT cell_id, count(DISTINCT item_id) AS items, count(DISTINCT CASE WHEN eligible THEN item_id END) AS eligible_items, count(DISTINCT CASE WHEN price > 100000 THEN item_id END) AS large_items,
 count(DISTINCT CASE WHEN priority = '1-URGENT' THEN item_id END) AS urgent_items, max(event_date) AS latest_date FROM ({R.BASELINE}) GROUP BY cell_id""")
def filtered_distinct_counts(spark, d):
    p = {"items": F.lit(True), "eligible_items": F.col("eligible"), "large_items": F.col("price") > 100000, "urgent_items": F.col("priority") == "1-URGENT"}
    return R.with_cells(V.filtered_distinct_counts(R.baseline_rows(spark, d), KEYS, "item_id", p, "event_date"), spark, d).select("cell_id", *p, "latest_date")


@query(f"""SELECT cell_id, count(DISTINCT CASE WHEN state = 'supported' THEN item_id END) AS supported_items, count(DISTINCT CASE WHEN state = 'rejected' THEN item_id END) AS rejected_items,
 count(DISTINCT CASE WHEN state = 'pending' THEN item_id END) AS pending_items, count(DISTINCT CASE WHEN state = 'uncertain' THEN item_id END) AS uncertain_items FROM ({R.CANDIDATES}) GROUP BY cell_id""")
def review_state_counts(spark, d):
    states = ("supported", "rejected", "pending", "uncertain")
    return R.with_cells(V.review_state_counts(R.candidate_rows(spark, d), KEYS, "item_id", "state", states), spark, d).select("cell_id", *[f"{s}_items" for s in states])


@query(f"""SELECT coalesce(a.cell_id, s.cell_id) AS cell_id, a.cell_id IS NOT NULL AS in_recomputed, s.cell_id IS NOT NULL AS in_stored,
 concat_ws(',', CASE WHEN a.n IS DISTINCT FROM s.n THEN 'n' END, CASE WHEN a.latest_date IS DISTINCT FROM s.latest_date THEN 'latest_date' END) AS differing FROM
 (SELECT cell_id, count(DISTINCT item_id) AS n, max(event_date) AS latest_date FROM ({R.BASELINE}) GROUP BY 1) a
 FULL OUTER JOIN (SELECT cell_id, count(DISTINCT item_id) AS n, max(event_date) AS latest_date FROM ({R.BASELINE}) WHERE priority <> '5-LOW' GROUP BY 1) s ON a.cell_id = s.cell_id""")
def reconcile_full_outer(spark, d):
    b = R.baseline_rows(spark, d)
    side = lambda x: V.filtered_distinct_counts(x, KEYS, "item_id", {"n": F.lit(True)}, "event_date")
    out = V.reconcile_full_outer(side(b), side(b.filter("priority <> '5-LOW'")), KEYS, ["n", "latest_date"])
    return R.with_cells(out, spark, d).select("cell_id", "in_recomputed", "in_stored", F.array_join("differing", ",").alias("differing"))


@query(f"""SELECT cell_id, CAST(n - coalesce(o, 0) + coalesce(w, 0) AS BIGINT) AS n FROM (SELECT cell_id, count(*) AS n FROM ({R.CANDIDATES}) GROUP BY 1) LEFT JOIN
 (SELECT cell_id, count(*) AS o FROM ({R.CANDIDATES}) WHERE state = 'rejected' GROUP BY 1) USING (cell_id) LEFT JOIN (SELECT cell_id, count(*) AS w FROM ({R.CANDIDATES}) WHERE state = 'rejected' AND ready GROUP BY 1) USING (cell_id)""")
def overlay_counts(spark, d):
    c = R.candidates(spark, d)
    n = lambda x: x.groupBy("cell_id").agg(F.count("*").alias("n"))
    return V.overlay_counts(n(c), n(c.filter("state = 'rejected'")), n(c.filter("state = 'rejected' AND ready")), ["cell_id"], "n")


ROLLUP = f"""SELECT CASE WHEN grouping(continent) = 1 THEN 'global' WHEN grouping(country) = 1 THEN 'continent' ELSE 'country' END AS scope_level, continent, country, CAST(sum(baseline_items) AS BIGINT) AS baseline_items,
 CAST(sum(candidate_items) AS BIGINT) AS candidate_items, count(CASE WHEN baseline_items = 0 AND candidate_items > 0 THEN 1 END) AS candidate_only_cells, max(candidate_latest) AS candidate_latest,
 list_sort(list_distinct(flatten(list(reasons)))) AS rs FROM (SELECT *, list_filter([CASE WHEN baseline_items = 0 THEN 'no_baseline' END, CASE WHEN pending_items > 0 THEN 'pending' END], lambda x: x IS NOT NULL) AS reasons FROM ({CELLS}))
 GROUP BY GROUPING SETS ((), (continent), (continent, country))"""


def _rollup(spark, d):
    state, reasons = C.deficiency_reasons({"no_baseline": F.col("baseline_items") == 0, "pending": F.col("pending_items") > 0})
    cells = _cells(spark, d).withColumn("_reasons", reasons)
    return V.hierarchy_rollup(cells, ["continent", "country"], ["baseline_items", "candidate_items"], {"candidate_only": (F.col("baseline_items") == 0) & (F.col("candidate_items") > 0)}, ["candidate_latest"], "_reasons")


@query(f"SELECT * EXCLUDE (rs), array_to_string(rs, ',') AS reasons FROM ({ROLLUP})")
def hierarchy_rollup(spark, d):
    return _rollup(spark, d).withColumn("reasons", F.array_join("reasons", ","))


@query(f"SELECT scope_level, continent, country, candidate_items, CASE WHEN scope_level = 'continent' THEN 0 ELSE 1 END AS position FROM ({ROLLUP}) WHERE continent = 'ASIA'")
def rollup_navigation(spark, d):
    return V.rollup_navigation(_rollup(spark, d), ["continent", "country"], "continent", "ASIA", "candidate_items").select("scope_level", "continent", "country", "candidate_items", "position")


@query("""SELECT node_id, array_to_string(list_filter([parent_id, grand], lambda x: x IS NOT NULL), '>') AS ancestors, false AS cycle, false AS orphan FROM (
 SELECT 'n' || n_nationkey AS node_id, 'r' || n_regionkey AS parent_id, 'world' AS grand FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world', NULL FROM region UNION ALL SELECT 'world', NULL, NULL)""")
def scope_ancestors(spark, d):
    n, r = R.table(spark, d, "nation"), R.table(spark, d, "region")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    nodes = nodes.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit("world").alias("parent_id"))).unionByName(r.limit(1).select(F.lit("world").alias("node_id"), F.lit(None).cast("string").alias("parent_id")))
    return V.scope_ancestors(nodes).withColumn("ancestors", F.array_join("ancestors", ">"))


@query(f"""SELECT m AS measure, l AS left_value, r AS right_value, l - r AS difference FROM (SELECT unnest(['baseline_items', 'candidate_items']) AS m, unnest([a.baseline_items, a.candidate_items]) AS l, unnest([b.baseline_items, b.candidate_items]) AS r
 FROM ({ROLLUP}) a, ({ROLLUP}) b WHERE a.scope_level = 'continent' AND a.continent = 'ASIA' AND b.scope_level = 'continent' AND b.continent = 'EUROPE')""")
def compare_scopes(spark, d):
    at = lambda c: (F.col("scope_level") == "continent") & (F.col("continent") == c)
    return V.compare_scopes(_rollup(spark, d), at("ASIA"), at("EUROPE"), ["baseline_items", "candidate_items"])


@query(f"""SELECT cell_id, candidate_latest - baseline_latest AS day_gap, CASE WHEN candidate_latest IS NULL OR baseline_latest IS NULL THEN 'data_deficient' WHEN candidate_latest > baseline_latest THEN 'later'
 WHEN candidate_latest < baseline_latest THEN 'earlier' ELSE 'same' END AS temporal_state FROM ({CELLS})""")
def temporal_contribution(spark, d):
    return _cells(spark, d).select("cell_id", *[c.alias(n) for n, c in V.temporal_contribution("candidate_latest", "baseline_latest").items()])


@query(f"""SELECT CASE WHEN baseline_items = 0 AND ready_items > 0 THEN 'release_ready' WHEN baseline_items = 0 AND supported_items > 0 THEN 'human_supported' WHEN baseline_items = 0 AND candidate_items > 0 THEN 'potential' ELSE 'none' END AS maturity,
 count(*) AS cells FROM ({CELLS}) GROUP BY 1""")
def coverage_contribution(spark, d):
    return _cells(spark, d).groupBy(V.coverage_contribution().alias("maturity")).agg(F.count("*").alias("cells"))


@query(f"""SELECT count(CASE WHEN baseline_items > 0 THEN 1 END) AS baseline_cells, count(CASE WHEN baseline_items = 0 AND candidate_items > 0 THEN 1 END) AS additional_cells,
 round(count(CASE WHEN baseline_items = 0 AND candidate_items > 0 THEN 1 END) * 100.0 / count(CASE WHEN baseline_items > 0 THEN 1 END), 6) AS uplift_percent, 'available' AS uplift_state FROM ({CELLS})""")
def coverage_uplift(spark, d):
    return V.coverage_uplift(_cells(spark, d))


@query("""SELECT CASE WHEN c_acctbal IS NULL THEN 'unavailable' WHEN c_custkey % 500 > c_acctbal / 10 THEN 'uncertain' WHEN c_acctbal / 10 <= 25 THEN 'within_range' WHEN c_acctbal / 10 <= 200 THEN 'range_edge' ELSE 'beyond_range' END AS state, count(*) AS n FROM customer GROUP BY 1""")
def range_edge_states(spark, d):
    c = R.table(spark, d, "customer").select((F.col("c_acctbal") / 10).alias("km"), (F.col("c_custkey") % 500).alias("u"))
    return c.groupBy(V.range_edge_state("km", "u").alias("state")).agg(F.count("*").alias("n"))


@query(f"""SELECT cell_id, candidate_items, CAST((SELECT greatest(count(*) - 20, 0) FROM ({CELLS}) WHERE candidate_items > 0) AS BIGINT) AS omitted FROM ({CELLS}) WHERE candidate_items > 0 ORDER BY candidate_items DESC, cell_id LIMIT 20""")
def metric_top_k_bounded(spark, d):
    return V.metric_top_k(_cells(spark, d), "candidate_items", 20, ["cell_id"]).select("cell_id", "candidate_items", F.col("omitted").cast("long").alias("omitted"))


@query(f"SELECT cell_id, candidate_items FROM ({CELLS}) WHERE continent = 'AFRICA' AND baseline_items = 0 AND candidate_items > 0 ORDER BY candidate_items DESC, cell_id LIMIT 15")
def gap_cell_list(spark, d):
    return V.gap_cell_list(_cells(spark, d), C.scope_filter("continent", "AFRICA"), [F.desc("candidate_items"), "cell_id"], 15).select("cell_id", "candidate_items")


@query(f"SELECT cell_id, round(2 + 18 * sqrt(candidate_items) / sqrt((SELECT max(candidate_items) FROM ({CELLS}))), 6) AS radius FROM ({CELLS})")
def bubble_scale(spark, d):
    return V.bubble_scale(_cells(spark, d), "candidate_items", 2.0, 20.0).select("cell_id", F.round("radius", 6).alias("radius"))


@query(f"SELECT cell_id FROM ({CELLS}) WHERE supported_items + rejected_items > 0")
def evidence_mode_filter(spark, d):
    return _cells(spark, d).filter(C.evidence_mode_filter("reviewed")).select("cell_id")


@query(f"SELECT country, count(*) AS n FROM ({R.BASELINE}) WHERE continent = 'EUROPE' GROUP BY 1")
def scope_filter(spark, d):
    return R.baseline(spark, d).filter(C.scope_filter("continent", "EUROPE")).groupBy("country").agg(F.count("*").alias("n"))


REASONS = {"no_baseline_rows_in_cell": "b = 0", "no_range_inference_eligible_baseline": "b > 0 AND e = 0", "unresolved_provider_duplicates": "dup > 0", "preserved_specimen_or_fossil_only": "b > 0 AND old = b", "coordinate_uncertainty_unavailable_for_all_baseline_rows": "b > 0 AND unk = b",
           "all_baseline_rows_have_geospatial_issues": "b > 0 AND iss = b", "credible_baseline_date_unavailable": "e > 0 AND latest IS NULL", "reviewed_quality_snapshot_unavailable": "pos > 0 AND snapshot IS NULL"}


@query(f"""SELECT cell_id, CASE WHEN reasons = '' THEN 'sufficient' ELSE 'data_deficient' END AS state, reasons FROM (SELECT cell_id, concat_ws(',', {", ".join(f"CASE WHEN {REASONS[k]} THEN '{k}' END" for k in sorted(REASONS))}) AS reasons FROM (
 SELECT c.cell_id, baseline_items AS b, eligible_items AS e, coalesce(dup, 0) AS dup, coalesce(old, 0) AS old, coalesce(unk, 0) AS unk, coalesce(iss, 0) AS iss, latest, supported_items AS pos, CASE WHEN c.country <> 'CHINA' THEN 'q1' END AS snapshot FROM ({CELLS}) c LEFT JOIN
 (SELECT cell_id, count(DISTINCT CASE WHEN owner_id % 50 = 0 THEN item_id END) AS dup, count(DISTINCT CASE WHEN priority = '5-LOW' THEN item_id END) AS old, count(DISTINCT CASE WHEN owner_id % 3 = 0 THEN item_id END) AS unk, count(DISTINCT CASE WHEN price > 200000 THEN item_id END) AS iss,
  max(CASE WHEN priority <> '3-MEDIUM' THEN event_date END) AS latest FROM ({R.BASELINE}) GROUP BY 1) x ON x.cell_id = c.cell_id))""")
def deficiency_reasons(spark, d):
    b = R.baseline(spark, d)
    p = {"unresolved_groups": F.col("owner_id") % 50 == 0, "preserved_items": F.col("priority") == "5-LOW", "unknown_uncertainty_items": F.col("owner_id") % 3 == 0, "issue_items": F.col("price") > 200000}
    facts = V.filtered_distinct_counts(b.withColumn("dated", F.when(F.col("priority") != "3-MEDIUM", F.col("event_date"))), ["cell_id"], "item_id", p, "dated")
    cells = _cells(spark, d).drop("baseline_latest").join(facts, "cell_id", "left").fillna(0, list(p)).withColumn("snapshot", F.when(F.col("country") != "CHINA", "q1"))
    state, reasons = C.deficiency_reasons(C.coverage_deficiency(latest="latest_date", positive="supported_items", quality="snapshot"))
    return cells.select("cell_id", state.alias("state"), F.array_join(reasons, ",").alias("reasons"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def left_join_stats(spark, d):
    s = R.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return V.left_join_stats(R.table(spark, d, "customer").select("c_custkey"), s, ["c_custkey"], ["n_orders", "total"])


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) ON c_custkey = o_custkey AND rn = 1""")
def latest_by_key_join(spark, d):
    o = R.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return V.latest_by_key_join(R.table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderdate", "o_orderkey").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT count(DISTINCT o_orderkey) AS n_items FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join_membership(spark, d):
    released = R.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.semi_join_membership(R.table(spark, d, "orders"), released, ["o_orderkey"], "o_orderkey")


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def context_left_join(spark, d):
    o, c, n = (R.table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").select("o_orderkey", "c_mktsegment", "n_name")  # nation is a fixed list


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_checked(spark, d):
    o, c = R.table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), R.table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    return C.join_checked(o, c, ["k"]).select("o_orderkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, p_type, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def multi_key_enrich(spark, d):
    li, p, s = (R.table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    out = C.multi_key_enrich(li.withColumnRenamed("l_partkey", "p_partkey"), p.select("p_partkey", "p_type"), ["p_partkey"], ["p_type"])
    return C.multi_key_enrich(out.withColumnRenamed("l_suppkey", "s_suppkey"), s.select("s_suppkey", "s_name"), ["s_suppkey"], ["s_name"]).select("l_orderkey", "l_linenumber", "p_type", "s_name")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_check(spark, d):
    return C.orphans(R.table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), R.table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), ["k"]).select(F.col("k").alias("c_custkey"), "c_nationkey")


@query("""SELECT count(CASE WHEN NOT l_quantity > 0 THEN 1 END) AS positive_quantity, count(CASE WHEN NOT l_discount < 0.1 THEN 1 END) AS small_discount, count(CASE WHEN NOT coalesce(l_shipdate >= TIMESTAMP '1993-01-01', false) THEN 1 END) AS recent FROM lineitem""")
def validate_rules(spark, d):
    return C.rule_violations(R.table(spark, d, "lineitem"), {"positive_quantity": F.col("l_quantity") > 0, "small_discount": F.col("l_discount") < 0.1, "recent": F.col("l_shipdate") >= F.lit("1993-01-01").cast("timestamp")})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS INT) AS o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def conform_schema(spark, d):
    return C.conform_schema(R.table(spark, d, "orders"), T.StructType([T.StructField("o_orderkey", T.StringType()), T.StructField("o_custkey", T.IntegerType()), T.StructField("o_orderdate", T.DateType())]))


@query("SELECT r_regionkey, r_name, (SELECT count(DISTINCT l_linestatus) FROM lineitem WHERE l_linestatus = 'O') AS n, 'O' AS l_linestatus FROM region")
def attach_scope(spark, d):
    scope = R.table(spark, d, "lineitem").filter("l_linestatus = 'O'")
    return C.attach_scope(R.table(spark, d, "region").withColumn("n", F.lit(1).cast("long")), scope, ["l_linestatus"])


LONG = """SELECT p_partkey, r AS spatial_resolution, c AS spatial_cell_id, c IS NOT NULL AS cell_supported, CASE WHEN c IS NULL THEN 'unsupported_precision' ELSE 'supported' END AS cell_support_status, q AS coordinate_quality FROM (
 SELECT p_partkey, CAST(unnest([3, 5, 7]) AS SMALLINT) AS r, unnest([p_brand, CASE WHEN p_size > 10 THEN p_type END, CASE WHEN p_size > 30 THEN p_name END]) AS c, CASE WHEN p_size > 25 THEN 'precise' WHEN p_size > 10 THEN 'regional' ELSE 'coarse' END AS q FROM part)"""


def _long(spark, d):
    p = R.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, "precise").when(F.col("p_size") > 10, "regional").otherwise("coarse").alias("coordinate_quality"),
                                         F.col("p_brand").alias("c3"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("c5"), F.when(F.col("p_size") > 30, F.col("p_name")).alias("c7"))
    return C.unpivot_precision_cells(p, ["p_partkey", "coordinate_quality"], {3: "c3", 5: "c5", 7: "c7"})


@query(LONG)
def unpivot_precision_cells(spark, d):
    return _long(spark, d)


@query(f"""SELECT p_partkey, spatial_resolution, cell_supported FROM ({LONG}) WHERE cell_supported IS DISTINCT FROM (coordinate_quality = 'precise' OR spatial_resolution = 3 OR (spatial_resolution = 5 AND coordinate_quality = 'regional'))""")
def check_precision_support(spark, d):
    rows = [(q, r, r <= most) for q, most in (("coarse", 3), ("regional", 5), ("precise", 7)) for r in (3, 5, 7)]
    support = spark.createDataFrame(rows, "coordinate_quality string, spatial_resolution short, expected boolean")
    return C.check_precision_support(_long(spark, d), support).select("p_partkey", "spatial_resolution", "cell_supported")


@query(f"""SELECT p_partkey, max(CASE WHEN cell_supported THEN spatial_resolution END) AS finest_resolution, max_by(CASE WHEN cell_supported THEN spatial_cell_id END, CASE WHEN cell_supported THEN spatial_resolution END) AS finest_cell_id,
 CASE WHEN bool_or(cell_supported AND spatial_resolution = 5) THEN 'available' ELSE 'blocked_precision' END AS requested_status FROM ({LONG}) GROUP BY 1""")
def select_finest_supported(spark, d):
    return C.select_finest_supported(_long(spark, d), ["p_partkey"], 5)


@query("SELECT page_id FROM pages WHERE url IS NULL OR trim(url) = '' OR html IS NULL OR trim(html) = ''")
def missing_provenance_filter(spark, d):
    return R.table(spark, d, "pages").filter(C.missing_provenance(["url", "html"])).select("page_id")


@query("SELECT page_id, CASE WHEN lower(url) LIKE 'https://%' AND page_id % 3 <> 0 AND page_id % 3 <> 1 THEN 'allowed' ELSE 'restricted' END AS status FROM pages")
def licence_filter(spark, d):
    licence = F.element_at(F.array(F.lit(""), F.lit("CC-BY-ND"), F.lit("CC-BY")), (F.col("page_id") % 3).cast("int") + 1)
    return R.table(spark, d, "pages").withColumn("licence", licence).select("page_id", C.licence_status("url", "licence").alias("status"))


TIER = "CASE WHEN CAST(split_part(query_tier, ':', 1) AS INT) <= 3 AND split_part(query_tier, ':', 2) = 'A' THEN 'T1' WHEN CAST(split_part(query_tier, ':', 1) AS INT) <= 6 AND split_part(query_tier, ':', 2) = 'A' THEN 'T2' WHEN CAST(split_part(query_tier, ':', 1) AS INT) <= 6 THEN 'T3' WHEN split_part(query_tier, ':', 2) = 'A' THEN 'T4' ELSE 'T5' END"


@query(f"SELECT {TIER} AS tier, count(*) AS n FROM ({R.QUERY_HITS}) GROUP BY 1")
def query_trust_tier(spark, d):
    return R.query_hits(spark, d).groupBy(C.query_trust_tier().alias("tier")).agg(F.count("*").alias("n"))


BANDS = """SELECT CASE WHEN p IS NULL THEN 'missing' WHEN p < 0.35 THEN 'low' WHEN p < 0.7 THEN 'middle' ELSE 'high' END AS score_band,
 CASE WHEN margin IS NULL THEN 'missing' WHEN margin < 0 THEN 'negative' WHEN margin < 0.02 THEN 'near_tie' WHEN margin < 0.15 THEN 'small' ELSE 'clear' END AS margin_band, count(*) AS n FROM ({}) GROUP BY 1, 2"""


@query(BANDS.format(R.DECISIONS))
def score_bands(spark, d):
    return R.decisions(spark, d).withColumns(C.score_bands("p", "margin")).groupBy("score_band", "margin_band").agg(F.count("*").alias("n"))


@query(f"SELECT (CASE WHEN p IS NULL THEN 'missing' WHEN p < 0.35 THEN 'low' WHEN p < 0.7 THEN 'middle' ELSE 'high' END) || '__' || lang AS stratum, count(*) AS n FROM ({R.DECISIONS}) GROUP BY 1")
def screening_strata(spark, d):
    return R.decisions(spark, d).groupBy(C.screening_strata(C.score_bands("p", "margin")["score_band"], F.col("lang")).alias("stratum")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN n_chars END, CASE WHEN doc_id % 2 = 0 THEN doc_id END, 7) AS size FROM documents""")
def stage_metric_coalesce(spark, d):
    docs = R.table(spark, d, "documents").withColumns({"m1": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")), "m2": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), "m3": F.lit(7).cast("long")})
    return docs.select("doc_id", *C.stage_metric_coalesce({"size": ["m1", "m2", "m3"]}))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN lang END AS lang, CASE WHEN l.doc_id IS NOT NULL THEN source END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def blind_projection(spark, d):
    rows = R.table(spark, d, "documents").join(R.table(spark, d, "labels"), "doc_id", "left")
    return C.blind_projection(rows, ["lang", "source"], F.col("quality").isNotNull()).select("doc_id", "lang", "source")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND coalesce(CASE WHEN event_id % 4 = 0 THEN 'settled' END, '') NOT IN ('settled')")
def actionable_review(spark, d):
    return R.table(spark, d, "events").withColumn("reason", F.when(F.col("event_id") % 4 == 0, "settled")).filter(C.actionable_review("event_type", "reason", ("view", "click"), ("settled",))).select("event_id")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, value * 2) AS score FROM events WHERE trim(event_type) <> ''")
def numeric_alias_pick(spark, d):
    e = R.table(spark, d, "events").withColumns({"a": F.when(F.col("event_id") % 2 == 0, F.col("value")), "b": F.col("value") * 2})
    return C.numeric_alias_pick(e, ["event_type"], ["a", "b"]).select("event_id", "score")


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS h FROM nation""")
def canonical_row_hash(spark, d):
    return R.table(spark, d, "nation").select("n_nationkey", C.canonical_row_hash(R.table(spark, d, "nation")).alias("h"))


FINGERPRINT = """WITH a AS (SELECT sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
 b AS (SELECT substr(h, 1, 4) || sha256(string_agg(h, ',' ORDER BY h)) AS h, count(*) AS n FROM a GROUP BY substr(h, 1, 4)), c AS (SELECT substr(h, 1, 2) || sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n) AS n FROM b GROUP BY substr(h, 1, 2))
 SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(h, ',' ORDER BY h)) AS fingerprint FROM c"""


@query(FINGERPRINT)
def dataset_fingerprint(spark, d):
    return C.dataset_fingerprint(R.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""SELECT *, 'expected' AS side FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT *, 'actual' FROM (SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)""")
def symmetric_diff(spark, d):
    return C.symmetric_diff(R.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), R.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey AS id, c_name AS name, NULL AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def union_by_name(spark, d):
    return C.union_by_name(R.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), R.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")))


@query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)")
def expected_key_union(spark, d):
    return C.expected_key_union(["k"], R.table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), R.table(spark, d, "customer").withColumnRenamed("c_custkey", "k"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def keep_first(spark, d):
    return C.keep_first(R.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def group_invariance_check(spark, d):
    return C.group_invariance(R.table(spark, d, "orders"), ["o_custkey"], ["o_orderstatus"])


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS found FROM lineitem GROUP BY 1 HAVING list_sort(list(l_linenumber)) <> [1, 2, 3]")
def projection_completeness(spark, d):
    out = C.projection_completeness(R.table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", [1, 2, 3])
    return out.select("l_orderkey", F.array_join(F.col("found").cast("array<string>"), ",").alias("found"))


@query("""SELECT l_orderkey, CASE WHEN len(s) = 1 THEN s[1] ELSE sha256('["' || array_to_string(s, '","') || '"]') END AS set_key FROM (SELECT l_orderkey, list_transform(list_sort(list(DISTINCT l_suppkey)), lambda x: CAST(x AS VARCHAR)) AS s FROM lineitem GROUP BY 1)""")
def identity_set_key(spark, d):
    return I.identity_set_keys(R.table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("SELECT c_nationkey AS cell, CAST(sum(n) AS BIGINT) AS items FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def presummed_counts(spark, d):
    return R.table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").count().groupBy(F.col("c_nationkey").alias("cell")).agg(F.sum("count").alias("items"))


@query(f"SELECT cell_id, baseline_items > 0 AND candidate_items = 0 AS baseline_only, baseline_items > 0 AND candidate_items > 0 AS matched, baseline_items = 0 AND candidate_items > 0 AS candidate_only FROM ({CELLS})")
def classify_membership(spark, d):
    flags = C.classify_membership()
    return _cells(spark, d).select("cell_id", *[flags[f].alias(f) for f in ("baseline_only", "matched", "candidate_only")])
