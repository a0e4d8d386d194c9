"""Queries of the replay and identity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import core as C
from verdigris.operators import identity as I
from verdigris.operators import replay as P
from verdigris.plans import roles as R
from verdigris.plans.coverage import TIER
from verdigris.plans.registry import query


@query(f"SELECT source, item_id, min(query_hash) AS query_hash, count(*) AS n_rows FROM ({R.QUERY_HITS}) GROUP BY 1, 2")
def dedupe_any_value(spark, d):
    return P.dedupe_any_value(R.query_hits(spark, d), ["source", "item_id"], "query_hash")


@query(f"SELECT source, item_id, query_hash, sha256(CAST(item_id AS VARCHAR)) AS feature FROM ({R.QUERY_HITS})")
def fan_back(spark, d):
    return P.fan_back(R.query_hits(spark, d).select("source", "item_id", "query_hash"), ["item_id"], lambda k: k.withColumn("feature", F.sha2(F.col("item_id").cast("string"), 256)))


@query(f"SELECT source, item_id, query_hash FROM (SELECT *, row_number() OVER (PARTITION BY source, item_id ORDER BY query_hash, search_term, query_tier) AS rn FROM ({R.QUERY_HITS})) WHERE rn = 1")
def anti_join_duplicates(spark, d):
    return P.anti_join_duplicates(R.query_hits(spark, d), ["source", "item_id"], ["query_hash", "search_term", "query_tier"]).select("source", "item_id", "query_hash")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS avoided FROM (SELECT count(*) AS n FROM ({R.QUERY_HITS}) GROUP BY source, item_id)")
def work_avoided(spark, d):
    return P.work_avoided(R.query_hits(spark, d), ["source", "item_id"])


@query(f"SELECT {TIER} AS bucket, count(*) AS n_rows, count(DISTINCT source || '|' || item_id) AS items, count(DISTINCT search_term) AS terms, count(DISTINCT query_hash) AS hashes FROM ({R.QUERY_HITS}) GROUP BY 1")
def query_yield(spark, d):
    return P.query_yield(R.query_hits(spark, d), C.query_trust_tier())


STAGES = """SELECT 0 AS position, 'orders' AS stage, count(*) AS n_rows, count(CASE WHEN o_orderkey IS NULL THEN 1 END) AS n_null FROM orders UNION ALL
 SELECT 1, 'final', count(*), 0 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'returned', count(*), 0 FROM lineitem WHERE l_returnflag = 'R'"""


def _stages(spark, d):
    o, li = R.table(spark, d, "orders"), R.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return P.stage_row_counts({"orders": o, "final": o.filter("o_orderstatus = 'F'"), "returned": li.filter("l_returnflag = 'R'")}, "o_orderkey")


@query(STAGES)
def stage_row_counts(spark, d):
    return _stages(spark, d)


@query(f"""SELECT position, stage, n_rows, CASE WHEN stage = 'returned' THEN 'lines' ELSE 'orders' END AS unit, CASE WHEN stage = 'final' THEN round(n_rows * 1.0 / lag(n_rows) OVER (ORDER BY position), 6) END AS conversion, 'available' AS status FROM ({STAGES})""")
def evidence_funnel(spark, d):
    return P.evidence_funnel(_stages(spark, d), {"orders": "orders", "final": "orders", "returned": "lines"}).drop("n_null")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def count_mapping(spark, d):
    return P.count_mapping(R.table(spark, d, "orders"), "o_orderpriority")


@query("SELECT count(*) AS n_rows, count(CASE WHEN p_size > 25 THEN 1 END) AS large, count(CASE WHEN p_retailprice < 1000 THEN 1 END) AS cheap, count(DISTINCT CASE WHEN starts_with(p_brand, 'Brand#1') THEN p_brand END) AS prefixed_clusters FROM part")
def workload_summary(spark, d):
    return P.workload_summary(R.table(spark, d, "part"), "p_brand", "Brand#1", {"large": F.col("p_size") > 25, "cheap": F.col("p_retailprice") < 1000})


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_candidates, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS candidates, arg_max(l_suppkey, (l_extendedprice, l_suppkey)) AS target FROM lineitem GROUP BY 1""")
def candidate_set_summary(spark, d):
    return P.candidate_set_summary(R.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_extendedprice")


@query("SELECT p_brand, count(CASE WHEN p_size <= 40 THEN 1 END) AS eligible, count(CASE WHEN NOT p_size <= 40 THEN 1 END) AS disabled, max(p_size) AS max_priority FROM part GROUP BY 1")
def definition_summary(spark, d):
    return P.definition_summary(R.table(spark, d, "part"), F.col("p_size") <= 40, "p_brand", "p_size")


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'open' WHEN event_type = 'purchase' THEN 'done' ELSE event_type END AS status, count(*) AS n, count(DISTINCT user_id) AS media, max(value) AS max_priority FROM events GROUP BY 1")
def queue_summary(spark, d):
    return P.queue_summary(R.table(spark, d, "events"), "event_type", {"view": "open", "click": "open", "purchase": "done"}, "user_id", "value")


@query("SELECT c_nationkey, count(DISTINCT c_custkey) AS available, CAST(greatest(60 - count(DISTINCT c_custkey), 0) AS BIGINT) AS shortfall, CASE WHEN count(DISTINCT c_custkey) >= 60 THEN 'ready' ELSE 'short' END AS status FROM customer GROUP BY 1")
def readiness_summary(spark, d):
    return P.readiness_summary(R.table(spark, d, "customer"), "c_nationkey", 60, "c_custkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def representative_record(spark, d):
    return P.representative_record(R.table(spark, d, "lineitem"), "l_partkey", ["l_partkey"])


@query("SELECT event_type, count(value) AS n, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS most FROM events GROUP BY 1")
def numeric_summary(spark, d):
    return P.numeric_summary(R.table(spark, d, "events"), "event_type", "value").withColumn("median", F.round("median", 6))


def _sessions(spark, d):
    """Conversations as work: a user's turn makes time active and acts ten seconds later, an answer pauses; the last event completes."""
    from pyspark.sql import Window

    c = R.table(spark, d, "conversations")
    event = lambda kind, state, seconds: F.struct(F.lit(kind).alias("kind"), F.lit(state).cast("string").alias("state"), F.lit(seconds).alias("seconds"))
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1
    events = F.when(F.col("role") == "user", F.array(event("activity", "active", 0), event("action", None, 10))).otherwise(F.array(event("activity", "paused", 0)))
    rows = c.withColumn("e", F.concat(events, F.when(last, F.array(event("completion", None, 20))).otherwise(F.array().cast("array<struct<kind:string,state:string,seconds:int>>")))).select("conv_id", "turn", F.md5("text").alias("target"), F.posexplode("e").alias("i", "e"))
    at = F.timestamp_seconds(1700000000 + F.col("turn") * 60 + F.col("conv_id") % 60 + F.col("e.seconds"))
    return rows.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")).alias("number"), at.alias("at"), "e.kind", "e.state", "target")


SESSIONS = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS number, 1700000000000 + (turn * 60 + conv_id % 60 + s) * 1000 AS ms, kind, state, md5(text) AS target FROM (
 SELECT conv_id, turn, text, 0 AS i, 0 AS s, 'activity' AS kind, CASE WHEN role = 'user' THEN 'active' ELSE 'paused' END AS state FROM conversations UNION ALL SELECT conv_id, turn, text, 1, 10, 'action', NULL FROM conversations WHERE role = 'user'
 UNION ALL SELECT conv_id, turn, text, 2, 20, 'completion', NULL FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)"""
INTERVALS = f"SELECT * FROM (SELECT *, lead(state) OVER w AS nxt, lead(ms) OVER w AS until_ms, lead(number) OVER w AS until_number FROM ({SESSIONS}) WHERE kind = 'activity' WINDOW w AS (PARTITION BY conv_id ORDER BY number)) WHERE state = 'active' AND nxt = 'paused'"


@query(f"SELECT conv_id, number, until_number AS until_order, until_ms - ms AS active_ms FROM ({INTERVALS})")
def session_intervals(spark, d):
    out = P.session_intervals(_sessions(spark, d), "conv_id", "number", "at")
    return out.select("conv_id", "number", "until_order", (F.unix_millis("until") - F.unix_millis("at")).alias("active_ms"))


@query(f"""WITH s AS (SELECT *, lag(ms) OVER w AS early, number = max(number) OVER (PARTITION BY conv_id) AS final FROM ({SESSIONS}) WINDOW w AS (PARTITION BY conv_id ORDER BY number)),
 m AS (SELECT s.*, (SELECT arg_max(x.state, x.number) FROM s x WHERE x.conv_id = s.conv_id AND x.kind = 'activity' AND x.number < s.number) AS was FROM s)
 SELECT conv_id, 'overlapping_activity' AS rule FROM m WHERE kind = 'activity' AND state = 'active' AND was = 'active' UNION SELECT conv_id, 'pause_without_activity' FROM m WHERE kind = 'activity' AND state = 'paused' AND was IS DISTINCT FROM 'active'
 UNION SELECT conv_id, 'action_outside_activity' FROM m WHERE kind = 'action' AND was IS DISTINCT FROM 'active' UNION SELECT conv_id, 'activity_left_open' FROM m WHERE final AND coalesce(CASE WHEN kind = 'activity' THEN state END, was) = 'active'
 UNION SELECT conv_id, 'not_chronological' FROM m WHERE ms < early UNION SELECT conv_id, 'completion_not_final' FROM m WHERE (kind = 'completion') <> final""")
def session_violations(spark, d):
    return P.session_violations(_sessions(spark, d), "conv_id", "number", "at")


@query(f"""SELECT conv_id, actions, targets, CAST(coalesce(ms, 0) AS BIGINT) AS active_ms FROM (SELECT conv_id, count(CASE WHEN kind = 'action' THEN 1 END) AS actions, count(DISTINCT CASE WHEN kind = 'action' THEN target END) AS targets FROM ({SESSIONS}) GROUP BY 1)
 LEFT JOIN (SELECT conv_id, sum(until_ms - ms) AS ms FROM ({INTERVALS}) GROUP BY 1) USING (conv_id)""")
def session_activity_summary(spark, d):
    return P.session_activity_summary(_sessions(spark, d), "conv_id", "number", "at", "target")


@query("""SELECT a.o_custkey AS pair, a.t AS first, b.t AS second, b.t - a.t AS delta, round((b.t - a.t) * 1.0 / a.t, 6) AS relative FROM (SELECT o_custkey, count(*) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
 JOIN (SELECT o_custkey, count(*) AS t FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey)""")
def paired_deltas(spark, d):
    per = R.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("pair"), "o_orderstatus").agg(F.count("*").alias("t"))
    return P.paired_deltas(per, "pair", "o_orderstatus", ("F", "O"), "t")


@query("""SELECT o_orderkey, n_name, r_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def id_join_chain(spark, d):
    li, o, s, n, r = (R.table(spark, d, t) for t in ("lineitem", "orders", "supplier", "nation", "region"))
    out = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    return out.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("o_orderkey", "n_name", "r_name", "s_name")


@query("SELECT vec_id, e.label, members FROM embeddings e JOIN (SELECT label, count(*) AS members FROM embeddings GROUP BY 1) c ON e.label = c.label")
def cluster_assignment_join(spark, d):
    e = R.table(spark, d, "embeddings")
    return e.join(e.groupBy("label").agg(F.count("*").alias("members")), "label").select("vec_id", "label", "members")


URL = """CASE WHEN regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') THEN NULL WHEN lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) NOT IN ('http', 'https') THEN NULL ELSE
 lower(regexp_extract(trim(url), '^([A-Za-z]+)://([^/?#:@]*)', 1)) || '://' || lower(regexp_extract(trim(url), '^([A-Za-z]+)://([^/?#:@]*)', 2)) || CASE WHEN regexp_extract(trim(url), '^[A-Za-z]+://[^/?#:@]*(:\\d+)?([^#]*)', 2) = '' THEN '/' ELSE regexp_extract(trim(url), '^[A-Za-z]+://[^/?#:@]*(:\\d+)?([^#]*)', 2) END END"""


@query(f"SELECT page_id, {URL} AS canonical_url FROM pages")
def normalize_url(spark, d):
    return R.table(spark, d, "pages").select("page_id", I.normalize_url(F.col("url")).alias("canonical_url"))


def _records(spark, d):
    """Pages as records of three providers: some with the provider's number, the central index's number, a scoped occurrence id, or place, day and observer only."""
    p, n = R.table(spark, d, "pages"), F.col("page_id")
    kind = n % 8
    text = lambda c: c.cast("string")
    return p.select("page_id", F.when(kind < 6, F.col("url")).alias("url"), F.element_at(F.array(F.lit("east"), F.lit("west"), F.lit("north")), (n % 3).cast("int") + 1).alias("source"), F.lit("index").alias("delivery"),
                    F.when(kind == 0, text(F.floor(n / 16))).alias("provider_id"), F.when(kind == 1, text(F.floor(n / 16))).alias("index_key"), F.when(kind == 2, F.lit("museum")).alias("ns"), F.when(kind == 2, text(n % 24)).alias("occ"),
                    F.when(kind == 6, F.concat(F.lit("Observer "), text(n % 5))).alias("observer"), F.when(kind == 6, text(n % 40)).alias("day"), F.regexp_extract("url", r"://([^/]*)", 1).alias("host"), F.regexp_extract("url", r"/(en|de|fr|es)/", 1).alias("lang"))


RECORDS = """SELECT page_id, CASE WHEN page_id % 8 < 6 THEN url END AS url, ['east', 'west', 'north'][CAST(page_id % 3 AS INT) + 1] AS source, 'index' AS delivery, CASE WHEN page_id % 8 = 0 THEN CAST(page_id // 16 AS VARCHAR) END AS provider_id, CASE WHEN page_id % 8 = 1 THEN CAST(page_id // 16 AS VARCHAR) END AS index_key,
 CASE WHEN page_id % 8 = 2 THEN 'museum' END AS ns, CASE WHEN page_id % 8 = 2 THEN CAST(page_id % 24 AS VARCHAR) END AS occ, CASE WHEN page_id % 8 = 6 THEN 'Observer ' || (page_id % 5) END AS observer, CASE WHEN page_id % 8 = 6 THEN CAST(page_id % 40 AS VARCHAR) END AS day,
 regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang FROM pages"""
IDENTITY = f"""SELECT * EXCLUDE (b, addr), b.m AS identity_method, b.p AS identity_priority, sha256(concat_ws(chr(31), 'v1', b.m, b.ns, b.v)) AS canonical_id FROM (SELECT *, CASE WHEN provider_id IS NOT NULL THEN {{'m': 'provider_identity', 'p': 1, 'ns': source, 'v': provider_id}} WHEN index_key IS NOT NULL THEN {{'m': 'provider_identity', 'p': 1, 'ns': 'index', 'v': index_key}}
 WHEN ns IS NOT NULL THEN {{'m': 'scoped_occurrence_id', 'p': 3, 'ns': ns, 'v': occ}} WHEN addr IS NOT NULL THEN {{'m': 'stable_source_reference', 'p': 4, 'ns': source, 'v': addr}} WHEN observer IS NOT NULL THEN {{'m': 'strict_composite', 'p': 5, 'ns': source, 'v': lower(observer) || chr(31) || day}}
 ELSE {{'m': 'singleton', 'p': 7, 'ns': delivery, 'v': CAST(page_id AS VARCHAR)}} END AS b FROM (SELECT *, {URL} AS addr FROM ({RECORDS})))"""


def _identity(spark, d):
    return I.resolve_identity(_records(spark, d), [("provider_id", F.col("source")), ("index_key", F.lit("index"))], ("ns", "occ"), "url", ["observer", "day"], "page_id")


@query(f"SELECT page_id, identity_method, identity_priority, canonical_id FROM ({IDENTITY})")
def resolve_identity(spark, d):
    return _identity(spark, d).select("page_id", "identity_method", "identity_priority", "canonical_id")


@query(f"""SELECT page_id, CASE lang WHEN 'en' THEN 'alpha' WHEN 'de' THEN 'beta' ELSE host END AS origin, CASE WHEN lang IN ('en', 'de') THEN 'redelivered' ELSE 'direct' END AS relationship FROM ({RECORDS})""")
def classify_origin(spark, d):
    return I.classify_origin(_records(spark, d), "lang", {"en": "alpha", "de": "beta"}, "host").select("page_id", "origin", "relationship")


DEEPER = " + ".join(f"CASE WHEN members > {I.LIST * 256**d} THEN 2 ELSE 0 END" for d in range(7))
DUPLICATES = f"""WITH RECURSIVE held AS (SELECT DISTINCT sha256(text) AS h, CAST(doc_id AS VARCHAR) AS member FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), sizes AS (SELECT h, count(*) AS members FROM held GROUP BY 1 HAVING count(*) > 1),
 fold(h, depth, hash) AS (SELECT h, {DEEPER}, sha256(member) FROM held JOIN sizes USING (h) WHERE members > {I.LIST} UNION ALL SELECT h, depth - 2, left(hash, depth) || sha256(string_agg(hash, ',' ORDER BY hash)) FROM fold WHERE depth >= 0 GROUP BY h, depth, left(hash, depth)),
 ids AS (SELECT h, sha256(string_agg(member, chr(31) ORDER BY member)) AS group_id FROM held JOIN sizes USING (h) WHERE members <= {I.LIST} GROUP BY 1 UNION ALL SELECT h, hash FROM fold WHERE depth = -2)
 SELECT h, member, members, group_id FROM held JOIN sizes USING (h) JOIN ids USING (h)"""


@query(DUPLICATES)
def duplicate_groups(spark, d):
    """Copies of a text with the id of their set: the hash of the listed ids, or of the tree that `set_digests` folds a set of over 256 ids into."""
    return I.duplicate_groups(R.table(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id"), "h", "doc_id")[1]


CLASSES = f"SELECT canonical_id, host, lang, source, min(page_id) AS member, count(*) AS n FROM ({IDENTITY}) GROUP BY 1, 2, 3, 4"


@query(f"""SELECT * FROM (SELECT a.canonical_id, a.member AS left_member, b.member AS right_member, a.n AS left_rows, b.n AS right_rows, concat_ws(',', CASE WHEN a.host <> b.host THEN 'host' END, CASE WHEN a.lang <> b.lang THEN 'lang' END, CASE WHEN a.source <> b.source THEN 'source' END) AS contradictions
 FROM ({CLASSES}) a JOIN ({CLASSES}) b ON a.canonical_id = b.canonical_id AND a.member < b.member) WHERE contradictions <> ''""")
def pairwise_contradictions(spark, d):
    fields = ["host", "lang", "source"]
    classes, _ = I.value_classes(_identity(spark, d), "canonical_id", "page_id", fields)
    return I.expand_contradictions(classes, "canonical_id", fields).withColumn("contradictions", F.array_join("contradictions", ","))


KNOWN = " UNION ALL ".join(f"SELECT canonical_id, '{f}' AS field, {f} AS value FROM ({IDENTITY}) WHERE {f} IS NOT NULL" for f in ("host", "lang", "source"))


@query(f"""WITH s AS (SELECT canonical_id, field, value, count(*) AS n FROM ({KNOWN}) GROUP BY 1, 2, 3)
 SELECT canonical_id, field, CAST(any_value(v) AS BIGINT) AS values, CAST(any_value(t) AS BIGINT) AS rows, CAST(sum(a.n * b.n) AS BIGINT) AS pairs FROM s a JOIN s b USING (canonical_id, field) JOIN (SELECT canonical_id, field, count(*) AS v, sum(n) AS t FROM s GROUP BY 1, 2) USING (canonical_id, field) WHERE a.value < b.value GROUP BY 1, 2""")
def contradiction_summary(spark, d):
    return I.contradictions(_identity(spark, d), "canonical_id", "page_id", ["host", "lang", "source"])[0]


@query(f"SELECT page_id, min(page_id) OVER (PARTITION BY canonical_id, host, lang, source) AS member FROM ({IDENTITY})")
def contradiction_members(spark, d):
    """Which value class each linked record belongs to: with the pairs of classes this gives all pairs of records."""
    return I.value_classes(_identity(spark, d), "canonical_id", "page_id", ["host", "lang", "source"])[1].select("page_id", "member")


@query(f"""SELECT page_id, CASE WHEN rn = 1 THEN 'canonical' WHEN source = cp THEN 'exact_duplicate_removed' ELSE 'cross_provider_duplicate_removed' END AS relationship FROM (SELECT *, row_number() OVER w AS rn, first_value(source) OVER w AS cp FROM ({IDENTITY}) WINDOW w AS (PARTITION BY canonical_id ORDER BY identity_priority, page_id))""")
def provider_union(spark, d):
    return I.provider_union(_identity(spark, d), "canonical_id", "source", ["identity_priority", "page_id"])[1].select("page_id", "relationship")


@query(f"""WITH RECURSIVE e AS (SELECT doc_id, sha256(text) AS a, {R.WHOLE_TEXT_KEY} AS b FROM documents), adj AS (SELECT x.doc_id AS s, y.doc_id AS t FROM e x JOIN e y ON x.a = y.a OR x.b = y.b),
 r(i, j) USING KEY (i) AS (SELECT doc_id, doc_id FROM documents UNION SELECT adj.t, min(r.j) FROM r JOIN adj ON adj.s = r.i JOIN recurring.r c ON c.i = adj.t WHERE r.j < c.j GROUP BY adj.t) SELECT i AS doc_id, j AS group_id FROM r""")
def link_groups(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("a"), R.whole_text_key().alias("b"))
    return I.link_groups(docs, "doc_id", ["a", "b"])


@query(f"""SELECT 'group_crosses_split' AS kind, group_id AS key, count(DISTINCT split) AS n FROM ({R.POPULATION}) GROUP BY 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'group_crosses_owner', group_id, count(DISTINCT owner_id) FROM ({R.POPULATION}) GROUP BY 2 HAVING count(DISTINCT owner_id) > 1
 UNION ALL SELECT 'owner_crosses_split', owner_id, count(DISTINCT split) FROM ({R.POPULATION}) GROUP BY 2 HAVING count(DISTINCT split) > 1""")
def split_leakage_check(spark, d):
    return I.split_leakage(R.population(spark, d), "group_id", "owner_id", "split")


@query("""SELECT 'c' || c_custkey AS root, unnest(['c' || c_custkey, 'n' || n_nationkey, 'r' || n_regionkey]) AS node FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def lineage_closure(spark, d):
    c, n = R.table(spark, d, "customer"), R.table(spark, d, "nation")
    pair = lambda a, x, b, y: (F.concat(F.lit(a), x).alias("node"), F.concat(F.lit(b), y).alias("parent"))
    edges = c.select(*pair("c", "c_custkey", "n", "c_nationkey")).unionByName(n.select(*pair("n", "n_nationkey", "r", "n_regionkey")))
    return I.lineage_closure(edges, c.select(F.concat(F.lit("c"), "c_custkey").alias("node")))


@query("SELECT doc_id, sha256(text) AS content_id, len(text)::INT AS n_chars, len(regexp_extract_all(text, '[0-9]'))::INT AS n_digits FROM documents")
def compute_once_fan_back(spark, d):
    """The costly step, here counts over a whole text, runs once per content and comes back to every document that has it."""
    docs = R.table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("content_id"))
    work = lambda one: one.select("content_id", F.char_length("text").alias("n_chars"), F.regexp_count("text", F.lit("[0-9]")).alias("n_digits"))
    return P.compute_once_fan_back(docs, "content_id", ["text"], work).select("doc_id", "content_id", "n_chars", "n_digits")


@query("SELECT o_orderkey, 'target' AS kind FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'competitor' FROM orders WHERE o_orderpriority = '1-URGENT'")
def candidate_union(spark, d):
    o = R.table(spark, d, "orders")
    return C.union_by_name(o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("target").alias("kind")), o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("competitor").alias("kind")))


@query("SELECT n_nationkey, n_name, 'nation' AS level FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def vertical_concat(spark, d):
    n, r = R.table(spark, d, "nation"), R.table(spark, d, "region")
    return C.union_by_name(n.select("n_nationkey", "n_name", F.lit("nation").alias("level")), r.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit("region").alias("level")))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END, o_orderkey")
def ordered_output(spark, d):
    ranks = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    return C.ordered_output(R.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), {"o_orderpriority": ranks}, ["o_orderkey"])
