"""The given tables in the roles that the operators expect, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def nations(spark, sf_dir) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("continent"))


def baseline_rows(spark, sf_dir) -> DataFrame:
    """Orders as observations, keyed by nation, segment and month: narrow keys that get their names after aggregation."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return rows.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.trunc("o_orderdate", "MM").alias("month"), F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") == "F").alias("eligible"),
                       F.to_date("o_orderdate").alias("event_date"), F.col("o_custkey").alias("owner_id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


def with_cells(rows: DataFrame, spark, sf_dir) -> DataFrame:
    """Adds continent, country and cell_id = nation, segment and month to rows or aggregates by these three."""
    named = rows.join(F.broadcast(nations(spark, sf_dir)), F.col("nation") == F.col("n_nationkey")).drop("n_nationkey")  # nations are a fixed list
    return named.withColumn("cell_id", F.concat_ws("|", "country", "segment", F.date_format("month", "yyyy-MM"))).drop("nation", "month")


def baseline(spark, sf_dir) -> DataFrame:
    """Orders as observations: cell = (nation, segment, month), eligible = status F."""
    return with_cells(baseline_rows(spark, sf_dir), spark, sf_dir)


BASELINE = """SELECT r_name AS continent, n_name AS country, c_mktsegment AS segment, concat_ws('|', n_name, c_mktsegment, strftime(o_orderdate, '%Y-%m')) AS cell_id, o_orderkey AS item_id,
 o_orderstatus = 'F' AS eligible, CAST(o_orderdate AS DATE) AS event_date, o_custkey AS owner_id, o_totalprice AS price, o_orderpriority AS priority
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def candidate_rows(spark, sf_dir) -> DataFrame:
    """Line items as candidates, keyed by the supplier's nation, a segment from the part key and month; review state from the flags."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    segment = F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("l_partkey") % 5).cast("int") + 1)
    state = F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_linestatus") == "O", "pending").otherwise("uncertain")
    rows = li.join(s, li.l_suppkey == s.s_suppkey)
    return rows.select(F.col("s_nationkey").alias("nation"), segment.alias("segment"), F.trunc("l_shipdate", "MM").alias("month"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), state.alias("state"),
                       F.to_date("l_shipdate").alias("event_date"), F.col("l_suppkey").alias("owner_id"), (F.col("l_discount") <= 0.04).alias("ready"))


def candidates(spark, sf_dir) -> DataFrame:
    """Line items as candidates: cell = (supplier nation, segment from the part key, month)."""
    return with_cells(candidate_rows(spark, sf_dir), spark, sf_dir)


CANDIDATES = """SELECT r_name AS continent, n_name AS country, seg AS segment, concat_ws('|', n_name, seg, strftime(l_shipdate, '%Y-%m')) AS cell_id, l_orderkey * 10 + l_linenumber AS item_id,
 CASE WHEN l_returnflag = 'A' THEN 'supported' WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'uncertain' END AS state,
 CAST(l_shipdate AS DATE) AS event_date, l_suppkey AS owner_id, l_discount <= 0.04 AS ready
 FROM (SELECT *, ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][CAST(l_partkey % 5 AS INT) + 1] AS seg FROM lineitem)
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def query_hits(spark, sf_dir) -> DataFrame:
    """Line items as search hits: (source, item) found by a query hash with a trust tier."""
    tier = F.concat_ws(":", F.month("l_shipdate").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("source"), F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("query_hash"), tier.alias("query_tier"),
                                                   F.concat(F.lit("term"), F.col("l_partkey") % 50).alias("search_term"))


QUERY_HITS = """SELECT l_linestatus AS source, l_orderkey AS item_id, l_suppkey AS query_hash, month(l_shipdate) || ':' || l_returnflag || ':' || l_linestatus AS query_tier,
 'term' || (l_partkey % 50) AS search_term FROM lineitem"""

def ledger(spark, sf_dir) -> DataFrame:
    """Events as a review ledger: ten items a user, five reviewers by event id; every seventh event replaces the reviewer's one before on the item, some decisive ones are adjudications, and a few differ in a field or point at a conflict."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    outcome = F.when(kind == "view", "yes").when(kind == "click", "no").when(kind == "purchase", "cant_tell").when(kind == "signup", "cant_view").otherwise("skipped")
    rows = e.select("event_id", (F.col("user_id") * 10 + F.floor(n / 5) % 10).alias("item_id"), (n % 5).alias("reviewer_id"), outcome.alias("outcome"), F.col("ts").alias("reviewed_at"), F.col("value").alias("confidence"))
    w = Window.partitionBy("item_id", "reviewer_id").orderBy("reviewed_at", "event_id")
    rows = rows.withColumn("review_round", F.row_number().over(w)).withColumn("earlier", F.lag("event_id").over(w))
    fields = {"non_target_category": F.when((F.col("outcome") == "no") & (n % 13 == 0), "other"), "alternative_taxon": F.when((F.col("outcome") == "no") & (n % 17 == 0), "alternative"), "life_stage": F.when(n % 19 == 0, "larva").otherwise("adult"),
              "visual_domain": F.when(n % 23 == 0, "artwork").otherwise("live_field"), "view": F.when(n % 29 == 0, "side").otherwise("dorsal"), "conflicts_with_decision_id": F.when(n % 101 == 0, n - 1), "duplicate_concern": n % 41 == 0}
    adjudication = (n % 31 == 0) & F.col("outcome").isin("yes", "no")
    return rows.withColumns(fields).withColumn("supersedes_event_id", F.when(n % 7 == 0, F.col("earlier"))).withColumn("event_type", F.when(adjudication, "adjudication").otherwise("review")).drop("earlier")


LEDGER = """SELECT event_id, item_id, reviewer_id, outcome, reviewed_at, confidence, review_round, CASE WHEN event_id % 7 = 0 THEN earlier END AS supersedes_event_id,
 CASE WHEN event_id % 31 = 0 AND outcome IN ('yes', 'no') THEN 'adjudication' ELSE 'review' END AS event_type, CASE WHEN outcome = 'no' AND event_id % 13 = 0 THEN 'other' END AS non_target_category,
 CASE WHEN outcome = 'no' AND event_id % 17 = 0 THEN 'alternative' END AS alternative_taxon, CASE WHEN event_id % 19 = 0 THEN 'larva' ELSE 'adult' END AS life_stage, CASE WHEN event_id % 23 = 0 THEN 'artwork' ELSE 'live_field' END AS visual_domain,
 CASE WHEN event_id % 29 = 0 THEN 'side' ELSE 'dorsal' END AS view, CASE WHEN event_id % 101 = 0 THEN event_id - 1 END AS conflicts_with_decision_id, event_id % 41 = 0 AS duplicate_concern FROM (
 SELECT *, row_number() OVER w AS review_round, lag(event_id) OVER w AS earlier FROM (SELECT event_id, user_id * 10 + (event_id // 5) % 10 AS item_id, event_id % 5 AS reviewer_id,
 CASE event_type WHEN 'view' THEN 'yes' WHEN 'click' THEN 'no' WHEN 'purchase' THEN 'cant_tell' WHEN 'signup' THEN 'cant_view' ELSE 'skipped' END AS outcome, ts AS reviewed_at, value AS confidence FROM events)
 WINDOW w AS (PARTITION BY item_id, reviewer_id ORDER BY reviewed_at, event_id))"""


def whole_text_key():
    """SHA-256 of the whole text in lower case, white space folded."""
    return F.sha2(F.lower(F.trim(F.regexp_replace("text", r"[\x09-\x0D\x20]+", " "))), 256)


WHOLE_TEXT_KEY = r"sha256(lower(trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g'))))"


def population(spark, sf_dir) -> DataFrame:
    """Documents as a sampling population, with the review outcome from the labels."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(lab, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("stratum"), F.concat_ws("/", "lang", "source").alias("owner_id"), whole_text_key().alias("group_id"),
                       F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.col("doc_id") % 3).cast("int") + 1).alias("split"), "quality", "toxic", "n_chars", "source")


POPULATION = f"""SELECT d.doc_id AS item_id, lang AS stratum, lang || '/' || source AS owner_id, {WHOLE_TEXT_KEY} AS group_id,
 ['train','dev','test'][CAST(d.doc_id % 3 AS INT) + 1] AS split, quality, toxic, n_chars, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def decisions(spark, sf_dir) -> DataFrame:
    """Labelled documents as decision samples: probability from length, margin, truth = quality."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    hundredths = F.floor((F.col("n_chars") % 1000) / 10)
    p = hundredths / 100.0
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("sample_id"), (F.col("quality") == 1).alias("truth"), F.when(F.col("doc_id") % 29 != 0, p).alias("p"), F.when(F.col("doc_id") % 31 != 0, (hundredths - 5 * (F.col("doc_id") % 11)) / 100.0).alias("margin"),
        (1.0 + F.col("doc_id") % 3).alias("weight"), (F.col("doc_id") % 17 != 0).alias("route_ok"), (F.col("toxic") == 1).alias("domain_negative"), (F.col("doc_id") % 23 == 0).alias("out_of_distribution"),
        (F.col("doc_id") % 19 != 0).alias("detail_ok"), (F.col("doc_id") % 13 != 0).alias("coverage_ok"), (F.col("doc_id") % 5 != 0).alias("geo_ok"), (F.col("doc_id") % 37 == 0).alias("no_geo_fallback"), F.when(F.col("doc_id") % 41 != 0, (hundredths - 7 * (F.col("doc_id") % 5)) / 100.0).alias("nonmatch_margin"),
        F.when(F.col("doc_id") % 3 == 0, "regional_competitor").when(F.col("doc_id") % 3 == 1, "other").alias("leading_outcome"), F.when(F.col("doc_id") % 2 == 0, "domain_negative").alias("negative_outcome"), F.element_at(F.array(F.lit("fit"), F.lit("test")), (F.col("doc_id") % 2).cast("int") + 1).alias("split"), "lang")


DECISIONS = """SELECT d.doc_id AS sample_id, quality = 1 AS truth, CASE WHEN d.doc_id % 29 <> 0 THEN floor((n_chars % 1000) / 10) / 100.0 END AS p,
 CASE WHEN d.doc_id % 31 <> 0 THEN (floor((n_chars % 1000) / 10) - 5 * (d.doc_id % 11)) / 100.0 END AS margin, 1.0 + d.doc_id % 3 AS weight, d.doc_id % 17 <> 0 AS route_ok, toxic = 1 AS domain_negative,
 d.doc_id % 23 = 0 AS out_of_distribution, d.doc_id % 19 <> 0 AS detail_ok, d.doc_id % 13 <> 0 AS coverage_ok, d.doc_id % 5 <> 0 AS geo_ok, d.doc_id % 37 = 0 AS no_geo_fallback, CASE WHEN d.doc_id % 41 <> 0 THEN (floor((n_chars % 1000) / 10) - 7 * (d.doc_id % 5)) / 100.0 END AS nonmatch_margin,
 CASE d.doc_id % 3 WHEN 0 THEN 'regional_competitor' WHEN 1 THEN 'other' END AS leading_outcome, CASE WHEN d.doc_id % 2 = 0 THEN 'domain_negative' END AS negative_outcome, ['fit','test'][CAST(d.doc_id % 2 AS INT) + 1] AS split, lang
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def points(spark, sf_dir) -> DataFrame:
    """Embeddings as points: two elements scaled to degrees."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.round(F.element_at("embedding", 1).cast("double") * 60, 4).alias("lon"), F.round(F.element_at("embedding", 2).cast("double") * 40, 4).alias("lat"), "label")


POINTS = """SELECT vec_id AS point_id, round(CAST(embedding[1] AS DOUBLE) * 60, 4) AS lon, round(CAST(embedding[2] AS DOUBLE) * 40, 4) AS lat, label FROM embeddings"""
