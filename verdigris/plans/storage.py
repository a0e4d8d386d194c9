"""Queries of sources, sinks and streams: each writes the given tables into the shared folder and reads them again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.operators.identity import shared_path
from verdigris.plans import roles as R
from verdigris.plans.ledger import CONSENSUS
from verdigris.plans.registry import query
from verdigris.sources import tables as X
from verdigris.streaming import ledger as stream


_place = shared_path


@query("SELECT n_nationkey, n_name FROM nation")
def scan_parquet_contract(spark, d):
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())])
    return X.scan_parquet_contract(spark, f"{d}/nation.parquet", schema).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_ndjson(spark, d):
    path, orders = _place(spark), R.table(spark, d, "orders")
    orders.write.json(path)
    return X.scan_ndjson(spark, path, orders.schema, ["o_orderkey", "o_totalprice"], F.col("o_orderstatus") == "F")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_rows_document(spark, d):
    path, nation = _place(spark), R.table(spark, d, "nation")
    doc = nation.agg(F.to_json(F.struct(F.lit("v1").alias("schema_version"), F.collect_list(F.struct(*nation.columns)).alias("rows"))).alias("value"))
    doc.write.text(path)
    return X.scan_rows_document(spark, path, nation.schema, "v1")


@query("SELECT count(*) AS n_rows, 'zstd' AS codec, true AS has_bytes FROM customer")
def write_with_receipt(spark, d):
    receipt = X.write_with_receipt(R.table(spark, d, "customer"), _place(spark))
    return receipt.select("n_rows", "codec", (F.col("n_bytes") > 0).alias("has_bytes"))


@query("SELECT 0 AS problems, 1 AS problems_after_change FROM region LIMIT 1")
def verify_files(spark, d):
    path = _place(spark)
    R.table(spark, d, "orders").write.parquet(path)
    manifest = X.file_digests(spark, path).filter("name like '%.parquet'")
    files = lambda m: X.verify_files(spark, path, m).filter("name like '%.parquet' AND problem = 'missing_or_changed'")
    one = F.broadcast(manifest.agg(F.min("name").alias("one")))  # one row
    changed = manifest.join(one).withColumn("n_bytes", F.col("n_bytes") + (F.col("name") == F.col("one")).cast("int")).drop("one")
    return files(manifest).agg(F.count("*").cast("int").alias("problems")).join(F.broadcast(files(changed).agg(F.count("*").cast("int").alias("problems_after_change"))))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def write_bucket_views(spark, d):
    path = _place(spark)
    X.write_bucket_views(R.table(spark, d, "part"), "p_brand", path)
    return spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, c_name AS name, NULL::INT AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def write_aligned_batches(spark, d):
    path = _place(spark)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("size", T.IntegerType())])
    X.write_aligned_batches([R.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), R.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))], schema, path)
    return spark.read.parquet(path)


@query("SELECT c_custkey, c_name FROM customer")
def export_csv_ordered(spark, d):
    path = _place(spark)
    X.export_csv_ordered(R.table(spark, d, "customer"), ["c_custkey", "c_name"], ["c_custkey"], path)
    return spark.read.option("lineSep", "\r\n").schema("c_custkey long, c_name string").csv(path, header=True)


@query(f"SELECT point_id, lon FROM ({R.POINTS}) ORDER BY point_id LIMIT 100")
def export_geojson_points(spark, d):
    path = _place(spark)
    X.export_geojson_points(R.points(spark, d), "lon", "lat", ["point_id"], ["point_id"], 100, path)
    rows = spark.read.text(path).select(F.from_json("value", "geometry struct<coordinates:array<double>>, properties struct<point_id:bigint>").alias("v"))
    return rows.select("v.properties.point_id", F.get("v.geometry.coordinates", 0).alias("lon"))


@query("SELECT doc_id, quality, toxic FROM labels")
def export_label_table(spark, d):
    path = _place(spark)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    X.export_label_table(R.table(spark, d, "labels"), schema, {"known": F.col("doc_id").isNotNull(), "binary": F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)}, ["doc_id"], path)
    return spark.read.parquet(path)


@query("SELECT count(*) AS sent, count(*) AS stored, 0 AS lost, 0 AS repeated FROM events")
def stream_ledger_ingest(spark, d):
    """The later half of the ledger comes first, then all of it, as late uploads and retries do; the stored table has each event once."""
    path, ledger = _place(spark), R.ledger(spark, d)
    middle = ledger.agg(F.percentile_approx("reviewed_at", 0.5)).first()[0]
    for part in (ledger.filter(F.col("reviewed_at") > middle), ledger):
        part.write.mode("append").parquet(path + "/sent")
        stream.start_ingest(spark.readStream.schema(ledger.schema).parquet(path + "/sent"), path + "/stored", path + "/state").awaitTermination()
    return stream.audit(ledger, spark.read.parquet(path + "/stored"))


@query(f"SELECT item_id, status, consensus_outcome, decisive FROM ({CONSENSUS})")
def stream_consensus(spark, d):
    """Two micro-batches by time; the last version of each item equals the batch result."""
    path, ledger = _place(spark), R.ledger(spark, d)
    middle = ledger.agg(F.percentile_approx("reviewed_at", 0.5)).first()[0]
    for part in (ledger.filter(F.col("reviewed_at") <= middle), ledger.filter(F.col("reviewed_at") > middle)):
        part.write.mode("append").parquet(path + "/sent")
        stream.start_consensus(spark, spark.readStream.schema(ledger.schema).parquet(path + "/sent"), path + "/out", path + "/state").awaitTermination()
    return stream.current_consensus(spark, path + "/out").select("item_id", "status", "consensus_outcome", "decisive")



@query("SELECT s_suppkey, s_name FROM supplier")
def write_parquet_atomic(spark, d):
    path = _place(spark)
    X.write_parquet_atomic(R.table(spark, d, "supplier"), path)
    X.write_parquet_atomic(R.table(spark, d, "supplier"), path, overwrite=True)
    return spark.read.parquet(path).select("s_suppkey", "s_name")
