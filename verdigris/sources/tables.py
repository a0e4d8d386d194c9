"""Reading under a contract, and writing with receipts. Paths are Spark paths, so any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.operators.core import ContractError, assert_schema, conform_schema, union_by_name, validate_rules


def scan_parquet_contract(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet whose stored schema is the contract's."""
    return assert_schema(spark.read.parquet(path), schema)


def scan_ndjson(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """JSON lines under an explicit schema, projected and filtered."""
    df = spark.read.schema(schema).json(path)
    df = df if where is None else df.filter(where)
    return df.select(*columns) if columns else df


def scan_rows_document(spark: SparkSession, path: str, row: T.StructType, version: str) -> DataFrame:
    """A JSON document {schema_version, rows: [...]} as a table; another version is an error."""
    whole = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("rows", T.ArrayType(row))])
    doc = spark.read.schema(whole).option("multiLine", True).json(path)
    if not doc.filter(~F.col("schema_version").eqNullSafe(F.lit(version))).isEmpty():
        raise ContractError(f"document is not of version {version}")
    return doc.select(F.explode("rows").alias("r")).select("r.*")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_bytes, sha256) of every file under a path. A task holds one file at a time; a file of 2 GB or more is beyond one value, and none that Spark writes is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Differences between files and manifest (name, n_bytes, sha256), empty if all is well."""
    found = file_digests(spark, path)
    keys = ["name", "n_bytes", "sha256"]
    missing = manifest.join(found, keys, "left_anti").select("name", F.lit("missing_or_changed").alias("problem"))
    return missing.unionByName(found.join(manifest, keys, "left_anti").select("name", F.lit("not_in_manifest_or_changed").alias("problem")))


def write_parquet_atomic(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """zstd Parquet; the commit protocol makes files visible together."""
    df.write.option("compression", "zstd").mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_aligned_batches(frames: list[DataFrame], schema: T.StructType, path: str) -> None:
    """Many frames under one schema; columns that a frame lacks are null."""
    write_parquet_atomic(conform_schema(union_by_name(*frames), schema), path)


def write_with_receipt(df: DataFrame, path: str) -> DataFrame:
    """Writes and returns one row (uri, n_rows, n_files, n_bytes, codec), read back from the store."""
    write_parquet_atomic(df, path)
    spark = df.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
    rows = spark.read.parquet(path).agg(F.count("*").alias("n_rows"))
    return rows.join(F.broadcast(files)).select(F.lit(path).alias("uri"), "n_rows", "n_files", "n_bytes", F.lit("zstd").alias("codec"))  # one row each


def write_bucket_views(df: DataFrame, bucket: str, path: str) -> None:
    df.write.option("compression", "zstd").partitionBy(bucket).parquet(path)


def export_csv_ordered(df: DataFrame, columns: list[str], order: list, path: str) -> None:
    """Fixed columns in a total order with CRLF line ends; files sort by name."""
    df.select(*columns).orderBy(*order).write.option("lineSep", "\r\n").csv(path, header=True)


def geojson_features(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def export_geojson_points(df: DataFrame, lon: str, lat: str, properties: list[str], order: list, k: int, path: str) -> None:
    """The first k rows in order as GeoJSON point features, one a line."""
    geojson_features(df.orderBy(*order).limit(k), lon, lat, properties).write.text(path)


def export_label_table(df: DataFrame, schema: T.StructType, rules: dict[str, Column], order: list[str], path: str) -> None:
    """A typed and validated label table, sorted inside of its files."""
    write_parquet_atomic(validate_rules(conform_schema(df, schema), rules).sortWithinPartitions(*order), path)
