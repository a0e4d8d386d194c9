"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.identity import shared_path


def ship(name: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors, and columns stay compressed."""
    spark = df.sparkSession
    path = shared_path(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bound the Arrow batches sent to Python tasks by rows and by bytes: long documents must not add up to one huge batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: str = "text"):
    """128 bits of a text, null as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


ship(__name__)
