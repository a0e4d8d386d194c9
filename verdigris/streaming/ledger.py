"""The ledger as a stream: at-least-once uploads to unique events, and consensus kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.ledger import project_consensus


def ingest(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Unique events by id as a stream of its own. Repeats within the watermark are dropped; rows later than it are dropped too, for the audit to count. `start_ingest` keeps them."""
    return events.withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp")).withWatermark("reviewed_at", late).dropDuplicatesWithinWatermark(["event_id"])


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _unseen(rows: DataFrame, path: str, number: int) -> DataFrame:
    """Rows of a batch whose events aren't stored by an earlier one. Only the stored days of the batch's own events are read, and of these the ids."""
    spark = rows.sparkSession
    if not _exists(spark, path):
        return rows
    days = [r.day for r in rows.select("day").distinct().collect()]  # the days of one batch
    stored = spark.read.parquet(path).filter(F.col("batch") < number)
    known = stored.filter(F.coalesce(F.col("day").isin([d for d in days if d is not None]), F.lit(False)) | (F.col("day").isNull() if None in days else F.lit(False)))
    seen = known.select("event_id").join(rows.select("event_id"), "event_id", "left_semi").distinct()
    return rows.join(seen, "event_id", "left_anti")


def start_ingest(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends unique events to a Parquet table (batch, day of reviewed_at) until what is there now has been read.

    However late an event comes, it is kept, and however late a repeat comes, it is dropped: a repeat has the id and time of
    its event, so a batch looks for its ids among the stored events of its own days. There is no state to keep or to
    expire. A batch that runs again overwrites its own files.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp")).withColumn("day", F.to_date("reviewed_at")).dropDuplicates(["event_id"]).persist()
        try:
            _unseen(rows, path, number).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number:09d}")
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit(sent: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: distinct events sent, stored, lost (late) and stored twice."""
    ids = sent.select("event_id").distinct()
    counts = stored.groupBy("event_id").count()
    both = ids.join(counts, "event_id", "full_outer")
    return both.agg(F.count("*").alias("sent"), F.count("count").alias("stored"), F.count_if(F.col("count").isNull()).alias("lost"), F.count_if(F.coalesce("count", F.lit(0)) > 1).alias("repeated"))


def refresh_consensus(ledger: DataFrame, touched: DataFrame) -> DataFrame:
    """Consensus of the touched items from a ledger that holds all their events."""
    return project_consensus(ledger.join(touched.select("item_id").distinct(), "item_id", "left_semi"))


def histories(events: DataFrame) -> DataFrame:
    """(item_id, events): for each item with new events in a batch all its events so far, once by id; the first to arrive stays. The state of an item is its events, and an id is a state of its own, so a batch reads and writes what its own items have."""
    return events.dropDuplicates(["item_id", "event_id"]).groupBy("item_id").agg(F.collect_list(F.struct(*events.columns)).alias("events"))


def start_consensus(spark: SparkSession, events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Per micro-batch: remember the events of its items, and write their consensus as the batch's version.

    The state is kept by item in Spark's state store (RocksDB on the executors' disks, saved to the checkpoint), so a batch
    costs what its own items have, however long the ledger is. Both states are Spark's own, a deduplication and an
    aggregation, so no item costs a call of Python. Repeats of an event change nothing: an item without other events has
    no new version. A batch that runs again starts from the state before it and overwrites its own files.
    `current_consensus` reads the last version of each item; `events_read` says how many events of the item a version read.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def step(batch: DataFrame, number: int) -> None:
        told = batch.persist()
        try:
            read = told.select(F.col("item_id").alias("_item"), F.size("events").cast("long").alias("events_read"))
            found = project_consensus(told.select(F.inline("events")))
            found.join(read, F.col("item_id") == F.col("_item")).drop("_item").write.mode("overwrite").parquet(f"{folder}/consensus/batch={number:09d}")
        finally:
            told.unpersist()

    return histories(events).writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """All versions of all items, with their batch."""
    return spark.read.parquet(f"{folder}/consensus")


def current_consensus(spark: SparkSession, folder: str) -> DataFrame:
    found = versions(spark, folder)
    values = [c for c in found.columns if c not in ("item_id", "batch")]
    return found.groupBy("item_id").agg(F.max_by(F.struct(*values), F.col("batch")).alias("_c")).select("item_id", "_c.*")


def compact_consensus(spark: SparkSession, folder: str, to: str) -> None:
    """The last version of each item as a table of its own."""
    current_consensus(spark, folder).write.parquet(to)
