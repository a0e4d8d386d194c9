"""Sharding by sampled splitters, with DataFrame functions only.

A record's key is its text's hash, its doc_id and a row number that is written once,
so equal texts are neighbours and any group of copies, rows repeated as a whole too,
can be cut between its members. A seeded sample
draws keys, each row by itself, with a chance in proportion to size (half of the draw) and to row
count (the other half); every `PER_SPLITTER`-th sampled key bounds a range. Range
totals give each range's offset, a window inside the range gives each record's,
and a range that straddles a shard boundary is subdivided at the record.

Laws: `bytes` cuts at equal sizes (a shard is off by less than one record),
`rows` at equal counts (at most one apart), `key` is the hash of doc_id by
jump-style rendezvous: a further shard takes rows only into itself.

Null texts count as empty, null doc_ids sort last. Repeated rows have equal keys
and get neighbouring slots. An empty table gives an empty result. Result columns
replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._shared import materialize, ship, table

PER_SPLITTER = 16
ROWS_PER_RANGE = 2_000
MOST_RANGES = 16_384
SHARDS = 8


def record_size() -> Column:
    return F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long") + 1


def record_key() -> Column:
    """The text's MD5, doc_id with its sign bit flipped (a null last) and the row's number, as hexadecimal digits in byte order."""
    doc = F.col("v_doc").cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.concat("v_hash", F.coalesce(F.lpad(F.hex(doc), 16, "0"), F.lit("~" * 16)), F.lpad(F.hex("v_number"), 16, "0"))


def range_column(splitters: list[str], key: str) -> Column:
    """How many splitters are at or below the key, by binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    top = 1 << (len(splitters).bit_length() - 1)
    steps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])
    bounds = F.split(F.lit(",".join(splitters)), ",")
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) <= F.col(key), step).otherwise(0))


def sampled_splitters(keyed: DataFrame, n: int, total: int, seed: int = 1) -> list[str]:
    """Range boundaries, from at most about PER_SPLITTER * MOST_RANGES sampled keys."""
    ranges = max(SHARDS, min(MOST_RANGES, -(-n // ROWS_PER_RANGE)))
    draws = ranges * PER_SPLITTER
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "v_key"), 11) / float(1 << 53)
    chance = draws * 0.5 * (F.col("v_size") / float(total) + F.lit(1.0 / n))
    drawn = [r.v_key for r in keyed.filter(unit < chance).select("v_key").orderBy("v_key").collect()]  # about as many as draws: keys are unique, so each row is drawn by itself
    return sorted(set(drawn[PER_SPLITTER - 1 :: PER_SPLITTER]))


def rendezvous(shards: int, salt: int = 0) -> Column:
    """The shard whose hash with doc_id is highest: with one more shard, a row stays or moves to the new one."""
    weights = F.array(*[F.struct(F.xxhash64(F.lit(salt), F.lit(s), "v_doc").alias("h"), F.lit(s).alias("s")) for s in range(shards)])
    return F.array_max(weights)["s"]


def assign_shards(docs: DataFrame, law: str = "bytes", shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; with `carry` all columns of the input come first."""
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"unknown law {law!r}")
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    names = [c for c in docs.columns if c.lower() not in new] if carry else ["doc_id"]
    inner = [f"c{i}" for i in range(len(names))]  # the input's columns travel under names of our own
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = [F.col("doc_id").alias("v_doc"), record_size().alias("v_size"), F.crc32(text.cast("binary")).alias("v_crc"), F.md5(text).alias("v_hash"), F.monotonically_increasing_id().alias("v_number")]
    numbered = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)], *facts)
    keyed = materialize(numbered.withColumn("v_key", record_key()).drop("v_hash", "v_number"))  # row numbers count once they are written
    n, total = keyed.agg(F.count("*"), F.coalesce(F.sum("v_size"), F.lit(0))).first()
    splitters = sampled_splitters(keyed, n, total) if n else []
    ranged = keyed.withColumn("v_range", range_column(splitters, "v_key"))

    def placed(rows: DataFrame) -> DataFrame:
        """Adds the shard and v_index, the row's place in the order of keys."""
        inside = Window.partitionBy("v_range").orderBy("v_key")
        before = F.sum("v_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("v_size")
        at = rows.join(F.broadcast(offsets), "v_range")  # at most MOST_RANGES + 1 rows
        at = at.withColumn("v_index", F.col("v_rows_before") + F.row_number().over(inside) - 1).withColumn("v_start", F.col("v_bytes_before") + before)
        if law == "key":
            return at.withColumn("shard", rendezvous(shards).cast("int")).withColumn("grown_shard", rendezvous(shards + 1).cast("int"))
        middle = 2 * F.col("v_start") + F.col("v_size") if law == "bytes" else 2 * F.col("v_index") + 1
        cut = F.floor(middle * F.lit(shards) / F.lit(2 * (total if law == "bytes" else n) or 1))
        return at.withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int")).withColumn("grown_shard", F.lit(None).cast("int"))

    sums = ranged.groupBy("v_range").agg(F.sum("v_size").alias("b"), F.count("*").alias("r"))
    order = Window.orderBy("v_range").rowsBetween(Window.unboundedPreceding, -1)  # over at most MOST_RANGES + 1 rows
    offsets = materialize(sums.select("v_range", F.coalesce(F.sum("b").over(order), F.lit(0)).alias("v_bytes_before"), F.coalesce(F.sum("r").over(order), F.lit(0)).alias("v_rows_before")))
    rows = placed(ranged)
    inside = Window.partitionBy("v_range", "shard")
    counts = materialize(placed(ranged.select("v_doc", "v_key", "v_size", "v_range")).groupBy("v_range", "shard").agg(F.count("*").alias("c"), F.min("v_index").alias("v_first")))
    earlier = F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("v_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("v_range", "shard", earlier.alias("v_slot"), "v_first")
    if law == "key":
        rows = rows.withColumn("v_in", F.row_number().over(inside.orderBy("v_index")) - 1)
    out = rows.join(F.broadcast(starts), ["v_range", "shard"])  # at most shards * (MOST_RANGES + 1) rows
    slot = F.col("v_slot") + (F.col("v_in") if law == "key" else F.col("v_index") - F.col("v_first"))
    return out.select(*[F.col(i).alias(c) for c, i in zip(names, inner)], F.col("v_size").alias("size"), F.col("v_crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")


#: The law `bytes` in SQL: one global order and prefix sums. CRC-32 is spelt out byte by byte.
ORACLE_SQL = """WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
keyed AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
placed AS (SELECT *, sum(size) OVER w - size AS start, row_number() OVER w - 1 AS pos, sum(size) OVER () AS total FROM keyed WINDOW w AS (ORDER BY md5(text), doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)),
dealt AS (SELECT *, least(floor((2 * start + size) * 8 / (2 * total)), 7)::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_transform(range(1, size), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS text_crc32,
 'bytes' AS law, shard, (pos - min(pos) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM dealt, crc"""


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


ship(__name__)
