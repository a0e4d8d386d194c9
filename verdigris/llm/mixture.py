"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Sources in code point order weigh 3, 1, 2, 3, ...; together they get 150 % of all
words. A source's target stops at twice its size and the excess is shared again
by weight (water filling, in closed form over the sources sorted by cap per
weight). The targets become blocks of `BLOCK` words: seats go to the highest
quotients target / (2 * seats + 1), first between sources, then between the shards
of a source. A shard's documents stand in a seeded order; its quota takes whole
passes over them and then the first blocks of one more, so no document is taken
more than twice.

A source with many documents has many shards, so no window holds more than about
DOCS_PER_SHARD rows of a source, however hot. A row's shard comes from its doc_id; rows
of one doc_id, or without any, are dealt by their text and a number of their own. Documents without words have size 0
and nothing is taken from them; a null source is a source of its own. Repeated
rows are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._shared import materialize, ship, table, text_key

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_PASSES = 2
BLOCK = 8
DOCS_PER_SHARD = 2_000
MOST_SMALL = 10_000


def words_in(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """(v_source, v_total, ...) plus v_target. The table has one row per source."""
    ranked = sources.withColumn("v_rank", F.row_number().over(Window.orderBy(F.col("v_source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("v_weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("v_rank") % len(WEIGHTS)).cast("int") + 1))
    ranked = ranked.withColumn("v_cap", F.col("v_total") * MOST_PASSES)
    by_cap = Window.orderBy(F.col("v_cap") / F.col("v_weight"), "v_rank")
    everything = Window.partitionBy()
    share = F.sum("v_total").over(everything) * (SHARE_PERCENT / 100.0)
    caps_before = F.coalesce(F.sum("v_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights_left = F.sum("v_weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("v_level", (share - caps_before) / weights_left)
    above = F.col("v_cap") / F.col("v_weight") > F.col("v_level")
    level = level.withColumn("v_open", above).withColumn("v_water", F.max(F.when(above, F.col("v_level"))).over(everything))
    # up to the first open source levels rise with each cap that is taken off; beyond it they fall, so the first open level is the highest
    return level.withColumn("v_target", F.least(F.col("v_cap").cast("double"), F.coalesce(F.col("v_weight") * F.col("v_water"), F.col("v_cap").cast("double"))))


def sainte_lague(claims: DataFrame, group: list[str], weight: str, seats: str, tie: list[str]) -> DataFrame:
    """Adds v_seats: `seats` of each group dealt to the highest quotients weight / (2 * j + 1).

    A claim's seats lie within half the group's number of claims times its share
    of its quota, so only those quotients are ranked: about three per claim.
    """
    own = Window.partitionBy(*group)
    total, n = F.sum(weight).over(own), F.count("*").over(own)
    part = F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0))
    bounds = claims.withColumn("v_quota", F.col(seats) * part).withColumn("v_slack", n * part / 2 + 1)
    low = F.greatest(F.floor(F.col("v_quota") - F.col("v_slack")), F.lit(0))
    high = F.ceil(F.col("v_quota") + F.col("v_slack"))
    bounds = bounds.withColumn("v_low", low).withColumn("v_high", high)
    open_seats = F.col(seats) - F.sum("v_low").over(own)
    each = bounds.withColumn("v_open", open_seats).withColumn("v_j", F.explode(F.sequence(F.col("v_low"), F.col("v_high"))))
    rank = F.row_number().over(own.orderBy(F.desc(F.col(weight) / (2 * F.col("v_j") + 1)), *[F.col(t).asc_nulls_last() for t in tie], "v_j"))
    won = each.withColumn("v_won", ((rank <= F.col("v_open")) & (F.col(weight) > 0)).cast("long"))
    kept = [c for c in claims.columns]
    return won.groupBy(*kept).agg((F.first("v_low") + F.sum("v_won")).alias("v_seats"))


def _ordered(rows: DataFrame, seed: str) -> DataFrame:
    """Adds v_order, the seeded place of each row: by its doc_id, and for a doc_id of several rows, or none, by the text and a number among equal rows too.

    So rows of one id are dealt over all shards. Equal rows can't be told apart, so any numbers 0, 1, ... of theirs give
    the same result. The numbers come from counts by partition, so no window holds all rows of an id.
    """
    again = rows.groupBy("v_id").agg(F.count("*").alias("n")).filter("n > 1 or v_id = ''").select(F.col("v_id").alias("a_id"))
    again = materialize(again)
    plain = F.md5(F.concat(F.lit(seed + "|"), F.col("v_id")))
    if again.isEmpty():
        return rows.withColumn("v_order", plain)
    small = again.limit(MOST_SMALL + 1).count() <= MOST_SMALL
    marked = rows.join(F.broadcast(again) if small else again, F.col("v_id") == F.col("a_id"), "left")
    apart = materialize(marked.filter("a_id is not null").drop("a_id").withColumn("v_row", F.monotonically_increasing_id()))
    apart = apart.withColumn("v_part", F.shiftright("v_row", 33))
    group = ["v_id", "v_text", "v_source"]
    counts = apart.groupBy(*group, "v_part").count()
    before = F.sum("count").over(Window.partitionBy(*group).orderBy("v_part")) - F.col("count")
    offsets = materialize(counts.select(*[F.col(c).alias(f"o{c}") for c in (*group, "v_part")], before.alias("v_before")))
    same = [F.col(c).eqNullSafe(F.col(f"o{c}")) for c in (*group, "v_part")]
    number = F.row_number().over(Window.partitionBy(*group, "v_part").orderBy("v_row")) - 1 + F.col("v_before")
    key = F.concat_ws("|", F.lit(seed), F.col("v_id"), F.hex("v_text"), number.cast("string"))
    numbered = apart.join(offsets, reduce(lambda a, b: a & b, same)).withColumn("v_order", F.md5(key))
    return marked.filter("a_id is null").drop("a_id").withColumn("v_order", plain).unionByName(numbered.select(*rows.columns, "v_order"))


def take_words(docs: DataFrame, seed: str = "mix", carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken; with `carry` the input's columns as c0, c1, ..., then v_taken and v_size."""
    names = docs.columns if carry else ["doc_id"]
    inner = [f"c{i}" for i in range(len(names))]  # the input's columns travel under names of our own
    source, doc = F.col("source").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)], source.alias("v_source"), words_in().alias("v_size"), doc.alias("v_id"), text_key().alias("v_text"))
    sized = _ordered(sized, seed).drop("v_id", "v_text")
    light = materialize(sized.select("v_source", "v_size", "v_order") if carry else sized)
    sized = sized if carry else light
    totals = source_targets(light.groupBy("v_source").agg(F.sum("v_size").alias("v_total"), F.count("*").alias("v_docs")))
    totals = materialize(totals.withColumn("v_shards", F.ceil(F.col("v_docs") / DOCS_PER_SHARD)))
    small = totals.limit(MOST_SMALL + 1).count() <= MOST_SMALL
    facts = totals.select(F.col("v_source").alias("s_source"), "v_total", "v_target", "v_shards")
    facts = F.broadcast(facts) if small else facts  # beyond MOST_SMALL sources a shuffled join with skew handling

    def with_shard(rows: DataFrame) -> DataFrame:
        return rows.join(facts, F.col("v_source").eqNullSafe(F.col("s_source"))).withColumn("v_shard", F.conv(F.substring("v_order", 1, 8), 16, 10).cast("long") % F.col("v_shards"))

    blocks = totals.withColumn("v_blocks", F.round(F.sum("v_target").over(Window.partitionBy()) / BLOCK).cast("long")).withColumn("v_all", F.lit(0))
    seats = sainte_lague(blocks.select("v_all", "v_source", "v_target", "v_blocks"), ["v_all"], "v_target", "v_blocks", ["v_source"])
    shards = with_shard(light).groupBy("v_source", "v_shard").agg(F.sum("v_size").alias("v_words"))
    shards = shards.join(F.broadcast(seats) if small else seats, shards.v_source.eqNullSafe(seats.v_source)).select(shards.v_source, "v_shard", "v_words", F.col("v_seats").alias("v_mine"))
    quotas = sainte_lague(shards, ["v_source"], "v_words", "v_mine", ["v_shard"])
    quotas = quotas.select(F.col("v_source").alias("q_source"), F.col("v_shard").alias("q_shard"), "v_words", F.least(F.col("v_seats") * BLOCK, F.col("v_words") * MOST_PASSES).alias("v_quota"))
    quotas = materialize(quotas)
    bound = quotas.limit(MOST_SMALL + 1).count() <= MOST_SMALL
    rows = with_shard(sized)
    rows = rows.join(F.broadcast(quotas) if bound else quotas, F.col("v_source").eqNullSafe(F.col("q_source")) & (F.col("v_shard") == F.col("q_shard")))
    order = Window.partitionBy("v_source", "v_shard").orderBy("v_order", "v_size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("v_size").over(order) - F.col("v_size")
    passes = F.when(F.col("v_words") > 0, F.floor(F.col("v_quota") / F.col("v_words"))).otherwise(F.lit(0))
    rest = F.col("v_quota") - passes * F.col("v_words")
    taken = passes * F.col("v_size") + F.greatest(F.lit(0), F.least(F.col("v_size"), rest - start))
    rows = rows.withColumn("v_taken", taken.cast("long"))
    if carry:
        return rows.select(*inner, "v_taken", "v_size")
    return rows.select(F.col("c0").alias("doc_id"), F.col("v_size").alias("size"), F.col("v_total").alias("source_size"), F.col("v_target").alias("target"), F.col("v_taken").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole copy; columns stay."""
    rows = take_words(docs, carry=True)
    copies = F.when(F.col("v_size") > 0, F.floor(F.col("v_taken") / F.col("v_size") + 0.5)).otherwise(0).cast("int")
    return rows.withColumn("v_copies", copies).filter("v_copies > 0").withColumn("v_copy", F.explode(F.sequence(F.lit(1), F.col("v_copies")))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


#: The same by one global pass; blocks, seats and the seeded order are as above.
ORACLE_SQL = r"""WITH sized AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, count(*) AS docs FROM sized GROUP BY 1),
ranked AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rk, 2 * total AS cap FROM totals),
levels AS (SELECT *, (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM ranked),
water AS (SELECT *, max(CASE WHEN cap::DOUBLE / weight > lev THEN lev END) OVER () AS wl FROM levels),
targets AS (SELECT source, total, ceil(docs / 2000.0)::BIGINT AS shards, least(cap::DOUBLE, coalesce(weight * wl, cap::DOUBLE)) AS target FROM water),
need AS (SELECT CAST(round(sum(target) / 8) AS BIGINT) AS seats, sum(target) AS tot, count(*) AS n FROM targets),
b1 AS (SELECT source, target, seats, greatest(floor(seats * p - (n * p / 2 + 1)), 0)::BIGINT AS lo, ceil(seats * p + (n * p / 2 + 1))::BIGINT AS hi FROM (SELECT source, target, seats, n, CASE WHEN tot > 0 THEN target / tot ELSE 0 END AS p FROM targets, need)),
o1 AS (SELECT any_value(seats) - sum(lo) AS open FROM b1),
c1 AS (SELECT source, lo, target > 0 AND row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source NULLS LAST, j) <= open AS won FROM (SELECT source, target, lo, unnest(range(lo, hi + 1)) AS j FROM b1), o1),
s1 AS (SELECT source, any_value(lo) + count(CASE WHEN won THEN 1 END) AS mine FROM c1 GROUP BY 1),
placed AS MATERIALIZED (SELECT z.*, t.total, t.target, CAST('0x' || substr(ord, 1, 8) AS BIGINT) % t.shards AS shard FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
sh AS (SELECT p.source, shard, CAST(sum(size) AS BIGINT) AS words, any_value(mine) AS mine FROM placed p JOIN s1 ON p.source IS NOT DISTINCT FROM s1.source GROUP BY 1, 2),
b2 AS (SELECT *, greatest(floor(mine * p - (n * p / 2 + 1)), 0)::BIGINT AS lo, ceil(mine * p + (n * p / 2 + 1))::BIGINT AS hi FROM (SELECT *, count(*) OVER w AS n, CASE WHEN sum(words) OVER w > 0 THEN words::DOUBLE / sum(words) OVER w ELSE 0 END AS p FROM sh WINDOW w AS (PARTITION BY source))),
c2 AS (SELECT source, shard, words, lo, words > 0 AND row_number() OVER (PARTITION BY source ORDER BY words::DOUBLE / (2 * j + 1) DESC, shard, j) <= open AS won FROM (SELECT source, shard, words, lo, open, unnest(range(lo, hi + 1)) AS j FROM (SELECT *, mine - sum(lo) OVER (PARTITION BY source) AS open FROM b2))),
q AS (SELECT source, shard, words, least((any_value(lo) + count(CASE WHEN won THEN 1 END)) * 8, words * 2) AS quota FROM c2 GROUP BY 1, 2, 3),
runs AS (SELECT p.*, q.words, q.quota, CASE WHEN q.words > 0 THEN q.quota // q.words ELSE 0 END AS passes, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY ord, size ROWS UNBOUNDED PRECEDING) - size AS start FROM placed p JOIN q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard)
SELECT doc_id, CAST(size AS BIGINT) AS size, total AS source_size, target, CAST(passes * size + greatest(0, least(size, quota - passes * words - start)) AS BIGINT) AS taken FROM runs"""


def op8_mixture(spark, sf_dir: str) -> DataFrame:
    return take_words(table(spark, sf_dir, "documents"))


ship(__name__)
