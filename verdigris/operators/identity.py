"""Record identity, duplicate groups, linked components, unions of providers, leakage and lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; without it a temporary one, in local sessions only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/verdigris-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port or fragment; null with credentials, another scheme or no host."""
    scheme, host, port = (F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]*)(?::(\d+))?([^#]*)", i) for i in (1, 2, 3))
    rest = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]*(?::\d+)?([^#]*)", 1)
    scheme = F.lower(scheme)
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    built = F.concat(scheme, F.lit("://"), F.lower(host), F.when(plain, F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.when(rest == "", F.lit("/")).otherwise(rest))
    credentials = F.trim(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@")
    return F.when(scheme.isin("http", "https") & (host != "") & ~credentials, built)


def positive_integer(column: str) -> Column:
    """A whole number over 0 as text without leading zeros, null if blank; anything else fails the query."""
    text = F.trim(F.col(column).cast("string"))
    whole = F.regexp_replace(text, r"^0+(?=\d)", "")
    return F.when(text.isNull() | (text == ""), F.lit(None)).when(text.rlike(r"^\d*[1-9]\d*$"), whole).otherwise(F.raise_error(F.concat(F.lit(f"{column} is no positive integer: "), text)).cast("string"))


def resolve_identity(df: DataFrame, providers: list[tuple], occurrence: tuple[str, str], url: str, composite: list[str], singleton: str, source: str = "source", delivery: str = "delivery") -> DataFrame:
    """The strongest usable basis: method, priority, namespace and hashed canonical id.

    `providers` are (column, namespace) in order of trust, or (column, namespace, "positive_integer") where the id must be one; then come the occurrence id in its scope, the stable address and
    the strict composite, both in the source's namespace, and the row itself. A namespace is part of every key, so equal
    numbers of two providers stay apart.
    """

    def present(*cols: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in cols])

    def option(method: str, priority: int, ok: Column, namespace: Column, *parts: Column) -> Column:
        key = F.concat_ws("\x1f", F.lit("v1"), F.lit(method), namespace, *parts)
        return F.when(ok, F.struct(F.lit(method).alias("identity_method"), F.lit(priority).alias("identity_priority"), namespace.cast("string").alias("identity_namespace"), F.sha2(key, 256).alias("canonical_id")))

    address = normalize_url(F.col(url))
    text = lambda c: F.trim(F.col(c).cast("string"))
    found = F.coalesce(
        *[option("provider_identity", 1, present(c), ns, positive_integer(c) if kind else text(c)) for c, ns, *kind in providers],
        option("scoped_occurrence_id", 3, present(*occurrence), text(occurrence[0]), text(occurrence[1])),
        option("stable_source_reference", 4, address.isNotNull(), F.col(source), address),
        option("strict_composite", 5, present(*composite), F.col(source), *[F.lower(text(c)) for c in composite]),
        option("singleton", 7, F.lit(True), F.col(delivery), F.col(singleton).cast("string")),
    )
    return df.withColumn("_id", found).select("*", "_id.*").drop("_id")


def classify_origin(df: DataFrame, key: str, origins: dict[str, str], delivery: str) -> DataFrame:
    """Origin provider by exact dataset key, else the delivering provider itself."""
    mapped = reduce(lambda acc, kv: F.when(F.col(key) == kv[0], F.lit(kv[1])).otherwise(acc), origins.items(), F.lit(None).cast("string"))
    return df.withColumn("origin", F.coalesce(mapped, F.col(delivery))).withColumn("relationship", F.when(mapped.isNotNull() & (mapped != F.col(delivery)), "redelivered").otherwise("direct"))


LIST = 256


def set_digests(members: DataFrame, keys: list[str], member: str, order: str, few: Callable[[Column], Column], most: int = LIST) -> DataFrame:
    """(keys, members, digest) of each key's set of strings; rows of `members` are distinct, and members aren't null.

    Up to `most` members are listed by `order` and `few` gives their digest. A larger set is folded as a tree: its members fall
    into buckets by the first hexadecimal digits of their hash, so many digits that a bucket holds about `most` members; a
    bucket's sorted hashes are hashed, then the sorted digests of 256 buckets with common digits, up to the root. The
    depth follows from the number of members alone, so the digest is that of the set under any partitioning, and no
    list grows with the set.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("members"))
    low, k = [F.col(f"m.{c}") for c in keys], [F.col(f"s.{c}") for c in keys]
    same = reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(low, k)])
    sized = members.alias("m").join(sizes.filter(F.col("members") > most).alias("s"), same)
    listed = members.alias("m").join(sizes.filter(F.col("members") <= most).alias("s"), same)
    small = listed.groupBy(*[x.alias(c) for x, c in zip(k, keys)]).agg(few(F.transform(F.sort_array(F.collect_list(F.struct(F.col(f"m.{order}").alias("o"), F.col(f"m.{member}").alias("t")))), lambda x: x["t"])).alias("digest"), F.first("members").alias("members")).select(*keys, "members", "digest")
    digits = sum((F.when(F.col("members") > most * 256**d, 2).otherwise(0) for d in range(7)), F.lit(0))
    level = written(sized.select(*[x.alias(c) for x, c in zip(k, keys)], "members", digits.alias("_digits"), F.sha2(F.col(f"m.{member}"), 256).alias("_hash")))
    deepest = level.agg(F.max("_digits")).first()[0] or 0
    for depth in range(deepest, -1, -2):
        now = F.col("_digits") >= depth
        bucket = F.substring("_hash", 1, depth).alias("_bucket")
        folded = level.filter(now).groupBy(*keys, "members", "_digits", bucket).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_hash")), ","), 256).alias("_fold"))
        level = level.filter(~now).unionByName(folded.select(*keys, "members", "_digits", F.concat("_bucket", "_fold").alias("_hash")))
    return small.unionByName(level.select(*keys, "members", F.col("_hash").alias("digest")))


def duplicate_groups(df: DataFrame, key: str, member: str) -> tuple[DataFrame, DataFrame]:
    """(groups, membership): keys with two or more distinct members, their number and a group_id from the set of members; and the same with a row for each member."""
    rows = df.filter(F.col(key).isNotNull() & F.col(member).isNotNull()).select(F.col(key), F.col(member).cast("string").alias("member")).distinct()
    ids = set_digests(rows, [key], "member", "member", lambda m: F.sha2(F.array_join(m, "\x1f"), 256))
    groups = ids.filter("members > 1").withColumnRenamed("digest", "group_id")
    return groups, rows.join(groups, key)


def identity_set_keys(df: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """(keys, set_key): the only id of each key, null without one, or the hash of the sorted set; a large set's hash is folded as a tree."""
    rows = df.filter(F.col(ids).isNotNull()).select(*keys, F.col(ids).alias("_id")).distinct()
    few = lambda m: F.when(F.size(m) == 1, m[0]).otherwise(F.sha2(F.to_json(m), 256))
    found = set_digests(rows.withColumn("_t", F.col("_id").cast("string")), keys, "_t", "_id", few)
    every = df.select(*keys).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys])
    return every.alias("e").join(found.alias("f"), same, "left").select(*[F.col(f"e.{c}").alias(c) for c in keys], F.col("f.digest").alias("set_key"))


def value_classes(df: DataFrame, link: str, member: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classes, members): rows of a link that are equal in all fields are one class, with its least member and its number of rows; and each row's class."""
    linked = df.filter(F.col(link).isNotNull())
    values = linked.groupBy(link, *fields).agg(F.min(member).alias("member"), F.count("*").alias("n"))
    same = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"v.{c}")) for c in (link, *fields)])
    members = linked.alias("r").join(values.alias("v"), same).select(F.col(f"r.{link}").alias(link), F.col(f"r.{member}").alias(member), F.col("v.member").alias("member"))
    return values, members


def contradictions(df: DataFrame, link: str, member: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(summary, values): per link and field with contradictions the number of values, of rows that know the field, and of contradictory pairs of rows; and the values with their rows.

    Two rows contradict in a field if both know it and it differs, so the pairs follow from the sizes of the values,
    (n^2 - sum of squares) / 2: a link with a third of all rows costs its rows and no pair is made.
    """
    linked = df.filter(F.col(link).isNotNull())
    held = linked.select(link, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))).filter("value is not null")
    sizes = held.groupBy(link, "field", "value").agg(F.count("*").alias("rows"))
    n = F.col("rows").cast("decimal(38,0)")
    total = sizes.groupBy(link, "field").agg(F.count("*").alias("values"), F.sum("rows").alias("rows"), F.sum(n * n).alias("_squares"))
    pairs = ((F.col("rows").cast("decimal(19,0)") * F.col("rows").cast("decimal(19,0)") - F.col("_squares")) / 2).cast("long")
    summary = total.filter(F.col("values") > 1).select(link, "field", "values", "rows", pairs.alias("pairs"))
    return summary, sizes.join(summary.select(link, "field"), [link, "field"], "left_semi")


def expand_contradictions(classes: DataFrame, link: str, fields: list[str], links: DataFrame | None = None) -> DataFrame:
    """Pairs on request: per two classes of a link the fields that both know and that differ, for the links of a table, or for all."""
    asked = classes if links is None else classes.join(links.select(link).distinct(), link, "left_semi")
    a, b = asked.alias("a"), asked.alias("b")
    pairs = a.join(b, (F.col(f"a.{link}") == F.col(f"b.{link}")) & (F.col("a.member") < F.col("b.member")))
    differ = F.array_compact(F.array(*[F.when(F.col(f"a.{f}") != F.col(f"b.{f}"), F.lit(f)) for f in fields]))
    found = pairs.select(F.col(f"a.{link}").alias(link), F.col("a.member").alias("left_member"), F.col("b.member").alias("right_member"), F.col("a.n").alias("left_rows"), F.col("b.n").alias("right_rows"), differ.alias("contradictions"))
    return found.filter(F.size("contradictions") > 0)


def provider_union(df: DataFrame, identity: str, provider: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, audit): one row per identity, first in a total order; the audit marks each row kept or removed.

    The first of each identity comes from an aggregate and is joined back, so an identity with very many rows is split.
    """
    first = df.groupBy(F.col(identity).alias("_identity")).agg(F.min(F.struct(*order)).alias("_first"), F.min_by(provider, F.struct(*order)).alias("canonical_provider"))
    marked = df.join(written(first), F.col(identity).eqNullSafe(F.col("_identity"))).withColumn("_kept", F.struct(*order).eqNullSafe(F.col("_first")))
    relationship = F.when(F.col("_kept"), "canonical").when(F.col(provider) == F.col("canonical_provider"), "exact_duplicate_removed").otherwise("cross_provider_duplicate_removed")
    audit = marked.withColumn("relationship", relationship).drop("_identity", "_first", "_kept")
    return marked.filter("_kept").select(*df.columns), audit


def link_groups(df: DataFrame, item: str, keys: list[str]) -> DataFrame:
    """(item, group_id): the least item id reachable over shared keys.

    Items of a key are linked to its least item, so there are no more links than items and keys. Then links contract: a
    link that is its larger end's only one is written off as a pointer and leaves; the rest becomes stars, each node's
    larger neighbours linked to its least one, and then its smaller neighbours too. So each round writes less than the
    one before, and finished groups are never read again. Pointers are followed in the end, the last round's first.
    """
    edges = reduce(lambda a, b: a.unionByName(b), [df.filter(F.col(k).isNotNull()).select(F.col(item).alias("i"), F.lit(n).alias("f"), F.col(k).cast("string").alias("k")) for n, k in enumerate(keys)])
    heads = written(edges.groupBy("f", "k").agg(F.min("i").alias("r"), F.max("i").alias("last")).filter("r <> last").drop("last"))
    links = written(edges.join(heads, ["f", "k"]).filter("i <> r").select(F.col("i").alias("a"), F.col("r").alias("b")).distinct())
    pointers = []
    while not links.isEmpty():
        degree = links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count().filter("count = 1").select(F.col("v").alias("a"))
        marked = written(links.join(degree.withColumn("alone", F.lit(True)), "a", "left"))
        pointers.append(marked.filter("alone").select("a", "b"))
        rest = marked.filter("alone is null").select("a", "b")
        least = rest.groupBy(F.col("b").alias("v")).agg(F.min("b").alias("m")).unionByName(rest.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))).groupBy("v").agg(F.min("m").alias("m"))
        # a node's larger neighbours go to the least of it and its neighbours
        large = rest.join(least.withColumnRenamed("v", "b"), "b").select("a", F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # a node and its smaller neighbours go to the least of them
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        links = written(small)
    labels = None
    for step in reversed(pointers):
        ends = step.withColumnRenamed("b", "to") if labels is None else step.join(labels.select(F.col("a").alias("b"), "to"), "b", "left").select("a", F.coalesce("to", "b").alias("to"))
        labels = written(ends if labels is None else labels.unionByName(ends))
    every = df.select(F.col(item).alias("a")).distinct()
    found = every.withColumn("to", F.col("a")) if labels is None else every.join(labels, "a", "left").select("a", F.coalesce("to", "a").alias("to"))
    return found.select(F.col("a").alias(item), F.col("to").alias("group_id"))


def split_leakage(df: DataFrame, group: str, owner: str, split: str) -> DataFrame:
    """Groups and owners that cross splits, and groups that cross owners: (kind, key, n)."""
    one = lambda key, value, kind: df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count_distinct(value).alias("n")).filter("n > 1").withColumn("kind", F.lit(kind))
    return one(group, split, "group_crosses_split").unionByName(one(group, owner, "group_crosses_owner")).unionByName(one(owner, split, "owner_crosses_split"))


def lineage_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node): all nodes upstream of each root over (node, parent) edges, by frontier joins until nothing is new.

    A round writes only what it finds; what was seen is the union of the rounds' tables.
    """
    rounds = [written(start.select(F.col("node").alias("root"), "node").distinct())]
    while True:
        seen = reduce(lambda a, b: a.unionByName(b), rounds)
        found = rounds[-1].join(edges, "node").select("root", F.col("parent").alias("node")).distinct().join(seen, ["root", "node"], "left_anti")
        fresh = written(found)
        if fresh.isEmpty():
            return seen
        rounds.append(fresh)
