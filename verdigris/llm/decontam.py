"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

A text becomes words: lower-cased, split at everything but letters and digits.
In its template, numbers, names (capitalised words in the middle of a sentence)
and units after numbers are typed placeholders. All windows of WINDOW words of the
benchmark are joined to the documents' by the hash of their words, and those with
at least LITERALS plain words by the hash of their template too. Each hit gives a
diagonal (document position minus item position), along which all words are
compared. A stretch is a run of at least one window's width whose words are equal
in the template or as they are. Its fillers are compared: a filler of the item must
always stand for the same filler of the document. Of a stretch in conflict only the
runs that are equal word by word count. A document holds an item when the positions
that its stretches cover reach COVERAGE of the item's words, or LONG_RUN words.

Items with the same template and pattern of equal fillers are one class, named by the least of them, and a
document has one row for a class: a template that many items share makes no pairs of
all its items with all its documents.

Items with fewer than WINDOW words take one window of their own length. Copies with
other fillers are found by a window with LITERALS plain words; items without any are
found as exact copies only, and so are items under LITERALS words: these can stand in
a text by chance, so they are reported and don't make `drop_leaks` drop it. `benchmark_coverage` says which is which. Null and empty texts
hold nothing. Documents count by doc_id and text, so repeated rows are one; a null
doc_id is an id like others, items without item_id are left out. An empty
documents or benchmark table gives no rows. Only doc_id and text, item_id and text
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm._shared import materialize, ship, table, unused

WINDOW = 6
LITERALS = 4
COVERAGE = 0.5
LONG_RUN = 25
MOST_BROADCAST = 200_000
UNITS = "mm|cm|m|km|in|inch|inches|ft|feet|yards|miles|mg|g|kg|lb|lbs|pounds|tons|ml|l|litres|liters|s|sec|seconds|minutes|hours|days|weeks|months|years|percent|dollars|euros|cents|degrees"
MARK = "\ue000"


def raw_words(text: Column) -> Column:
    """Lower-case words; names carry a mark."""
    own = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))
    named = F.regexp_replace(own, r"(?<=[\p{Ll},;:] )(?=\p{Lu}\p{Ll})", MARK)
    joined = F.regexp_replace(F.lower(named), r"(?<=\d)[.,](?=\d)", "")
    return F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}" + MARK + "]+", " "))


def template(raw: Column) -> Column:
    """Placeholders for marked names, numbers, and units after numbers; as many words as before."""
    names = F.regexp_replace(raw, MARK + r"\S*", "<n>")
    numbers = F.regexp_replace(names, r"(?<!\S)\d\S*", "<d>")
    return F.regexp_replace(numbers, rf"(?<=<d> )(?:{UNITS})(?!\S)", "<u>")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _unmarked(raw: Column) -> Column:
    return F.replace(raw, F.lit(MARK), F.lit(""))


def _slot(word: Column) -> Column:
    return word.isin("<n>", "<d>", "<u>")


def _plain(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~_slot(w)))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast up to MOST_BROADCAST rows; a shuffled join beyond. df must be written or cheap."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def _keys(df: DataFrame, tpl: str, raw: str, width: Column | int, *columns: str) -> DataFrame:
    """(columns, place, part, h) of all windows: hashes of the template and of the words, once where both are equal."""
    width = F.lit(width) if isinstance(width, int) else width
    at = df.filter(F.size(tpl) >= width).select("*", F.explode(F.sequence(F.lit(1), F.size(tpl) - width + 1)).alias("i"))
    part, own = F.slice(tpl, F.col("i"), width), F.slice(raw, F.col("i"), width)
    both = at.select(*columns, (F.col("i") - 1).alias("place"), part.alias("part"), F.xxhash64(part).alias("h_tpl"), F.xxhash64(own).alias("h_raw"))
    keys = F.when(F.col("h_tpl") == F.col("h_raw"), F.array("h_raw")).otherwise(F.array("h_raw", "h_tpl"))
    return both.select(*columns, "place", "part", "h_raw", F.explode(keys).alias("h"))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_raw, item_tpl, class, width): an item's class is the least item with the same template and the same slots of equal fillers, so what is found for one holds for all."""
    items = benchmark.filter("item_id is not null").select(F.col("item_id").alias("item"), raw_words(F.col("text").cast("string")).alias("raw")).distinct()
    items = items.withColumn("item_raw", _words(_unmarked(F.col("raw")))).withColumn("item_tpl", _words(template(F.col("raw")))).drop("raw")
    items = items.withColumn("fillers", F.transform("item_tpl", lambda w, i: F.when(_slot(w), F.get("item_raw", i))))
    pattern = F.transform("fillers", lambda f: F.coalesce(F.array_position("fillers", f), F.lit(0)).cast("string"))
    items = items.withColumn("t", F.md5(F.concat_ws("\n", F.array_join("item_tpl", " "), F.array_join(pattern, " ")))).drop("fillers")
    items = materialize(items.withColumn("width", F.least(F.lit(WINDOW), F.size("item_tpl"))))
    classes = materialize(items.groupBy("t").agg(F.min("item").alias("class")))
    return materialize(items.join(classes, "t").drop("t"))


def benchmark_coverage(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_id, n_words, found): how an item can be found. `class_id` is the least item of the same template and pattern, which stands for it in the results.

    found: `none` without words, `verbatim` if no window has LITERALS plain words, else `template`.
    """
    items = _items(benchmark)
    n = F.size("item_tpl")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - F.col("width") + 1, F.lit(1))), lambda i: F.slice("item_tpl", i, F.greatest("width", F.lit(1))))
    found = F.when(n == 0, "none").when(F.exists(windows, lambda w: _plain(w) >= LITERALS), "template").otherwise("verbatim")
    return items.select(F.col("item").alias("item_id"), F.col("class").alias("class_id"), n.alias("n_words"), found.alias("found"))


def benchmark_windows(benchmark: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(items of `least` words or more with their words, windows with hash, item and position). Windows that several items of a class share stand once, for the least of them."""
    items = materialize(_items(benchmark).filter(F.size("item_tpl") >= least))
    windows = _keys(items, "item_tpl", "item_raw", F.col("width"), "item", "class", "width")
    windows = windows.filter((F.col("h") == F.col("h_raw")) | (_plain(F.col("part")) >= LITERALS))
    windows = windows.groupBy("class", F.col("place").alias("at"), "width", "h").agg(F.min("item").alias("item"))
    return items, materialize(windows.select("item", "at", "width", "h"))


def _covered(equal: Column, width: Column) -> Column:
    """Positions, in order, of the runs of at least width equal words; equal is a string of a 1 or 0 for each word."""
    starts = F.filter(F.sequence(F.lit(0), F.length(equal) - width), lambda i: F.substr(equal, i + 1, width) == F.repeat(F.lit("1"), width))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + width - 1))))


def held_items(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, version, class, item, n_item, n, n_slots, changed) for each version of a document and class of items (of `least` words or more) that it holds, with the item that fits best."""
    items, windows = benchmark_windows(benchmark, least)
    widths = sorted(r.width for r in windows.select("width").distinct().collect())  # at most WINDOW values
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("version"))
    words = own.select("doc_id", "version", raw_words(F.col("text")).alias("raw"))
    words = words.select("doc_id", "version", _words(template(F.col("raw"))).alias("tpl"), _words(_unmarked(F.col("raw"))).alias("raw"))
    bench = _bounded(windows)
    hits = None
    for width in widths or [WINDOW]:
        at = _keys(words, "tpl", "raw", width, "doc_id", "version").select("doc_id", "version", "place", "h")
        found = at.join(bench.filter(F.col("width") == width), "h").select("doc_id", "version", "item", (F.col("place") - F.col("at")).alias("diagonal"))
        hits = found if hits is None else hits.unionByName(found)
    runs = materialize(hits.distinct())
    few = runs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    sized = runs.join(_bounded(items.select("item", F.size("item_raw").alias("n"))), "item")
    wanted = sized.groupBy(F.col("doc_id").alias("r_doc"), F.col("version").alias("r_version")).agg(F.collect_list(F.struct("item", "diagonal", "n")).alias("runs"))  # no more than a text has windows, for each item
    held = own.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("version") == F.col("r_version")))
    held = held.select("doc_id", "version", "runs", raw_words(F.col("text")).alias("raw"))
    held = held.select("doc_id", "version", "runs", _words(_unmarked(F.col("raw"))).alias("raw"), _words(template(F.col("raw"))).alias("tpl"))
    stretch = lambda r: (F.greatest(r["diagonal"], F.lit(0)) + 1, r["n"])
    cut = F.transform("runs", lambda r: F.struct(r["item"].alias("item"), F.least(r["diagonal"], F.lit(0)).alias("diagonal"), F.slice("raw", *stretch(r)).alias("doc_raw"), F.slice("tpl", *stretch(r)).alias("doc_tpl")))
    # a text is read into words once; only the words that face an item leave it, and equal ones on several diagonals are compared once
    held = held.select("doc_id", "version", F.inline(cut)).dropDuplicates().join(_bounded(items), "item")
    skip = F.greatest(-F.col("diagonal"), F.lit(0))
    everywhere = F.sequence(F.lit(0), F.size("item_tpl") - 1)
    same = lambda a, b, p: F.coalesce((p >= skip) & (F.get(a, p) == F.get(b, p - skip)), F.lit(False))
    bits = lambda test: F.array_join(F.transform(everywhere, lambda p: F.when(test(p), "1").otherwise("0")), "")
    held = held.withColumn("exact", bits(lambda p: same("item_raw", "doc_raw", p))).withColumn("alike", bits(lambda p: same("item_raw", "doc_raw", p) | same("item_tpl", "doc_tpl", p)))
    held = held.withColumn("exact", _covered(F.col("exact"), F.col("width"))).withColumn("alike", _covered(F.col("alike"), F.col("width")))
    first = F.transform("alike", lambda p, i: p - i)  # the same all along a stretch
    held = held.withColumn("first", first).withColumn("stretch", F.explode(F.array_distinct("first")))
    held = held.withColumn("covered", F.filter("alike", lambda p, i: F.get("first", i) == F.col("stretch")))
    slots = lambda covered: F.filter(covered, lambda p: _slot(F.get("item_tpl", p)))
    held = held.withColumn("slots", slots("covered"))
    fillers = F.transform("slots", lambda p: F.get("item_raw", p))
    pairs = F.transform("slots", lambda p: F.concat_ws("\n", F.get("item_raw", p), F.get("doc_raw", p - skip)))
    consistent = F.size(F.array_distinct(fillers)) == F.size(F.array_distinct(pairs))
    held = held.withColumn("covered", F.when(consistent, F.col("covered")).otherwise(F.array_intersect("covered", "exact"))).withColumn("slots", slots("covered"))
    changed = F.exists("slots", lambda p: F.get("item_raw", p) != F.get("doc_raw", p - skip))
    judged = held.select("doc_id", "version", "class", "item", "covered", "slots", changed.alias("changed"), F.size("item_tpl").alias("n_item"))
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    total = judged.groupBy("doc_id", "version", "class", "item", "n_item").agg(union("covered").alias("n"), union("slots").alias("n_slots"), F.max("changed").alias("changed"))
    held = total.filter((F.col("n") >= COVERAGE * F.col("n_item")) | (F.col("n") >= LONG_RUN))
    values = ["item", "n_item", "n", "n_slots", "changed"]
    best = F.max_by(F.struct(*values), F.struct("n", ~F.col("changed"), -F.col("item")))
    return held.groupBy("doc_id", "version", "class").agg(best.alias("b")).select("doc_id", "version", "class", *[F.col(f"b.{v}").alias(v) for v in values])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, class_id, item_id, coverage, n_slots, kind) for each document and class of items with one template that it holds; item_id is the one that fits best.

    So a template that many items share costs its documents and not their product; `benchmark_coverage` lists the members of a class.
    """
    leaks = held_items(docs, benchmark)
    kind = F.when(F.min("changed"), F.lit("reparameterised")).otherwise(F.lit("verbatim"))
    share = F.col("n") / F.col("n_item")
    return leaks.groupBy("doc_id", F.col("class").alias("class_id")).agg(F.max_by("item", F.struct("n", ~F.col("changed"), -F.col("item"))).alias("item_id"), F.max(share).alias("coverage"), F.max("n_slots").alias("n_slots"), kind.alias("kind"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item; columns stay, whatever their names. Rows go by doc_id and text, so another text under the same or no id stays."""
    leak, version = unused(docs, "v_leak", "v_version")
    held = materialize(held_items(docs, benchmark, LITERALS).select(F.col("doc_id").alias(leak), F.col("version").alias(version)).distinct())
    return docs.join(_bounded(held), docs["doc_id"].eqNullSafe(F.col(leak)) & (F.xxhash64(docs["text"].cast("string")) == F.col(version)), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ship(__name__)
