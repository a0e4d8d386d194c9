"""License scans by diagonal voting.

All rolling K-word hashes of every text are joined, by Spark, to the positions of
the templates' hashes. A hit votes for its diagonal: document position less
template position. A base phrase stands where a diagonal has a vote from each of
the phrase's positions. For the templates, neighbouring diagonals (up to DRIFT
apart, as insertions shift them) are merged into spans. A span whose distinct voted
positions reach COVERAGE of the template's is a candidate (all of them in templates
of up to SHORT positions, where one word makes the difference). It is verified on the words themselves: the
share of the template's words that stand in the document on one of the span's
diagonals must reach COVERAGE too, and is the score.

Licences quote each other, so a template may be covered by another one's text. Where the
words of a template of another label would make a candidate of it, its K-grams that the
other lacks are its distinguishing places (a version, "lesser", "affero"): neighbouring
ones form a site, and more than half of the sites must have a vote. A label whose template stands whole
within one of another label ("gpl" in "gpl-2") is general, and goes when the special one
is found. Both relations are computed from the templates.

Words are runs of letters and digits in A-Z lower case; every character beyond
ASCII counts as a letter. Null and empty texts have no words and no labels.
Documents count by doc_id and text, so repeated rows get equal results. An empty
table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm._shared import materialize, ship, table, text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
DRIFT = 3
COVERAGE = 0.6
SHORT = 4
#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices and texts of public licences, a paragraph each.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "released under the mit license",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "bsl-1": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"],
    "gpl-2": [
        "licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "gpl-3": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "agpl-3": [
        "under the terms of the gnu affero general public license as published by the free software foundation either version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
    ],
    "lgpl": [
        "under the terms of the gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
    ],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc", "creative commons attribution noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["creative commons attribution sharealike", "licensed under cc by sa", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law has waived all copyright and related or neighboring rights"],
}


def words_of(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(WORD), F.lit(0))


def grams_of(words: Column, k: int = K) -> Column:
    n = F.size(words) - k + 1
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(words, i, k)))


def _phrases() -> list[tuple[str, str, str, str]]:
    base = [(f"base{i}", "base", label, phrase) for i, (phrase, label) in enumerate(BASE.items())]
    return base + [(f"{label}/{i}", "method", label, phrase) for label, phrases in TEMPLATES.items() for i, phrase in enumerate(phrases)]


def _grams(phrase: str) -> list[tuple[str, ...]]:
    words = phrase.split(" ")
    return [tuple(words[i : i + K]) for i in range(len(words) - K + 1)]


def distinguishing_sites() -> dict[str, list[list[list[int]]]]:
    """Per template and template of another label that would pass for it, the runs of gram positions that set it apart."""
    own = [(name, label, _grams(phrase)) for name, kind, label, phrase in _phrases() if kind == "method"]
    out: dict[str, list[list[list[int]]]] = {}
    for name, label, grams in own:
        groups = []
        for _, other, theirs in own:
            shared = set(theirs)
            apart = [i for i, g in enumerate(grams) if g not in shared]
            if other != label and apart and len(grams) - len(apart) >= (1.0 if len(grams) <= SHORT else COVERAGE) * len(grams):
                cuts = [k for k, i in enumerate(apart) if not k or apart[k - 1] != i - 1]
                groups.append([apart[a:b] for a, b in zip(cuts, [*cuts[1:], len(apart)])])
        out[name] = sorted({str(g): g for g in groups}.values())
    return out


def general_labels() -> dict[str, list[str]]:
    """Labels with the special labels that make them redundant."""
    own = [(label, _grams(phrase)) for _, kind, label, phrase in _phrases() if kind == "method"]
    within = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    pairs = sorted({(a, b) for a, x in own for b, y in own if a != b and a not in BASE.values() and within(x, y)})
    return {a: [y for x, y in pairs if x == a] for a, _ in pairs}


def template_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_phrases(), "template string, kind string, label string, phrase string").withColumn("words", F.split("phrase", " "))


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, kind, label, size, at, gram): a constant table of about a thousand rows."""
    return template_words(spark).select("template", "kind", "label", (F.size("words") - K + 1).alias("size"), F.posexplode(grams_of(F.col("words"))).alias("at", "gram"))


def _special(labels: Column) -> Column:
    """The labels without general ones whose special ones are there."""
    for general, special in general_labels().items():
        labels = F.when(F.arrays_overlap(labels, F.array(*map(F.lit, special))), F.array_remove(labels, general)).otherwise(labels)
    return labels


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score per document."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_key().alias("version"))
    worded = own.select("doc_id", "version", words_of(F.col("text")).alias("words"))
    at = worded.select("doc_id", "version", F.posexplode(grams_of(F.col("words"))).alias("place", "gram"))
    hits = at.join(F.broadcast(template_grams(spark)), "gram").withColumn("diagonal", F.col("place") - F.col("at"))
    key = ["doc_id", "version", "template", "kind", "label", "size"]
    votes = hits.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("voted"))
    order = Window.partitionBy("doc_id", "version", "template").orderBy("diagonal")
    starts = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"), F.lit(1))
    merged = votes.withColumn("whole", F.size("voted") == F.col("size")).withColumn("starts", starts)
    merged = merged.withColumn("span", F.sum("starts").over(order))
    spans = merged.groupBy(*key, "span").agg(F.array_distinct(F.flatten(F.collect_list("voted"))).alias("voted"), F.count_if("whole").alias("places"), F.collect_list("diagonal").alias("diagonals"),
                                             F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first"), F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last"))
    base = F.col("kind") == "base"
    enough = F.when(F.col("size") <= SHORT, 1.0).otherwise(COVERAGE)
    sites = F.from_json(F.try_element_at(F.create_map(*[x for t, own in distinguishing_sites().items() for x in (F.lit(t), F.lit(str(own)))]), F.col("template")), "array<array<array<int>>>")
    apart = F.forall(sites, lambda g: 2 * F.size(F.filter(g, lambda s: F.arrays_overlap(s, F.col("voted")))) > F.size(g))
    spans = materialize(spans.filter(F.when(base, F.col("places") > 0).otherwise((F.size("voted") / F.col("size") >= enough) & apart)).drop("voted"))  # few: only texts that quote a licence
    wanted = spans.filter(~base).select("doc_id", "version").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["version"] == b["version"])
    texts = own.join(wanted, same(own, wanted), "left_semi").dropDuplicates(["doc_id", "version"]).select(F.col("doc_id").alias("t_id"), F.col("version").alias("t_version"), words_of(F.col("text")).alias("words"))
    phrases = template_words(spark).select("template", F.col("words").alias("phrase"))
    faced = spans.filter(~base).join(F.broadcast(phrases), "template").join(texts, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("version") == F.col("t_version")))  # a constant table
    stands = lambda w, i: F.exists("diagonals", lambda d: (i + d >= 0) & (F.get("words", (i + d).cast("int")) == w))
    share = F.size(F.filter("phrase", stands)) / F.size("phrase")
    columns = ["doc_id", "version", "kind", "label", "places", "first", "last"]
    good = spans.filter(base).select(*columns, F.lit(1.0).alias("share")).unionByName(faced.select(*columns, share.alias("share")).filter(F.col("share") >= COVERAGE))
    found = good.groupBy("doc_id", "version").agg(
        F.sum(F.when(base, F.col("places")).otherwise(0)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("last"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(_special(F.sort_array(F.collect_set("label"))), ",").alias("labels"), F.max("share").alias("score"),
    )
    counted = own.select("doc_id", "version", F.regexp_count(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD)).cast("long").alias("n_words"))
    joined = counted.alias("c").join(found.alias("f"), F.col("c.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("c.version") == F.col("f.version")), "left")
    return joined.select(F.col("c.doc_id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
                         F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle_sql() -> str:
    """The same votes in SQL, on the words themselves instead of hashes."""
    sites = distinguishing_sites()
    values = ", ".join(f"('{t}', '{k}', '{label}', '{p}', '{sites.get(t, [])}')" for t, k, label, p in _phrases())
    labels = "list_sort(list(DISTINCT label))"
    for general, special in general_labels().items():
        labels = f"CASE WHEN list_has_any({labels}, {special}) THEN list_filter({labels}, lambda x: x <> '{general}') ELSE {labels} END"
    return rf"""WITH phrases AS MATERIALIZED (SELECT template, kind, label, string_split(phrase, ' ') AS w, sites::INT[][][] AS sites FROM (VALUES {values}) v(template, kind, label, phrase, sites)),
tpl AS (SELECT template, kind, label, len(w) - 2 AS size, i - 1 AS pos, array_to_string(list_slice(w, i, i + 2), ' ') AS gram FROM phrases, unnest(range(1, len(w) - 1)) r(i)),
worded AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
hits AS (SELECT doc_id, i - 1 AS place, array_to_string(list_slice(w, i, i + 2), ' ') AS gram FROM worded, unnest(range(1, greatest(len(w) - 1, 1))) r(i)),
votes AS (SELECT doc_id, template, kind, label, size, place - pos AS diagonal, list(DISTINCT pos) AS voted FROM hits JOIN tpl USING (gram) GROUP BY ALL),
starts AS (SELECT *, len(voted) = size AS whole, coalesce(CAST(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {DRIFT} AS INT), 1) AS s FROM votes),
spans AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM starts),
merged AS (SELECT doc_id, template, kind, label, size, list_distinct(flatten(list(voted))) AS voted, count(CASE WHEN whole THEN 1 END) AS places, min(CASE WHEN whole THEN diagonal END) AS f, max(CASE WHEN whole THEN diagonal END) AS l, list(diagonal) AS ds FROM spans GROUP BY doc_id, template, kind, label, size, span),
cand AS (SELECT m.*, p.w AS phrase, d.w AS words FROM merged m JOIN phrases p USING (template) JOIN worded d ON d.doc_id = m.doc_id WHERE m.kind <> 'base' AND len(list_filter(sites, lambda g: 2 * len(list_filter(g, lambda s: list_has_any(s, voted))) <= len(g))) = 0 AND len(voted)::DOUBLE / size >= CASE WHEN size <= {SHORT} THEN 1.0 ELSE {COVERAGE} END),
good AS (SELECT doc_id, kind, label, places, f, l, 1.0::DOUBLE AS share FROM merged WHERE kind = 'base' AND places > 0 UNION ALL SELECT * FROM (SELECT doc_id, kind, label, places, f, l,
 len(list_filter(range(1, len(phrase) + 1), lambda i: len(list_filter(ds, lambda d: i + d >= 1 AND words[i + d] = phrase[i])) > 0))::DOUBLE / len(phrase) AS share FROM cand) WHERE share >= {COVERAGE}),
found AS (SELECT doc_id, sum(CASE WHEN kind = 'base' THEN places ELSE 0 END) AS n_base, min(CASE WHEN kind = 'base' THEN f END) AS f, max(CASE WHEN kind = 'base' THEN l END) AS l, array_to_string(list_sort(list(DISTINCT label) FILTER (kind = 'base')), ',') AS base_labels, array_to_string({labels}, ',') AS labels, max(share) AS score FROM good GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM worded LEFT JOIN found USING (doc_id)"""


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


ship(__name__)
