"""License scans by diagonal voting.

Every rolling word k-gram of the corpus is hashed and joined with the k-grams of known license
texts.  A hit at word ``p`` of a document and ``t`` of a template votes for the diagonal p - t.
Votes are counted by diagonal, neighbouring diagonals (an insertion or deletion shifts the rest of
a notice by a few words) are merged into spans, spans that follow each other in text and template
are joined, and they are verified word by word.  Short templates may differ in one word, but not in
the one that names the license; pairs of words with it vote too, as an edit may leave no k-gram.
Expressions and joins only; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinmap.llm.common import cut, join_few

GRAM = 4
#: Diagonals at most so far apart are merged.
NEAR = 3
#: Share of a template's words that verifies it.
LEAST = 0.88
#: Words that a short template's notice must hold; then one of its other words may differ.
NAMING = {"apache": "apache", "cc-by-nc": "nc", "cc-by-sa": "sa", "mit": "mit"}

#: Label and words of license notices.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "apache-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-terms": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Phrases of the base and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, divided by what is not a digit, a letter of a-z or beyond ASCII."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _BETWEEN), lambda w: w != "")


def bind(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand, from 0."""
    parts = phrase.split(" ")
    here = lambda i: _all([F.get(words, i + k) == p for k, p in enumerate(parts)])
    rare = parts[-1] if len(parts) > 2 else parts[0]
    return F.when(F.array_contains(words, rare) & (F.size(words) >= len(parts)), F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def template_grams(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """label, t, gram: bounded by the number of template words."""
    rows = spark.createDataFrame([(label, text.split(" ")) for label, text in templates.items()], "label string, words array<string>")
    return rows.select("label", F.posexplode(_grams(F.col("words"))).alias("t", "gram"))


def naming_pairs(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """label, t, gram: of pairs of words with a short template's naming word."""
    rows = [(label, t, *text.split(" ")[t : t + 2]) for label, text in templates.items() if label in NAMING for t in range(len(text.split(" ")) - 1) if NAMING[label] in text.split(" ")[t : t + 2]]
    return spark.createDataFrame(rows, "label string, t int, a string, b string").select("label", "t", F.xxhash64("a", "b").alias("gram"))


def _grams(words: Column) -> Column:
    gram = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(GRAM)))
    return F.when(F.size(words) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), gram)).otherwise(F.array().cast("array<long>"))


def _pairs(words: Column) -> Column:
    """(p, gram) of the text's pairs of words with a naming word."""
    names = sorted(set(NAMING.values()))
    near = lambda i: F.get(words, i).isin(names) | F.get(words, i + 1).isin(names)
    some = (F.size(words) >= 2) & F.arrays_overlap(words, F.array(*map(F.lit, names)))
    return F.when(some, F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), near), lambda i: F.struct(i.alias("p"), F.xxhash64(F.get(words, i), F.get(words, i + 1)).alias("gram"))))


def spans(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs (text_id, words) -> text_id, label, first, last (words), votes, diagonals: candidate spans.

    Equal texts share their spans; hits of copies are one hit.  A span continues the one before it
    if it starts after it in text and template, at most the template's length of words further on.
    """
    spark, texts = docs.sparkSession, templates or TEMPLATES
    grams = template_grams(spark, texts)
    rolled = docs.select("text_id", F.posexplode(_grams(F.col("words"))).alias("p", "gram"))
    hits = rolled.join(F.broadcast(grams), "gram").select("text_id", "label", "p", (F.col("p") - F.col("t")).alias("diagonal"), (F.col("p") + (GRAM - 1)).alias("end"))
    paired = docs.select("text_id", F.inline(_pairs(F.col("words")))).join(F.broadcast(naming_pairs(spark, texts)), "gram").select("text_id", "label", "p", (F.col("p") - F.col("t")).alias("diagonal"), (F.col("p") + 1).alias("end"))
    votes = hits.union(paired).distinct().groupBy("text_id", "label", "diagonal").agg(F.count("*").alias("votes"), F.min("p").alias("first"), F.max("end").alias("last"))
    line = Window.partitionBy("text_id", "label").orderBy("diagonal")  # a text's own diagonals
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > NEAR, F.lit(True)).cast("int")
    named = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    t = F.struct((F.col("first") - F.col("diagonal")).alias("from"), (F.col("last") - F.col("diagonal")).alias("to"))
    whole = named.withColumn("t", t).groupBy("text_id", "label", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"), F.collect_set("diagonal").alias("diagonals"), F.min("t.from").alias("from"), F.max("t.to").alias("to"))
    sizes = F.create_map(*(F.lit(x) for label, text in texts.items() for x in (label, len(text.split(" ")))))
    order = Window.partitionBy("text_id", "label").orderBy("first", "last", "span")  # a text's own spans
    gap = F.col("first") - F.lag("last").over(order)
    follows = (gap > 0) & (gap <= F.element_at(sizes, F.col("label")) + 1) & (F.col("from") > F.lag("to").over(order))
    joined = whole.withColumn("fresh", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("text_id", "label", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"), F.flatten(F.collect_list("diagonals")).alias("diagonals")).drop("part")


def verified(docs: DataFrame, candidates: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """text_id, found: array of (label, share, first, last) of spans with enough of a template's words on their diagonals.

    Of a short template (``NAMING``) one word may be missing, and words count up to ``NEAR`` off a
    diagonal.  All spans of a text are verified in its row, beside one copy of its words.
    """
    known = templates or TEMPLATES
    words_by = F.create_map(*(F.lit(x) if i % 2 == 0 else F.split(F.lit(x), " ") for label, text in known.items() for i, x in enumerate((label, text))))
    naming_by = F.create_map(*(F.lit(x) for label in known for x in (label, NAMING.get(label, ""))))
    own = cut(candidates.groupBy("text_id").agg(F.collect_list(F.struct("label", "first", "last", "diagonals")).alias("spans")))
    rows = join_few(docs, own.select("text_id"), "text_id", "left_semi").groupBy("text_id").agg(F.first("text").alias("text")).join(own, "text_id")

    def judged(words: Column, span: Column) -> Column:
        def counted(template: Column, naming: Column) -> Column:
            wide = F.array_distinct(F.flatten(F.transform(span["diagonals"], lambda d: F.sequence(d - NEAR, d + NEAR))))
            stands = lambda t, d: F.coalesce((t + d >= 0) & (F.get(words, F.greatest(t + d, F.lit(0))) == F.get(template, t)), F.lit(False))
            stand = bind(F.when(naming != "", wide).otherwise(span["diagonals"]), lambda ds: F.filter(F.sequence(F.lit(0), F.size(template) - 1), lambda t: F.exists(ds, lambda d: stands(t, d))))
            edited = lambda at: (naming != "") & (F.size(at) >= F.size(template) - 1) & F.exists(at, lambda t: F.get(template, t) == naming)
            share = lambda at: F.size(at) / F.size(template)
            return bind(stand, lambda at: F.when((share(at) >= least) | edited(at), F.struct(span["label"].alias("label"), share(at).alias("share"), span["first"].alias("first"), span["last"].alias("last"))))

        return bind(F.element_at(words_by, span["label"]), lambda template: counted(template, F.element_at(naming_by, span["label"])))

    found = bind(words_of(F.col("text")), lambda words: F.array_compact(F.transform("spans", lambda span: judged(words, span))))
    return rows.select("text_id", found.alias("found"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base phrases and license notices of each whole text.

    Returns doc_id, n_words, n_base (places of base phrases), first_word, last_word (their smallest
    and largest start, else null), base_labels, labels (with the templates'; both distinct, sorted,
    comma-joined), score (the best verified share of a template; 1 with a base phrase; else 0) and
    spans.  A null text counts as empty.  Null ids and repeated rows stay; no rows give no rows.
    Other columns are not looked at.  Memory is some words beside each text and a row for each
    span, however long the text.  Texts are told apart by 128-bit hashes.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_id", F.unhex(F.md5("text")))
    ids = named.select("text_id", words_of(F.col("text")).alias("words"))
    found = verified(named.select("text_id", "text"), spans(ids, templates), templates)

    split = named.select("doc_id", "text_id", words_of(F.col("text")).alias("words"))
    places = split.select("doc_id", "text_id", F.size("words").cast("long").alias("n_words"), *(_places(F.col("words"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)))
    every = F.concat(*(F.col(f"p{i}") for i in range(len(PHRASES))))
    labels = F.array_distinct(F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())))))
    base = places.select("doc_id", "text_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))
    rows = join_few(base, cut(found), "text_id", "left")  # written: a hot text's rows can be split
    more = F.coalesce(F.transform("found", lambda s: s["label"]), F.array().cast("array<string>"))
    share = F.coalesce(F.array_max(F.transform("found", lambda s: s["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(share).alias("score"), F.coalesce("found", F.array().cast("array<struct<label:string,share:double,first:int,last:int>>")).alias("spans"),
    )


def oracle() -> str:
    phrases = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, i FROM p WHERE {' AND '.join(f'w[i + {k + 1}] = ' + chr(39) + x + chr(39) for k, x in enumerate(phrase.split(' ')))}" for phrase, label in PHRASES.items())
    templates = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in TEMPLATES.items())
    gram = lambda w, i: " || ' ' || ".join(f"{w}[{i} + {k + 1}]" for k in range(GRAM))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
base AS ({phrases}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id),
t(label, t) AS (VALUES {templates}),
tg AS (SELECT label, i, {gram("t", "i")} AS g FROM (SELECT label, t, unnest(range(len(t) - {GRAM - 1})) AS i FROM t)),
dg AS (SELECT doc_id, i, {gram("w", "i")} AS g FROM p WHERE i <= len(w) - {GRAM}),
diagonals AS (SELECT DISTINCT doc_id, label, dg.i - tg.i AS k FROM dg JOIN tg USING (g)),
f AS (SELECT *, coalesce(k - lag(k) OVER (PARTITION BY doc_id, label ORDER BY k) > {NEAR}, true) AS fresh FROM diagonals),
s AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id, label ORDER BY k) AS span FROM f),
hits AS (SELECT doc_id, label, span, count(DISTINCT i) AS n, any_value(len(t)) AS size FROM (SELECT doc_id, label, span, k, t, unnest(range(len(t))) AS i FROM s JOIN t USING (label)) JOIN d USING (doc_id) WHERE i + k >= 0 AND w[i + k + 1] = t[i + 1] GROUP BY ALL),
l AS (SELECT doc_id, list(DISTINCT label) AS labels, max(n / size) AS share FROM hits WHERE n / size >= {LEAST} GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(l.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""
