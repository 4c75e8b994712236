"""License scan: phrases, and an exact set-similarity join of license wordings with the texts' blocks.

A block is a run of SPREAD times as many consecutive words of a paragraph (blank lines part paragraphs) as a wording has; a
paragraph of fewer words is one block. A wording matches a block that holds at least CONTAINMENT of its distinct words. Line
breaks, however a notice is wrapped, don't matter, and a long text without breaks doesn't match by its length alone.

The join: all words of all wordings are ordered by how many documents of the corpus have them, rarest first. A paragraph is cut
into segments that overlap by a block, so every block lies in one; a segment's wording words, in that order, are joined
with the wordings' prefixes by word. Filters, none of which loses a match, for a wording of t words needing c: prefix - one of
its first t - c + 1 words must be shared (a pair is followed from its first shared word alone); length - the segment has at
least c wording words; positional - of these, at least c stand from the shared word on. What is left is counted exactly,
block by block. Results are by text, so equal texts are looked up once each and joined back with all their rows.

Only DataFrame functions are used. Wordings are a parameter; their number isn't bounded, as they are joined and not written
into the plan. Null texts are empty; blocks without words match nothing; rows that repeat stay rows of their own, with equal
results; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import spread_join, table

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Wordings of licenses and their notices, (label, words).
WORDINGS = [
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that conditions are met"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license cc by nc"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it under the terms of the gnu general public license version 3"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software under the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]
CONTAINMENT, SPREAD = 0.8, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARAGRAPH = r"\n[ \t\r\x0B\x0C]*\n"
MATCH = "struct<label:string,score:double>"


def spaced(text: Column) -> Column:
    """The words, lower-cased and parted by single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def split_words(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def places(words: Column, phrase: str) -> Column:
    """Starts of the phrase's words, counted from 0."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))

    def at(i):
        fits = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            fits = fits & (F.get(words, i + k) == p)
        return F.coalesce(fits, F.lit(False))

    return F.filter(starts, at)


def _hits(phrase: str, label: str) -> Column:
    place = lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start"))
    none = F.array().cast("array<struct<label:string,start:bigint>>")
    found = F.contains(F.concat(F.lit(" "), F.col("joined"), F.lit(" ")), F.lit(f" {phrase} "))
    return F.when(found, F.transform(places(F.col("words"), phrase), place)).otherwise(none)


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def word_order(docs: DataFrame, words: list[str]) -> list[str]:
    """The wordings' words, rarest in the whole corpus first (ties by name); a count for each of them is gathered."""
    held = docs.select(F.explode(F.array_intersect(_literal(words), split_words(spaced(F.col("text"))))).alias("word"))
    counts = {r.word: r["count"] for r in held.groupBy("word").count().collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def wording_rows(spark, wordings: list[tuple[str, str]], order: list[str], containment: float) -> tuple[DataFrame, list[int]]:
    """(word, span, id, label, prefix, full, need): a row for each word of each wording's prefix; and the spans."""
    rank, rows = {w: i for i, w in enumerate(order)}, []
    for i, (label, text) in enumerate(wordings):
        full = sorted(set(text.lower().split()), key=rank.__getitem__)
        need = math.ceil(containment * len(full) - 1e-9)
        prefix = full[: len(full) - need + 1]
        rows += [(w, SPREAD * len(text.split()), i, label, prefix, full, need) for w in prefix]
    kinds = "word string, span int, id int, label string, prefix array<string>, full array<string>, need int"
    return spark.createDataFrame(rows, kinds), sorted({r[1] for r in rows})


def matches(docs: DataFrame, wordings: list[tuple[str, str]], containment: float = CONTAINMENT) -> DataFrame:
    """(text_key, matches): for each text with a match, its labels with their best containment."""
    spark = docs.sparkSession
    order = word_order(docs, sorted({w for _, t in wordings for w in t.lower().split()}))
    rows, spans = wording_rows(spark, wordings, order, containment)
    first = sorted({r.word for r in rows.select("word").distinct().collect()})  # words of the prefixes
    held = F.arrays_overlap(split_words(spaced(F.col("text"))), _literal(first))
    paragraphs = docs.where(held).select(text_key(), F.explode(F.split("text", PARAGRAPH)).alias("p")).withColumn("w", split_words(spaced(F.col("p")))).where(F.arrays_overlap("w", _literal(first)))
    # A block of any span starts in [k * span, (k + 1) * span) of one segment.
    each = paragraphs.select("text_key", "w", F.explode(F.array(*[F.lit(s) for s in spans])).alias("span"))
    cut = each.select("text_key", "span", F.posexplode(F.sequence(F.lit(0), F.floor(F.greatest(F.size("w") - 1, F.lit(0)) / F.col("span")).cast("int"))).alias("k", "_k"), "w")
    segments = cut.select("text_key", "span", F.slice("w", F.col("k") * F.col("span") + 1, 2 * F.col("span")).alias("seg")).where(F.arrays_overlap("seg", _literal(first)))
    known = segments.withColumn("own", F.array_intersect(_literal(order), F.col("seg")))  # in the global order
    words = known.select("text_key", "span", "seg", "own", F.posexplode("own").alias("at", "word"))
    pairs = words.join(F.broadcast(rows) if len(wordings) <= 10_000 else rows, ["word", "span"])
    pairs = pairs.where(F.col("word") == F.get(F.array_intersect("prefix", "own"), 0))
    pairs = pairs.where((F.size("own") >= F.col("need")) & (F.size("own") - F.col("at") >= F.col("need")))
    pairs = pairs.where(F.size(F.array_intersect("full", "own")) >= F.col("need"))
    block = lambda i: F.size(F.array_intersect("full", F.slice("seg", i + 1, F.col("span"))))
    starts = F.filter(F.sequence(F.lit(0), F.least(F.col("span"), F.size("seg")) - 1), lambda i: F.array_contains("full", F.get("seg", i)))
    best = F.array_max(F.transform(F.concat(F.array(F.lit(0)), starts), block))
    scored = pairs.select("text_key", "label", "need", best.alias("n"), (best / F.size("full")).alias("score")).where("n >= need")
    one = scored.groupBy("text_key", "label").agg(F.max("score").alias("score"))
    return one.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("label", "score"))).alias("matches"))


def text_key() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_key")


def scan_licenses(docs: DataFrame, wordings: list[tuple[str, str]] = WORDINGS, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """Per document row: doc_id, n_words, hits (label and start of each phrase place), matches (label and best containment)."""
    joined = docs.select("doc_id", text_key(), spaced(F.col("text")).alias("joined")).withColumn("words", split_words(F.col("joined")))
    none = F.array().cast("array<struct<label:string,start:bigint>>")
    base = joined.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.flatten(F.array(none, *[_hits(p, label) for p, label in phrases.items()])).alias("hits"))
    if wordings:
        base = spread_join(base, matches(docs.select("text"), wordings, containment), "text_key", "doc_id")
    else:
        base = base.withColumn("matches", F.lit(None).cast(f"array<{MATCH}>"))
    return base.select("doc_id", "n_words", "hits", F.coalesce("matches", F.array().cast(f"array<{MATCH}>")).alias("matches"))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    got = scan_licenses(table(spark, sf_dir, "documents"))
    names = lambda c: F.array_distinct(F.transform(c, lambda x: x["label"]))
    starts = F.transform("hits", lambda x: x["start"])
    base = names("hits")
    return got.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, names("matches"))), ",").alias("labels"),
        F.when(F.size("hits") > 0, F.lit(1.0)).otherwise(F.round(F.coalesce(F.array_max(F.transform("matches", lambda x: x["score"])), F.lit(0.0)), 6)).alias("score"),
    )


def _sql() -> str:
    """The same without a join order: each wording against every block of each paragraph that has enough of its words."""
    values = ", ".join(f"({i}, '{label}', '{t}')" for i, (label, t) in enumerate(WORDINGS))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    words = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH v AS (SELECT id, label, len(string_split(t, ' ')) * {SPREAD} AS span, list_distinct(string_split(t, ' ')) AS fw FROM (VALUES {values}) x(id, label, t)),
d AS (SELECT doc_id, coalesce(text, '') AS text, {words.format(t="coalesce(text, '')")} AS w FROM documents),
h AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1:i + len(string_split(p, ' '))], ' ') = p)) AS place FROM d, (VALUES {phrases}) x(p, label) WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p || ' ')),
b AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM h GROUP BY doc_id),
p AS (SELECT doc_id, {words.format(t="p")} AS w FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n[ \\t\\r\\x0B\\x0C]*\\n')) AS p FROM d)),
c AS (SELECT doc_id, label, w, span, fw FROM p, v WHERE len(list_intersect(fw, w)) >= ceil({CONTAINMENT} * len(fw) - 1e-9)),
r AS (SELECT doc_id, label, list_max(list_transform(range(0, len(w)), lambda i: len(list_intersect(fw, w[i + 1:i + span])))) AS n, fw FROM c),
m AS (SELECT doc_id, label, max(n / len(fw)) AS score FROM r WHERE n >= ceil({CONTAINMENT} * len(fw) - 1e-9) GROUP BY ALL),
ls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, max(score) AS score FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word, coalesce(ls, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE round(coalesce(score, 0.0), 6) END AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN s USING (doc_id)"""


OP4_SQL = _sql()
