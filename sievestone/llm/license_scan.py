"""License scans: base phrases by position, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (label, phrase) of the base rules.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: (label, text) of the templates that blocks are joined with.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]
CONTAINMENT = 0.8


def words_of(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased: runs of digits, a-z and everything beyond ASCII."""
    return F.array_remove(F.split(text, NOT_WORD), "")


def template_sets(templates: Sequence[tuple[str, str]], containment: float) -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct words, how many of them a block must hold) for each template with a word."""
    out = []
    for label, text in templates:
        words = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in "".join(c.lower() if c.isascii() else c for c in text)).split(" ")
        if distinct := list(dict.fromkeys(w for w in words if w)):
            out.append((len(out), label, distinct, max(1, math.ceil(containment * len(distinct) - 1e-9))))
    return out


def matched_blocks(texts: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, key: str = "key", text: str = "t") -> DataFrame:
    """(key, block, label, found, size) for every block (line) of `text` and template of which it holds at least
    `containment` of the distinct words.  `text` is lower-cased already.

    Words are ordered by their frequency over the whole corpus, rarest first.  A block that meets the threshold must
    hold one of the first size - need + 1 words of the template (prefix filter), have at least `need` distinct words
    (length filter), and have enough template words left behind its first match (positional filter); what passes
    is counted in full.  Only words of templates matter to any of the three, so the order is counted for those, in one
    pass that sends one partial count for each word and task.  Templates are a parameter, not data: what is
    collected and broadcast is bounded by their words.
    """
    spark = texts.sparkSession
    sets = template_sets(templates, containment)
    vocabulary = sorted({w for s in sets for w in s[2]})
    schema = f"{key} {dict(texts.dtypes)[key]}, block int, label string, found int, size int"
    if not sets:
        return spark.createDataFrame([], schema)
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("block", "line"))
    blocks = lines.select(key, "block", F.array_distinct(words_of(F.col("line"))).alias("words"))
    shared = texts.select(F.explode(F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, vocabulary)))).alias("word"))
    count = {r["word"]: r["n"] for r in shared.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each template word at most
    ordered = [(n, label, sorted(words, key=lambda w: (count.get(w, 0), w)), need) for n, label, words, need in sets]
    prefix = [(w, n, at, label, words, len(words), need) for n, label, words, need in ordered for at, w in enumerate(words[: len(words) - need + 1])]
    frame = F.broadcast(spark.createDataFrame(prefix, "word string, n int, at int, label string, template array<string>, size int, need int"))
    first = sorted({p[0] for p in prefix})
    fits = blocks.filter(F.size("words") >= min(s[3] for s in sets)).withColumn("hit", F.array_intersect("words", F.array(*map(F.lit, first)))).filter(F.size("hit") > 0)
    pairs = fits.select(key, "block", "words", F.explode("hit").alias("word")).join(frame, "word").filter((F.size("words") >= F.col("need")) & (F.col("size") - F.col("at") >= F.col("need")))
    # Of several prefix words that a block holds, the first in the order stands for the pair: no shuffle to tell pairs apart.
    first_hit = F.element_at(F.filter(F.slice("template", 1, F.col("size") - F.col("need") + 1), lambda w: F.array_contains("words", w)), 1) == F.col("word")
    counted = pairs.filter(first_hit).withColumn("found", F.size(F.array_intersect("template", "words")))
    return counted.filter("found >= need").select(key, "block", "label", "found", "size")


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: (key, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts every place where a phrase's words stand consecutively (overlaps too); first_word and last_word are
    the smallest and largest start.  labels adds those of templates that a line meets; score is the largest contained
    part of a template that was met, 1 with a base label, else 0.  Null text is like an empty one.  Repeated rows each
    get a row (rows are told apart by id and text, so equal ones share their equal results).
    """
    base = docs.select(F.col(key).alias("key"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    base = base.withColumn("h", F.xxhash64("t"))
    blocks = matched_blocks(base.withColumn("id", F.struct("key", "h")).select("id", "t"), templates, containment, key="id")
    # The few matched lines are written, so that the words of all documents aren't looked through again for the join.
    found = materialize(blocks.groupBy("id").agg(F.collect_set("label").alias("more"), F.max(F.col("found") / F.col("size")).alias("best")), "licenses")

    rows = base.withColumn("w", words_of(F.col("t")))
    packed = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    starts = []
    for label, phrase in phrases:
        words = phrase.split(" ")
        same = " AND ".join(f"w[i + {k}] = '{w}'" if k else f"x = '{w}'" for k, w in enumerate(words))
        at = F.expr(f"filter(transform(w, (x, i) -> if({same}, i, -1)), i -> i >= 0)")
        starts.append((label, F.when(F.contains(F.col("p"), F.lit(f" {phrase} ")), at).otherwise(F.expr("array()").cast("array<int>"))))
    rows = rows.select("key", "h", "w", packed.alias("p")).select("key", "h", F.size("w").cast("long").alias("n_words"), *[s.alias(f"s{k}") for k, (_, s) in enumerate(starts)])
    every = F.concat(*[F.col(f"s{k}") for k in range(len(starts))])
    rows = rows.select("key", "h", "n_words", every.alias("every"), F.array_compact(F.array(*[F.when(F.size(f"s{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(starts)])).alias("base"))
    out = rows.join(found, (F.col("key").eqNullSafe(F.col("id.key"))) & (F.col("h") == F.col("id.h")), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(F.col("key").alias(key), "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"), joined(F.col("base")).alias("base_labels"),
                      joined(F.concat("base", F.coalesce("more", F.expr("array()").cast("array<string>")))).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle() -> str:
    quoted = lambda words: "[" + ", ".join("'" + w + "'" for w in words) + "]"
    phrases = ", ".join(f"('{label}', {quoted(p.split(' '))})" for label, p in PHRASES)
    templates = ", ".join(f"({n}, '{label}', {quoted(words)}, {need})" for n, label, words, need in template_sets(TEMPLATES, CONTAINMENT))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM t),
ph(label, p) AS (VALUES {phrases}),
tp(n, label, p, need) AS (VALUES {templates}),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, label, w, p, unnest(range(1, len(w) + 1)) AS i FROM d, ph WHERE list_has_all(w, p)) WHERE list_slice(w, i, i + len(p) - 1) = p),
b AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS base FROM places GROUP BY doc_id),
l AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{word}')) AS w FROM d),
m AS (SELECT doc_id, list(DISTINCT label) AS more, max(len(list_intersect(w, p)) / len(p)) AS best FROM l, tp WHERE len(list_intersect(w, p)) >= need GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels, CASE WHEN base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


ORACLE = oracle()
