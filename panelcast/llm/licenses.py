"""License scan: an exact set-similarity join of text blocks and templates, in DataFrame operations only.

A block is a line of a text, a set of words; a template is a notice, a set of words too.  A block
meets a template when it holds at least *percent* of the template's words.  The words of all
templates are ordered by the number of documents that have them, rare ones first.  Filters before
the exact overlap: a block must hold one of the template's leading words, the prefix, of which so
many may miss at most (prefix filter); it must have enough words at all (length filter); and from
the common word on, both must have enough words left in the order (positional filter).

The templates are a fixed, short list, so their index and the order are literals of bounded size;
everything that grows with the texts stays a row of Spark.  The base phrases are places of fixed
word runs anywhere in a text.

Nulls and empty texts: no word, no place, empty labels, score 0.  Repeated rows and null ids are rows
like others, each row is scanned by itself.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENT = 80

# Phrases of the base scan and their labels, and the notices with theirs.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "Released under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("cc-by", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("public-domain", "This work has been dedicated to the public domain"),
    ("reserved", "Copyright, all rights reserved"),
)

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE = "(?<![^ ])(?=(?:" + "|".join(PHRASES) + ")(?: |\\z))"  # not $, which also matches before a last line separator


def normal(text: Column) -> Column:
    """Words, A-Z in lower case, with one space between."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, _GAP, " "))


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def count_words(norm: Column) -> Column:
    spaces = F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit("")))
    return F.when(norm == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def word_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The words of the templates, rarest first by the number of documents of *docs* that have them."""
    every = sorted({w for _, t in templates for w in template_words(t)})
    found = F.array_intersect(F.array(*map(F.lit, every)), F.split(normal(F.col("text")), " "))
    counts = dict(docs.select(F.explode(found).alias("w")).groupBy("w").count().collect())  # a row a word of the list
    return sorted(every, key=lambda w: (counts.get(w, 0), w))


def scan(docs: DataFrame, percent: int = PERCENT, templates=TEMPLATES) -> DataFrame:
    """A row for each row of *docs*: counts and places of the base phrases, labels and score."""
    order = word_order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    index, leads = [], set()
    for k, (label, text) in enumerate(templates):
        own = sorted(template_words(text), key=rank.__getitem__)
        need = -(-percent * len(own) // 100)
        for i, w in enumerate(own[: len(own) - need + 1]):
            index.append((w, i, k, label, len(own), need, own))
            leads.add(w)
    probe = docs.sparkSession.createDataFrame(
        index, "word string, i int, template int, label string, size int, need int, own array<string>"
    )
    shortest = min(r[5] for r in index)
    array = lambda ws: F.array(*map(F.lit, ws))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text", normal(F.col("text")).alias("norm")
    )
    parts = F.split("norm", _PLACE)
    head = F.lit(0)
    for p in PHRASES:
        head = F.greatest(head, (F.element_at("parts", 1).startswith(p + " ") | (F.element_at("parts", 1) == p)).cast("int"))
    tail = F.element_at("parts", -1)
    padded = F.concat(F.lit(" "), "norm", F.lit(" "))
    names = F.array_compact(F.array(*(F.when(padded.contains(f" {p} "), F.lit(label)) for p, label in PHRASES.items())))
    lines = F.transform(
        F.split("text", "\n"), lambda line: F.array_intersect(array(order), F.split(normal(line), " "))
    )
    known = F.when(
        F.arrays_overlap(F.split("norm", " "), array(sorted(leads))), F.filter(lines, lambda x: F.size(x) >= shortest)
    )
    base = rows.select("row", "doc_id", count_words(F.col("norm")).alias("n_words"), parts.alias("parts"), names.alias("base"), known.alias("known"))
    n = F.size("parts") - 1
    base = base.select(
        "row", "doc_id", "n_words",
        (n + head).cast("long").alias("n_base"),
        F.when(head == 1, F.lit(0)).when(n > 0, _spaces(F.element_at("parts", 1))).cast("long").alias("first_word"),
        F.when(n + head > 0, F.col("n_words") - _spaces(tail) - 1).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("base")).alias("base"), "known",
    )
    blocks = base.select("*", F.explode_outer("known").alias("block")).drop("known")
    words = blocks.select("*", F.posexplode_outer("block").alias("j", "word"))
    left = F.least(F.col("size") - F.col("i"), F.size("block") - F.col("j"))
    overlap = F.size(F.array_intersect("block", "own"))
    met = words.join(F.broadcast(probe), "word", "left").withColumn(
        "share", F.when((F.size("block") >= F.col("need")) & (left >= F.col("need")) & (overlap >= F.col("need")), overlap / F.col("size"))
    )
    keys = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    done = met.groupBy(*keys).agg(
        F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("more"), F.max("share").alias("share")
    )
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return done.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        score.alias("score"),
    )


def _spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def _sql() -> str:
    """The same by brute force: every line against every template."""
    templates = ", ".join(f"({k}, '{label}', {template_words(t)!r})" for k, (label, t) in enumerate(TEMPLATES))
    cls = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    at = " OR ".join(
        "(" + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in PHRASES
    )
    labels = ", ".join(
        f"CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ') THEN '{label}' END" for p, label in PHRASES.items()
    )
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(translate(coalesce(text, ''), {letters}), '{cls}') AS w FROM documents),
t(k, label, own) AS (VALUES {templates}),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
b AS (SELECT DISTINCT r, list_distinct(regexp_extract_all(translate(line, {letters}), '{cls}')) AS b FROM l),
m AS (SELECT r, label, len(list_intersect(b, own)) / len(own) AS share FROM b, t
      WHERE 100 * len(list_intersect(b, own)) >= {PERCENT} * len(own)),
g AS (SELECT r, list(label) AS more, max(share) AS share FROM m GROUP BY r),
p AS (SELECT d.*, list_filter(range(1, len(w) + 1), lambda i: coalesce({at}, false)) AS places,
             list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  (places[1] - 1)::BIGINT AS first_word, (places[len(places)] - 1)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM p LEFT JOIN g USING (r)
"""


SQL = _sql()
