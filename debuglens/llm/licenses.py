"""License scans: phrases at fixed places, and an exact set-similarity join with notice templates.

Blocks are the lines of a text and, so that wrapped notices are found, all windows of as many
words as the longest template has, over the whole text with line breaks ignored. A block matches
a template if it contains at least the share ``CONTAINMENT`` of the template's distinct words.
The join is exact and uses three filters: words are ordered by their document frequency over all
documents, rarest first, and a match must share one of the first ``size - needed + 1`` words of
the template (prefix); a block with fewer template words than needed can't match (length); and
the words left behind the first shared one bound the overlap (position). Windows are looked for
around each prefix word: the words that any window with it can have pass the filters together,
then its windows are verified one by one.

One pass over the texts makes the words, the places of the phrases and the template words that a
text has; only texts with enough words of some template are kept for the join. Only DataFrame
functions are used.
"""

from __future__ import annotations

import math
import string
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debuglens.llm.common import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
#: Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that the join looks for, in their words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution license"),
    ("reserved", "all rights reserved"),
)


#: ASCII signs that are no letter or digit become spaces, A-Z become a-z.
_SIGNS = [chr(c) for c in range(128) if not chr(c).isalnum()]
_FROM = "".join(_SIGNS) + string.ascii_uppercase
_TO = " " * len(_SIGNS) + string.ascii_lowercase


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase, found at its last word."""
    parts = phrase.split()
    last = F.sequence(F.lit(0), F.size(words) - 1)

    def stands(i: Column) -> Column:
        here = F.get(words, i) == parts[-1]
        for k, word in enumerate(reversed(parts[:-1]), 1):
            here = here & F.coalesce(F.get(words, i - k) == word, F.lit(False))
        return here

    return F.transform(F.filter(last, stands), lambda i: i - (len(parts) - 1))


def _folded(name: str = "text") -> Column:
    """The text with A-Z in lower case and every ASCII sign that is no letter or digit as a space; null is empty."""
    return F.translate(F.coalesce(name, F.lit("")), _FROM, _TO)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are those of the whole text with A-Z in lower case; other letters stay as they are.
    ``n_base`` counts all places of the phrases; ``score`` is the greatest containment of a
    template in a block that matches, 0 without a match. A null text counts as empty; a text
    without words has no places and empty labels. Every row has values of its own, also rows
    that repeat a doc_id or have none; labels are distinct and sorted, so ties have no order. An
    empty table gives an empty result, and columns other than doc_id and text are not read.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    empty = F.array().cast("array<int>")
    base = docs.select("doc_id", F.col("text").alias("text_"), _folded().alias("folded_")).select("doc_id", "text_", "folded_", _split(F.col("folded_")).alias("words_"))
    last_words = sorted({p.split()[-1] for p, _ in PHRASES})
    likely = reduce(or_, [F.col("folded_").contains(w) for w in last_words])
    columns = [F.when(likely, _places(F.col("words_"), p)).otherwise(empty).alias(f"at{k}") for k, (p, _) in enumerate(PHRASES)]
    shared = F.array_intersect("words_", F.array(*map(F.lit, vocabulary)))
    slim = base.select("doc_id", "text_", F.size("words_").cast("long").alias("n_words"), shared.alias("shared"), *columns)
    # a text that doesn't have enough words of any template holds no block that matches one
    sets = [sorted(set(t.split())) for _, t in templates]
    enough = reduce(or_, [F.size(F.array_intersect("shared", F.array(*map(F.lit, t)))) >= _needed(len(t), containment) for t in sets])
    able = (F.size("shared") >= min(_needed(len(t), containment) for t in sets)) & enough
    rows = cut(slim.select("doc_id", F.monotonically_increasing_id().alias("row_"), "n_words", "shared", *[f"at{k}" for k in range(len(PHRASES))], F.when(able, F.col("text_")).alias("text_")))
    places = F.concat(*[f"at{k}" for k in range(len(PHRASES))])
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(name)) for k, (_, name) in enumerate(PHRASES)]), lambda x: x.isNotNull())))
    found = _matches(rows, templates, containment)
    joined = rows.select("row_", "doc_id", "n_words", places.alias("places"), labels.alias("base")).join(found, "row_", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("names", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _needed(size: int, containment: float) -> int:
    return math.ceil(containment * size - 1e-9)


def _matches(rows: DataFrame, templates, containment: float) -> DataFrame:
    """(row_, names, score) of the rows with a block that matches a template.

    The template words, fewer than 200 whatever the input is, are ranked by document frequency.
    """
    spark = rows.sparkSession
    counted = {r["w"]: r["n"] for r in rows.select(F.explode("shared").alias("w")).groupBy("w").count().withColumnRenamed("count", "n").collect()}
    order = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (counted.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    ranked = [(k, label, sorted({rank[w] for w in t.split()})) for k, (label, t) in enumerate(templates)]
    prefix = [(k, label, r, len(r), n, p, r[p]) for k, label, r in ranked for n in (_needed(len(r), containment),) for p in range(len(r) - n + 1)]
    # a row for each prefix word of each template: bounded by the templates
    index = F.broadcast(spark.createDataFrame(prefix, "template int, label string, ranks array<int>, size int, needed int, at int, rank int"))
    rare = sorted({order[x[-1]] for x in prefix})
    lookup = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    texts = rows.filter("text_ IS NOT NULL").select("row_", "text_")
    # a block is looked at word by word only if it has a rare word's letters
    blocks = texts.select("row_", F.explode(F.split("text_", "\n")).alias("line")).select("row_", _folded("line").alias("block")).filter(F.greatest(*[F.col("block").contains(w) for w in rare], F.lit(False)))
    sets = blocks.select("row_", F.array_sort(F.filter(F.transform(F.array_distinct(_split(F.col("block"))), lambda w: F.try_element_at(lookup, w)), lambda r: r.isNotNull())).alias("has"))
    least = min(x[4] for x in prefix)
    met = sets.filter(F.size("has") >= least).select("row_", "has", F.posexplode("has").alias("here", "rank")).join(index, "rank")
    able = met.filter((F.size("has") >= F.col("needed")) & (F.least(F.col("size") - F.col("at"), F.size("has") - F.col("here")) + F.least("at", "here") >= F.col("needed")))
    scored = able.withColumn("share", F.size(F.array_intersect("has", "ranks")) / F.col("size")).select("row_", "label", "share")
    scored = scored.unionByName(_windows(texts, index, lookup, prefix, max(len(t.split()) for _, t in templates))).filter(F.col("share") >= containment - 1e-9)
    return scored.groupBy("row_").agg(F.sort_array(F.collect_set("label")).alias("names"), F.max("share").alias("score"))


def _windows(texts: DataFrame, index: DataFrame, lookup: Column, prefix: list, length: int) -> DataFrame:
    """(row_, label, share) of windows of length words around prefix words, in texts of several lines."""
    every = F.transform(_split(_folded("text_")), lambda w: F.coalesce(F.try_element_at(lookup, w), F.lit(-1)))
    ranked = texts.filter(F.col("text_").contains("\n")).select("row_", every.alias("words_"))
    places = F.filter(F.sequence(F.lit(0), F.size("words_") - 1), lambda i: F.get("words_", i).isin(sorted({x[-1] for x in prefix})))
    reach = lambda i: F.slice("words_", F.greatest(i - (length - 2), F.lit(1)), F.least(i, F.lit(length - 1)) + length)
    around = ranked.select("row_", F.explode(F.transform(places, lambda i: F.struct(F.get("words_", i).alias("rank"), reach(i).alias("words")))).alias("s")).select("row_", "s.rank", "s.words")
    sets = around.withColumn("has", F.array_sort(F.array_distinct(F.filter("words", lambda r: r >= 0)))).filter(F.size("has") >= min(x[4] for x in prefix))
    met = sets.withColumn("here", F.array_position("has", F.col("rank")) - 1).join(index, "rank")
    able = met.filter((F.size("has") >= F.col("needed")) & (F.least(F.col("size") - F.col("at"), F.size("has") - F.col("here")) + F.least("at", "here") >= F.col("needed")))
    whole = able.filter(F.size(F.array_intersect("has", "ranks")) >= F.col("needed"))
    shares = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - length, F.lit(0)) + 1), lambda k: F.size(F.array_intersect(F.slice("words", k, F.lit(length)), F.col("ranks"))))
    return whole.select("row_", "label", (F.array_max(shares) / F.col("size")).alias("share"))


def _oracle() -> str:
    rows = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in sorted(set(t.split())))}])" for k, (label, t) in enumerate(TEMPLATES))
    pattern = "'" + WORD + "'"

    def places(phrase: str) -> str:
        parts = phrase.split()
        return f"list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"coalesce(w[i + {k}], '') = '{p}'" for k, p in enumerate(parts)) + ")"

    ats = [places(p) for p, _ in PHRASES]
    return rf"""
WITH d AS (SELECT doc_id, t, regexp_extract_all(t, {pattern}) AS w FROM (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents) x),
p AS (SELECT doc_id, len(w) AS n, {ats[0]} AS a0, {ats[1]} AS a1, {ats[2]} AS a2 FROM d),
b AS (SELECT doc_id, n, list_concat(list_concat(a0, a1), a2) AS places, len(a0) AS c0, len(a1) AS c1, len(a2) AS c2 FROM p),
tpl(k, label, words) AS (VALUES {rows}),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(line, {pattern})) AS has FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) x),
hits AS (SELECT doc_id, label, len(list_intersect(words, has)) / CAST(len(words) AS DOUBLE) AS share FROM blocks, tpl),
m AS (SELECT doc_id, max(share) AS score, max(CASE WHEN label = 'apache' THEN 1 ELSE 0 END) AS apache, max(CASE WHEN label = 'bsd' THEN 1 ELSE 0 END) AS bsd, max(CASE WHEN label = 'cc' THEN 1 ELSE 0 END) AS cc, max(CASE WHEN label = 'gpl' THEN 1 ELSE 0 END) AS gpl, max(CASE WHEN label = 'mit' THEN 1 ELSE 0 END) AS mit, max(CASE WHEN label = 'mpl' THEN 1 ELSE 0 END) AS mpl, max(CASE WHEN label = 'reserved' THEN 1 ELSE 0 END) AS reserved
  FROM hits WHERE share >= {CONTAINMENT} - 1e-9 GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  concat_ws(',', CASE WHEN c1 > 0 THEN 'apache' END, CASE WHEN c2 > 0 THEN 'gpl' END, CASE WHEN c0 > 0 THEN 'mit' END) AS base_labels,
  concat_ws(',', CASE WHEN c1 > 0 OR apache = 1 THEN 'apache' END, CASE WHEN bsd = 1 THEN 'bsd' END, CASE WHEN cc = 1 THEN 'cc' END, CASE WHEN c2 > 0 OR gpl = 1 THEN 'gpl' END, CASE WHEN c0 > 0 OR mit = 1 THEN 'mit' END, CASE WHEN mpl = 1 THEN 'mpl' END, CASE WHEN reserved = 1 THEN 'reserved' END) AS labels,
  coalesce(score, 0.0) AS score
FROM b LEFT JOIN m ON b.doc_id = m.doc_id
"""


ORACLE = _oracle()
