"""License scan: exact phrases, and an exact set-similarity join of text blocks with license notices.

Join: a block of a text is a run of words, as many as the template has and a quarter more, wherever it stands (line
breaks separate words like any other separator).  A block matches a template when it holds at least ``threshold`` of
the template's distinct tokens.  Tokens have one global order, rarest first, from their counts in all texts.  Then,
exactly:

* prefix: a matching block holds a token of the template's first |T| - need + 1 tokens, so texts meet templates by an
  equi-join on the places of prefix tokens (never all pairs), and only blocks around such a place are looked at;
* length: words around the place with fewer distinct vocabulary tokens than ``need`` hold no match;
* position: the tokens left on either side of the meeting token, in global order, must still be able to reach ``need``.

Survivors are verified on full sets, block by block; a block begins at a token of the template (the first one in any
matching run of words).  Each text is split once: what is kept of it are the places of words of the phrases and
templates (``vocabulary_places``), written to the shared folder; counts, phrases and blocks come from there.  Templates
are a small table (checked against ``MAX_TEMPLATES``) and broadcast; texts are never shuffled, only matches are.

Native: DataFrame expressions only; templates are SQL ``VALUES``.

Edge cases: null or empty text has no words and no matches; a null ``doc_id``
groups like any other value; rows sharing a ``doc_id`` share the joined labels
but keep their own counts; ties in frequency are ordered by token; templates without words match nothing; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import ascii_lower, bounded_rows, materialize, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATES = 5_000
THRESHOLD = 0.8
PIECE = 512  # places of a text that are searched at once

# Phrases whose words must stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Short license notices (label, text).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("proprietary", "Copyright. All rights reserved. No part may be reproduced without prior written permission."),
]


def word_list(text: str) -> list[str]:
    """Words of a template or phrase, as texts are split into them."""
    lower = text.translate({c: c + 32 for c in range(0x41, 0x5B)})
    return [w for w in re.split(SEPARATORS, lower) if w]


def block_words(n: int) -> int:
    """Words in a block for a template of ``n`` words."""
    return n + n // 4


def vocabulary_places(docs: DataFrame, vocabulary: set[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits): per row, its number of words and the places ``(at, w)`` of the vocabulary's words."""
    words = F.split(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), SEPARATORS, -1)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), words.alias("words"))
    lead = F.when(F.col("words")[0] == "", 1).otherwise(0)  # a leading separator makes an empty first word
    trail = F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    known = sorted(vocabulary)
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(known), F.struct((i - lead).alias("at"), w.alias("w")))),
                      lambda h: h.isNotNull())
    return rows.select("doc_id", (F.size("words") - lead - trail).cast("long").alias("n_words"), places.alias("hits"))


def phrase_columns(hits: Column, phrases: dict[str, str] = PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word and the array of base labels, from the places of the phrases' words."""
    def stands(phrase: list[str]):
        def here(h, j):
            ok = h["w"] == phrase[0]
            for k, w in enumerate(phrase[1:], 1):
                next_ = F.get(hits, j + k)
                ok = ok & F.coalesce((next_["w"] == w) & (next_["at"] == h["at"] + k), F.lit(False))
            return ok
        return here

    found, labels = [], []
    for phrase, label in phrases.items():
        places = F.transform(F.filter(hits, stands(word_list(phrase))), lambda h: h["at"])
        found.append(places)
        labels.append(F.when(F.size(places) > 0, F.lit(label)))
    every = F.concat(*found)
    return {"n_base": F.size(every).cast("long"), "first_word": F.array_min(every).cast("long"),
            "last_word": F.array_max(every).cast("long"), "base": F.array_distinct(F.array_compact(F.array(*labels)))}


def _sql_list(values: list[str]) -> str:
    return "ARRAY(" + ", ".join(f"'{v}'" for v in values) + ")"


def need_of(size: int, threshold: float) -> int:
    return -int(-(threshold * size - 1e-9) // 1)


def prefix_tokens(text: str, counts: dict[str, int], threshold: float) -> list[str]:
    """The template's rarest tokens, one of which every matching block holds."""
    tokens = sorted(set(word_list(text)), key=lambda w: (counts.get(w, 0), w))
    return tokens[:len(tokens) - need_of(len(tokens), threshold) + 1] if tokens else []


def probe_table(spark: SparkSession, templates: list[tuple[str, str]], counts: dict[str, int],
                threshold: float) -> tuple[DataFrame, Column]:
    """(template, label, t_tokens, t_at, token, need, span) for each prefix token, and the global rank of tokens."""
    sets = [(i, label, word_list(t)) for i, (label, t) in enumerate(templates)]
    order = sorted({w for _, _, t in sets for w in t}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: r for r, w in enumerate(order)}
    rows = []
    for i, label, t in sets:
        tokens = sorted(set(t), key=rank.get)
        need, first = need_of(len(tokens), threshold), prefix_tokens(templates[i][1], counts, threshold)
        rows += [f"({i}, '{label}', {_sql_list(tokens)}, {at}, '{w}', {need}, {block_words(len(t))})"
                 for at, w in enumerate(first)]
    names = "template, label, t_tokens, t_at, token, need, span"
    empty = "(0, '', ARRAY(''), 0, CAST(NULL AS STRING), 1, 1)"  # joins with nothing
    probes = spark.sql(f"SELECT * FROM VALUES {', '.join(rows or [empty])} AS t({names})")
    return probes, F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)] or [F.lit(""), F.lit(0)])


def match(places: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every (doc_id, at, template, label, containment) with containment >= threshold in the block that begins at word
    ``at``, a token of the template.  ``places`` is what ``vocabulary_places`` gives for all their words."""
    spark = places.sparkSession
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"templates: more than {MAX_TEMPLATES}; scan them in several calls")
    vocabulary = {w for _, t in templates for w in word_list(t)}
    counted = places.select(F.explode("hits.w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(
        F.col("w").isin(sorted(vocabulary)))
    counts = {r["w"]: r["n"] for r in bounded_rows(counted, len(vocabulary), "token frequencies")}
    probes, rank = probe_table(spark, templates, counts, threshold)
    prefix = sorted({w for i, (_, t) in enumerate(templates) for w in prefix_tokens(t, counts, threshold)})
    widest = max((block_words(len(word_list(t))) for _, t in templates), default=1)
    # A text's places in pieces that overlap by a block on both sides; then, around each prefix token, the places near it.
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("hits") - 1) / PIECE).cast("int")), lambda c: F.struct(
        F.least(c * PIECE, F.lit(widest)).alias("own"),
        F.slice("hits", F.greatest(c * PIECE - widest, F.lit(0)) + 1,
                F.least(c * PIECE, F.lit(widest)) + (PIECE + widest)).alias("part")))
    parts = places.filter(F.size("hits") > 0).select("doc_id", F.inline(pieces))
    around = F.transform("part", lambda h, i: F.when(
        h["w"].isin(prefix) & (i >= F.col("own")) & (i < F.col("own") + PIECE),
        F.struct(h["at"].alias("p"), h["w"].alias("token"),
                 F.slice("part", F.greatest(i - widest, F.lit(0)) + 1, 2 * widest + 1).alias("near"))))
    met = parts.select("doc_id", F.inline(F.filter(around, lambda a: a.isNotNull())))
    met = met.join(F.broadcast(probes), "token")
    near = F.filter("near", lambda h: (h["at"] > F.col("p") - F.col("span")) & (h["at"] < F.col("p") + F.col("span")))
    met = met.select("doc_id", "p", "template", "label", "t_tokens", "t_at", "token", "need", "span", near.alias("near"))
    tokens = F.array_distinct("near.w")
    met = met.filter(F.size(tokens) >= F.col("need"))
    ranks = F.array_sort(F.filter(F.transform(tokens, lambda w: rank[w]), lambda r: r.isNotNull()))
    met = met.withColumn("ranks", ranks).withColumn("b_at", F.array_position("ranks", rank[F.col("token")]).cast("int") - 1)
    met = met.filter(F.lit(1) + F.least(F.size("t_tokens") - F.col("t_at") - 1, F.size("ranks") - F.col("b_at") - 1)
                     + F.least("t_at", "b_at") >= F.col("need"))
    met = met.withColumn("own", F.filter("near", lambda h: F.array_contains("t_tokens", h["w"])))

    def held(s):
        block = F.filter("own", lambda h: (h["at"] >= s["at"]) & (h["at"] < s["at"] + F.col("span")))
        return F.size(F.array_distinct(F.transform(block, lambda h: h["w"])))

    starts = F.transform(F.filter("own", lambda h: h["at"] <= F.col("p")), lambda s: F.struct(s["at"], held(s).alias("n")))
    met = met.select("doc_id", "template", "label", "t_tokens", "need", F.inline(starts)).filter(F.col("n") >= F.col("need"))
    return met.select("doc_id", "at", "template", "label", (F.col("n") / F.size("t_tokens")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``match`` of a table of texts."""
    vocabulary = {w for _, t in templates for w in word_list(t)}
    return match(materialize(vocabulary_places(docs, vocabulary, doc_id, text), "places"), templates, threshold)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and template matches of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = {w for t in [*PHRASES, *(t for _, t in TEMPLATES)] for w in word_list(t)}
    places = materialize(vocabulary_places(docs, known), "places")
    found = match(places).groupBy("doc_id").agg(F.collect_set("label").alias("met"),
                                                F.max("containment").alias("score"))
    base = places.select("doc_id", "n_words", *[c.alias(n) for n, c in phrase_columns(F.col("hits")).items()])
    hits = found.select(F.col("doc_id").alias("_id"), "met", "score")
    out = base.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    met = F.coalesce("met", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                      F.array_join(F.array_sort(F.array_union("base", met)), ",").alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))


def _duck_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i : w[i + 1:i + {len(p.split())}] = "
    f"{_duck_list(p.split())})) AS pos FROM d" for p, label in PHRASES.items())
_TEMPLATE_SQL = "VALUES " + ", ".join(
    f"('{label}', {_duck_list(sorted(set(word_list(t))))}, {block_words(len(word_list(t)))})" for label, t in TEMPLATES)
#: DuckDB SQL of the query: phrases by list slices, templates by list intersection with the block at every word that is
#: one of the template's.
OP1_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex({_LOWER_SQL},
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x : x <> '') AS w FROM documents),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
  list_sort(list(DISTINCT label)) AS labels FROM ({_PHRASE_SQL}) GROUP BY doc_id),
t(label, tw, span) AS ({_TEMPLATE_SQL}),
starts AS (SELECT doc_id, w, label, tw, span,
  unnest(list_filter(range(len(w)), lambda i : list_contains(tw, w[i + 1]))) AS pos FROM d, t),
met AS (SELECT doc_id, label, len(list_intersect(tw, w[pos + 1:pos + span])) / len(tw) AS share FROM starts),
hits AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS score FROM met
  WHERE share >= {THRESHOLD} - 1e-9 GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(hits.labels, [])))), ',') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN hits USING (doc_id)
"""
