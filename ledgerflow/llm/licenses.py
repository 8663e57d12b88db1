"""License scan: exact phrases, and an exact set-similarity join of text blocks with templates.

Base: the places where a phrase's words stand consecutively, over the whole text.

Join: blocks are overlapping windows of words over the whole text, wherever its lines break.  Templates
are put into classes by size, u tokens at most in each (4, 8, 16, ...); the windows of a class have 2u
words and start every u words, so a notice of up to u words lies whole in one of them, however it is
wrapped.  All template tokens are ordered by how often they occur in all documents, rarest first.  For a
template of n tokens and threshold t a block must hold ceil(t n) of them, so it holds one of the first
n - ceil(t n) + 1 (the prefix).  Texts and windows without any prefix token of their class are
skipped; the rest meet the prefix index (broadcast: its size is that of the template list, not of the
data), and the length and positional filters, before the overlap is counted exactly.  Every template
that a block contains to the threshold gives its label.

Only DataFrame functions run.  Hot documents need no split: everything but the last join works
inside a row, and that join carries narrow rows of the documents with a match, one per text.

Defined results: a null text is empty: no words, no places, no labels, score 0.  Repeated rows give
equal rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_of, ascii_lower

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrase and label of the base scan.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Label and words of common license notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased (A-Z), joined by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR, " "))


def count_words(words: Column) -> Column:
    return F.regexp_count(words, F.lit("[^ ]+")).cast("long")


def base_scan(words: str, total: str, phrases=PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels (array) from the column of joined words."""
    padded = F.concat(F.lit(" "), F.col(words), F.lit(" "))
    places, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in phrases:
        parts = F.split(padded, f"(?<= ){phrase}(?= )")
        hit = F.contains(padded, F.lit(f" {phrase} "))
        n = len(phrase.split(" "))
        places = places + F.when(hit, F.size(parts) - 1).otherwise(F.lit(0))
        firsts.append(F.when(hit, count_words(parts[0])))
        lasts.append(F.when(hit, F.col(total) - count_words(F.element_at(parts, -1)) - n))
        labels.append(F.when(hit, F.lit(label)))
    return {"n_base": places.cast("long"), "first_word": F.least(*firsts), "last_word": F.greatest(*lasts),
            "base_labels": F.array_distinct(F.array_sort(F.array_compact(F.array(*labels))))}


def token_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Occurrences of each vocabulary token in all documents (one row per template token comes back)."""
    token = F.explode(F.split(words_of(F.col("text")), " ")).alias("token")
    found = docs.select(token).where(F.col("token").isin(vocabulary)).groupBy("token").count()
    return {t: 0 for t in vocabulary} | {r["token"]: r["count"] for r in found.collect()}


def window_class(n: int) -> int:
    """The least power of two, from 4 on, that is at least ``n``."""
    return max(4, 1 << (n - 1).bit_length())


def block_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Every (text, block, template contained to the threshold): _id, _text, _u, block, label, containment."""
    spark = docs.sparkSession
    counts = token_counts(docs, sorted({t for _, w in templates for t in w.split(" ")}))
    order = sorted(counts, key=lambda t: (counts[t], t))
    rank = {t: i for i, t in enumerate(order)}
    index, sets, prefixes = [], [], {}
    for k, (label, w) in enumerate(templates):
        own = sorted(rank[t] for t in set(w.split(" ")))
        need, u = math.ceil(threshold * len(own)), window_class(len(w.split(" ")))
        sets.append((k, label, own, need))
        prefix = own[: len(own) - need + 1]
        prefixes.setdefault(u, set()).update(order[r] for r in prefix)
        index += [(u, r, k, len(own), need, p) for p, r in enumerate(prefix)]
    any_prefix = f"(^| )({'|'.join(sorted(set().union(*prefixes.values())))})( |$)"
    index_df = F.broadcast(spark.createDataFrame(index, "_u int, _rank int, _k int, _n int, _need int, _p int"))
    sets_df = F.broadcast(spark.createDataFrame(sets, "_k int, label string, _set array<int>, _need int"))
    ranks = F.create_map(*[x for t, r in rank.items() for x in (F.lit(t), F.lit(r))])
    in_order = F.array(*[F.lit(t) for t in order])

    def windows(u: int) -> Column:
        """The windows of a class that hold one of its prefix tokens."""
        tokens = F.array(*[F.lit(t) for t in sorted(prefixes[u])])
        starts = F.sequence(F.lit(0), F.floor((F.size("_words") - 1) / u).cast("int"))
        cut = F.transform(starts, lambda i: F.struct(F.lit(u).alias("u"), i.alias("block"), F.slice("_words", i * u + 1, F.lit(2 * u)).alias("words")))
        return F.filter(cut, lambda x: F.arrays_overlap(x["words"], tokens))

    worded = (docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), words_of(F.col("text")).alias("_line"))
              .where(F.col("_line").rlike(any_prefix)).select("_id", "_text", F.split("_line", " ").alias("_words")))
    blocks = (worded.select("_id", "_text", F.explode_outer(F.concat(*[windows(u) for u in sorted(prefixes)])).alias("_b"))
              .select("_id", "_text", F.col("_b.u").alias("_u"), "_b.block", F.array_sort(F.transform(
                  F.array_intersect("_b.words", in_order), lambda t: F.element_at(ranks, t))).alias("_own")))
    met = (blocks.select("*", F.posexplode_outer("_own").alias("_q", "_rank")).join(index_df, ["_u", "_rank"])
           .where((F.size("_own") >= F.col("_need"))  # length, then position: what can still come on either side
                  & (F.least(F.col("_n") - F.col("_p"), F.size("_own") - F.col("_q")) >= F.col("_need")
                     - F.least(F.col("_p"), F.col("_q")))))
    return (met.select("_id", "_text", "_u", "block", "_own", "_k").join(sets_df, "_k")
            .withColumn("_both", F.size(F.array_intersect("_set", "_own"))).where(F.col("_both") >= F.col("_need"))
            .select("_id", "_text", "_u", "block", "label", (F.col("_both") / F.size("_set")).alias("containment")))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = docs.select("doc_id", "text")
    base = (docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), words_of(F.col("text")).alias("_words"))
            .withColumn("n_words", count_words(F.col("_words"))).withColumns(base_scan("_words", "n_words", phrases)).drop("_words"))
    met = (block_matches(docs, templates, threshold).groupBy("_id", "_text")
           .agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_score")))
    joined = base.join(met, all_of([F.col("doc_id").eqNullSafe(F.col("_id")), F.col("_hash") == F.col("_text")]), "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("_labels", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                         F.array_join(every, ",").alias("labels"),
                         F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("_score", F.lit(0.0))).alias("score"))
