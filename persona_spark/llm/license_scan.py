"""License scan by diagonal voting: rolling word k-gram hashes joined to template positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from persona_spark.llm.common import UPPER
from persona_spark.scale import lookup_join

#: Words of a k-gram: hashes of two words, then of two such pairs.
GRAM = 4
#: Diagonals at most this far apart are one span: so many words may be put in or left out between two hits.
SLACK = 3
#: Share of a template's distinct words that a span must hold.
MIN_SHARE = 0.75
#: Templates are broadcast; this bounds them.
MAX_TEMPLATE_WORDS = 200_000

PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0",),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0",),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License",),
}


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then the runs of ASCII letters, ASCII digits and non-ASCII characters."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def with_grams(df: DataFrame, words: str, grams: str) -> DataFrame:
    """Adds the hashes of the 4-word windows of the array `words`, by position."""
    pairs = "zip_with({0}, slice({0}, {1}, size({0})), (a, b) -> xxhash64(a, b))"
    return (
        df.withColumn("_one", F.expr(f"transform({words}, w -> xxhash64(w))"))
        .withColumn("_two", F.expr(pairs.format("_one", 2)))
        .withColumn(
            grams, F.expr(f"slice({pairs.format('_two', 3)}, 1, greatest(size(_two) - {GRAM - 1}, 0))")
        )
        .drop("_one", "_two")
    )


def template_words(spark: SparkSession, templates: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per template text: label, number and words. Texts under four words cannot be found."""
    rows = [(label, n, text) for n, (label, text) in enumerate((a, t) for a, ts in templates.items() for t in ts)]
    if sum(len(t.split()) for _, _, t in rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
    frame = spark.createDataFrame(rows, "label string, template int, text string")
    return frame.select("label", "template", words_of(F.col("text")).alias("words"))


def _phrase_starts(words: str, phrase: str) -> str:
    """SQL for the start positions of a phrase. The cheap test on single words spares most texts the search."""
    parts = phrase.split()
    has_all = " AND ".join(f"array_contains({words}, '{p}')" for p in parts)
    here = " AND ".join(f"get({words}, i + {k}) = '{p}'" for k, p in enumerate(parts))
    return f"CASE WHEN {has_all} THEN filter(sequence(0, size({words}) - 1), i -> {here}) ELSE array() END"


def license_spans(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Candidate spans by votes: document key, template, first and last word, number of k-gram votes.

    All k-grams of all documents meet the template positions in one broadcast join (templates are bounded).
    Votes are summed by diagonal (position in the document minus position in the template) on the map side, and
    neighbouring diagonals are merged. What is grouped is bounded by one document's hits in one template.
    """
    grams = (
        with_grams(templates, "words", "_g")
        .select("template", F.posexplode("_g").alias("_tpos", "_gram"))
    )
    hits = (
        with_grams(docs.select("_id", "_hash", "_words"), "_words", "_g")
        # The outer form, as the plain one adds a filter on the array's size and works the array out once more.
        .select("_id", "_hash", F.posexplode_outer("_g").alias("_pos", "_gram"))
        .join(F.broadcast(grams), "_gram")
    )
    diagonal = F.col("_pos") - F.col("_tpos")
    votes = hits.groupBy("_id", "_hash", "template", diagonal.alias("_diagonal")).agg(
        F.count("*").alias("_votes"),
        F.min("_pos").alias("_first"),
        F.max("_pos").alias("_last"),
    )
    along = W.partitionBy("_id", "_hash", "template").orderBy("_diagonal")
    new = F.coalesce(F.col("_diagonal") - F.lag("_diagonal").over(along) > SLACK, F.lit(True))
    return (
        votes.withColumn("_new", new.cast("int"))
        .withColumn("_span", F.sum("_new").over(along))
        .groupBy("_id", "_hash", "template", "_span")
        .agg(
            F.sum("_votes").alias("votes"),
            F.min("_first").alias("first"),
            (F.max("_last") + GRAM - 1).alias("last"),
        )
        .drop("_span")
    )


def license_scan(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    text: str = "text",
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row per row of `docs`: n_words, places of the phrases, labels, score and the verified spans.

    A span from the votes is verified against the document's own words: it gives its label if it holds at least
    `min_share` of the template's distinct words. `score` is the best share found, 1.0 for a phrase.
    Null text is an empty one: no words, no labels, score 0.0. Repeated rows get the same result each; ids may be
    null or repeated (a row is known by its id and a hash of its text). Other columns of `docs` are left out.
    """
    spark = docs.sparkSession
    known = template_words(spark, templates)
    keyed = docs.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"),
        words_of(F.coalesce(text, F.lit(""))).alias("_words"),
    )
    spans = (
        license_spans(keyed, known)
        .join(F.broadcast(known), "template")
        .groupBy(F.struct("_id", "_hash").alias("_key"))
        .agg(F.collect_set(F.struct("label", "first", "last", "votes", "words")).alias("_spans"))
    )
    found = lookup_join(
        keyed.withColumn("_key", F.struct("_id", "_hash")), spans, ["_key"], "left", stage=True
    )
    for n, phrase in enumerate(phrases):
        found = found.withColumn(f"_starts{n}", F.expr(_phrase_starts("_words", phrase)))
    starts = F.concat(*[F.col(f"_starts{n}") for n in range(len(phrases))])
    base = F.array_compact(
        F.array(*[F.when(F.size(f"_starts{n}") > 0, F.lit(label)) for n, label in enumerate(phrases.values())])
    )
    share = (
        "transform(_spans, s -> struct(s.label AS label, s.first AS first, s.last AS last, s.votes AS votes, "
        "size(array_intersect(slice(_words, s.first + 1, s.last - s.first + 1), s.words)) "
        "/ size(array_distinct(s.words)) AS share))"
    )
    verified = F.expr(f"sort_array(filter({share}, s -> s.share >= {min_share}))")
    empty = F.array().cast("array<struct<label:string,first:int,last:int,votes:bigint,share:double>>")
    return (
        found.withColumn("_starts", starts)
        .withColumn("_base", F.sort_array(F.array_distinct(base)))
        .withColumn("spans", F.coalesce(F.when(F.col("_spans").isNotNull(), verified), empty))
        .select(
            F.col("_id").alias("doc_id"),
            F.size("_words").cast("bigint").alias("n_words"),
            F.size("_starts").cast("bigint").alias("n_base"),
            F.array_min("_starts").cast("bigint").alias("first_word"),
            F.array_max("_starts").cast("bigint").alias("last_word"),
            F.concat_ws(",", "_base").alias("base_labels"),
            F.concat_ws(
                ",", F.sort_array(F.array_distinct(F.concat("_base", F.col("spans.label"))))
            ).alias("labels"),
            F.when(F.size("_base") > 0, F.lit(1.0))
            .otherwise(F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0)))
            .alias("score"),
            "spans",
        )
    )
