"""License texts found by diagonal voting.

Every pair of neighbouring words of a text is joined to the places in the templates that
hold the same two words. A hit votes for its diagonal, the start the template would have
in the text; a template quoted with words put in or left out leaves its votes on
neighbouring diagonals, which are merged in bands as wide as the words that may be missing or added,
each overlapping the next by half, so a band is bounded and no quotation falls between two.
A band with enough votes is verified: its longest chain of hits that ascend in the template
and in the text alike, which are word-for-word matches as hits carry the words themselves, has to hold
the share of the template. A full diagonal is a word-for-word quotation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The phrases whose places are reported, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Clauses of license texts, found where at least ``SHARE`` of their word pairs follow one another.
TEXTS = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-notice": "unless required by applicable law or agreed to in writing software distributed under the license "
    "is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-header": "licensed under the apache license version 2 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to "
    "the warranties of merchantability fitness for a particular purpose and noninfringement",
    "cc-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
}

SHARE = 0.7
#: Words put in or left out that any template may have; longer ones may have the share of words that may be missing.
SLACK = 3

# Fixed value: what stands between words, after A-Z are lower-cased.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() also changes letters beyond A-Z, of which these two become A-Z in part.
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    lowered = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def template_pairs(spark: SparkSession, phrases: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """One row per word pair of each template: its hash and place, and what the template is."""
    templates = [(True, label, wording) for wording, label in phrases.items()]
    templates += [(False, label, wording) for label, wording in texts.items()]
    # The empty pair stands for the text itself, so texts without a hit keep a row.
    rows = [("", "", None, None, None, 1, 0)]
    for number, (exact, label, wording) in enumerate(templates):
        own = re.sub("[^0-9a-z\x80-\U0010ffff]+", " ", wording.lower()).split()
        if len(own) < 2:
            raise ValueError(f"a template needs two words: {wording}")
        rows += [(a, b, number, label, exact, len(own) - 1, i) for i, (a, b) in enumerate(zip(own, own[1:]))]
    ddl = "a string, b string, template int, label string, exact boolean, pairs int, at int"
    return spark.createDataFrame(rows, ddl).select(
        F.xxhash64("a", "b").alias("hash"), F.concat_ws(" ", "a", "b").alias("wording"), "template", "label", "exact", "pairs", "at"
    )


def votes(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, template and diagonal with hits: how many, and which word pairs of the template.

    A row with a null template stands for each document.
    """
    split = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), words(F.col(text)).alias("words")
    ).withColumn("n_words", F.size("words").cast("bigint"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.col("n_words").cast("int")).alias("b"))
    none = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b")))
    rolling = split.select("row", "doc", "n_words", F.posexplode(F.concat(none, pairs)).alias("place", "two"))
    rolling = rolling.withColumn("said", F.concat_ws(" ", "two.a", "two.b")).withColumn("key", F.xxhash64("two.a", "two.b"))
    # Equal hashes count only with equal words.
    same = (F.col("key") == F.col("hash")) & F.startswith("said", "wording") & F.startswith("wording", "said")
    hit = rolling.join(F.broadcast(templates), same)
    diagonal = (F.col("place") - 1 - F.col("at")).alias("diagonal")
    return hit.groupBy("row", "doc", "n_words", "template", "label", "exact", "pairs", diagonal).agg(
        F.count("*").alias("votes"), F.collect_set("at").alias("places")
    )


def _width(share: float, slack: int) -> Column:
    """How many diagonals half a band has: a quotation with that many words less or more stays in one band."""
    return F.greatest(F.lit(slack), F.floor(F.lit(1 - share) * F.col("pairs")).cast("int")) + 1


def longest_chain(hits: Column) -> Column:
    """How many of the hits ``(at, place)``, sorted, can follow one another in template and text.

    A band has at most its width times the template's length of them.
    """
    kind = "array<struct<at:int,place:bigint,n:int>>"

    def longer(chains: Column, hit: Column) -> Column:
        before = F.filter(chains, lambda c: (c["at"] < hit["at"]) & (c["place"] < hit["place"]))
        n = F.coalesce(F.array_max(F.transform(before, lambda c: c["n"])), F.lit(0)) + 1
        return F.concat(chains, F.array(F.struct(hit["at"].alias("at"), hit["place"].alias("place"), n.alias("n"))))

    return F.aggregate(hits, F.array().cast(kind), longer, lambda chains: F.coalesce(F.array_max(F.transform(chains, lambda c: c["n"])), F.lit(0)))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
    texts: dict[str, str] | None = None, share: float = SHARE, slack: int = SLACK,
) -> DataFrame:
    """``(key, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row of ``docs``.

    ``n_base`` counts the places of phrases, overlapping ones too; ``first_word`` and
    ``last_word`` are null without any. ``score`` is 1 with such a place, else the largest verified share of any
    wording if that is at least ``share``, else 0. Null and empty texts have no words; repeated rows stay apart.
    """
    templates = template_pairs(docs.sparkSession, PHRASES if phrases is None else phrases, TEXTS if texts is None else texts)
    found = votes(docs, templates, key, text)
    wording = ~F.coalesce("exact", F.lit(True))
    cell = F.floor(F.col("diagonal") / _width(share, slack)).cast("bigint")
    bands = F.when(wording, F.array(cell - 1, cell)).otherwise(F.array(F.col("diagonal")))
    full = F.col("exact") & (F.col("votes") == F.col("pairs"))
    banded = (
        found.withColumn("band", F.explode(bands))
        .groupBy("row", "doc", "n_words", "template", "label", "exact", "pairs", "band")
        .agg(
            F.count_if(full).alias("n_base"),
            F.min(F.when(full, F.col("diagonal"))).alias("first_word"),
            F.sum("votes").alias("votes"),
            F.collect_list(F.when(wording, F.struct("diagonal", "places"))).alias("hits"),
        )
    )
    hits = F.flatten(F.transform("hits", lambda d: F.transform(d["places"], lambda at: F.struct(at.alias("at"), (d["diagonal"] + at).alias("place")))))
    enough = wording & (F.col("votes") >= share * F.col("pairs"))
    verified = F.when(enough, longest_chain(F.array_sort(hits)) / F.col("pairs"))
    merged = banded.withColumn("share", verified).withColumn("share", F.when(F.col("share") >= share, F.col("share")))
    base = F.when(F.col("n_base") > 0, F.col("label"))
    own = F.when(F.col("share").isNotNull(), F.col("label"))
    labels = lambda *of: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*(F.collect_set(o) for o in of))))), ",")
    return merged.groupBy("row", "doc", "n_words").agg(
        F.sum("n_base").alias("n_base"),
        F.min("first_word").cast("bigint").alias("first_word"),
        F.max("first_word").cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"), labels(base, own).alias("labels"),
        F.greatest(F.max(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)), F.coalesce(F.max("share"), F.lit(0.0))).alias("score"),
    ).select(F.col("doc").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
