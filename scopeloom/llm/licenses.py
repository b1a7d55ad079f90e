"""License scan by diagonal voting, in DataFrame operations only.

Every rolling k-gram of a text's words is hashed and joined with the k-grams of the license templates
(a broadcast of a fixed rule table). A hit at word p of the text and word q of a template votes for the
diagonal p - q. Votes are summed by diagonal; diagonals that neighbour each other, as an inserted or
dropped word shifts them, are merged into spans, which are verified by the share of the template's
k-grams that they cover. A template that is covered wholly on one diagonal stands there word for word.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeloom.llm.common import stored

#: Words of a k-gram, how far apart neighbouring diagonals are, and the share that verifies a span.
K, SHIFT, VERIFIED = 3, 3, 0.7
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases with their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Opening passages of well-known license notices.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under the creative commons attribution noncommercial license", "cc-by-nc"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
)


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") for x in parts))


def templates(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """One row per template k-gram: template, label, base, n_grams, q, h. Templates need K words or more."""
    rows = []
    for t, (phrase, label) in enumerate([*base, *notices]):
        found = re.findall(r"[0-9a-z]+", phrase.lower())
        if len(found) < K:
            raise ValueError(f"a template needs {K} words: {phrase!r}")
        rows += [(t, label, t < len(base), len(found) - K + 1, q, *found[q : q + K]) for q in range(len(found) - K + 1)]
    df = spark.createDataFrame(rows, f"template int, label string, base boolean, n_grams int, q int, {', '.join(f'w{i} string' for i in range(K))}")
    return df.select("template", "label", "base", "n_grams", "q", _hash(*(F.col(f"w{i}") for i in range(K))).alias("h"))


def license_votes(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k-gram hits (row, template, label, base, n_grams, q, p) by row of ``docs``, and a row with template null that holds n_words.

    The words of a text are exploded once, with a closing row for the count of words; that row meets the
    template table's own closing row, so that a document without hits keeps a row and no second pass or
    text shuffle is needed.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))
    lists = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    shifted = [F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{i}") for i in range(K)]
    zipped = F.arrays_zip(*[F.concat(x, F.array(F.lit(None).cast("string"))).alias(f"w{i}") for i, x in enumerate(shifted)])
    rolled = lists.select("id", "row", F.size("words").cast("long").alias("n_words"), F.posexplode(zipped).alias("p", "g"))
    # the last of the zipped rows, at p = n_words, is the closing one; ends shorter than K words hash nothing
    full = F.col(f"g.w{K - 1}").isNotNull()
    h = F.when(F.col("p") == F.col("n_words"), F.lit(None).cast("long")).when(full, _hash(*(F.col(f"g.w{i}") for i in range(K))))
    closing = F.col("p") == F.col("n_words")
    keyed = rolled.select("id", "row", "n_words", F.col("p").cast("long").alias("p"), F.coalesce(h, F.lit(0).cast("long")).alias("h"), F.when(closing, F.lit(2)).when(full, F.lit(1)).otherwise(F.lit(0)).alias("kind"))
    spark = docs.sparkSession
    end = spark.range(1).select(*(F.lit(None).cast(t).alias(n) for n, t in grams.dtypes if n != "h"), F.lit(0).cast("long").alias("h"), F.lit(2).alias("kind"))
    table = grams.withColumn("kind", F.lit(1)).unionByName(end)
    return keyed.join(F.broadcast(table), ["h", "kind"]).select("id", "row", "n_words", "template", "label", "base", "n_grams", "q", "p")


def license_spans(votes: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Votes by diagonal, neighbouring diagonals of a template merged: row, template, label, base, n_grams, exact, first, last, share.

    ``exact`` counts a merged span's diagonals that hold all k-grams of the template; ``share`` is the
    part of the template's k-grams that the span covers.
    """
    hits = votes.where(F.col("template").isNotNull())
    keys = ["row", "template", "label", "base", "n_grams"]
    diagonals = hits.groupBy(*keys, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("qs"), F.min("p").alias("first"), F.max("p").alias("last"))
    order = W.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > shift).cast("int"), F.lit(1))
    numbered = diagonals.withColumn("new", new).withColumn("span", F.sum("new").over(order))
    whole = F.size("qs") == F.col("n_grams")
    return numbered.groupBy(*keys, "span").agg(
        F.sum(whole.cast("long")).alias("exact"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_exact"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_exact"),
        F.min("first").alias("first"),
        (F.max("last") + K - 1).alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("qs")))) / F.first("n_grams")).alias("share"),
    )


def scan_licenses(docs: DataFrame, base=BASE, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text", verified: float = VERIFIED) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of base phrases, ``labels`` also holds templates with a span that covers
    ``verified`` of their k-grams, ``score`` is the best span's share. Null and empty texts have no words.
    Rows that repeat an id, or have none, are reported each with the hits of its own text. Other columns are ignored.
    The hits are few and are written once, with the number of the row that each belongs to.
    """
    seen = stored(license_votes(docs, templates(docs.sparkSession, base, notices), id_col, text_col))
    spans = license_spans(seen)
    kept = spans.where((F.col("exact") > 0) | (~F.col("base") & (F.col("share") >= verified)))
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    exact_base = F.col("base") & (F.col("exact") > 0)
    found = kept.groupBy("row").agg(
        F.sum(F.when(F.col("base"), F.col("exact"))).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_exact"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("last_exact"))).alias("last_word"),
        labels(exact_base).alias("base_labels"),
        labels(F.lit(True)).alias("labels"),
        F.max("share").alias("score"),
    )
    ends = seen.where(F.col("template").isNull()).select("id", "row", "n_words")
    joined = ends.join(found, "row", "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))).alias("score"),
    )
