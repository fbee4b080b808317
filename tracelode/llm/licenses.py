"""License scan by diagonal voting, in DataFrame functions only.

Every word k-gram of every text (rolling, k = 2 and 3) is hashed and joined with the places of the templates' k-grams.
A joined pair of places votes for the diagonal (place in the text - place in the template); votes are summed by
diagonal, neighbouring diagonals (at most SLACK words inserted or left out between them) are merged to one span, and a
span stands if it holds enough different k-grams of its template within about the template's length. The k-grams'
words are compared as well as their hashes, so no vote rests on a collision.

Base phrases are templates of one k-gram, so each of their places is one vote on one diagonal; they always stand.
A text is opened into its words within the scan, and only votes (and one row per document) are shuffled: the templates
are a broadcast table of some hundred rows, fixed with the code. What one document votes meets in one task, as its
text has.

Cases: a null or empty text, or one without words, has n_words 0, empty labels and score 0; rows with the same doc_id
are scanned on their own; repeated and overlapping places all count; other columns aren't read.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that may be inserted or missing between two diagonals of a span.
SLACK = 4
#: Templates of fewer words than WHOLE must be there whole, of others this share of the k-grams.
WHOLE, SHARE = 12, 0.6
#: Base phrases and their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Notices that public licenses state, as words, and their labels.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]


def values(notices: list[tuple[str, str]]) -> str:
    """The templates as SQL: id, label, words, base."""
    every = [(label, text, True) for label, text in BASE] + [(label, text, False) for label, text in notices]
    return ", ".join(f"({i}, '{label}', '{text}', {str(base).lower()})" for i, (label, text, base) in enumerate(every))


def grams(words: str) -> list:
    """The words and the two behind each, as one array of structs a, b, c (null beyond the end)."""
    n = F.size(words)
    return F.arrays_zip(F.col(words).alias("a"), F.slice(words, F.lit(2), n).alias("b"), F.slice(words, F.lit(3), n).alias("c"))


def templates(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    """A row per k-gram of each template: hash, its words a, b, c (null for k = 2), template, label, base, at (place),
    grams and length of the template, and least, the k-grams a span needs."""
    rows = spark.sql(f"select * from values {values(notices)} as t(template, label, text, base)").withColumn("__w", F.split("text", " "))
    length = F.size("__w")
    k = F.least(length, F.lit(3))
    count = length - k + 1
    opened = rows.select("template", "label", "base", length.alias("length"), k.alias("k"), count.alias("grams"), F.posexplode(grams("__w")).alias("at", "__g")).where("at < grams")
    c = F.when(F.col("k") == 3, F.col("__g.c"))
    least = F.when(F.col("length") < WHOLE, F.col("grams")).otherwise(F.ceil(F.col("grams") * SHARE))
    return opened.select("template", "label", "base", "length", "grams", "at", least.alias("least"), F.col("__g.a").alias("ta"), F.col("__g.b").alias("tb"), c.alias("tc"), F.xxhash64("k", "__g.a", "__g.b", c).alias("hash"))


def votes(docs: DataFrame, notices: list[tuple[str, str]]) -> DataFrame:
    """Per row of docs (__row), template and diagonal: seen (places in the template), first and last word; and for each
    row of docs at least one row, of no template where nothing is found at its beginning."""
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("__row"), F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0)).alias("__w"))
    opened = words.select("doc_id", "__row", F.size("__w").cast("long").alias("n_words"), F.posexplode_outer(grams("__w")).alias("__at", "__g"))
    flat = opened.select("doc_id", "__row", "n_words", F.coalesce("__at", F.lit(0)).alias("__at"), F.col("__g.a").alias("a"), F.col("__g.b").alias("b"), F.col("__g.c").alias("c"))
    hashed = flat.withColumn("hash", F.explode(F.array(F.xxhash64(F.lit(2), "a", "b"), F.xxhash64(F.lit(3), "a", "b", "c"))))
    joined = hashed.join(F.broadcast(templates(docs.sparkSession, notices)), "hash", "left")
    same = F.coalesce((F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & (F.col("tc").isNull() | (F.col("c") == F.col("tc"))), F.lit(False))
    kept = joined.where(same | (F.col("__at") == 0)).select("doc_id", "__row", "n_words", "__at", *[F.when(same, F.col(c)).alias(c) for c in ["template", "label", "base", "length", "grams", "least", "at"]])
    keys = ["__row", "doc_id", "n_words", "template", "label", "base", "length", "grams", "least", (F.col("__at") - F.col("at")).alias("diagonal")]
    return kept.groupBy(*keys).agg(F.collect_set("at").alias("seen"), F.min("__at").alias("first"), F.max("__at").alias("last"))


def spans(voted: DataFrame) -> DataFrame:
    """Neighbouring diagonals merged: per span its k-grams' share of the template, and whether it stands."""
    order = Window.partitionBy("__row", "template").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(0))
    begins = (F.col("base") | (gap > SLACK)).cast("int")
    numbered = voted.withColumn("__begins", begins).withColumn("__span", F.sum("__begins").over(order))
    keys = ["__row", "doc_id", "n_words", "template", "label", "base", "length", "grams", "least", "__span"]
    merged = numbered.groupBy(*keys).agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("found"), F.min("first").alias("first"), F.max("last").alias("last"))
    fits = F.col("last") - F.col("first") <= F.col("length") * 1.5 + SLACK
    return merged.withColumn("stands", F.coalesce(F.col("base") | ((F.col("found") >= F.col("least")) & fits), F.lit(False))).withColumn("share", F.col("found") / F.col("grams"))


def scanned(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score: the largest share of a notice that
    stands, and 0.5 at least with a base phrase."""
    base = F.coalesce(F.col("base"), F.lit(False))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    score = F.greatest(F.coalesce(F.max(F.when(F.col("stands") & ~base, F.col("share"))), F.lit(0.0)), F.max(F.when(base, 0.5).otherwise(0.0)))
    out = spans(votes(docs, notices)).groupBy("__row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("stands")).alias("labels"), score.alias("score"),
    )
    return out.drop("__row")
