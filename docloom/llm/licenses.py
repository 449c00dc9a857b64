"""License notices in documents, found by votes of equal word runs for offset diagonals.

Every run of ``k`` words of every document is hashed and joined with the places where known
notices (templates) have it.  Runs that agree lie on one diagonal (place in the document minus
place in the template); votes are summed by diagonal, diagonals a few words apart are merged,
as an added or dropped word shifts the rest, and a merged span is verified: its words must cover
enough of the template and of the span itself.  Runs count only when their words are equal, not
just their hashes.

All of it is DataFrame operations.  The text is read once; only matches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Scratch

#: Phrase and label of the base.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Openings of public notices, as words.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    bare = F.btrim(F.translate(text, _UPPER, _LOWER), F.lit(_APART))
    return F.when(F.coalesce(bare, F.lit("")) != "", F.split(bare, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).otherwise(F.array().cast("array<string>"))


def places(template_rows: DataFrame, k: int) -> DataFrame:
    """One row for each hash of k words: (gram, at), ``at`` the places (template, place, words) that have it."""
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.struct(i.alias("place"), F.slice("w", i + 1, F.lit(k)).alias("run")))
    rows = template_rows.where(F.size("w") >= k).select("template", F.explode(runs).alias("r")).select("template", "r.*")
    return rows.groupBy(F.xxhash64(*[F.get("run", F.lit(j)) for j in range(k)]).alias("gram")).agg(F.collect_list(F.struct("template", "place", "run")).alias("at"))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, label, w, length) of given notices."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    return rows.select("template", "label", words(F.col("text")).alias("w")).withColumn("length", F.size("w"))


def hits(docs: DataFrame, known: DataFrame, scratch: Scratch, k: int, id_col: str, text_col: str) -> DataFrame:
    """Written rows (row, id, n_words, pos, base, at): each base phrase or run of a template, and a last row for each document.

    ``row`` numbers the rows of ``docs`` within this one pass, so rows of equal ids stay apart.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), words(F.col(f"`{text_col}`")).alias("w"))
    each = source.select("row", "id", "w", F.size("w").alias("n_words"), F.posexplode(F.array_append("w", F.lit(None).cast("string"))).alias("pos", "word"))
    following = lambda j: F.get("w", F.col("pos") + j)
    base = None
    for phrase, label in BASE:
        first, *rest = phrase.split(" ")
        fits = F.col("word") == first
        for j, x in enumerate(rest, 1):
            fits = fits & (following(j) == x)
        base = F.when(fits, label) if base is None else base.when(fits, label)
    run = [F.col("word"), *[following(j) for j in range(1, k)]]
    gram = F.when(F.col("pos") <= F.col("n_words") - k, F.xxhash64(*run))
    rows = each.select("row", "id", "n_words", "pos", base.alias("base"), gram.alias("gram"), *[x.alias(f"x{j}") for j, x in enumerate(run)])
    joined = rows.join(F.broadcast(known), "gram", "left").where("at is not null or base is not null or pos = n_words")
    same = F.transform(F.filter("at", lambda a: a["run"] == F.array(*[F.col(f"x{j}") for j in range(k)])), lambda a: F.struct(a["template"].alias("template"), a["place"].alias("place")))
    return scratch.table(joined.select("row", "id", "n_words", "pos", "base", same.alias("at")), "hits")


def spans(found: DataFrame, template_rows: DataFrame, k: int, slack: int, least: float) -> DataFrame:
    """(row, template, label, first, last, votes, score): verified spans of words ``first`` to ``last``.

    A diagonal's votes are the template's places that agree on it.  Diagonals at most ``slack``
    words apart, with spans that lie within a template's length of each other, are one.  Of the
    template's words at least the share ``least`` must be covered, and of the span's too.
    """
    size = F.broadcast(template_rows.select("template", "label", "length"))
    votes = found.where(F.size("at") > 0).select("row", "pos", F.explode("at").alias("a")).select("row", "pos", "a.*")
    key = ["row", "template"]
    diagonals = votes.groupBy(*key, (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(order) <= slack) & (F.col("first") - F.lag("last").over(order) <= F.col("length")) & (F.lag("first").over(order) - F.col("last") <= F.col("length"))
    merged = diagonals.join(size, "template").withColumn("new", F.when(near, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*key, "label", "length", "island").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list(F.transform("places", lambda p: p + F.col("diagonal")))).alias("at"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"))
    covered = lambda c: F.size(F.array_distinct(F.flatten(F.transform(c, lambda p: F.sequence(p, p + k - 1)))))
    scored = merged.withColumn("score", covered("places") / F.col("length")).withColumn("dense", covered("at") / (F.col("last") - F.col("first") + 1))
    return scored.where((F.col("score") >= least) & (F.col("dense") >= least)).select(*key, "label", "first", "last", F.size(F.array_distinct("places")).alias("votes"), "score")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, k: int = 3, slack: int = 3, least: float = 0.7) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts all places of base phrases; ``first_word`` and ``last_word`` are where the
    first and the last begin, from 0.  ``labels`` adds those of verified spans, and ``spans`` lists
    these (label, first word, last word, score).  ``score`` is 1 with a base phrase, else the
    largest share of a template that a span covers, else 0.

    Null and empty texts have no words and no labels.  Rows that repeat an id keep a row each,
    null ids too.  ``templates`` is a short list of (label, text), which is broadcast; those of
    fewer than k words match nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    template_rows = scratch.table(template_table(spark, templates), "templates")
    found = hits(docs, places(template_rows, k), scratch, k, id_col, text_col)
    whole = scratch.table(spans(found, template_rows, k, slack, least), "spans")
    none = F.lit(None)
    base = found.groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.count("base").alias("n_base"), F.min(F.when(F.col("base").isNotNull(), F.col("pos"))).alias("first_word"),
        F.max(F.when(F.col("base").isNotNull(), F.col("pos"))).alias("last_word"), F.collect_set("base").alias("base_labels"),
    )
    own = whole.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("first", "last", "label", "score"))).alias("spans"))
    out = base.join(own, "row", "left")
    labels = F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        joined(F.col("base_labels")).alias("base_labels"), joined(labels).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("spans", none).alias("spans"),
    )
