"""License scans, in DataFrame functions alone.

Texts become words (ASCII letters and digits, in lower case, and all non-ASCII
characters). Windows of ``WINDOW`` words, each ``STEP`` words after the one
before, overlap so that every shingle lies whole in one of them. A window's
minhash under each of ``BANDS`` functions is a band of one row; it retrieves the
templates that have a window with the same value. The weakest case, a window
that shares one of its two shingles with a one-shingle template, collides in a
band with probability 1/2 or more, so in one of them with 1 - 2 ** -BANDS, 0.9999.
Retrieved pairs are verified exactly: the share of the template's distinct
shingles that the whole text contains must reach ``CONTAINMENT``.

Null and empty texts and texts shorter than a shingle hold no license; shorter
templates are refused. Rows of one id are scanned as one document, rows without an
id as another one. Templates of one name are alternatives: the best one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW = 6
STEP = 2
BANDS = 14
CONTAINMENT = 0.8
BROADCAST_TEMPLATES = 10_000  # words of all templates; beyond it joins shuffle

# Notices as their licenses ask to put them into a work.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may "
                   "not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
            "this software and associated documentation files (the \"Software\"), to deal in "
            "the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later "
                "version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 "
                  "International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are "
                     "met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."),
)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)],
                                 "template int, license string, text string")


def word_array(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                        "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is computed once a row, however often it is used afterwards."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_shingles(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Add ``shingles``: the hash of every run of words of ``text``, in order."""
    hashed = _once(texts, F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)), "words")
    run = F.transform(F.sequence(F.lit(1), F.size("words") - (size - 1)), lambda i: F.xxhash64(
        *[F.element_at("words", i + k) for k in range(size)]))
    long_enough = hashed.where(F.size("words") >= size)
    return _once(long_enough, run, "shingles").drop("words", "text")


def with_bands(shingled: DataFrame, step: int) -> DataFrame:
    """A row per window of two shingles, ``step`` apart, and band: its minhash as ``value``.

    Values are seeded by their band, so those of different bands do not meet.
    """
    n = F.size("shingles")
    windows = F.transform(F.sequence(F.lit(1), n, F.lit(step)), lambda i: F.struct(
        F.element_at("shingles", i).alias("one"),
        F.element_at("shingles", F.least(i + 1, n)).alias("two")))
    rows = shingled.select("*", F.explode(windows).alias("w")).drop("shingles")
    return rows.select("*", F.explode(F.array(*[
        F.least(F.xxhash64("w.one", F.lit(b)), F.xxhash64("w.two", F.lit(b)))
        for b in range(BANDS)])).alias("value")).drop("w")


def license_matches(docs: DataFrame, templates: DataFrame,
                    containment: float = CONTAINMENT) -> DataFrame:
    """Per document and license found: doc_id, license, containment."""
    own = with_shingles(templates)
    parts = own.select("template", "license", F.explode("shingles").alias("shingle")).distinct()
    sizes = parts.groupBy("template", "license").agg(F.count(F.lit(1)).alias("size"))
    # A copy may lie at any step of a text's windows, so those of templates begin everywhere,
    # and their first and last shingles also stand alone, as where a copy begins or ends.
    alone = own.select("template", F.explode("shingles").alias("s")).select(
        "template", F.array("s").alias("shingles"))
    bands = with_bands(own.select("template", "shingles").union(alone), 1).distinct()
    small = (templates.agg(F.sum(F.size(word_array(F.col("text")))).alias("n")).first()["n"]
             or 0) <= BROADCAST_TEMPLATES
    side = F.broadcast if small else (lambda df: df)
    shingled = with_shingles(docs.select("doc_id", "text"))
    retrieved = (with_bands(shingled, STEP).join(side(bands), "value")
                 .select("doc_id", "template").distinct())
    found = (shingled.select("doc_id", F.explode("shingles").alias("shingle"))
             .join(side(parts.select("template", "shingle")), "shingle")
             .select("doc_id", "template", "shingle").distinct())
    found, retrieved = found.alias("found"), retrieved.alias("retrieved")
    same = (F.col("found.doc_id").eqNullSafe(F.col("retrieved.doc_id"))
            & (F.col("found.template") == F.col("retrieved.template")))
    return (found.join(retrieved, same, "left_semi")
            .groupBy("doc_id", "template").agg(F.count(F.lit(1)).alias("shared"))
            .join(side(sizes), "template")
            .groupBy("doc_id", "license")
            .agg(F.max(F.col("shared") / F.col("size")).alias("containment"))
            .where(F.col("containment") >= containment))
