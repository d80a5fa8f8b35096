"""License scan: TF-IDF cosine to templates, then inheritance from the nearest directory.

A file's evidence is every line of its text that names a licence (a header), and,
for licence files (LICENSE, COPYING, ...), the whole text too. Evidence and
templates are sparse TF-IDF vectors; document frequencies of the templates'
terms are counted over all files, and terms outside all templates weigh as terms
no file has, so they only lengthen a vector. The best template of at least
``threshold`` cosine is the file's own licence.

A directory has the licence of the best licence file in it. A file without a
licence of its own inherits from the nearest directory above it that has one:
distinct directories are joined with their ancestors, not files with files.

DataFrame functions only. The template table is part of the code, so its
broadcast is bounded by it.

Defined results: null or empty texts have no licence of their own; files without
a path inherit nothing; of equal scores the smaller licence id counts, of equal
licence files in a directory the smaller path; rows that repeat a file are
scanned each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence id and wording, one row a template.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under the CC0 1.0 Universal Public Domain Dedication license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: A term: letters and digits, joined by single dots or hyphens.
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: A line that names a licence.
NAMES = r"licen[cs]e|licensing|copyright|permission|permitted|redistribut|creative commons|public domain|spdx"
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _weights(files: DataFrame, templates: DataFrame, vocabulary: list[str]) -> tuple[DataFrame, Column]:
    """(term, idf) of template terms from all files, and the idf of other terms."""
    n = files.count()
    has = files.where("text is not null").select(F.explode(F.array_intersect(terms(F.col("text")), F.array(*[F.lit(t) for t in vocabulary]))).alias("term"))
    df = has.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(n)) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    words = templates.select("term").distinct()
    return words.join(df, "term", "left").select("term", idf.alias("idf")), F.log(F.lit(float(n)) + 1) + 1


def own_licences(files: DataFrame, threshold: float = 0.6, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """file_id, licence and score of the files with a licence of their own."""
    spark = files.sparkSession
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, licence string, wording string")
    of = table.select("template", "licence", F.explode(terms(F.col("wording"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    vocabulary = sorted(r.term for r in of.select("term").distinct().collect())  # terms of TEMPLATES
    idf, other = _weights(files, of, vocabulary)
    weighted = of.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_norm"))
    weighted = weighted.join(norms, "template").select("template", "licence", "term", "idf", "w", "template_norm")

    rows = files.where(F.lower("text").rlike(NAMES)).select("file_id", "path", "text")
    lines = rows.select("file_id", F.posexplode(F.split("text", "\n")).alias("line", "words")).where(F.lower("words").rlike(NAMES))
    whole = rows.where(F.col("path").rlike(LICENCE_FILE)).select("file_id", F.lit(-1).alias("line"), F.col("text").alias("words"))
    units = lines.unionByName(whole).select("file_id", "line", terms(F.col("words")).alias("t"))
    units = units.select("file_id", "line", F.explode("t").alias("term")).groupBy("file_id", "line", "term").agg(F.count("*").alias("tf"))
    # the idf table has as many rows as TEMPLATES has terms
    units = units.join(F.broadcast(idf.select("term", "idf")), "term", "left").withColumn("u", F.col("tf") * F.coalesce("idf", other)).drop("idf")
    norm = units.groupBy("file_id", "line").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
    dots = units.join(F.broadcast(weighted.drop("idf")), "term").groupBy("file_id", "line", "template", "licence", "template_norm").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    scored = dots.join(norm, ["file_id", "line"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6)).where(F.col("score") >= threshold)
    best = scored.groupBy("file_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("file_id", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, threshold: float = 0.6) -> DataFrame:
    """file_id, path, licence, score, origin (header, file, inherited, none) and from_dir of every file.

    ``files`` has file_id, path and text.
    """
    own = own_licences(files, threshold)
    rows = files.select("file_id", "path", directory(F.col("path")).alias("dir"))
    named = rows.where(F.col("path").rlike(LICENCE_FILE)).join(own, "file_id")
    of_dir = named.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("b")).select(F.col("dir").alias("above"), F.col("b.licence").alias("dir_licence"))

    dirs = rows.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    chain = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).withColumn("above", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(F.split("dir", "/"), 1, F.greatest(F.col("depth"), F.lit(1))), "/")))
    nearest = chain.join(of_dir, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_licence")).alias("b")).select("dir", F.col("b.above").alias("from_dir"), "b.dir_licence")

    out = rows.join(own, "file_id", "left").join(nearest, "dir", "left")
    has = F.col("licence").isNotNull()
    is_file = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    inherits = ~has & F.col("dir_licence").isNotNull()
    return out.select(
        "file_id",
        "path",
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(has & is_file, "file").when(has, "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("from_dir")).alias("from_dir"),
    )
