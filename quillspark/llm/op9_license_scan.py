"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Units are the lines of every file and, for a licence file, its whole text. A unit's vector has tf x idf for each of its
words; idf comes from document frequencies counted over all files for the words of the templates, and words of
no template weigh like words of no file (they only lengthen the unit's vector). A template's cosine is a sparse join:
the unit's words that are in the template, weighted and summed. Units are found by a prefix filter that loses nothing:
a unit without any of a template's heaviest words, those whose absence leaves less than ``threshold`` of its norm,
can't reach the threshold.

A file's own licence is its best unit's. A licence file is one named like one (LICENSE, COPYING, NOTICE), or one whose
whole text reaches ``whole_threshold``. A file without a licence of its own takes that of the licence file in the nearest
directory above it: each file's directories are joined with those that have one, and the deepest wins.

Cases: null paths have no directories and inherit nothing; null and empty texts have no unit. Ties: the greater cosine, then the
licence's name; in a directory with several licence files the best cosine, then name. Repeated rows repeat
in the result. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Tables, join_small

#: Names of licences (SPDX) and short standard wordings that announce them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice)([.-][^/]*)?$"
SPLIT = "[^\\p{L}\\p{N}]+"


def _words(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), SPLIT, -1), "")


def _template_words(templates: list[tuple[str, str]]) -> list[tuple[str, dict[str, int]]]:
    import re

    out = []
    for name, text in templates:
        tf: dict[str, int] = {}
        for w in re.findall(r"[^\W_]+", text.lower()):
            tf[w] = tf.get(w, 0) + 1
        out.append((name, tf))
    return out


def needed(vector: dict[str, float], threshold: float) -> set[str]:
    """The heaviest words of a unit vector: a text without them has a cosine under the threshold."""
    left, out = 1.0, set()
    for w, x in sorted(vector.items(), key=lambda kv: (-kv[1], kv[0])):
        if left < threshold * threshold:
            break
        out.add(w)
        left -= x * x
    return out


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.7, whole_threshold: float = 0.8) -> DataFrame:
    """``files``: file_id, path, text. Returns file_id, path, licence, how (own, inherited or null), cosine (of the unit
    that decided), origin (directory it was inherited from)."""
    spark = files.sparkSession
    tables = Tables(spark, "licence")
    words = _template_words(TEMPLATES if templates is None else templates)
    vocabulary = sorted({w for _, tf in words for w in tf})
    f = files.select("file_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    vocab = F.array(*map(F.lit, vocabulary))
    seen = f.select(F.explode(F.array_intersect(_words(F.col("text")), vocab)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    df = {r["w"]: r["df"] for r in seen.collect()}  # a row a word of the templates
    n = f.count()
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    other = math.log(1 + n) + 1
    vectors = []
    for name, tf in words:
        v = {w: c * idf[w] for w, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((name, {w: x / norm for w, x in v.items()}))
    must = sorted(set().union(*(needed(v, min(threshold, whole_threshold)) for _, v in vectors)))
    rare = F.array(*map(F.lit, must))
    base = F.regexp_extract(F.coalesce("path", F.lit("")), "([^/]*)$", 1)
    f = f.withColumn("named", base.rlike(LICENCE_FILE))
    # one number for each row, so that repeated rows keep apart: written once, so it never changes
    hit = f.where(F.arrays_overlap(_words(F.col("text")), rare)).select("path", "named", "text", F.struct("file_id", "path").alias("f"))
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.struct(_words(x).alias("w"), F.lit(False).alias("whole"))), lambda u: F.arrays_overlap(u["w"], rare))
    units = hit.select("f", "named", F.explode(F.array_distinct(F.concat(lines, F.array(F.struct(_words(F.col("text")).alias("w"), F.lit(True).alias("whole")))))).alias("u"))
    units = tables.save(units.distinct().select("f", "named", "u.whole", "u.w", F.monotonically_increasing_id().alias("unit")), "units")
    tf = units.select("unit", F.explode("w").alias("w")).groupBy("unit", "w").agg(F.count("*").cast("double").alias("tf"))
    weights = spark.createDataFrame([(w, idf[w]) for w in vocabulary], "w string, idf double")
    tf = join_small(tf, weights, ["w"], "unit", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    tf = tables.save(tf.select("unit", "w", "x"), "vectors")
    norm = tf.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    sparse = spark.createDataFrame([(k, name, w, x) for k, (name, v) in enumerate(vectors) for w, x in v.items()], "k int, licence string, w string, t double")
    dot = join_small(tf, sparse, ["w"], "unit").groupBy("unit", "k", "licence").agg(F.sum(F.col("x") * F.col("t")).alias("dot"))
    cos = dot.join(norm, "unit").select("unit", "licence", F.least(F.lit(1.0), F.col("dot") / F.col("norm")).alias("cosine"))
    best = cos.groupBy("unit").agg(F.min(F.struct((-F.round("cosine", 9)).alias("c"), "licence")).alias("b")).select("unit", (-F.col("b.c")).alias("cosine"), "b.licence")
    u = tables.save(units.select("f", "named", "whole", "unit").join(best, "unit"), "best")
    line = (~F.col("whole") & (F.col("cosine") >= threshold)) | (F.col("whole") & (F.col("cosine") >= whole_threshold))
    own = u.where(line).groupBy("f").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"), F.max(F.col("named") | F.col("whole")).alias("is_file"))
    own = tables.save(own.select("f.*", (-F.col("b.c")).alias("cosine"), "b.licence", "is_file"), "own")
    # Directories with a licence file, and the best one of each.
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    holders = own.where("is_file AND path IS NOT NULL").groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    holders = tables.save(holders.select("dir", (-F.col("b.c")).alias("dir_cosine"), F.col("b.licence").alias("dir_licence")), "holders")
    mine = own.select(F.col("file_id").alias("_f"), F.col("path").alias("_p"), "cosine", "licence")
    paths = f.select("file_id", "path")
    all_ = paths.join(mine, paths["file_id"].eqNullSafe(F.col("_f")) & paths["path"].eqNullSafe(F.col("_p")), "left").drop("_f", "_p")
    bare = paths.where("path IS NOT NULL").distinct()
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    up = bare.select("file_id", "path", F.explode(above).alias("dir"))
    near = join_small(up, holders, ["dir"], "path").groupBy("file_id", "path").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "dir_licence", "dir_cosine")).alias("d"))
    near = near.select(F.col("file_id").alias("_f"), F.col("path").alias("_p"), "d")
    out = all_.join(near, all_["file_id"].eqNullSafe(F.col("_f")) & all_["path"].eqNullSafe(F.col("_p")), "left")
    has, got = F.col("licence").isNotNull(), F.col("d").isNotNull()
    return out.select("file_id", "path", F.coalesce("licence", "d.dir_licence").alias("licence"), F.when(has, "own").when(got, "inherited").alias("how"), F.coalesce("cosine", "d.dir_cosine").alias("cosine"), F.when(~has & got, F.col("d.dir")).alias("origin"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no path: source / language / number by hundreds / number."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    path = F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("-")), F.concat(part("doc_id"), F.lit(".txt")))
    out = scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return out.select(F.col("file_id").alias("doc_id"), "path", "licence", "how", F.round("cosine", 6).alias("cosine"), "origin")
