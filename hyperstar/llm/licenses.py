"""License scans: TF-IDF cosine to templates, then inheritance along paths.

Every line of a text that speaks of a license, alone and with the two lines
after it, and the whole text of a licence file, is compared with each template
as a sparse TF-IDF vector over words. The inverse document frequencies come
from the templates, so vectors need no pass over the corpus and no shuffle. A
file without a statement of its own inherits the licence of the nearest
directory above it that holds a licence file.

Only DataFrame functions are used. Directories are joined, not files: each
directory finds its licence among its ancestors once, and files then join
their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, text_key, words, written

#: Fixed values: (licence, text) of the templates.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
)
CUE = r"(?i)licen[cs]e|permission is hereby granted|redistribution and use|free software|public domain|spdx"
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Least cosine of a match, and the share of a text's words in matching lines that makes it a licence file.
MATCH, MAINLY = 0.7, 0.5


def _idf() -> tuple[dict[str, float], float]:
    n = len(TEMPLATES)
    df = Counter(t for _, text in TEMPLATES for t in set(re.findall(TERM, text.lower())))
    return {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}, math.log(1 + n) + 1


IDF, IDF_NEW = _idf()


def _vector(text: str) -> dict[str, float]:
    """Of a template: what one occurrence of each term adds to the cosine, but for the other side's length."""
    tf = Counter(re.findall(TERM, text.lower()))
    norm = math.sqrt(sum((n * IDF[t]) ** 2 for t, n in tf.items()))
    return {t: n * IDF[t] * IDF[t] / norm for t, n in tf.items()}


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for item in values.items() for x in item))


def best_match(text: Column) -> Column:
    """(score, license) of the template nearest to ``text``; equal scores go to the template listed first."""

    def of(terms: Column) -> Column:
        weight = lambda t: F.coalesce(F.try_element_at(_map(IDF), t), F.lit(IDF_NEW))
        tf = lambda t: F.size(F.filter(terms, lambda x: x == t))
        norm = F.sqrt(F.aggregate(F.array_distinct(terms), F.lit(0.0), lambda a, t: a + F.pow(tf(t) * weight(t), F.lit(2))))
        dot = lambda v: F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(_map(v), t), F.lit(0.0)))
        each = F.array(*(F.struct(dot(_vector(x)).alias("score"), F.lit(-k).alias("at"), F.lit(name).alias("license")) for k, (name, x) in enumerate(TEMPLATES)))
        return let(F.array_max(each), lambda m: F.struct(F.when(norm > 0, F.round(m["score"] / norm, 9)).otherwise(0.0).alias("score"), m["license"].alias("license")))

    return let(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), of)


def license_scan(files: DataFrame) -> DataFrame:
    """For every row of ``files(path, text)``: path, row_key, own_license and own_score of its best statement (null where none matches), license (its own or the inherited one) and inherited_from (that directory).

    Null and empty texts have no statement and inherit. A null path has no
    directory and inherits nothing. Of licence files in one directory the
    nearest match counts, then the smallest path. Repeated rows are scanned
    each, further columns are ignored, an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    cues = lambda x: F.filter(F.transform(x, lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda s: s["line"].rlike(CUE))
    joined = lambda x, s: F.array_join(F.slice(x, s["i"] + 1, 3), " ")

    def statements(x: Column) -> Column:
        return F.transform(cues(x), lambda s: F.struct(F.array_max(F.array(best_match(s["line"]), best_match(joined(x, s)))).alias("m"), F.size(words(s["line"])).alias("n")))

    name = F.element_at(F.split(F.col("path"), "/"), -1)
    found = files.select("path", text_key(F.col("text")).alias("row_key"), let(lines, statements).alias("s"), F.size(words(F.col("text"))).alias("n"), F.when(name.rlike(LICENCE_NAME), best_match(text)).alias("whole"), F.coalesce(name.rlike(LICENCE_NAME), F.lit(False)).alias("named"))
    matched = F.filter("s", lambda s: s["m"]["score"] >= MATCH)
    best = F.array_max(F.concat(F.transform(matched, lambda s: s["m"]), F.when(F.col("whole.score") >= MATCH, F.array("whole")).otherwise(F.array().cast("array<struct<score:double,license:string>>"))))
    mainly = F.aggregate(matched, F.lit(0), lambda a, s: a + s["n"]) >= MAINLY * F.col("n")
    scanned = written(found.select("path", "row_key", best.alias("b"), (F.col("named") | mainly).alias("file")).select(
        "path", "row_key", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score"), "file",
        F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))).alias("dir"),
    ))
    of_dir = scanned.where("file and own_license is not null and dir is not null").groupBy("dir").agg(F.max("own_score").alias("own_score"))
    chosen = scanned.where("file and own_license is not null").join(of_dir, ["dir", "own_score"]).groupBy("dir").agg(F.min_by("own_license", "path").alias("license"))
    parts = lambda d: F.split(d, "/")
    above = scanned.select("dir").where("dir is not null").distinct().select("dir", F.explode(let(parts(F.col("dir")), lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(p, 1, k), "/").alias("above"))))).alias("a")).select("dir", "a.*").distinct()
    nearest = above.join(chosen.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("license", "above"), "depth").alias("up"))
    judged = scanned.join(nearest, "dir", "left")
    return judged.select("path", "row_key", "own_license", "own_score", F.coalesce("own_license", "up.license").alias("license"), F.when(F.col("own_license").isNull(), F.col("up.above")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """path and text of ``docs``: each source is a tree of directories of a thousand documents."""
    path = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), "text")


def op4(spark, sf_dir: str) -> DataFrame:
    found = license_scan(document_paths(table(spark, sf_dir, "documents")))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "own_license", "own_score", "license", "inherited_from")
