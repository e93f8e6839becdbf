"""Licence scans by sparse TF-IDF cosine to templates, and inheritance from licence files along directory paths."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import Scratch, free_name

#: Headers as licences ask for them, or as they are usually named.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. Creative Commons Attribution-NonCommercial.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal Public Domain Dedication.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted. ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Unlicense.",
    "proprietary": "All rights reserved.",
}
#: Words without weight, in templates and texts alike.
STOP_WORDS = ("a", "all", "and", "any", "are", "as", "at", "be", "by", "for", "from", "has", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "was", "with")
#: Words of templates that much other prose has; the scan avoids to search for them.
PROSE_WORDS = ("author", "code", "copy", "extent", "form", "forms", "free", "general", "international", "law", "library", "possible", "public", "purpose", "released", "software", "source", "subject", "terms", "use", "version", "without", "work")
HEADER_LEAST, FILE_LEAST = 0.5, 0.8
WORD = "[a-z0-9]+(?:[.][0-9]+)*"
LICENSE_NAME = "(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"


def template_weights() -> tuple[list[tuple[str, str, float, float]], float, list[str]]:
    """Rows (word, licence, idf, weight in the licence's unit vector), the idf of other words, and the scan's words.

    The scan's words: without any of them, no text reaches HEADER_LEAST with any template, as the rest of each
    template's unit vector is shorter than that. So texts without them need no vector.
    """
    words = {k: Counter(w for w in re.findall(WORD, v.lower()) if w not in STOP_WORDS) for k, v in TEMPLATES.items()}
    df = Counter(w for c in words.values() for w in c)
    idf = {w: round(math.log((len(words) + 1) / (n + 1)) + 1, 6) for w, n in df.items()}
    unit = {}
    for k, c in words.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        unit[k] = {w: n * idf[w] / norm for w, n in c.items()}
    left = set(idf)
    for w in sorted(idf, key=lambda w: (not w[0].isdigit() and len(w) > 1, w not in PROSE_WORDS, idf[w], w)):  # what other texts hold too is left out first
        left.discard(w)
        if any(math.sqrt(sum(x * x for v, x in u.items() if v not in left)) >= HEADER_LEAST for u in unit.values()):
            left.add(w)
    return [(w, k, idf[w], round(x, 9)) for k, u in sorted(unit.items()) for w, x in sorted(u.items())], round(math.log(len(words) + 1) + 1, 6), sorted(left)


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row for each row of `files`, with its columns and license, how, inherited_from, own_score and own_licenses.

    Texts are cut into lines and sentences; a header is one whose TF-IDF cosine to a template is HEADER_LEAST or more.
    own_licenses are all licences found so, sorted; the best one (ties: the first by name) is the row's license
    ('own'). A file whose whole text reaches FILE_LEAST, or whose name is that of a licence file and that has a header,
    is a licence file of its directory. Rows without a licence take that of the nearest directory above that has a
    licence file ('inherited'; in a directory the best score counts, ties: the first by name), and else have none
    ('none'). Directories are joined by path once each, and files to them afterwards.

    Null and empty texts have no licence of their own; a null path lies in no directory. Rows that share a path and a
    text share a result. A column of `files` named like a result column is replaced.
    """
    spark = files.sparkSession
    rows, other, wanted = template_weights()
    weights = F.broadcast(spark.createDataFrame(rows, "word string, license string, idf double, weight double"))
    idfs = F.broadcast(spark.createDataFrame(sorted({(w, i) for w, _, i, _ in rows}), "word string, idf double"))
    base = files.drop("license", "how", "inherited_from", "own_score", "own_licenses")
    best_of, list_of, near_of = (free_name(base, c) for c in ("top", "licenses_found", "near"))
    keyed = base.withColumn("_path", F.coalesce(F.col(path), F.lit(""))).withColumn("_text", F.unhex(F.md5(F.concat_ws("\n", F.col(path), F.coalesce(F.col(text), F.lit(""))))))
    pattern = r"(?i)(^|[^a-z0-9])(" + "|".join(re.escape(w) for w in wanted) + r")($|[^a-z0-9])"
    # Texts are searched once and their words counted once; both results are read several times.
    scratch = Scratch(spark, "licenses")
    hits = scratch.table(keyed.where(F.col(text).rlike(pattern)).select("_path", "_text", F.lower(F.col(text)).alias("body")), "hits")
    marked = hits.select("_text", "body").dropDuplicates(["_text"]).select("_text", "body", F.split(F.regexp_replace("body", r"([.!?])[ \t\r]+", "$1\n"), "\n").alias("parts"))
    units = marked.select("_text", F.posexplode("parts").alias("unit", "part")).where(F.col("part").rlike(pattern))
    units = units.unionAll(marked.select("_text", F.lit(-1).alias("unit"), F.col("body").alias("part")))
    words = units.select("_text", "unit", F.explode(F.regexp_extract_all("part", F.lit(f"({WORD})"))).alias("word")).where(~F.col("word").isin(*STOP_WORDS))
    counted = words.groupBy("_text", "unit", "word").agg(F.count("*").cast("double").alias("n")).join(idfs, "word", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other))).drop("idf")
    counted = scratch.table(counted, "counted")
    norms = counted.groupBy("_text", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = counted.join(weights.drop("idf"), "word").groupBy("_text", "unit", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, ["_text", "unit"]).select("_text", "unit", "license", F.round(F.col("dot") / F.col("norm"), 4).alias("score"))
    best = F.struct((-F.col("score")).alias("s"), F.col("license").alias("license"))
    per_unit = scores.where(F.col("score") >= HEADER_LEAST).groupBy("_text", "unit").agg(F.min(best).alias("top"))
    own = per_unit.groupBy("_text").agg(F.min(F.when(F.col("unit") >= 0, F.col("top"))).alias("top"), F.array_sort(F.collect_set(F.when(F.col("unit") >= 0, F.col("top.license")))).alias("own_licenses"), F.min(F.when(F.col("unit") < 0, F.col("top"))).alias("whole"))
    own = own.join(hits.select("_path", "_text").distinct(), "_text")
    named = F.regexp_extract("_path", "([^/]*)$", 1).rlike(LICENSE_NAME)
    own = own.select("_path", "_text", "top", "own_licenses", F.when(-F.col("whole.s") >= FILE_LEAST, F.col("whole")).when(named, F.coalesce("top", "whole")).alias("file"))
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    held = own.where(F.col("file").isNotNull() & (F.col("_path") != "")).groupBy(folder(F.col("_path")).alias("above")).agg(F.min("file").alias("file"))
    # Each folder once, with all folders above it and itself.
    folders = keyed.where("_path <> ''").select(folder(F.col("_path")).alias("folder")).distinct()
    steps = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    near = folders.select("folder", F.posexplode(above).alias("depth", "above")).join(held, "above").groupBy("folder").agg(F.max_by(F.struct("file", "above"), "depth").alias("near"))
    found = own.select("_text", F.col("top").alias(best_of), F.col("own_licenses").alias(list_of))
    near = near.withColumnRenamed("near", near_of)
    out = keyed.join(found, "_text", "left").withColumn("_folder", F.when(F.col("_path") != "", folder(F.col("_path")))).join(near.withColumnRenamed("folder", "_folder"), "_folder", "left")
    mine, theirs = F.col(best_of)["license"], F.col(near_of)["file"]["license"]
    return out.select(
        *base.columns,
        F.coalesce(mine, theirs).alias("license"),
        F.when(mine.isNotNull(), "own").when(theirs.isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(mine.isNull(), F.col(near_of)["above"]).alias("inherited_from"),
        (-F.col(best_of)["s"]).alias("own_score"),
        F.coalesce(list_of, F.array().cast("array<string>")).alias("own_licenses"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as files <source>/<lang>/<doc_id>; the list of licences is joined to one string."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return scan_licenses(docs).select("doc_id", "path", "license", "how", "inherited_from", "own_score", F.array_join("own_licenses", ",").alias("own_licenses"))


def _oracle() -> str:
    rows, other, wanted = template_weights()
    values = ", ".join(f"('{w}', '{k}', {i!r}::DOUBLE, {x!r}::DOUBLE)" for w, k, i, x in rows)
    pattern = "(?i)(^|[^a-z0-9])(" + "|".join(re.escape(w) for w in wanted) + ")($|[^a-z0-9])"
    return f"""
WITH weights(word, license, idf, weight) AS (VALUES {values}),
idfs AS (SELECT DISTINCT word, idf FROM weights),
files AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
scanned AS (SELECT DISTINCT path, md5(text) AS t, lower(text) AS body FROM files WHERE regexp_matches(text, '{pattern}')),
marked AS (SELECT path, t, body, string_split(regexp_replace(body, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM scanned),
units AS (
  SELECT * FROM (SELECT path, t, generate_subscripts(parts, 1) AS unit, unnest(parts) AS part FROM marked) WHERE regexp_matches(part, '{pattern}')
  UNION ALL SELECT path, t, -1, body FROM marked
),
words AS (SELECT * FROM (SELECT path, t, unit, unnest(regexp_extract_all(part, '{WORD}')) AS word FROM units) WHERE word NOT IN {STOP_WORDS!r}),
counted AS (
  SELECT path, t, unit, c.word, n * coalesce(idf, {other!r}::DOUBLE) AS w
  FROM (SELECT path, t, unit, word, count(*)::DOUBLE AS n FROM words GROUP BY ALL) c LEFT JOIN idfs USING (word)
),
norms AS (SELECT path, t, unit, sqrt(sum(w * w)) AS norm FROM counted GROUP BY ALL),
dots AS (SELECT path, t, unit, license, sum(w * weight) AS dot FROM counted JOIN weights USING (word) GROUP BY ALL),
scores AS (SELECT path, t, unit, license, round(dot / norm, 4) AS score FROM dots JOIN norms USING (path, t, unit)),
per_unit AS (
  SELECT path, t, unit, license, score FROM scores WHERE score >= {HEADER_LEAST}
  QUALIFY row_number() OVER (PARTITION BY path, t, unit ORDER BY score DESC, license) = 1
),
tops AS (SELECT path, t, license, score FROM per_unit WHERE unit >= 0 QUALIFY row_number() OVER (PARTITION BY path, t ORDER BY score DESC, license) = 1),
lists AS (SELECT path, t, string_agg(DISTINCT license, ',' ORDER BY license) AS own_licenses FROM per_unit WHERE unit >= 0 GROUP BY ALL),
held AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS above, license, score FROM per_unit WHERE unit = -1 AND score >= {FILE_LEAST}
  QUALIFY row_number() OVER (PARTITION BY above ORDER BY score DESC, license) = 1
),
folders AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM files),
near AS (
  SELECT folder, license, above FROM folders JOIN held ON above = folder OR above = '' OR starts_with(folder, above || '/')
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(above) DESC) = 1
)
SELECT doc_id, f.path, coalesce(o.license, n.license) AS license,
       CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN o.license IS NULL THEN n.above END AS inherited_from, o.score AS own_score, coalesce(l.own_licenses, '') AS own_licenses
FROM files f LEFT JOIN tops o ON o.path = f.path AND o.t = md5(f.text) LEFT JOIN lists l ON l.path = f.path AND l.t = md5(f.text)
LEFT JOIN near n ON n.folder = regexp_replace(f.path, '/?[^/]*$', '')
"""


OP10_SQL = _oracle()
