"""Licence notices by canonical digests, in DataFrame functions only.

A unit of text (a whole document, a paragraph or a line) is brought to a canonical form: lower
case, copyright lines left out, punctuation as blanks, equivalent spellings made one. Its digest
is joined with those of known licences, and the canonical text confirms a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import written_table


#: Short notices and their SPDX names; fixed values.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
#: Spellings that mean the same, applied to canonical text in this order; fixed values.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("redistributions", "redistribution"),
    ("noncommercial", "non commercial"), ("merchantability", "merchantibility"), ("version", "v"), ("ver", "v"),
)
COPYRIGHT = r"(?dim)^[ \t]*(?:[#*/;-]+[ \t]*)?(?:copyright\b|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Words of letters and digits in lower case with single blanks; line breaks stay."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, ""))
    words = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", " \n "), F.lit(" "))
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    words = F.regexp_replace(words, r" v (\d)", " v$1")
    return F.regexp_replace(F.regexp_replace(words, r" *\n *", "\n"), r"^[ \n]+|[ \n]+$", "")


def known(spark: SparkSession, notices=NOTICES) -> DataFrame:
    return spark.createDataFrame(list(notices), "licence string, text string")


def scan(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, scope, places): how often a licence is a whole text, paragraph or line of a document.

    scope is the widest unit that is the licence alone: text, paragraph or line; places counts the
    units of that kind. Null, empty and punctuation-only texts and licences match nothing; licences
    with one canonical text all match; repeated rows add up.
    """
    flat = lambda c: F.regexp_replace(c, r"[ \n]+", " ")
    marks = licences.select("licence", flat(canonical(F.col("text"))).alias("canon")).filter("canon <> ''").distinct()
    # a written table has a known size: a small list is broadcast, a large one joined by shuffle
    marks = written_table(marks.withColumn("digest", F.xxhash64("canon")), "licences")
    body = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("body"))
    kinds = [("text", F.array("body")), ("paragraph", F.split("body", r"\n{2,}")), ("line", F.split("body", r"\n+"))]
    named = lambda scope: lambda unit: F.struct(F.lit(scope).alias("scope"), unit.alias("unit"))
    units = F.flatten(F.array(*[F.transform(parts, named(scope)) for scope, parts in kinds]))
    rows = body.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.scope", flat(F.col("u.unit")).alias("unit"))
    rows = rows.withColumn("digest", F.xxhash64("unit"))
    hits = rows.join(marks, (rows["digest"] == marks["digest"]) & (rows["unit"] == marks["canon"]))
    counts = hits.groupBy("doc_id", "licence", "scope").agg(F.count("*").alias("places"))
    rank = F.when(F.col("scope") == "text", 0).when(F.col("scope") == "paragraph", 1).otherwise(2)
    widest = counts.groupBy("doc_id", "licence").agg(F.min_by(F.struct("scope", "places"), rank).alias("w"))
    return widest.select("doc_id", "licence", F.col("w.scope").alias("scope"), F.col("w.places").alias("places"))
