"""Revision histories as landed JSON pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.schema import HISTORY_PAGE, NOT_AVAILABLE


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(article, page_no, body) from files ``<page_no>.json`` in one folder per article.

    The folder name is the percent-encoded address of the article.
    """
    parts = F.split(F.col("_metadata.file_path"), "/")
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.url_decode(F.url_decode(F.element_at(parts, -2))).alias("article"),
        F.regexp_extract(F.element_at(parts, -1), r"^(\d+)", 1).cast("long").alias("page_no"),
        F.col("value").alias("body"),
    )


def revision_text(rev: Column) -> Column:
    """Text from the nested or the flat shape of the answer, '' when both are missing."""
    return F.coalesce(rev["slots"]["main"]["*"], rev["*"], F.lit(""))


def parse_pages(pages: DataFrame) -> DataFrame:
    """(article, rev_seq, revid, user, timestamp, text) from (article, page_no, body).

    Pages list revisions newest first, and so do the entries of a page. ``rev_seq`` is dense
    and grows with time (0 is the newest, -1 the one before). Only page sizes are summed
    along an article; texts stay where they were parsed.
    """
    body = F.from_json("body", HISTORY_PAGE)
    listed = pages.select("article", "page_no", F.map_entries(body["query"]["pages"]).alias("p"))
    # Only the first entry of an answer counts, and id -1 means there is no such page.
    first = F.get("p", F.lit(0))
    found = listed.select("article", "page_no", first.alias("page")).filter(F.col("page.key") != "-1")
    revs = found.select("article", "page_no", F.coalesce("page.value.revisions", F.array()).alias("revs"))
    before = W.partitionBy("article").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    sizes = revs.select("article", "page_no", F.size("revs").alias("n"))
    offsets = sizes.select("article", "page_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # Hashed by article alone after the window; left so, the join would bring a whole article together.
    offsets = offsets.repartition("article", "page_no")
    rows = revs.select("article", "page_no", F.posexplode("revs").alias("pos", "rev"))
    return rows.join(offsets, ["article", "page_no"]).select(
        "article",
        (-(F.col("offset") + F.col("pos"))).cast("long").alias("rev_seq"),
        F.col("rev.revid").alias("revid"),
        F.coalesce("rev.user", F.lit(NOT_AVAILABLE)).alias("user"),
        F.coalesce("rev.timestamp", F.lit(NOT_AVAILABLE)).alias("timestamp"),
        revision_text(F.col("rev")).alias("text"),
    )
