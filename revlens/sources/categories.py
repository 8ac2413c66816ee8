"""Ordered label lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(pos, label) from a JSON array of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "label"))


def category_frame(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(labels)), "pos int, label string")


def category_counts(categories: DataFrame, revisions: DataFrame, column: str) -> DataFrame:
    """Rows per listed label, in list order, 0 for a label nobody uses."""
    counts = revisions.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return (
        categories.join(counts, "label", "left")
        .select("pos", "label", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("pos")
    )
