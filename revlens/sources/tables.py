"""Stored tables: creation, scans, upsert of scored changes, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.text import event_date, month_key
from revlens.operators.labels import training_export
from revlens.schema import ARTICLES, REVISIONS
from revlens.sources.articles import latest


def create_tables(spark: SparkSession, folder: str, database: str = "default") -> None:
    """Create both tables over ``folder`` unless they are there already."""
    for name, schema in (("articles", ARTICLES), ("revisions", REVISIONS)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"create table if not exists {database}.{name} ({columns}) using parquet location '{folder}/{name}'"
        )


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLES).parquet(path)


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """Revisions with the derived time columns; unused columns never leave the files."""
    ts = F.col("timestamp")
    return (
        spark.read.schema(REVISIONS)
        .parquet(path)
        .withColumn("event_ts", F.try_to_timestamp(ts))
        .withColumn("event_date", event_date(ts))
        .withColumn("event_month", month_key(ts))
    )


def upsert_changes(stored: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Replace or add scored changes by id. A replaced row keeps the labels humans gave it."""
    fresh = latest(changes, "id", order).drop("manual_bias", "manual_topic")
    labels = stored.select("id", "manual_bias", "manual_topic")
    labelled = fresh.join(labels, "id", "left").select(*stored.columns)
    return stored.join(fresh.select("id"), "id", "left_anti").unionByName(labelled)


def export_training(revisions: DataFrame, path: str) -> None:
    training_export(revisions).write.mode("overwrite").parquet(path)
