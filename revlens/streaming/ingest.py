"""Continuous ingest of scored changes with the duplicate check against everything saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from revlens.operators.dedup import saved_changes, seen_texts
from revlens.session import written_table
from revlens.streaming.live import BATCH, publish, published


def number_after(saved: DataFrame, stored: DataFrame) -> DataFrame:
    """Row ids that go on after the ordinals a revision already has, so no stored row is replaced."""
    taken = stored.groupBy("article", "original_revid").agg(F.count("*").alias("_taken"))
    inside = W.partitionBy("article", "original_revid").orderBy("change_ord")
    ordinal = F.row_number().over(inside) + F.coalesce(F.col("_taken"), F.lit(0))
    return (
        saved.join(taken, ["article", "original_revid"], "left")
        .withColumn("id", F.format_string("%d-%04d", F.col("original_revid"), ordinal))
        .drop("_taken")
    )


def ingest_changes(changes: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the new changes of each micro-batch to ``path/rows``.

    Needs article, original_revid, change_ord, diff_before and diff_after; other columns are
    carried along. Within a batch ``change_ord`` decides which of two equal texts is first;
    between batches the earlier batch does. The texts saved so far are kept as digests in
    ``path/seen``, so a batch never reads stored texts again. A repeated batch sees only
    older ones, so it writes the same rows again.
    """
    rows = StructType([*changes.schema.fields, StructField("id", StringType())])
    digests = StructType([f for f in rows.fields if f.name == "article"] + [StructField("own", StringType())])

    def keep_new(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession

        def older(name: str, schema: StructType) -> DataFrame:
            return published(spark, f"{path}/{name}", schema).filter(F.col(BATCH) < number).drop(BATCH)

        fresh = written_table(batch, "batch")
        saved = saved_changes(fresh, older("seen", digests))
        named = written_table(number_after(saved, older("rows", rows)).select(*rows.names), "new")
        seen_texts(named).write.mode("overwrite").parquet(f"{path}/seen/{BATCH}={number}")
        return named

    return publish(changes, f"{path}/rows", checkpoint, "append", keep_new, every)
