"""Live aggregates: the dashboard, the label state and daily windows as streaming queries.

Every sink is a folder with one sub-folder per micro-batch, overwritten when a batch is
repeated after a failure, so each batch counts exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from revlens.functions.scores import score_bin
from revlens.functions.text import event_date, present
from revlens.schema import LABEL_EVENTS, SKIPPED

BATCH = "batch"


def publish(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str,
    transform: Callable[[DataFrame, int], DataFrame] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Write each micro-batch to its own folder; ``every`` is a pace, without it the stream drains and ends."""

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch, number) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def published(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows written so far, with their batch number; empty before the first batch."""
    full = StructType([*schema.fields, StructField(BATCH, LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def newest_batch(rows: DataFrame) -> DataFrame:
    """Rows of the last batch: the current result of a query in complete mode."""
    last = rows.agg(F.max(BATCH)).scalar()
    return rows.filter(F.col(BATCH) == last).drop(BATCH)


def live_labels(revisions: DataFrame, column: str) -> DataFrame:
    """Rows per label so far."""
    label = F.col(column)
    return revisions.filter(present(label)).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def live_histogram(revisions: DataFrame) -> DataFrame:
    """Rows per score bin so far; bins without rows are absent."""
    bin_of = score_bin(F.col("bias_score_after"))
    return revisions.filter(bin_of.isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))


def live_daily_labels(revisions: DataFrame, column: str) -> DataFrame:
    """Rows per day and label so far; state grows with days times labels only."""
    label = F.col(column)
    return (
        revisions.filter(present(label))
        .groupBy(event_date(F.col("timestamp")).alias("date"), label.alias("label"))
        .agg(F.count("*").alias("n"))
    )


def live_daily_bias(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy(event_date(F.col("timestamp")).alias("date")).agg(
        F.avg("bias_score_after").alias("avg_score")
    )


def live_label_writes(events: DataFrame) -> DataFrame:
    """Newest write per id; clears share the NULL id. For update mode."""
    cleared = F.col("kind") == "clear"
    skipped = F.col("kind") == "skip"
    write = F.struct(
        "event_seq",
        F.when(skipped, SKIPPED).otherwise(F.col("stance")).alias("manual_bias"),
        F.when(skipped, SKIPPED).otherwise(F.col("topic")).alias("manual_topic"),
    )
    newest = events.groupBy(F.when(~cleared, F.col("id")).alias("id")).agg(F.max(write).alias("w"))
    return newest.select("id", "w.event_seq", "w.manual_bias", "w.manual_topic")


def current_labels(writes: DataFrame) -> DataFrame:
    """Label state from the published writes: newest per id, void when older than the last clear."""
    newest = writes.groupBy("id").agg(
        F.max(F.struct("event_seq", "manual_bias", "manual_topic")).alias("w")
    )
    last_clear = writes.filter(F.col("id").isNull()).agg(F.coalesce(F.max("event_seq"), F.lit(-1))).scalar()
    return newest.select("id", "w.manual_bias", "w.manual_topic", "w.event_seq").filter(
        F.col("id").isNotNull() & (F.col("event_seq") > last_clear)
    )


def first_seen(rows: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """First row per key among rows no further apart than ``delay``; state older than that is let go."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def daily_windows(rows: DataFrame, event_time: str, label: Column, delay: str) -> DataFrame:
    """Rows per day and label, each day emitted once, ``delay`` after it is over. For append mode."""
    return (
        rows.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "1 day").alias("w"), label.alias("label"))
        .agg(F.count("*").alias("n"))
        .select(F.to_date("w.start").alias("date"), "label", "n")
    )


def read_label_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LABEL_EVENTS).json(path)
