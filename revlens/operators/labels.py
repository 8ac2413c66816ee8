"""Human labels as an append-only event log, and the state they fold to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.schema import SKIPPED


def label_event(ids: DataFrame, stance: Column, topic: Column, seq: Column) -> DataFrame:
    return _events(ids, stance, topic, seq, "label")


def skip_event(ids: DataFrame, seq: Column) -> DataFrame:
    return _events(ids, F.lit(SKIPPED), F.lit(SKIPPED), seq, "skip")


def clear_event(one_row: DataFrame, seq: Column) -> DataFrame:
    """Voids every label written before it."""
    nothing = F.lit(None).cast("string")
    return _events(one_row.withColumn("id", nothing), nothing, nothing, seq, "clear")


def _events(ids: DataFrame, stance: Column, topic: Column, seq: Column, kind: str) -> DataFrame:
    return ids.select(
        "id", stance.alias("stance"), topic.alias("topic"), seq.cast("long").alias("event_seq"), F.lit(kind).alias("kind")
    )


def label_state(events: DataFrame) -> DataFrame:
    """Newest surviving label pair per id. (id, manual_bias, manual_topic, event_seq)

    The newest clear is one number, fetched as a scalar subquery.
    """
    last_clear = events.filter(F.col("kind") == "clear").agg(F.coalesce(F.max("event_seq"), F.lit(-1)))
    skipped = F.col("kind") == "skip"
    alive = events.filter((F.col("kind") != "clear") & (F.col("event_seq") > last_clear.scalar())).select(
        "id",
        F.struct(
            "event_seq",
            F.when(skipped, SKIPPED).otherwise(F.col("stance")).alias("manual_bias"),
            F.when(skipped, SKIPPED).otherwise(F.col("topic")).alias("manual_topic"),
        ).alias("write"),
    )
    return alive.groupBy("id").agg(F.max("write").alias("w")).select(
        "id", "w.manual_bias", "w.manual_topic", "w.event_seq"
    )


def with_labels(revisions: DataFrame, state: DataFrame) -> DataFrame:
    """Revisions with their label columns replaced by the folded state."""
    columns = revisions.columns
    bare = revisions.drop("manual_bias", "manual_topic")
    return bare.join(state.select("id", "manual_bias", "manual_topic"), "id", "left").select(*columns)


def label_progress(revisions: DataFrame) -> DataFrame:
    """Rows in the table and rows that carry a stance, skipped ones included."""
    return revisions.agg(F.count("*").alias("revisions"), F.count("manual_bias").alias("scored"))


def training_export(revisions: DataFrame) -> DataFrame:
    """Text pairs with the labels a human gave them; skipped rows stay out."""
    stance = F.col("manual_bias")
    return revisions.filter(stance.isNotNull() & (stance != SKIPPED)).select(
        "id", "article_url", "diff_before", "diff_after", "content", "manual_bias", "manual_topic"
    )
