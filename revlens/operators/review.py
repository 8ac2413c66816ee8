"""The queue of rows to label, and the facets to filter it by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.survey import by_count, label_counts
from revlens.schema import DESCRIPTION_FACETS, QUEUE_SIZE, REVISIONS

QUEUE_COLUMNS = [f.name for f in REVISIONS.fields if f.name not in ("manual_bias", "manual_topic")]

_ANY = ("", "Any")


def _orders(seed: int | None) -> dict[str, Column]:
    return {
        "bias_desc": F.col("bias_score_after").desc(),
        "bias_asc": F.col("bias_score_after").asc(),
        "delta_desc": F.col("bias_delta").desc(),
        "delta_asc": F.col("bias_delta").asc(),
        "time_newest": F.col("timestamp").desc(),
        "time_oldest": F.col("timestamp").asc(),
        "random": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))),
    }


def pending(revisions: DataFrame) -> DataFrame:
    """Rows without a stance chosen by a human; a row with only a topic still counts as pending."""
    return revisions.filter(F.col("manual_bias").isNull())


def review_queue(
    revisions: DataFrame,
    sort: str = "bias_desc",
    desc: str = "",
    topic: str = "",
    stance: str = "",
    n: int = QUEUE_SIZE,
    seed: int | None = None,
) -> DataFrame:
    """The next ``n`` pending rows. An unknown order falls back to highest score first.

    Filters reach the scan and the limit turns into a top-n per task. Rows holding a NULL
    are dropped after the limit, so a batch may come out shorter than ``n``. The random order
    is that of a digest of seed and id, so a seed gives one batch at any partitioning.
    """
    rows = pending(revisions)
    for column, wanted in (("change_desc", desc), ("ai_topic", topic), ("ai_political_stance", stance)):
        if wanted not in _ANY:
            rows = rows.filter(F.col(column) == wanted)
    orders = _orders(seed)
    order = orders.get(sort, orders["bias_desc"])
    batch = rows.select(*QUEUE_COLUMNS).orderBy(order, F.col("id")).limit(n)
    return batch.dropna(subset=QUEUE_COLUMNS).withColumn("is_ip", F.col("is_ip") == 1)


def description_facet(revisions: DataFrame, n: int = DESCRIPTION_FACETS) -> DataFrame:
    """Most frequent descriptions; the empty one takes a place among the ``n`` before it is dropped."""
    counts = pending(revisions).groupBy(F.col("change_desc").alias("label")).agg(F.count("*").alias("n"))
    return counts.orderBy(*by_count()).limit(n).filter(F.col("label").isNotNull() & (F.col("label") != ""))


def label_facet(revisions: DataFrame, column: str) -> DataFrame:
    return label_counts(pending(revisions), column).orderBy(*by_count())
