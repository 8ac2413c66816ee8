"""Distributions and axis ranges of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.scores import score_bin
from revlens.functions.text import chart_label
from revlens.operators.survey import by_count, label_counts
from revlens.schema import HISTOGRAM_BINS, TOP_LABELS


def top_labels(revisions: DataFrame, column: str, n: int = TOP_LABELS) -> DataFrame:
    return (
        label_counts(revisions, column)
        .orderBy(*by_count())
        .limit(n)
        .select("label", chart_label(F.col("label")).alias("chart_label"), "n")
    )


def bias_histogram(revisions: DataFrame) -> DataFrame:
    """Five bins, empty ones included; rows without a score are left out.

    The bins are five conditional counts of one aggregate, turned into rows afterwards.
    """
    index = score_bin(F.col("bias_score_after"), len(HISTOGRAM_BINS))
    counts = revisions.agg(*[F.count_if(index == i).alias(f"b{i}") for i in range(len(HISTOGRAM_BINS))])
    rows = [
        F.struct(F.lit(i).alias("bin"), F.lit(name).alias("label"), F.col(f"b{i}").alias("n"))
        for i, name in enumerate(HISTOGRAM_BINS)
    ]
    return counts.select(F.inline(F.array(*rows)))


def value_range(series: DataFrame, column: str) -> DataFrame:
    """(min, max) of a column: (0, 1) when it is empty, one unit tall when it is flat."""
    lo, hi = F.min(column), F.max(column)
    return series.agg(
        F.coalesce(lo, F.lit(0.0)).alias("min_value"),
        F.when(lo.isNull(), F.lit(1.0)).when(lo == hi, hi + 1).otherwise(hi).alias("max_value"),
    )
