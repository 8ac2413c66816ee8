"""Monthly outliers and daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.functions.text import event_date, month_key, present, usable_timestamp
from revlens.operators.agreement import only_article
from revlens.operators.grids import dense_series
from revlens.schema import OUTLIER_Z


def monthly_activity(revisions: DataFrame, article_url: str | None = None) -> DataFrame:
    """Rows and mean score per month. Months without rows are not filled in."""
    ts = F.col("timestamp")
    return (
        only_article(revisions, article_url)
        .filter(usable_timestamp(ts))
        .groupBy(month_key(ts).alias("month"))
        .agg(F.count("*").alias("revs"), F.avg("bias_score_after").alias("avg_score"))
    )


def monthly_outliers(revisions: DataFrame, article_url: str | None = None, z: float = OUTLIER_Z) -> DataFrame:
    """Months whose activity or mean score lies more than ``z`` standard deviations off.

    The deviation is the population one and every month weighs the same. The window has
    no partition key: its input is one row per month, already aggregated.
    """
    whole = W.partitionBy()
    stats = monthly_activity(revisions, article_url).select(
        "month",
        "revs",
        "avg_score",
        F.avg("revs").over(whole).alias("revs_mean"),
        F.stddev_pop("revs").over(whole).alias("revs_std"),
        F.avg("avg_score").over(whole).alias("score_mean"),
        F.stddev_pop("avg_score").over(whole).alias("score_std"),
    )

    def test(kind: int, name: str, value: str, mean: str, std: str, shown: Column, about: Column) -> Column:
        score = F.when(F.col(std) > 0, (F.col(value) - F.col(mean)) / F.col(std))
        return F.struct(
            F.lit(kind).alias("kind"),
            F.when(score > z, F.lit(f"High {name}")).when(score < -z, F.lit(f"Low {name}")).alias("reason"),
            F.col(value).cast("double").alias("value"),
            F.col(mean).alias("mean"),
            score.alias("z"),
            shown.alias("value_text"),
            about.alias("context"),
        )

    activity = test(
        0, "Activity", "revs", "revs_mean", "revs_std",
        F.format_string("%d revs", "revs"), F.format_string("(Mean: %.1f)", "revs_mean"),
    )
    bias = test(
        1, "Bias Score", "avg_score", "score_mean", "score_std",
        F.format_string("%.4f", "avg_score"), F.format_string("(Mean: %.4f)", "score_mean"),
    )
    return (
        stats.select("month", F.inline(F.array(activity, bias)))
        .filter(F.col("reason").isNotNull())
        .orderBy("month", "kind")
    )


def daily_bias(revisions: DataFrame) -> DataFrame:
    """Mean score per day; a day without date or without any score drops out."""
    return (
        revisions.groupBy(event_date(F.col("timestamp")).alias("date"))
        .agg(F.avg("bias_score_after").alias("avg_score"))
        .dropna(subset=["date", "avg_score"])
        .orderBy("date")
    )


def daily_activity(revisions: DataFrame) -> DataFrame:
    return (
        revisions.groupBy(event_date(F.col("timestamp")).alias("date"))
        .agg(F.count("*").alias("n"))
        .dropna(subset=["date"])
        .orderBy("date")
    )


def active_days(revisions: DataFrame) -> DataFrame:
    return revisions.select(event_date(F.col("timestamp")).alias("date")).dropna().distinct()


def daily_labels(revisions: DataFrame, column: str) -> DataFrame:
    """(date, label, n) for the days and labels that occur together."""
    label = F.col(column)
    return (
        revisions.filter(present(label))
        .groupBy(event_date(F.col("timestamp")).alias("date"), label.alias("label"))
        .agg(F.count("*").alias("n"))
    )


def daily_label_grid(revisions: DataFrame, column: str) -> DataFrame:
    """Every active day by every label, 0 where a label is absent that day.

    A label seen only on rows without a date keeps its row of zeros; one pass over the
    revisions feeds the days, the labels and the counts.
    """
    label = F.col(column)
    counts = (
        revisions.groupBy(
            event_date(F.col("timestamp")).alias("date"), F.when(present(label), label).alias("label")
        )
        .agg(F.count("*").alias("n"))
    )
    days = counts.select("date").dropna().distinct()
    return dense_series(days, counts.filter(F.col("label").isNotNull()), "date", "label", "n")


def segment_pairs(series: DataFrame, x: str, y: str) -> DataFrame:
    """Each point of a daily series with the next one: the line segments of a chart.

    The series holds one row per day, so a single partition is enough.
    """
    ahead = W.orderBy(x)
    return (
        series.select(
            F.col(x).alias("x1"),
            F.col(y).alias("y1"),
            F.lead(x).over(ahead).alias("x2"),
            F.lead(y).over(ahead).alias("y2"),
        )
        .filter(F.col("x2").isNotNull())
    )
