"""What the model says about rows nobody has labelled yet. Labels are not trimmed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.scores import exact_mean, micro
from revlens.functions.text import present
from revlens.operators.agreement import article_rollup, is_labelled, only_article, with_coordinates
from revlens.schema import TOP_LABELS


def unlabelled(revisions: DataFrame, article_url: str | None = None) -> DataFrame:
    """Exact complement of the labelled rows."""
    return only_article(revisions.filter(~is_labelled()), article_url)


def survey_totals(revisions: DataFrame, article_url: str | None = None) -> DataFrame:
    return unlabelled(revisions, article_url).agg(
        F.count("*").alias("rows"), F.avg("bias_score_after").alias("avg_score")
    )


def label_counts(rows: DataFrame, column: str) -> DataFrame:
    label = F.col(column)
    return rows.filter(present(label)).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def by_count() -> list[Column]:
    return [F.col("n").desc(), F.col("label").asc()]


def survey_topics(revisions: DataFrame, article_url: str | None = None) -> DataFrame:
    counts = label_counts(unlabelled(revisions, article_url), "ai_topic")
    return counts.orderBy(*by_count()).limit(TOP_LABELS)


def survey_stances(revisions: DataFrame, article_url: str | None = None) -> DataFrame:
    return label_counts(unlabelled(revisions, article_url), "ai_political_stance").orderBy(*by_count())


def survey_articles(revisions: DataFrame, articles: DataFrame, article_url: str | None = None) -> DataFrame:
    topic, stance, score = F.col("ai_topic"), F.col("ai_political_stance"), F.col("bias_score_after")
    per_article = article_rollup(
        unlabelled(revisions, article_url),
        {
            "dominant_ai_topic": F.when(present(topic), topic),
            "dominant_ai_stance": F.when(present(stance), stance),
        },
        {"score_sum": micro(score), "score_n": F.when(score.isNotNull(), 1)},
        F.col("id"),
    )
    return with_coordinates(per_article, articles).select(
        "article_url",
        "lon",
        "lat",
        F.col("rows").alias("revisions_analyzed"),
        "dominant_ai_topic",
        "dominant_ai_stance",
        exact_mean(F.col("score_sum"), F.col("score_n")).alias("avg_ai_bias"),
    )
