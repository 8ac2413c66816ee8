"""GeoJSON features, one per article with a valid coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def agreement_features(per_article: DataFrame) -> DataFrame:
    """Properties of the agreement map, beside lon and lat."""
    df = per_article.withColumnRenamed("article_url", "article")
    return located(_rounded(df, "topic_agreement", "stance_agreement", "avg_bias_score"))


def survey_features(per_article: DataFrame) -> DataFrame:
    """Properties of the survey map, beside lon and lat."""
    return located(_rounded(per_article.withColumnRenamed("article_url", "article"), "avg_ai_bias"))


def located(df: DataFrame) -> DataFrame:
    return df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def feature_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON Feature per row as text."""
    properties = [c for c in features.columns if c not in ("lon", "lat")]
    return features.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
                F.struct(*properties).alias("properties"),
            )
        ).alias("value")
    )


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited features, written by all tasks; no step gathers them in one place."""
    feature_lines(features).write.mode("overwrite").text(path)


