"""The whole report as named DataFrames over one revision table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from revlens.operators import agreement, survey, trends
from revlens.sources import geojson


def report(revisions: DataFrame, articles: DataFrame, article_url: str | None = None) -> dict[str, DataFrame]:
    """Agreement of both kinds, survey of unlabelled rows, outlier months; each part stays lazy."""
    parts: dict[str, DataFrame] = {}
    for kind in ("stance", "topic"):
        counts = agreement.pair_counts(revisions, kind, article_url)
        parts[f"{kind}_confusion"] = agreement.confusion_matrix(counts).orderBy("human", "ai")
        parts[f"{kind}_distribution"] = agreement.distribution_bias(counts)
        parts[f"{kind}_classes"] = agreement.classification_report(counts).drop("hit_n").orderBy("label")
        parts[f"{kind}_summary"] = agreement.report_summary(agreement.classification_report(counts))
    parts["articles"] = agreement.article_agreement(revisions, articles, article_url)
    parts["survey_totals"] = survey.survey_totals(revisions, article_url)
    parts["survey_topics"] = survey.survey_topics(revisions, article_url)
    parts["survey_stances"] = survey.survey_stances(revisions, article_url)
    parts["survey_articles"] = survey.survey_articles(revisions, articles, article_url)
    parts["outliers"] = trends.monthly_outliers(revisions, article_url)
    return parts


def write_maps(revisions: DataFrame, articles: DataFrame, folder: str, article_url: str | None = None) -> list[str]:
    """Write the agreement map, and the survey map when there are unlabelled rows."""
    parts = report(revisions, articles, article_url)
    written = [f"{folder}/agreement_map"]
    geojson.write_features(geojson.agreement_features(parts["articles"]), written[0])
    if not survey.unlabelled(revisions, article_url).isEmpty():
        written.append(f"{folder}/ai_survey_map")
        geojson.write_features(geojson.survey_features(parts["survey_articles"]), written[1])
    return written
