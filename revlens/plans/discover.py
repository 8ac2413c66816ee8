"""From a graph or landed search results to the article table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.discovery import Predicates, region_articles
from revlens.sources.articles import fill_coordinates


def one_per_url(found: DataFrame) -> DataFrame:
    """Several coordinates of one article: a given one before none, the smallest of the given."""
    return found.groupBy("url").agg(F.min("coord").alias("coord"))


def article_table(found: DataFrame) -> DataFrame:
    """(url, coord, coord_is_synthetic) from found (url, coord)."""
    return fill_coordinates(one_per_url(found))


def discover(
    triples: DataFrame, regions: DataFrame, sites: list[str], languages: list[str], names: Predicates = Predicates()
) -> DataFrame:
    found = region_articles(triples, regions, sites, languages, names)
    return article_table(found.select(F.col("article").alias("url"), "coord"))
