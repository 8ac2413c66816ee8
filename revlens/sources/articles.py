"""The article table: refresh, upsert, fill-in coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.geo import normalised, synthetic_point
from revlens.schema import DISCOVERY_RESULT
from revlens.session import cut_lineage


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """Landed discovery results as (url, coord); several files are read by several tasks."""
    return parse_bindings(spark.read.schema(DISCOVERY_RESULT).json(path, multiLine=True))


def parse_bindings(results: DataFrame) -> DataFrame:
    """One row per binding; a binding without coordinate keeps NULL."""
    return results.select(F.explode("results.bindings").alias("b")).select(
        F.try_element_at("b", F.lit("article"))["value"].alias("url"),
        F.try_element_at("b", F.lit("coord"))["value"].alias("coord"),
    )


def latest(writes: DataFrame, key: str, order: str) -> DataFrame:
    """Last write per key. Aggregates instead of ranking, so repeats combine before the shuffle."""
    rest = [c for c in writes.columns if c not in (key, order)]
    newest = writes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("w"))
    return newest.select(key, *[F.col(f"w.{c}").alias(c) for c in rest])


def upsert(stored: DataFrame, writes: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows, replaced or extended by the last write of each key.

    Stored rows are never aggregated, only matched against the keys being written.
    """
    fresh = latest(writes, key, order)
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*stored.columns))


def refresh(articles: DataFrame, path: str) -> None:
    """Replace the whole table at ``path``; the new rows must not be read from there."""
    articles.write.mode("overwrite").parquet(path)


def fill_coordinates(articles: DataFrame) -> DataFrame:
    """Upper-case the given points and give every other article a repeatable point of its own.

    A point somebody else uses is drawn again with the next salt. Rounds only touch the
    articles still without a point; clashes are rare, so there are few.
    """
    base = articles.select("url", normalised(F.col("coord")).alias("coord"))
    given = base.filter(F.col("coord").isNotNull()).withColumn("coord_is_synthetic", F.lit(False))
    used = given.select(F.col("coord").alias("point")).distinct()
    waiting = base.filter(F.col("coord").isNull()).select("url").distinct()
    done = given
    salt = 0
    while True:
        drawn = waiting.withColumn("point", synthetic_point(F.col("url"), F.lit(salt)))
        winners = (
            drawn.groupBy("point").agg(F.min("url").alias("url")).join(used, "point", "left_anti")
        )
        winners = cut_lineage(winners.select("url", "point"))
        done = done.unionByName(
            winners.select("url", F.col("point").alias("coord"), F.lit(True).alias("coord_is_synthetic"))
        )
        waiting = cut_lineage(waiting.join(winners, "url", "left_anti"))
        if waiting.isEmpty():
            return done
        used = used.unionByName(winners.select("point"))
        salt += 1


def ingest_totals(bindings: DataFrame) -> DataFrame:
    """Bindings read against distinct addresses stored."""
    return bindings.agg(F.count("*").alias("bindings"), F.count_distinct("url").alias("urls"))


def first_articles(articles: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` articles by address; all of them when ``n`` is not positive."""
    return articles.orderBy("url").limit(n) if n and n > 0 else articles


def needs_fetch(stored: DataFrame) -> bool:
    """True when the table is still empty."""
    return stored.isEmpty()
