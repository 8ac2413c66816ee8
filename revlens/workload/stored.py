"""Queries over landed files and stored tables: given rows are written out, then read by the library's own readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.text import parse_day
from revlens.operators import labels, scoring, trends
from revlens.plans import discover
from revlens.schema import REVISIONS
from revlens.session import scratch_path
from revlens.sources import articles, categories, tables
from revlens.workload import fixtures as fx


def landed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results land as one JSON document a file and become the article table."""
    path = scratch_path(spark, "landed")
    documents = fx.bindings(spark, sf_dir).select(F.to_json(F.struct("results")).alias("value"), F.monotonically_increasing_id().alias("document"))
    documents.write.partitionBy("document").text(path)
    return discover.article_table(articles.read_bindings(spark, path))


def listed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics in use, written as a JSON list, read as a dimension and counted in its order."""
    path, revisions = scratch_path(spark, "topics"), fx.event_rev(spark, sf_dir)
    revisions.agg(F.to_json(F.array_sort(F.collect_set("ai_topic"))).alias("value")).write.text(path)
    return categories.category_counts(categories.read_categories(spark, path), revisions, "ai_topic")


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables are made where none are, the empty one is fetched, and the stored one is read and refreshed by half of it."""
    folder, database = scratch_path(spark, "tables"), f"revlens_{uuid.uuid4().hex}"
    spark.sql(f"create database {database}")
    for _ in range(2):  # the second time finds both
        tables.create_tables(spark, folder, database)
    if articles.needs_fetch(spark.table(f"{database}.articles")):
        articles.refresh(fx.articles_fx(spark, sf_dir), f"{folder}/articles")
    spark.sql(f"drop database {database} cascade")  # the files stay
    stored = tables.read_articles(spark, f"{folder}/articles")
    articles.refresh(stored.filter("coord is not null"), f"{folder}/with-point")
    return tables.read_articles(spark, f"{folder}/with-point")


def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the changes are stored; half of all come in again with other scores, some twice."""
    folder, revisions = scratch_path(spark, "changes"), fx.event_rev(spark, sf_dir)
    typed = revisions.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REVISIONS.fields])
    typed.filter("original_revid % 3 <> 0").write.parquet(f"{folder}/before")
    stored = spark.read.schema(REVISIONS).parquet(f"{folder}/before")
    score = 1 - F.col("bias_score_after")
    again = typed.filter("original_revid % 2 = 0").withColumns({"bias_score_after": score, "manual_bias": F.lit("lost"), "content": F.lit("again")})
    writes = again.withColumn("seq", F.lit(2)).unionByName(typed.filter("original_revid % 4 = 0").withColumns({"content": F.lit("early"), "seq": F.lit(1)}))
    tables.upsert_changes(stored, writes, "seq").write.parquet(f"{folder}/after")
    read = tables.read_revisions(spark, f"{folder}/after")
    return read.select(
        "id", F.round("bias_score_after", 6).alias("score"), "manual_bias", "manual_topic", "content", F.col("event_date").cast("string").alias("event_date"), "event_month",
    )


def written_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, skips and clears written one kind at a time, folded to the state."""
    events = fx.label_events_fx(spark, sf_dir)
    of = lambda kind: events.filter(F.col("kind") == kind)
    log = (
        labels.label_event(of("label"), F.col("stance"), F.col("topic"), F.col("event_seq"))
        .unionByName(labels.skip_event(of("skip"), F.col("event_seq")))
        .unionByName(labels.clear_event(of("clear"), F.col("event_seq")))
    )
    return labels.label_state(log)


def short_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly activity where some timestamps are absent, a year, or a month only."""
    cut = F.expr("case original_revid % 5 when 0 then null when 1 then substr(timestamp, 1, 4) when 2 then substr(timestamp, 1, 7) else timestamp end")
    found = trends.monthly_activity(fx.event_rev(spark, sf_dir).withColumn("timestamp", cut))
    return found.select("month", "revs", F.round("avg_score", 6).alias("avg_score"))


def outlier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlier table as the report shows it."""
    return trends.monthly_outliers(fx.lineitem_rev(spark, sf_dir)).select("month", "reason", "value_text", "context")


def parsed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per day of a text column in which every seventh value is no day."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    shown = F.when(F.col("l_orderkey") % 7 == 0, F.translate(day, "-", "/")).otherwise(day)
    days = fx.table(spark, sf_dir, "lineitem").groupBy(parse_day(shown).cast("string").alias("day"))
    return days.agg(F.count("*").alias("n"))


def _length_model():
    return lambda texts: [{"long": min(1.0, len(t) / 64), "blank": t.count(" ") / len(t)} for t in texts]


def function_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outside model over the distinct texts of all changes, its scores joined back to both sides."""
    revisions = fx.event_rev(spark, sf_dir)
    scores = scoring.function_scorer(_length_model)(scoring.distinct_texts(revisions, "diff_before", "diff_after"))
    both = scoring.with_probabilities(scoring.with_probabilities(revisions, scores, "diff_before", "b"), scores, "diff_after", "a")
    shown = {f"{side}_{label}": F.round(F.col(k)[label], 6) for side, k in (("before", "b"), ("after", "a")) for label in ("long", "blank")}
    return both.select("id", *[c.alias(n) for n, c in shown.items()])


def queries():
    found = (landed_articles, listed_topics, stored_articles, stored_changes, written_labels, short_timestamps, outlier_texts, parsed_days, function_scored)
    return {f.__name__: f for f in found}
