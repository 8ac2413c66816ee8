"""Human-versus-model agreement over labelled revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.geo import latitude, longitude
from revlens.functions.scores import exact_mean, micro
from revlens.functions.text import present, strip
from revlens.operators.grids import label_square
from revlens.schema import NOT_AVAILABLE

# Human and model column of each compared kind. The stance a human chose is stored as manual_bias.
PAIRS = {"topic": ("manual_topic", "ai_topic"), "stance": ("manual_bias", "ai_political_stance")}


def is_labelled() -> Column:
    return F.col("manual_topic").isNotNull() | F.col("manual_bias").isNotNull()


def only_article(df: DataFrame, article_url: str | None) -> DataFrame:
    return df.filter(F.col("article_url") == article_url) if article_url else df


def labelled(revisions: DataFrame, article_url: str | None = None) -> DataFrame:
    return only_article(revisions.filter(is_labelled()), article_url)


def pair_counts(revisions: DataFrame, kind: str, article_url: str | None = None) -> DataFrame:
    """(human, ai, n) over labelled rows where both labels are present; labels are trimmed."""
    human, ai = (F.col(c) for c in PAIRS[kind])
    return (
        labelled(revisions, article_url)
        .filter(present(human) & present(ai))
        .groupBy(strip(human).alias("human"), strip(ai).alias("ai"))
        .agg(F.count("*").alias("n"))
    )


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """Square matrix in long form over all labels either side used."""
    return label_square(counts, "human", "ai", "n")


def confusion_display(counts: DataFrame, labels: list[str]) -> DataFrame:
    """Matrix for reading: one column per given label."""
    return counts.groupBy("human").pivot("ai", labels).agg(F.sum("n")).fillna(0).orderBy("human")


def class_totals(counts: DataFrame) -> DataFrame:
    """Per label: how often humans chose it, the model chose it, and both did."""
    cell = F.array(
        F.struct(
            F.col("human").alias("label"),
            F.col("n").alias("human_n"),
            F.lit(0).cast("long").alias("ai_n"),
            F.when(F.col("human") == F.col("ai"), F.col("n")).otherwise(F.lit(0)).alias("hit_n"),
        ),
        F.struct(
            F.col("ai").alias("label"),
            F.lit(0).cast("long").alias("human_n"),
            F.col("n").alias("ai_n"),
            F.lit(0).cast("long").alias("hit_n"),
        ),
    )
    return (
        counts.select(F.inline(cell))
        .groupBy("label")
        .agg(F.sum("human_n").alias("human_n"), F.sum("ai_n").alias("ai_n"), F.sum("hit_n").alias("hit_n"))
    )


def distribution_bias(counts: DataFrame) -> DataFrame:
    """Model count minus human count per label, largest gap first."""
    return (
        class_totals(counts)
        .select(
            "label",
            F.col("human_n").alias("human_count"),
            F.col("ai_n").alias("ai_count"),
            (F.col("ai_n") - F.col("human_n")).alias("diff"),
        )
        .orderBy(F.abs("diff").desc(), "label")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def classification_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; 0.0 where a denominator is 0."""
    metrics = class_totals(counts).select(
        "label",
        _ratio(F.col("hit_n"), F.col("ai_n")).alias("precision"),
        _ratio(F.col("hit_n"), F.col("human_n")).alias("recall"),
        F.col("human_n").alias("support"),
        "hit_n",
    )
    p, r = F.col("precision"), F.col("recall")
    return metrics.withColumn("f1", _ratio(2 * p * r, p + r))


def report_summary(report: DataFrame) -> DataFrame:
    """Accuracy, macro averages over all labels, and F1 weighted by support."""
    support = F.sum("support")
    return report.agg(
        _ratio(F.sum("hit_n"), support).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), support).alias("weighted_f1"),
        support.alias("total"),
    )


def article_rollup(rows: DataFrame, labels: dict[str, Column], sums: dict[str, Column], order: Column) -> DataFrame:
    """Per article: the sums, and for each named label column its most frequent value.

    One pass over the rows. Each row turns into one entry per label plus one entry that
    carries the numbers; entries are counted per (article, kind, label) with map-side
    combining, so an article holding a third of all rows is reduced before it is shuffled.
    Ties go to the label seen first in ``order``.
    """
    nothing = [F.lit(None).cast("long").alias(name) for name in sums]
    entries = [
        F.struct(
            F.lit("").alias("kind"),
            F.lit(None).cast("string").alias("label"),
            *[value.cast("long").alias(name) for name, value in sums.items()],
        )
    ] + [F.struct(F.lit(kind).alias("kind"), value.alias("label"), *nothing) for kind, value in labels.items()]
    wanted = (F.col("kind") == "") | F.col("label").isNotNull()
    counted = (
        rows.select("article_url", order.alias("seen"), F.inline(F.array(*entries)))
        .filter(wanted)
        .groupBy("article_url", "kind", "label")
        .agg(
            F.count("*").alias("n"),
            F.min("seen").alias("seen"),
            *[F.sum(name).alias(name) for name in sums],
        )
    )
    rank = F.struct((-F.col("n")).alias("n"), "seen", "label")
    return counted.groupBy("article_url").agg(
        F.max(F.when(F.col("kind") == "", F.col("n"))).alias("rows"),
        *[F.max(F.when(F.col("kind") == "", F.col(name))).alias(name) for name in sums],
        *[
            F.coalesce(F.min(F.when(F.col("kind") == kind, rank))["label"], F.lit(NOT_AVAILABLE)).alias(kind)
            for kind in labels
        ],
    )


def with_coordinates(per_article: DataFrame, articles: DataFrame) -> DataFrame:
    """Left join after the rollup, so each article is one row on both sides and cannot skew."""
    places = articles.select(F.col("url").alias("article_url"), "coord")
    return (
        per_article.join(places, "article_url", "left")
        .withColumn("lon", longitude(F.col("coord")))
        .withColumn("lat", latitude(F.col("coord")))
    )


def article_agreement(revisions: DataFrame, articles: DataFrame, article_url: str | None = None) -> DataFrame:
    """Agreement, sample sizes, dominant labels and mean score of every labelled article."""
    rows = labelled(revisions, article_url)
    both, same, labels = {}, {}, {}
    for kind, names in PAIRS.items():
        human, ai = (F.col(c) for c in names)
        both[kind] = present(human) & present(ai)
        same[kind] = both[kind] & (strip(human) == strip(ai))
        labels[f"dominant_human_{kind}"] = F.when(both[kind], strip(human))
        labels[f"dominant_ai_{kind}"] = F.when(both[kind], strip(ai))
    score = F.col("bias_score_after")
    sums = {
        "topic_hits": F.when(same["topic"], 1),
        "topic_n": F.when(both["topic"], 1),
        "stance_hits": F.when(same["stance"], 1),
        "stance_n": F.when(both["stance"], 1),
        "score_sum": micro(score),
        "score_n": F.when(score.isNotNull(), 1),
    }
    per_article = article_rollup(rows, labels, sums, F.col("id"))

    def share(top: str, bottom: str) -> Column:
        return F.coalesce(_ratio(F.coalesce(F.col(top), F.lit(0)), F.col(bottom)), F.lit(0.0))

    def samples(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    return with_coordinates(per_article, articles).select(
        "article_url",
        "lon",
        "lat",
        share("topic_hits", "topic_n").alias("topic_agreement"),
        samples("topic_n").alias("topic_samples"),
        share("stance_hits", "stance_n").alias("stance_agreement"),
        samples("stance_n").alias("stance_samples"),
        "dominant_human_topic",
        "dominant_ai_topic",
        "dominant_human_stance",
        "dominant_ai_stance",
        exact_mean(F.col("score_sum"), F.col("score_n")).alias("avg_bias_score"),
    )
