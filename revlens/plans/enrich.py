"""From raw revisions to scored, deduplicated, classified changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.markup import plain_text
from revlens.functions.scores import is_material, label_or_default, score_or_default
from revlens.functions.web import is_ip
from revlens.operators import dedup, scoring, textdiff
from revlens.schema import REVISIONS
from revlens.session import written_table


def clean_changes(revisions: DataFrame) -> DataFrame:
    """Structured changes with context and plain texts; changes without any plain text drop out.

    Input: (article, rev_seq, revid, user, timestamp, text).
    """
    pairs = textdiff.revision_pairs(revisions)
    changes = textdiff.with_context(textdiff.structured_changes(pairs), pairs, "revid", "user", "timestamp")
    cleaned = changes.withColumns(
        {"clean_before": plain_text(F.col("diff_before")), "clean_after": plain_text(F.col("diff_after"))}
    ).filter((F.col("clean_before") != "") | (F.col("clean_after") != ""))
    return cleaned.withColumn("change_ord", textdiff.change_order(F.col("rev_seq"), F.col("change_seq")))


def score_changes(changes: DataFrame, scorer: scoring.Scorer) -> DataFrame:
    """Bias score and label of both plain texts, and their difference."""
    scores = written_table(scorer(scoring.distinct_texts(changes, "clean_before", "clean_after")), "scores")
    both = scoring.with_probabilities(changes, scores, "clean_before", "p_before")
    both = scoring.with_probabilities(both, scores, "clean_after", "p_after")
    scored = both
    for side in ("before", "after"):
        text, probs = F.col(f"clean_{side}"), F.col(f"p_{side}")
        scored = scored.withColumn(f"bias_score_{side}", score_or_default(text, probs)).withColumn(
            f"bias_label_{side}", label_or_default(text, probs)
        )
    return scored.drop("p_before", "p_after").withColumn(
        "bias_delta", F.col("bias_score_after") - F.col("bias_score_before")
    )


def material_changes(scored: DataFrame) -> DataFrame:
    return scored.filter(is_material(F.col("bias_score_before"), F.col("bias_score_after")))


def enrich(
    revisions: DataFrame,
    bias: scoring.Scorer,
    topic: scoring.Scorer,
    stance: scoring.Scorer,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Rows of the revision table for all changes worth keeping.

    Each costly stage ends in a written table: texts are compared once, the bias scorer sees
    each distinct text once, and the topic and stance scorers see only changes that passed
    the gate and the duplicate check.
    """
    changes = written_table(clean_changes(revisions), "changes")
    gated = written_table(material_changes(score_changes(changes, bias)), "gated", "zstd")
    seen = None if stored is None else dedup.seen_texts(stored.withColumnRenamed("article_url", "article"))
    named = written_table(dedup.saved_with_id(gated.withColumnRenamed("revid", "original_revid"), seen), "saved")
    contexts = scoring.distinct_texts(named, "content")
    for column, scorer in (("ai_topic", topic), ("ai_political_stance", stance)):
        named = scoring.with_best_label(named, scorer(contexts), "content", column)
    nothing = F.lit(None).cast("string")
    return named.withColumns(
        {"is_ip": is_ip(F.col("user")), "manual_bias": nothing, "manual_topic": nothing}
    ).withColumnRenamed("article", "article_url").select(*[f.name for f in REVISIONS.fields])
