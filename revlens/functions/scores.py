"""Expressions over class probabilities and bias scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions.text import non_blank
from revlens.schema import DELTA_GATE, NEUTRAL, SCORE_GATE


def bias_score(probs: Column) -> Column:
    """Half the slight class plus the high class; both label namings are understood."""

    def p(name: str, alias: str) -> Column:
        return F.coalesce(F.try_element_at(probs, F.lit(name)), F.try_element_at(probs, F.lit(alias)), F.lit(0.0))

    return p("Slightly Biased", "LABEL_1") * 0.5 + p("Highly Biased", "LABEL_2") * 1.0


def best_label(probs: Column) -> Column:
    """Label of the highest probability, the first one on ties."""
    ranked = F.transform(
        F.map_entries(probs),
        lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("pos"), e["key"].alias("label")),
    )
    return F.array_max(ranked)["label"]


def score_or_default(text: Column, probs: Column) -> Column:
    return F.when(non_blank(text), F.coalesce(bias_score(probs), F.lit(0.0))).otherwise(F.lit(0.0))


def label_or_default(text: Column, probs: Column, default: str = NEUTRAL) -> Column:
    return F.when(non_blank(text), F.coalesce(best_label(probs), F.lit(default))).otherwise(F.lit(default))


def is_material(before: Column, after: Column) -> Column:
    """Worth keeping: the score moved by more than 0.1, or ends above 0.3 (both strict)."""
    return (F.abs(after - before) > DELTA_GATE) | (after > SCORE_GATE)


def delta_direction(delta: Column) -> Column:
    return F.when(delta > DELTA_GATE, "up").when(delta < -DELTA_GATE, "down").otherwise("flat")


def score_bin(score: Column, bins: int = 5) -> Column:
    """Bin index, truncated towards zero and clamped to the first and last bin."""
    clamped = F.greatest(F.lit(0.0), F.least(score * bins, F.lit(bins - 1.0)))
    return F.when(score.isNotNull(), clamped.cast("int"))


def micro(score: Column) -> Column:
    """A score in millionths, whole, so that sums do not depend on the order of rows."""
    return F.round(score * 1_000_000).cast("long")


def exact_mean(millionths: Column, n: Column) -> Column:
    """Mean of n scores from the sum of their millionths, rounded half away from zero to four places; 0 for none."""
    total, size = F.coalesce(millionths, F.lit(0)).cast("long"), F.coalesce(n, F.lit(0)).cast("long")
    half = F.when(total < 0, -100 * size).otherwise(100 * size)
    return F.when(size > 0, F.call_function("div", 2 * total + half, 200 * size) / 10_000).otherwise(0.0)
