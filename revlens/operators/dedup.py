"""Keep a change only if no earlier kept change of its article holds the same text.

The rule looks sequential: a change is skipped when its text equals the before- or after-
text of a change that was itself kept. It is computed in three parallel steps.

1. Of equal texts in an article the first stays.
2. A survivor ``c`` is skipped iff an earlier *kept* survivor has ``c``'s text as its
   before-text. Each survivor has one before-text, so these dependencies form trees.
3. The trees are evaluated by rounds that both resolve nodes whose inputs are known and
   halve every unbranched chain, so a chain of a million reverts takes about twenty rounds.

Texts never take part: rows carry (article, order number, two digests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.functions.text import chosen_text, non_blank, text_key
from revlens.session import cut_lineage, written_table


def digest(c: Column) -> Column:
    """128 bits of SHA-256 in 16 bytes; all of it in digits would take 64 in every shuffle."""
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def change_keys(changes: DataFrame, *carried: str) -> DataFrame:
    """(article, change_ord, own, old, *carried): digests of the chosen text and of the before-text.

    A chosen text is never blank, so a blank before-text cannot rule anything out: its digest
    is NULL, and the many pure insertions do not meet on one join key.
    """
    before, after = F.col("diff_before"), F.col("diff_after")
    return changes.select(
        "article",
        "change_ord",
        digest(chosen_text(before, after)).alias("own"),
        F.when(non_blank(before), digest(before)).alias("old"),
        *carried,
    )


def first_of_text(keys: DataFrame, *carried: str) -> DataFrame:
    """Step 1. Combines before the shuffle, so a text repeated everywhere costs little."""
    return (
        keys.groupBy("article", "own")
        .agg(F.min(F.struct("change_ord", "old", *carried)).alias("first"))
        .select("article", "own", "first.change_ord", "first.old", *[f"first.{c}" for c in carried])
    )


def dependencies(survivors: DataFrame) -> DataFrame:
    """Step 2. (article, src, dst): if ``src`` is kept then ``dst`` is skipped."""
    earlier = survivors.select("article", F.col("old").alias("own"), F.col("change_ord").alias("src"))
    later = survivors.select("article", "own", F.col("change_ord").alias("dst"))
    return earlier.join(later, ["article", "own"]).filter(F.col("src") < F.col("dst")).select("article", "src", "dst")


def _flip(a: Column, b: Column) -> Column:
    return a != b


def skipped_changes(edges: DataFrame) -> DataFrame:
    """Step 3. (article, change_ord) of the changes the dependencies rule out.

    An edge delivers kept(src), inverted when ``flip`` is set; a node is kept iff all its
    inputs are false. A source with a single input is replaced by that input's source, with
    the inversion carried along, which doubles the reach of the edge each round.
    """
    edges = cut_lineage(edges.withColumn("flip", F.lit(False)))
    decided = None
    while not edges.isEmpty():
        inputs = edges.groupBy("article", F.col("dst").alias("src")).agg(
            F.count("*").alias("n"), F.min("src").alias("far"), F.bool_or("flip").alias("far_flip")
        )
        known = edges.join(inputs, ["article", "src"], "left")
        if decided is not None:
            state = decided.select("article", F.col("change_ord").alias("src"), "kept")
            known = known.join(state, ["article", "src"], "left")
        else:
            known = known.withColumn("kept", F.lit(None).cast("boolean"))
        # No state and no input: nothing earlier matters to the source, so it is kept.
        kept = F.coalesce(F.col("kept"), F.when(F.col("n").isNull(), F.lit(True)))
        single = kept.isNull() & (F.col("n") == 1)
        moved = known.select(
            "article",
            "dst",
            F.when(single, F.col("far")).otherwise(F.col("src")).alias("src"),
            F.when(single, _flip(_flip(F.col("flip"), F.col("far_flip")), F.lit(True)))
            .otherwise(F.col("flip"))
            .alias("flip"),
            _flip(kept, F.col("flip")).alias("input"),
        )
        moved = cut_lineage(moved)
        verdict = (
            moved.groupBy("article", F.col("dst").alias("change_ord"))
            .agg(
                F.coalesce(F.bool_or("input"), F.lit(False)).alias("hit"),
                F.count_if(F.col("input").isNull()).alias("open"),
            )
            .filter(F.col("hit") | (F.col("open") == 0))
            .select("article", "change_ord", (~F.col("hit")).alias("kept"))
        )
        verdict = cut_lineage(verdict)
        decided = verdict if decided is None else cut_lineage(decided.unionByName(verdict))
        done = verdict.select("article", F.col("change_ord").alias("dst"))
        edges = cut_lineage(
            moved.filter(F.col("input").isNull()).join(done, ["article", "dst"], "left_anti").drop("input")
        )
    if decided is None:
        return edges.select("article", F.col("dst").alias("change_ord"))
    return decided.filter(~F.col("kept")).select("article", "change_ord")


def seen_texts(stored: DataFrame) -> DataFrame:
    """(article, own): digests of all texts the stored changes hold on either side."""
    digests = F.array(*[F.when(non_blank(F.col(c)), text_key(F.col(c))) for c in ("diff_before", "diff_after")])
    return stored.select("article", F.explode(digests).alias("own")).filter(F.col("own").isNotNull()).distinct()


def not_seen(changes: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop changes whose text the article already holds."""
    own = text_key(chosen_text(F.col("diff_before"), F.col("diff_after")))
    return changes.withColumn("own", own).join(seen, ["article", "own"], "left_anti").drop("own")


def _winners(changes: DataFrame, seen: DataFrame | None, *carried: str) -> tuple[DataFrame, DataFrame]:
    """The changes that may be saved, and (article, change_ord, *carried) of those to save."""
    changes = changes.filter(non_blank(F.col("diff_before")) | non_blank(F.col("diff_after")))
    if seen is not None:
        changes = not_seen(changes, seen)
    # A written table: the joins below shuffle both sides, so that a key with many rows can be split.
    survivors = written_table(first_of_text(change_keys(changes, *carried), *carried), "survivors")
    skipped = skipped_changes(dependencies(survivors))
    winners = survivors.select("article", "change_ord", *carried).join(skipped, ["article", "change_ord"], "left_anti")
    return changes, winners


def saved_changes(changes: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The changes to save, all columns. Needs ``article``, ``change_ord`` and both texts.

    ``changes`` is read several times; pass a table or a checkpoint, not a long plan. Changes
    blank on both sides are never saved. ``seen`` holds the texts saved by earlier runs.
    """
    changes, winners = _winners(changes, seen)
    return changes.join(winners, ["article", "change_ord"], "left_semi")


def _ordinal(revid: str) -> Column:
    """Place among the saved changes of one revision, from 1."""
    return F.row_number().over(W.partitionBy("article", revid).orderBy("change_ord"))


def _row_id(revid: str, ordinal: Column) -> Column:
    return F.format_string("%d-%04d", F.col(revid), ordinal)


def with_row_id(saved: DataFrame, revid: str = "original_revid") -> DataFrame:
    """Id ``<revid>-<4 digits>``: ordinal among the saved changes of one revision."""
    return saved.withColumn("id", _row_id(revid, _ordinal(revid)))


def saved_with_id(changes: DataFrame, seen: DataFrame | None = None, revid: str = "original_revid") -> DataFrame:
    """``with_row_id`` of ``saved_changes``, for order numbers that an article has once.

    Rows without texts are numbered, so the texts move once, for the join with them.
    """
    changes, winners = _winners(changes, seen, revid)
    numbered = winners.select("article", "change_ord", _ordinal(revid).alias("_ordinal"))
    joined = changes.join(numbered, ["article", "change_ord"])
    return joined.withColumn("id", _row_id(revid, F.col("_ordinal"))).drop("_ordinal")
