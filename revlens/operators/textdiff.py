"""Differences between adjacent revisions.

``revision_pairs`` shuffles each text once, by (article, bucket). Sentence edits are found
inside the row; node edits group by (article, bucket, rev_seq, ...), which needs no further
exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import markup
from revlens.functions.text import run_starts, sentences, with_context_window, words
from revlens.operators.sequence import BUCKET_WIDTH, with_previous

REV = ["article", "bucket", "rev_seq"]
# Text edits are numbered after all node edits of their revision. A text has fewer than 2^31
# characters, so neither kind reaches 2^31 and the two never meet.
TEXT_EDITS_FROM = 1 << 31
_ORDINAL_BITS = 32


def revision_pairs(revisions: DataFrame, width: int = BUCKET_WIDTH) -> DataFrame:
    """(article, bucket, rev_seq, previous, current, ...); the oldest revision pairs with ''.

    Input: (article, rev_seq, text, ...), ``rev_seq`` dense and growing with time.
    """
    return with_previous(revisions, "article", "rev_seq", "text", width).withColumnRenamed("text", "current")


def prose(text: Column) -> Column:
    """The text without templates and references, whose changes are node edits."""
    bare = F.when(
        F.contains(text, F.lit("<ref")), F.regexp_replace(text, r"(?is)<ref[^>/]*>.*?</ref>|<ref[^>]*/>", "")
    ).otherwise(text)
    return markup.without_templates(bare)


def _similar(a: Column, b: Column) -> Column:
    """Token sets overlap by at least half (Jaccard)."""
    wa, wb = words(a), words(b)
    return F.size(F.array_intersect(wa, wb)) * 2 >= F.size(F.array_union(wa, wb))


def _change(kind: str, before: Column, after: Column, desc: str) -> Column:
    return F.struct(
        F.lit(f"Text:Sentence:{kind}").alias("change_type"),
        before.alias("diff_before"),
        after.alias("diff_after"),
        F.lit(desc).alias("change_desc"),
    )


def sentence_edits(pairs: DataFrame) -> DataFrame:
    """Sentences inserted, removed and changed by each revision.

    Sentences are counted +1 in the new and -1 in the old text; what does not cancel is an
    edit. The k-th removed and the k-th inserted sentence of a revision are one change when
    half their tokens agree; a change stores the new text on both sides.
    """

    def side(listed: Column, sign: int) -> Column:
        return F.transform(
            listed, lambda s, i: F.struct(s.alias("sentence"), F.lit(sign).alias("sign"), i.alias("pos"))
        )

    def repeats(listed: Column) -> Column:
        return F.size(F.array_distinct(listed)) < F.size(listed)

    old, new = F.col("old"), F.col("new")
    listed = pairs.filter(F.col("previous") != F.col("current")).select(
        *REV, sentences(prose(F.col("previous"))).alias("old"), sentences(prose(F.col("current"))).alias("new")
    )
    # Only where a text repeats a sentence its copies are counted: sorted, then run by run. All stays in the row.
    entries = F.when(repeats(old) | repeats(new), F.array_sort(F.concat(side(old, -1), side(new, 1))))
    sorted_ = listed.withColumn("entries", entries).withColumn(
        "starts", run_starts(F.col("entries"), lambda e: F.struct(e["sentence"], e["sign"]))
    )

    def run(s: Column, k: Column) -> Column:
        first = F.get("entries", s)
        n = F.coalesce(F.get("starts", k + 1), F.size("entries")) - s
        return F.struct(
            first["sentence"].alias("sentence"), first["sign"].alias("sign"), first["pos"].alias("pos"), n.alias("n")
        )

    runs = sorted_.withColumn("runs", F.transform("starts", run))

    def copies(sign: int) -> Column:
        """Sentences one side has more often, at their first place there; the other side's run is a neighbour."""

        def surplus(e: Column, k: Column) -> Column:
            other = F.get("runs", k - sign)
            n = e["n"] - F.when(other["sentence"] == e["sentence"], other["n"]).otherwise(0)
            return F.struct(e["pos"].alias("pos"), e["sentence"].alias("sentence"), F.when(e["sign"] == sign, n).alias("n"))

        more = F.filter(F.transform("runs", surplus), lambda e: e["n"] > 0)
        return F.flatten(F.transform(F.array_sort(more), lambda e: F.array_repeat(e["sentence"], e["n"])))

    once = F.col("entries").isNull()
    per_revision = runs.select(
        *REV,
        F.when(once, F.array_except(new, old)).otherwise(copies(1)).alias("added"),
        F.when(once, F.array_except(old, new)).otherwise(copies(-1)).alias("removed"),
    )
    empty = F.lit("")

    def edits(came: Column, went: Column) -> Column:
        insert = _change("Insert", empty, came, "Inserted Sentence")
        remove = _change("Remove", went, empty, "Removed Sentence")
        change = _change("Change", came, came, "Changed Sentence")
        return (
            F.when(went.isNull(), F.array(insert))
            .when(came.isNull(), F.array(remove))
            .when(_similar(came, went), F.array(change))
            .otherwise(F.array(insert, remove))
        )

    changes = F.flatten(F.zip_with("added", "removed", edits))
    return per_revision.select(*REV, F.posexplode(changes).alias("at", "c")).select(
        *REV, (F.col("at").cast("long") + F.lit(TEXT_EDITS_FROM)).alias("change_seq"), "c.*"
    )


def node_edits(pairs: DataFrame) -> DataFrame:
    """Changed fields of templates, links and references; whole nodes coming or going yield nothing.

    Nodes equal on both sides cancel. What is left is matched by (kind, name) in order of
    appearance; links still alone are matched in order as a changed title, templates and
    references still alone as a changed name when their bodies are equal. All steps group by
    (article, bucket, rev_seq, ...), so none of them moves a row.
    """
    kind, name = F.col("kind"), F.col("name")

    def side(text: Column, sign: int) -> Column:
        return F.transform(
            markup.nodes(text),
            lambda n, i: F.struct(
                n["kind"].alias("kind"),
                n["name"].alias("name"),
                n["body"].alias("body"),
                F.lit(sign).alias("sign"),
                i.alias("pos"),
            ),
        )

    leftover = (
        pairs.filter((F.col("previous") != F.col("current")) & markup.may_hold_nodes(F.col("previous")))
        .select(*REV, F.inline(F.concat(side(F.col("previous"), -1), side(F.col("current"), 1))))
        .groupBy(*REV, "kind", "name", "body")
        .agg(F.sum("sign").alias("net"), F.min("pos").alias("pos"))
        .filter(F.col("net") != 0)
    )
    node = F.struct("pos", "name", "body")

    def zipped(df: DataFrame, olds: Column, news: Column, *keys: str) -> DataFrame:
        """k-th old node beside the k-th new node of each group."""
        sides = df.groupBy(*REV, *keys).agg(olds.alias("olds"), news.alias("news"))
        rows = sides.select(*REV, *keys, F.posexplode(F.arrays_zip("olds", "news")).alias("k", "m"))
        return rows.select(*REV, *keys, "k", F.col("m.olds").alias("old"), F.col("m.news").alias("new"))

    def copies(wanted: Column) -> Column:
        entry = F.struct(node.alias("node"), F.abs("net").cast("int").alias("n"))
        listed = F.sort_array(F.collect_list(F.when(wanted, entry)))
        return F.flatten(F.transform(listed, lambda e: F.array_repeat(e["node"], e["n"])))

    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    by_name = zipped(leftover, copies(F.col("net") < 0), copies(F.col("net") > 0), "kind", "name")
    # A pair found by name keeps a group of its own; nodes still alone meet by what else they share.
    lone_key = F.when(kind == "Wikilink", F.lit("")).otherwise(F.coalesce("old.body", "new.body"))
    regrouped = by_name.select(
        *REV, "kind", "old", "new",
        both.alias("same_name"),
        F.when(both, F.concat_ws("\u0000", name, F.col("k").cast("string"))).otherwise(lone_key).alias("meet"),
    )
    matched = zipped(
        regrouped, F.sort_array(F.collect_list("old")), F.sort_array(F.collect_list("new")), "kind", "same_name", "meet"
    ).filter(both)

    def value(field: str, part: Column, sign: int, i: Column, text: Column) -> Column:
        return F.struct(
            F.lit(field).alias("field"), part.alias("part"), F.lit(sign).alias("sign"), i.alias("i"), text.alias("value")
        )

    def whole(field: str, of: str) -> Column:
        none, first = F.lit(""), F.lit(0)
        return F.array(
            value(field, none, -1, first, F.col(f"old.{of}")), value(field, none, 1, first, F.col(f"new.{of}"))
        )

    def parts(of: str, sign: int) -> Column:
        return F.transform(
            markup.template_parts(F.col(of)), lambda p, i: value("parameter", p["key"], sign, i, p["value"])
        )

    values = (
        F.when(kind == "Wikilink", F.concat(whole("title", "name"), whole("text", "body")))
        .when(~F.col("same_name"), whole("name", "name"))
        .when(kind == "Reference", whole("content", "body"))
        .otherwise(F.concat(parts("old.body", -1), parts("new.body", 1)))
    )

    def last(sign: int) -> Column:
        # A part given twice counts with its last value.
        return F.coalesce(F.max(F.when(F.col("sign") == sign, F.struct("i", "value")))["value"], F.lit(""))

    edits = (
        matched.select(
            *REV, F.col("new.pos").alias("pos"), "k", "kind", F.col("old.name").alias("name"), F.inline(values)
        )
        .groupBy(*REV, "pos", "k", "kind", "name", "field", "part")
        .agg(last(-1).alias("before"), last(1).alias("after"))
        .filter(F.col("before") != F.col("after"))
        .groupBy(*REV)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("pos", "k", "field", "part", "kind", "name", "before", "after"))
            ).alias("edits")
        )
    )
    return edits.select(*REV, F.posexplode("edits").alias("change_seq", "e")).select(
        *REV,
        F.col("change_seq").cast("long").alias("change_seq"),
        F.concat_ws(":", F.lit("Node"), "e.kind", "e.field").alias("change_type"),
        F.col("e.before").alias("diff_before"),
        F.col("e.after").alias("diff_after"),
        F.concat_ws(" ", "e.kind", "e.name", F.lit("changed"), "e.field").alias("change_desc"),
    )


def structured_changes(pairs: DataFrame) -> DataFrame:
    """Node edits, then sentence edits, of every revision."""
    return node_edits(pairs).unionByName(sentence_edits(pairs))


def change_order(rev_seq: Column, change_seq: Column) -> Column:
    """One sortable number per change of an article: newest revision first, then edit order."""
    return F.shiftleft(-rev_seq.cast("long"), _ORDINAL_BITS) + change_seq.cast("long")


def with_context(changes: DataFrame, pairs: DataFrame, *carried: str) -> DataFrame:
    """Add ``content``: the changed text with its surroundings in the new revision.

    ``carried`` names further columns of the revision to take along.
    """
    texts = pairs.select(*REV, "previous", "current", *carried)
    joined = changes.join(texts, REV)
    sides = (F.col(c) for c in ("diff_before", "diff_after", "current", "previous"))
    return with_context_window(joined, "content", *sides).drop("previous", "current")
