"""Text expressions. All stay in the JVM; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (?U) lets \s cover no-break space and other Unicode blanks; trim() knows only U+0020.
_BLANKS = r"(?U)\s+"
_EDGE_BLANKS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_BLANKS, "")


def non_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def present(c: Column) -> Column:
    """Label present: neither NULL nor empty. A label of blanks counts as present."""
    return c.isNotNull() & (c != "")


def chosen_text(before: Column, after: Column) -> Column:
    """The text a change is known by: after unless blank, else before; untrimmed."""
    return F.when(non_blank(after), after).otherwise(before)


def month_key(ts: Column) -> Column:
    return F.substring(ts, 1, 7)


def usable_timestamp(ts: Column) -> Column:
    return F.length(ts) >= 7


def event_date(ts: Column) -> Column:
    """Calendar date of an ISO timestamp; NULL unless it starts with a full date."""
    return F.when(ts.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(F.try_to_timestamp(ts)))


def parse_day(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd")


def words(c: Column) -> Column:
    """Split on runs of Unicode white space, no empty entries."""
    return F.array_remove(F.split(c, _BLANKS), "")


def run_starts(listed: Column, key=lambda e: e) -> Column:
    """Places in a sorted array where elements with a new key begin; none for NULL."""

    def new(i: Column) -> Column:
        return (i == 0) | (key(F.get(listed, i)) != key(F.get(listed, i - 1)))

    some = F.filter(F.sequence(F.lit(0), F.size(listed) - 1), new)
    return F.when(F.size(listed) > 0, some).otherwise(F.array().cast("array<int>"))


def chart_label(c: Column) -> Column:
    return F.when(F.length(c) > 10, F.concat(F.substring(c, 1, 10), F.lit(".."))).otherwise(c)


def highlight(content: Column, target: Column, opening: str = "[+", closing: str = "+]") -> Column:
    """Mark every occurrence of the target; an empty target leaves the content alone."""
    marked = F.replace(content, target, F.concat(F.lit(opening), target, F.lit(closing)))
    return F.when((content == "") | (target == ""), content).otherwise(marked)


def changed_line(content: Column, target: Column) -> Column:
    """0-based index of the first line holding the target; NULL when no single line does."""
    at = F.position(target, content)
    head = F.substring(content, F.lit(1), at - 1)
    newlines = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.when((target != "") & (at > 0) & ~F.contains(target, F.lit("\n")), newlines)


def _pieces(text: Column, needle: Column) -> Column:
    """The text cut at every non-overlapping literal occurrence of the needle."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.split(text, quoted)


def _found(text: Column, needle: Column) -> Column:
    return (needle != "") & F.contains(text, needle)


def positions(text: Column, needle: Column) -> Column:
    """0-based start of every non-overlapping literal occurrence."""
    pieces = _pieces(text, needle)
    walked = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("out")),
        lambda acc, piece: F.struct(
            (acc["next"] + F.length(piece) + F.length(needle)).alias("next"),
            F.array_append(acc["out"], acc["next"] + F.length(piece)).alias("out"),
        ),
    )["out"]
    return F.when(_found(text, needle), walked).otherwise(F.array().cast("array<int>"))


def nearest_position(text: Column, needle: Column, hint: Column) -> Column:
    """0-based occurrence nearest to ``hint``, earliest on ties; the first one when hint is NULL.

    One pass with constant state, so a needle found a million times is no problem.
    """
    first = F.position(needle, text) - 1
    pieces = _pieces(text, needle)
    # The hint travels in the state, so that it is computed once and not per occurrence.
    best = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.struct(F.lit(0).alias("next"), F.lit(None).cast("int").alias("best"), hint.alias("hint")),
        lambda acc, piece: F.struct(
            (acc["next"] + F.length(piece) + F.length(needle)).alias("next"),
            F.when(
                acc["best"].isNull()
                | (F.abs(acc["next"] + F.length(piece) - acc["hint"]) < F.abs(acc["best"] - acc["hint"])),
                acc["next"] + F.length(piece),
            )
            .otherwise(acc["best"])
            .alias("best"),
            acc["hint"].alias("hint"),
        ),
    )["best"]
    several = F.position(needle, text, first + 1 + F.length(needle)) > 0
    return F.when(_found(text, needle), F.when(hint.isNotNull() & several, best).otherwise(first))


def with_context_window(
    df: DataFrame, name: str, before: Column, after: Column, content: Column, previous: Column
) -> DataFrame:
    """Add the changed text with one length to its left and one to its right, cut at the borders.

    Of several places the one nearest to the old place of ``before`` counts. In steps, so
    that each search through a text runs once.
    """
    hint = F.when(non_blank(before) & _found(previous, before), F.position(before, previous) - 1)
    size, at = F.length(after), F.col("_at")
    start = F.greatest(F.lit(0), at - size)
    end = F.least(F.length(content), at + 2 * size)
    window = F.substring(content, start + 1, end - start)
    return (
        df.withColumn("_hint", hint)
        .withColumn("_at", F.when(non_blank(after), nearest_position(content, after, F.col("_hint"))))
        .withColumn(name, F.when(at.isNotNull(), window).otherwise(chosen_text(before, after)))
        .drop("_hint", "_at")
    )


def sentences(c: Column) -> Column:
    """Sentences in order: lines, cut again after . ! ? with a blank and after full-width stops."""
    marked = F.regexp_replace(c, r"([.!?])\s+", "$1\n")
    marked = F.regexp_replace(marked, "([。！？])", "$1\n")
    trimmed = F.transform(F.split(marked, "\n"), lambda s: F.trim(s))
    return F.array_remove(trimmed, "")


def text_key(c: Column) -> Column:
    """Collision-resistant stand-in for a long text in shuffles and joins."""
    return F.sha2(c, 256)
