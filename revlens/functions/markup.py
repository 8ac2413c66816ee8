"""Wiki markup: plain text, and the nodes (templates, links, references) of a text.

Grammar of this module
* A template is ``{{name|part|key=part}}``. Closing braces close the nearest opening ones, so
  nesting has no limit (see ``braces``). They come in the order in which they close. Inside an outer template an
  inner one stays visible by name only, as ``{{name}}``; a name that holds a template itself is
  shown there up to that one.
* A link is ``[[title]]`` or ``[[title|text]]``.
* A reference is ``<ref ...>text</ref>``; its name is the value of the ``name`` attribute.
* Anything left open is plain text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions import braces
from revlens.functions.text import strip

# Stand-in for bars that belong to a link. Where the text holds it or the escape itself, these
# are written as the escape and a letter meanwhile.
_BAR, _ESCAPE = "\u0003", "\u0004"
_ESCAPED = {_ESCAPE: "e", _BAR: "b"}


def _templated(text: Column) -> Column:
    """False only when the text holds no closed template. A cheap test before the pieces are cut."""
    return F.contains(text, F.lit("{{")) & F.contains(text, F.lit("}}"))


def template_depth(text: Column) -> Column:
    """Deepest nesting of closed templates in the text, 0 when it holds none."""
    return F.when(_templated(text), braces.depth(text)).when(text.isNotNull(), 0)


def without_templates(text: Column) -> Column:
    return F.when(_templated(text), braces.without(text)).otherwise(text)


def plain_text(text: Column) -> Column:
    """Text a reader sees: references, templates and tags gone, links reduced to their label."""
    t = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<ref[^>/]*/>", "")
    t = F.regexp_replace(t, r"(?is)<ref[^>]*>.*?</ref>", "")
    t = without_templates(t)
    t = F.regexp_replace(t, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[\[([^\[\]|]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[[a-z]+://[^\s\]]+\s+([^\]]*)\]", "$1")
    t = F.regexp_replace(t, r"'{2,5}", "")
    t = F.regexp_replace(t, r"<[^<>]*>", "")
    # None of the patterns can match a text without these characters.
    return strip(F.when(text.rlike(r"[<{\[]|''"), t).otherwise(text))


def escaped(text: Column) -> Column:
    """Free the character of the stand-in."""
    out = text
    for char, letter in _ESCAPED.items():
        out = F.replace(out, F.lit(char), F.lit(_ESCAPE + letter))
    return F.when(text.rlike("[\u0003\u0004]"), out).otherwise(text)


def shown(text: Column) -> Column:
    """Turn the stand-in back into a bar, then the escaped characters into themselves."""
    back = F.replace(text, F.lit(_BAR), F.lit("|"))
    for char, letter in reversed(_ESCAPED.items()):
        back = F.replace(back, F.lit(_ESCAPE + letter), F.lit(char))
    return back


def templates(text: Column) -> Column:
    """array<struct<kind, name, body>>; body is what follows the first bar."""
    found = F.when(_templated(text), braces.parts(text)).otherwise(F.array().cast("array<struct<name: string, body: string>>"))
    return F.transform(
        found, lambda t: F.struct(F.lit("Template").alias("kind"), strip(t["name"]).alias("name"), t["body"].alias("body"))
    )


def links(text: Column) -> Column:
    pattern = r"\[\[([^\[\]|]*)\|?([^\[\]]*)\]\]"
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda t: F.struct(
            F.lit("Wikilink").alias("kind"),
            strip(F.regexp_extract(t, pattern, 1)).alias("name"),
            strip(F.regexp_extract(t, pattern, 2)).alias("body"),
        ),
    )


def references(text: Column) -> Column:
    pattern = r"(?is)<ref([^>/]*)>(.*?)</ref>"
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda t: F.struct(
            F.lit("Reference").alias("kind"),
            F.regexp_extract(F.regexp_extract(t, pattern, 1), r"name\s*=\s*[\"']?([^\"'>]*)", 1).alias("name"),
            F.regexp_extract(t, pattern, 2).alias("body"),
        ),
    )


def nodes(text: Column) -> Column:
    """Every template, link and reference of the text, in that order."""
    return F.concat(templates(text), links(text), references(text))


def may_hold_nodes(text: Column) -> Column:
    """False only when the text holds no node at all. A cheap test before the patterns run."""
    return F.contains(text, F.lit("{{")) | F.contains(text, F.lit("[[")) | F.lower(text).contains("<ref")


def template_parts(body: Column) -> Column:
    """array<struct<key, value>> of a template body; parts without '=' are keyed by position."""
    free = escaped(body)
    # Bars inside a link do not separate parts: hide them, cut, show them again.
    hidden = F.aggregate(
        F.regexp_extract_all(free, F.lit(r"\[\[[^\[\]]*\|[^\[\]]*\]\]"), F.lit(0)),
        free,
        lambda acc, link: F.replace(acc, link, F.replace(link, F.lit("|"), F.lit(_BAR))),
    )
    parts = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(hidden, r"\|"))
    return F.transform(
        parts,
        lambda p, i: F.when(
            F.contains(p, F.lit("=")),
            F.struct(
                shown(strip(F.substring_index(p, "=", 1))).alias("key"),
                shown(strip(F.substring(p, F.position(F.lit("="), p) + 1, F.length(p)))).alias("value"),
            ),
        ).otherwise(
            F.struct((i + 1).cast("string").alias("key"), shown(strip(p)).alias("value"))
        ),
    )
