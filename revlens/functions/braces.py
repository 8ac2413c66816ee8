"""Closed templates of a text by array functions: prefix sums of braces, partners by sorting.

A text is cut into pieces: pairs of braces, single braces and what stands between. The running
sum of +1 for ``{{`` and -1 for ``}}`` gives each piece a depth; sorted by (depth, place), an
opening pair stands right before the pair that closes it, with the direct content of the
template in between. A single brace belongs to no template, and no template reaches over one,
so partners must have the same number of single braces before them. Sums are built by doubling:
time grows with n log n, not with the depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Running sums hold the depth in the low and the number of single braces in the high 32 bits.
_SINGLE = 1 << 32
_HALF = 1 << 31


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of an array<bigint> up to each place."""

    def doubled(sums: Column, k: Column) -> Column:
        by = F.pow(F.lit(2.0), k).cast("int")
        shifted = F.concat(F.array_repeat(F.lit(0).cast("bigint"), by), F.slice(sums, F.lit(1), F.size(sums) - by))
        return F.zip_with(sums, shifted, lambda a, b: a + b)

    def summed(v: Column) -> Column:
        rounds = F.when(F.size(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1))
        return F.aggregate(F.coalesce(rounds, F.array().cast("array<int>")), v, doubled)

    return once(values, summed)


def _pieces(text: Column) -> Column:
    """array<string> that makes up the text: pairs of braces, single braces, other text."""

    def cut(run: Column) -> Column:
        n, first = F.length(run), F.substring(run, 1, 1)
        one = F.when(n % 2 == 1, F.array(first)).otherwise(F.array().cast("array<string>"))
        pairs = F.array_repeat(F.concat(first, first), F.floor(n / 2).cast("int"))
        return F.when(first == "{", F.concat(one, pairs)).when(first == "}", F.concat(pairs, one)).otherwise(F.array(run))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\{+|\}+|[^{}]+"), F.lit(0)), cut))


def _entry(depth: Column, at: Column, kind: Column, bars: Column, text: Column) -> Column:
    return F.struct(
        depth.alias("depth"), at.alias("at"), kind.cast("int").alias("kind"), bars.alias("bars"), text.alias("text")
    )


def _entries(pieces: Column) -> Column:
    """Pieces with depth, place, kind (1 opens, -1 closes, 0 neither) and single braces before them."""
    kind = lambda p: F.when(p == "{{", 1).when(p == "}}", -1).otherwise(0)
    steps = F.transform(pieces, lambda p: F.when(p.isin("{", "}"), F.lit(_SINGLE)).otherwise(kind(p)).cast("bigint"))

    def entry(p: Column, i: Column, sums: Column) -> Column:
        total = F.get(sums, i)
        bars = F.shiftright(total + F.lit(_HALF), 32)
        depth = total - F.shiftleft(bars, 32)
        return _entry(F.when(p == "}}", depth + 1).otherwise(depth), i, kind(p), bars, p)

    return once(running_sums(steps), lambda sums: F.transform(pieces, lambda p, i: entry(p, i, sums)))


def _partners(marks: Column) -> Column:
    """array<struct<a, b>>: neighbours in a sorted list of opening and closing entries that are one template."""
    beside = F.zip_with(F.slice(marks, F.lit(1), F.greatest(F.size(marks) - 1, F.lit(0))), F.slice(marks, F.lit(2), F.size(marks)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    fits = lambda m: (m["a"]["kind"] == 1) & (m["b"]["kind"] == -1) & (m["a"]["depth"] == m["b"]["depth"]) & (m["a"]["bars"] == m["b"]["bars"])
    return F.filter(beside, fits)


def _edges(entries: Column) -> Column:
    """array<struct<at, kind, n>>: both ends of each closed template by place, n templates open from there on."""
    pairs = once(F.sort_array(F.filter(entries, lambda e: e["kind"] != 0)), _partners)
    # a place and a kind in one number: the order of numbers is that of places
    coded = F.flatten(F.transform(pairs, lambda p: F.array(p["a"]["at"] * F.lit(2).cast("bigint") + 1, p["b"]["at"] * F.lit(2).cast("bigint"))))
    kind = lambda c: (c % 2) * 2 - 1

    def counted(codes: Column) -> Column:
        sums = running_sums(F.transform(codes, kind))
        return F.zip_with(codes, sums, lambda c, n: F.struct(F.shiftright(c, 1).cast("int").alias("at"), kind(c).alias("kind"), n.alias("n")))

    return once(F.sort_array(coded), counted)


def without(text: Column) -> Column:
    """The text without its closed templates."""

    def left(pieces: Column) -> Column:
        def gaps(edges: Column) -> Column:
            ends = F.concat(F.transform(F.filter(edges, lambda e: (e["kind"] == 1) & (e["n"] == 1)), lambda e: e["at"]), F.array(F.size(pieces)))
            starts = F.concat(F.array(F.lit(-1)), F.transform(F.filter(edges, lambda e: e["n"] == 0), lambda e: e["at"]))
            return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(pieces, a + 2, b - a - 1), ""))

        return F.array_join(once(once(_entries(pieces), _edges), gaps), "")

    return once(_pieces(text), left)


def depth(text: Column) -> Column:
    """The largest number of closed templates around one place."""
    edges = once(once(_pieces(text), _entries), _edges)
    return F.coalesce(F.array_max(F.transform(edges, lambda e: e["n"])), F.lit(0)).cast("int")


def parts(text: Column) -> Column:
    """array<struct<name, body>> of the closed templates in the order in which they close.

    A template inside shows as ``{{name}}``, its name cut before the first template it holds
    itself, so that each character is given at most twice.
    """

    def shown(pieces: Column) -> Column:
        def beginning(at: Column) -> Column:
            after = F.coalesce(F.get(pieces, at + 1), F.lit(""))
            return F.when(F.substring(after, 1, 1).isin("{", "}"), F.lit("")).otherwise(F.substring_index(after, "|", 1))

        def listed(entries: Column) -> Column:
            names = F.transform(
                F.filter(entries, lambda e: e["kind"] == 1),
                lambda e: _entry(e["depth"] - 1, e["at"], F.lit(2), e["bars"], F.concat(F.lit("{{"), beginning(e["at"]), F.lit("}}"))),
            )
            return once(F.sort_array(F.concat(entries, names)), cut)

        return once(_entries(pieces), listed)

    def cut(rows: Column) -> Column:
        marks = F.filter(
            F.transform(rows, lambda e, i: F.struct(e["depth"].alias("depth"), e["at"].alias("at"), e["kind"].alias("kind"), e["bars"].alias("bars"), i.alias("i"))),
            lambda m: F.abs(m["kind"]) == 1,
        )

        def template(pair: Column) -> Column:
            inner = F.slice(rows, pair["a"]["i"] + 2, pair["b"]["i"] - pair["a"]["i"] - 1)
            named = lambda name, body: F.struct(pair["b"]["at"].alias("at"), name.alias("name"), body.alias("body"))
            joined = lambda some: F.array_join(F.transform(some, lambda e: e["text"]), "")

            def split(inner: Column) -> Column:
                bar = F.array_position(F.transform(inner, lambda e: (e["kind"] == 0) & F.contains(e["text"], F.lit("|"))), F.lit(True)).cast("int")
                piece = F.get(inner, bar - 1)["text"]
                head = F.concat(joined(F.slice(inner, F.lit(1), F.greatest(bar - 1, F.lit(0)))), F.substring_index(piece, "|", 1))
                rest = F.concat(F.substring(piece, F.position(F.lit("|"), piece) + 1, F.length(piece)), joined(F.slice(inner, bar + 1, F.size(inner))))
                return F.when(bar > 0, named(head, rest)).otherwise(named(joined(inner), F.lit("")))

            return once(inner, split)

        return F.sort_array(F.transform(once(marks, _partners), template))

    return F.transform(once(_pieces(text), shown), lambda t: F.struct(t["name"].alias("name"), t["body"].alias("body")))
