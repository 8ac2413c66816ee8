import random
import re

import plain_braces
import pytest
from pyspark.sql import functions as F

from revlens.functions import geo, markup, scores, text, web


def column(spark, values, expression, schema="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {schema}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def loop_context(before, after, content, previous):
    chosen = after if after.strip() else before
    if not (after.strip() and content):
        return chosen
    at = [m.start() for m in re.finditer(re.escape(after), content)]
    if not at:
        return chosen
    best = at[0]
    if len(at) > 1 and before.strip() and previous:
        old = previous.find(before)
        if old >= 0:
            best = min(at, key=lambda x: abs(x - old))
    return content[max(0, best - len(after)) : min(len(content), best + 2 * len(after))]


def test_context_window_against_loop(spark):
    rng = random.Random(1)
    alphabet = ["a", "b", "é", ".", "\\E", "\u0000", "", " ", "𝒳"]

    def word(n):
        return "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))

    rows = [(word(3), word(3), word(25), word(25)) for _ in range(3000)]
    rows += [("b", "a", "a..a..a", "..b"), ("b", "a", "a....a", "...b"), ("x", "", "abc", "abc"), ("", " ", " ", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, a string, c string, p string")
    found = text.with_context_window(df, "w", *(F.col(x) for x in "bacp")).orderBy("i").collect()
    assert [r["w"] for r in found] == [loop_context(*r) for r in rows]


def test_positions(spark):
    df = spark.createDataFrame([("aXaXa", "a"), ("aaaa", "aa"), ("x", "y"), ("x", ""), ("a.b.c", ".")], "t string, n string")
    assert [r[0] for r in df.select(text.positions(F.col("t"), F.col("n"))).collect()] == [[0, 2, 4], [0, 2], [], [], [1, 3]]


def test_strip_and_blank(spark):
    assert column(spark, ["\t a ", "\n", "b"], text.strip) == ["a", "", "b"]
    assert column(spark, [" ", "x", None], text.non_blank) == [False, True, False]


def test_timestamps(spark):
    values = ["2024-01-31T23:59:59Z", "N/A", "", "2024-0", "2024-01", "2024-02-30T00:00:00Z", None]
    assert [str(d) if d else None for d in column(spark, values, text.event_date)] == ["2024-01-31"] + [None] * 6
    assert column(spark, values, text.usable_timestamp) == [True, False, False, False, True, True, None]


def test_parse_day(spark):
    assert [str(d) if d else None for d in column(spark, ["2024-02-29", "29.02.2024", None], text.parse_day)] == ["2024-02-29", None, None]


def test_highlight_and_line(spark):
    df = spark.createDataFrame(
        [("a\nb\nb c", "b"), ("a", ""), ("", "a"), ("a\nb", "a\nb"), ("abc", "z")], "c string, t string"
    )
    rows = df.select(text.highlight(F.col("c"), F.col("t")), text.changed_line(F.col("c"), F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [
        ("a\n[+b+]\n[+b+] c", 1), ("a", None), ("", None), ("[+a\nb+]", None), ("abc", None),
    ]


def test_chart_label(spark):
    assert column(spark, ["1234567890", "12345678901", "International"], text.chart_label) == [
        "1234567890", "1234567890..", "Internatio..",
    ]


def test_url_parts(spark):
    urls = ["https://zh.wiki.example/wiki/%E6%96%B0%E7%AB%B9", "https://en.wiki.example/wiki/A+B", "http://x.y/z/50%zz"]
    assert column(spark, urls, web.title) == ["新竹", "A+B", "50%zz"]
    assert column(spark, urls, web.language) == ["zh", "en", "x"]
    assert column(spark, urls[:1], web.api_url) == ["https://zh.wiki.example/w/api.php"]


def test_is_ip(spark):
    users = ["1.2.3.4", "999.1.1.1", "fe80::1", "::1", "fe80::", "[a:b]", "Cafe:Bad", "N/A", "", "1.2.3", None]
    assert column(spark, users, web.is_ip) == [1, 1, 1, 1, 0, 1, 1, 0, 0, 0, 0]


def test_coordinates(spark):
    points = ["POINT(121.5 24.75)", "point( 1  2 )", "POINT(x)", "LINE(1 2)", "POINT(a 2)", "", None, "POINT(1 2 3)"]
    assert column(spark, points, geo.longitude) == [121.5, 1.0, None, None, None, None, None, 1.0]
    assert column(spark, points, geo.latitude) == [24.75, 2.0, None, None, 2.0, None, None, 2.0]


def test_scores(spark):
    probs = [
        {"Neutral": 0.2, "Slightly Biased": 0.5, "Highly Biased": 0.3},
        {"LABEL_0": 0.4, "LABEL_1": 0.4, "LABEL_2": 0.2},
        {"Other": 1.0},
        None,
    ]
    kind = "map<string,double>"
    assert column(spark, probs, lambda p: scores.score_or_default(F.lit("t"), p), kind) == pytest.approx([0.55, 0.4, 0.0, 0.0])
    labels = column(spark, probs, lambda p: scores.label_or_default(F.lit("t"), p), kind)
    assert labels[0] == "Slightly Biased" and labels[2:] == ["Other", "Neutral"]
    assert column(spark, probs[:1], lambda p: scores.label_or_default(F.lit(" \n"), p), kind) == ["Neutral"]
    assert column(spark, [-0.5, 0.0, 0.2, 0.99, 1.0, 7.0, None], scores.score_bin, "double") == [0, 0, 1, 4, 4, 4, None]


def test_gate_is_strict(spark):
    df = spark.createDataFrame([(0.125, 0.25), (0.0, 0.3), (0.25, 0.3), (0.25, 0.375), (0.5, 0.25), (0.3, 0.3)], "b double, a double")
    rows = df.select(scores.is_material(F.col("b"), F.col("a"))).collect()
    assert [r[0] for r in rows] == [True, True, False, True, True, False]


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("{{A|x={{B|1}}}} text [[T|label]] and [[Plain]]<ref name=a>src</ref>", "text label and Plain"),
        ("'''bold''' ''it''<br/>", "bold it"),
        ("open {{tag [[x", "open {{tag [[x"),
        ("a<!-- note\n -->b<ref name=x />c", "abc"),
        ("[http://e.org/x site]  ", "site"),
        ("{{a|{{b|{{c|{{d|{{e|{{f|{{g}}}}}}}}}}}}}}x", "x"),
        ("}} {{ {{a}} y", "}} {{  y"),
    ],
)
def test_plain_text(spark, raw, plain):
    assert column(spark, [raw], markup.plain_text) == [plain]


def test_template_parts(spark):
    parts = column(spark, ["x = 1|two|u=[[A|b|c]]|w=p=q", ""], markup.template_parts)
    assert [tuple(p) for p in parts[0]] == [("x", "1"), ("2", "two"), ("u", "[[A|b|c]]"), ("w", "p=q")]
    assert parts[1] == []


def test_open_braces_cost_no_passes(spark):
    text = "{{ab " * 200_000
    df = spark.createDataFrame([(text,), (text + "}}",), ("}} {{a}} {{b {{c}} }} {{",), ("{{a}}" * 50_000 + "}}" * 50_000,)], "t string")
    got = df.select(markup.template_depth(F.col("t")), F.length(markup.without_templates(F.col("t")))).collect()
    assert [r[0] for r in got] == [0, 1, 2, 1]
    assert [r[1] for r in got] == [1_000_000, 1_000_000 - 5, len("}}   {{"), 100_000]


def test_characters_of_the_stand_ins_stay(spark):
    text = "{{n|k=x\u0001y\u0002z\u0003\u0004o|[[a|b]]{{m}}}}"
    parts = spark.createDataFrame([(text,)], "t string").select(
        F.flatten(F.transform(markup.templates(F.col("t")), lambda n: markup.template_parts(n["body"])))
    ).first()[0]
    assert [tuple(p) for p in parts] == [("k", "x\u0001y\u0002z\u0003\u0004o"), ("2", "[[a|b]]{{m}}")]


def test_needle_is_taken_literally(spark):
    rows = [("\u0000 a.b  a.b ", "a.b", [2, 8]), (r"x\Ey\Ex", r"\E", [1, 4]), ("a(b(", "(", [1, 3])]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, n string")
    assert [r[0] for r in df.select(text.positions(F.col("t"), F.col("n"))).collect()] == [r[2] for r in rows]


def peeled(text):
    """Templates of a text by rounds over the innermost ones, as (round, start) and the text without them."""
    pattern, found, rest, level = re.compile(r"\{\{[^{}]*\}\}"), [], text, 0
    while pattern.search(rest):
        level += 1
        found += [(level, m.start(), m.end()) for m in pattern.finditer(rest)]
        rest = pattern.sub(lambda m: "x" * len(m.group()), rest)  # keeps places
    inside = {k for _, s, e in found for k in range(s, e)}
    return sorted(found), "".join(c for k, c in enumerate(text) if k not in inside)


def test_braces_against_peeling_and_a_plain_walk(spark):
    rng = random.Random(7)
    tokens = ["{", "}", "{{", "}}", "a", "|", "{{b", "}}}", "é𝒳"]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randrange(16))) for _ in range(8000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    found = df.select(markup.templates(F.col("t")), markup.without_templates(F.col("t")), markup.template_depth(F.col("t"))).collect()
    for text, (nodes, rest, depth) in zip(texts, found):
        spans, left = peeled(text)
        assert sorted(plain_braces.closed(text)) == spans and rest == left, text
        assert depth == max((s[0] for s in spans), default=0), text
        assert [(n["name"], n["body"]) for n in nodes] == [(a.strip(), b) for a, b in plain_braces.parts(text)], text


def test_names_and_bodies_of_nested_templates(spark):
    texts = ["{{a|x={{b|1}}|{{c}}y}} {{d{{e|f}}g|h}}", "{{a{{b{{c}}}}}}", "{{[[x|y]]|z}}{{}}{{|}}", "", None]
    got = column(spark, texts, markup.templates)
    assert [[(n["name"], n["body"]) for n in nodes] for nodes in got] == [
        [("b", "1"), ("c", ""), ("a", "x={{b}}|{{c}}y"), ("e", "f"), ("d{{e}}g", "h")],
        [("c", ""), ("b{{c}}", ""), ("a{{b}}", "")], [("[[x", "y]]|z"), ("", ""), ("", "")], [], [],
    ]


def test_one_megabyte_of_closed_nesting(spark):
    import time

    n = 150_000
    rows = spark.createDataFrame([("{{ab " * n + "}}" * n,), ("{{ab|k=" * n + "}}" * n,), ("{{a}}" * n,), (None,)], "t string")
    start = time.time()
    found = markup.templates(F.col("t"))
    got = rows.select(F.size(found), F.length(markup.without_templates(F.col("t"))), markup.template_depth(F.col("t"))).collect()
    assert [tuple(r) for r in got[:3]] == [(n, 0, n), (n, 0, n), (n, 0, 1)] and got[3][1:] == (None, None)
    assert time.time() - start < 30
