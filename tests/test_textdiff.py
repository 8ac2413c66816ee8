from collections import Counter
from itertools import accumulate

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revlens.functions.lcs import common_words, edit_script
from revlens.functions.text import sentences
from revlens.operators import sequence, textdiff, worddiff

REVS = "article string, rev_seq long, text string"


def revise(spark, *texts, first=0):
    return spark.createDataFrame([("a", first + i, t) for i, t in enumerate(texts)], REVS)


def edits(df):
    return [tuple(r) for r in df.orderBy("rev_seq", "change_seq").select("change_type", "diff_before", "diff_after", "change_desc").collect()]


def nodes(spark, old, new):
    found = edits(textdiff.node_edits(textdiff.revision_pairs(revise(spark, old, new))))
    return [(kind.removeprefix("Node:"), before, after, desc) for kind, before, after, desc in found]


@pytest.mark.parametrize("first", [0, -150])
@pytest.mark.parametrize("width", [1, 3, 64])
def test_previous_over_bucket_borders(spark, width, first):
    n = 200
    rows = [(k, first + i, f"{k}{i}") for k in "ab" for i in range(n)]
    pairs = textdiff.revision_pairs(spark.createDataFrame(rows, REVS), width)
    got = {(r["article"], r["rev_seq"]): (r["previous"], r["current"]) for r in pairs.collect()}
    assert got == {(k, first + i): (f"{k}{i - 1}" if i else "", f"{k}{i}") for k in "ab" for i in range(n)}


def test_dense_sequence(spark):
    rng = random.Random(2)
    orders = {k: sorted(rng.sample(range(100000), 300)) for k in "xyz"}
    df = spark.createDataFrame([(k, o) for k, v in orders.items() for o in v], "k string, o long")
    got = sequence.dense_sequence(df, "k", "o", "n", width=500).collect()
    assert {(r["k"], r["o"]): r["n"] for r in got} == {(k, o): i for k, v in orders.items() for i, o in enumerate(v)}


def test_pairs_and_sentence_edits_shuffle_texts_once(spark):
    plan = textdiff.sentence_edits(textdiff.revision_pairs(revise(spark, "a", "b")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sentence_edits(spark):
    old = "One two three four. Gone now! Same.\nSame."
    new = "One two three five. Same.\nNew and fresh words here? Same. Same."
    found = edits(textdiff.sentence_edits(textdiff.revision_pairs(revise(spark, "", old, new))).filter("rev_seq = 2"))
    changed = "One two three five."
    assert found == [
        ("Text:Sentence:Change", changed, changed, "Changed Sentence"),
        ("Text:Sentence:Insert", "", "Same.", "Inserted Sentence"),
        ("Text:Sentence:Remove", "Gone now!", "", "Removed Sentence"),
        ("Text:Sentence:Insert", "", "New and fresh words here?", "Inserted Sentence"),
    ]


def test_equal_revisions_have_no_edits(spark):
    assert edits(textdiff.structured_changes(textdiff.revision_pairs(revise(spark, "a. {{t|1}}", "a. {{t|1}}"))).filter("rev_seq = 1")) == []


def test_sentence_counts_balance(spark):
    rng = random.Random(8)
    words = ["ab", "cd", "ef. ", "gh! ", "\n", "。"]
    texts = ["".join(rng.choice(words) + " " for _ in range(rng.randrange(12))) for _ in range(120)]
    revs = revise(spark, *texts)
    pairs = textdiff.revision_pairs(revs)
    listed = {r["rev_seq"]: Counter(r["s"]) for r in revs.select("rev_seq", sentences(F.col("text")).alias("s")).collect()}
    delta = {}
    for r in textdiff.sentence_edits(pairs).collect():
        c = delta.setdefault(r["rev_seq"], Counter())
        kind = r["change_type"].rsplit(":")[-1]
        if kind in ("Insert", "Change"):
            c[r["diff_after"]] += 1
        if kind == "Remove":
            c[r["diff_before"]] -= 1
    changes = {r["rev_seq"] for r in textdiff.sentence_edits(pairs).filter("change_type like '%Change'").collect()}
    for k in range(1, len(texts)):
        if k in changes:
            continue  # a change does not name the sentence it replaces
        want = Counter(listed[k])
        want.subtract(listed[k - 1])
        assert {s: n for s, n in want.items() if n} == {s: n for s, n in delta.get(k, Counter()).items() if n}


def test_template_parameters(spark):
    assert nodes(spark, "{{Box|a=1|b=2|old=x}}", "{{Box|a=1|b=3|new=y}}") == [
        ("Template:parameter", "2", "3", "Template Box changed parameter"),
        ("Template:parameter", "", "y", "Template Box changed parameter"),
        ("Template:parameter", "x", "", "Template Box changed parameter"),
    ]


def test_nested_template_reports_the_inner_one(spark):
    assert nodes(spark, "{{O|v={{I|1}}|k=1}}", "{{O|v={{I|2}}|k=1}}") == [
        ("Template:parameter", "1", "2", "Template I changed parameter")
    ]


def test_second_template_of_a_name(spark):
    assert nodes(spark, "{{B|1}} {{B|2}}", "{{B|1}} {{B|3}}") == [
        ("Template:parameter", "2", "3", "Template B changed parameter")
    ]


def test_links_and_references(spark):
    assert nodes(spark, "[[A]] [[B|x]]", "[[C]] [[B|y]]") == [
        ("Wikilink:title", "A", "C", "Wikilink A changed title"),
        ("Wikilink:text", "x", "y", "Wikilink B changed text"),
    ]
    assert nodes(spark, '<ref name="r">old</ref>', '<ref name="r">new</ref>') == [
        ("Reference:content", "old", "new", "Reference r changed content")
    ]


@pytest.mark.parametrize(
    "old, new", [("", "{{New|1}} [[L]]"), ("{{Gone|1}} t", "t"), ("{{open|1", "{{open|2"), ("plain", "other")]
)
def test_nodes_coming_or_going_yield_nothing(spark, old, new):
    assert nodes(spark, old, new) == []


def loop_script(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    out, i, j = [], n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("eq", a[i]))
        elif j and (not i or best[i][j - 1] >= best[i - 1][j]):
            j -= 1
            out.append(("ins", b[j]))
        else:
            i -= 1
            out.append(("del", a[i]))
    return out[::-1], best[n][m]


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_edit_script_against_table(monkeypatch, limit):
    monkeypatch.setattr("revlens.functions.lcs._ROWS_IN_MEMORY", limit)
    rng = random.Random(4)
    for _ in range(1500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(15))] for _ in range(2))
        script, length = loop_script(a, b)
        assert edit_script(a, b) == script
        assert common_words(a, b) == length


def test_word_diff_rebuilds_both_sides(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(30))) for _ in range(80)]
    pairs = textdiff.revision_pairs(revise(spark, *texts))
    for r in worddiff.word_diff(pairs).collect():
        assert [o["word"] for o in r["script"] if o["op"] != "ins"] == r["previous"].split()
        assert [o["word"] for o in r["script"] if o["op"] != "del"] == r["current"].split()
    churn = worddiff.word_churn(pairs, "article").collect()[0]
    kept = [loop_script(a.split(), b.split())[1] for a, b in zip(["", *texts], texts)]
    assert churn["words_kept"] == sum(kept)
    assert churn["words_added"] == sum(len(t.split()) for t in texts) - sum(kept)
    assert churn["revisions"] == len(texts)
    assert list(accumulate(kept))[-1] == churn["words_kept"]


def test_order_numbers_of_both_kinds_never_meet(spark):
    rows = [(1, (1 << 31) - 1), (1, 1 << 31), (1, (1 << 31) + 5), (0, 0), (2, (1 << 32) - 1)]
    df = spark.createDataFrame(rows, "rev_seq bigint, change_seq bigint")
    got = [r[0] for r in df.select(textdiff.change_order(F.col("rev_seq"), F.col("change_seq"))).collect()]
    assert len(set(got)) == len(rows) and got[4] < got[0] < got[1] < got[2] < got[3]


def test_word_diff_takes_few_words_at_once():
    """An Arrow batch of many long pairs is worked off in slices; a pair longer than a slice is taken alone."""
    rng = random.Random(2)
    sizes = [*[400] * 800, worddiff.WORDS_AT_ONCE, 0, 3]
    texts = [[rng.choice("abcdefg") for _ in range(n)] for n in sizes]
    sides = pa.array(texts), pa.array([t[1:] + ["z"] * bool(t) for t in texts])
    scripts, kept = ([x for x in f.func(iter([sides]))] for f in (worddiff._script, worddiff._common))
    assert max(len(x.flatten()) for x in scripts) <= worddiff.WORDS_AT_ONCE + 1 and len(scripts) >= 5
    assert [[o["word"] for o in s if o["op"] != "ins"] for x in scripts for s in x.to_pylist()] == texts
    assert [n for x in kept for n in x.to_pylist()] == [max(0, n - 1) for n in sizes]


def test_sentence_edits_stay_in_the_row(spark):
    """Against counters, with repeated sentences on both sides; nothing is grouped after the pairing."""
    rng = random.Random(9)
    sides = [[". ".join(rng.choice("abcdef") * 3 for _ in range(rng.randrange(1, 9))) + "." for _ in range(2)] for _ in range(150)]
    pairs = spark.createDataFrame([(1, 0, k, a, b) for k, (a, b) in enumerate(sides)], "article int, bucket int, rev_seq int, previous string, current string")
    edits = textdiff.sentence_edits(pairs)
    plan = edits._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan and "Sort" not in plan
    got = {}
    for r in sorted(edits.collect(), key=lambda r: (r["rev_seq"], r["change_seq"])):
        got.setdefault(r["rev_seq"], []).append((r["change_type"].split(":")[-1], r["diff_before"], r["diff_after"]))
    for k, (a, b) in enumerate(sides):
        old, new = ([s.strip() for s in x.replace(".", ".\n").split("\n") if s.strip()] for x in (a, b))
        up, down = Counter(new) - Counter(old), Counter(old) - Counter(new)
        added = [s for s in dict.fromkeys(new) for _ in range(up[s])]
        removed = [s for s in dict.fromkeys(old) for _ in range(down[s])]
        want = []
        for j in range(max(len(added), len(removed))):
            if j < len(removed) and j < len(added):
                want += [("Insert", "", added[j]), ("Remove", removed[j], "")]
            else:
                want += [("Insert", "", added[j])] if j < len(added) else [("Remove", removed[j], "")]
        assert got.get(k, []) == want, (k, a, b)
