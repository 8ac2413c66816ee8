"""The parallel duplicate check against the rule as a plain loop."""

import random
import re

from revlens.operators import dedup
from revlens.session import cut_lineage
from revlens.workload import catalogue

SCHEMA = "article string, change_ord long, original_revid long, diff_before string, diff_after string"


def one_by_one(rows):
    """Keep a row unless an earlier kept row of the article holds its text on either side."""
    kept = set()
    seen = {}
    for article, order, _, before, after in sorted(rows, key=lambda r: (r[0], r[1])):
        text = after if after.strip() else before
        texts = seen.setdefault(article, set())
        if text not in texts:
            texts.update((before, after))
            kept.add((article, order))
    return kept


def run(spark, rows, seen=None):
    changes = cut_lineage(spark.createDataFrame(rows, SCHEMA))
    return {(r["article"], r["change_ord"]) for r in dedup.saved_changes(changes, seen).collect()}


def random_rows(rng, articles, length, letters):
    rows = []
    for a in range(articles):
        for i in range(rng.randrange(1, length)):
            before, after = rng.choice(letters), rng.choice(letters)
            if rng.random() < 0.2:
                before = ""
            elif rng.random() < 0.2:
                after = rng.choice(["", "  "])
            rows.append((f"a{a}", i, i // 3, before, after))
    return rows


def test_random_sequences(spark):
    rng = random.Random(5)
    rows = random_rows(rng, 1500, 14, "abcdef")
    assert run(spark, rows) == one_by_one(rows)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """v1 -> v2 -> ... seen newest first: every second change repeats a saved before-text."""
    n = 700
    rows = [("x", i, i, f"v{n - i - 1}", f"v{n - i}") for i in range(n)]
    cuts = []
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    assert run(spark, rows) == one_by_one(rows)
    assert len(cuts) < 60


def test_branching_tree(spark):
    """Several earlier changes share the before-text of one later change, over a few levels."""
    rng = random.Random(9)
    rows = []
    for a in range(60):
        for i in range(40):
            rows.append((f"t{a}", i, i, f"n{rng.randrange(i + 1, 48)}", f"n{i}"))
    assert run(spark, rows) == one_by_one(rows)


def test_hot_article(spark):
    rng = random.Random(3)
    rows = [("hot", i, i, f"w{rng.randrange(900)}", f"w{rng.randrange(900)}") for i in range(3000)]
    assert run(spark, rows) == one_by_one(rows)


def test_stored_rows_count_as_saved(spark):
    rng = random.Random(11)
    rows = random_rows(rng, 200, 12, "abcdef")
    first = [r for r in rows if r[1] < 5]
    later = [r for r in rows if r[1] >= 5]
    kept_first = one_by_one(first)
    stored = spark.createDataFrame([r for r in first if (r[0], r[1]) in kept_first], SCHEMA)
    got = run(spark, later, dedup.seen_texts(stored)) | kept_first
    assert got == one_by_one(rows)


def test_insertions_share_no_join_key(spark):
    keys = dedup.change_keys(spark.createDataFrame([("a", 1, 1, "", "x"), ("a", 2, 1, " ", "y"), ("a", 3, 1, "z", "")], SCHEMA))
    assert [r["old"] is None for r in keys.orderBy("change_ord").collect()] == [True, True, False]


def test_blank_on_both_sides_is_never_saved(spark):
    assert run(spark, [("a", 1, 1, "", " "), ("a", 2, 1, "", "x")]) == {("a", 2)}


def test_row_ids(spark):
    rows = [("a", 1, 7, "", "x"), ("a", 2, 7, "", "y"), ("a", 3, 8, "", "z")]
    ids = dedup.with_row_id(spark.createDataFrame(rows, SCHEMA)).select("id").collect()
    assert sorted(r["id"] for r in ids) == ["7-0001", "7-0002", "8-0001"]


def test_ids_on_narrow_rows(spark):
    rows = random_rows(random.Random(8), 300, 14, "abcdef")
    changes = cut_lineage(spark.createDataFrame(rows, SCHEMA))
    want = dedup.with_row_id(dedup.saved_changes(changes))
    assert sorted(map(tuple, dedup.saved_with_id(changes).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {len(r["own"]) for r in dedup.change_keys(changes).filter("own is not null").collect()} == {16}


def test_texts_move_once_for_the_saved_rows(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalogue.saved_changes(spark, "/root/testdata/sf0.001")
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(moved) > 1 and sum("diff_after" in columns for columns in moved) == 1
