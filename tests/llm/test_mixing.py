from collections import defaultdict

from helpers import documents, nothing, words
from revlens.llm import mixing


def plain(rows):
    """(size, source_size, target) by source and the budget rule on sorted digests."""
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
    names = sorted([s for s in size if s is not None]) + [None] * (None in size)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        left = [s for s in names if s not in full]
        share = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in left) if left else 0
        new = {s for s in left if weight[s] * share >= 3 * size[s]}
        if not new:
            return size, {s: 3.0 * size[s] if s in full else weight[s] * share for s in names}
        full |= new


def check(rows, loose=False):
    size, target = plain(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= (2 if loose else 0.5) * largest[s] + 1e-6


def test_odd_rows(spark):
    docs = documents(spark)
    rows = mixing.shares(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(r["size"] for r in rows) == sorted(len(words(r["text"])) for r in docs.collect())
    check(rows, loose=True)  # equal rows are taken together
    mixed = mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "_copies"]
    assert sum(r["_copies"] * len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in rows)


def test_given_table_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.shares(docs).collect()
    check(rows)
    again = mixing.shares(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [(k, "w " * 5, "big") for k in range(200)] + [(900, "a b", "a"), (901, "a", "b"), (902, None, "c")]
    got = mixing.shares(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    check(got)
    assert {r["source"]: r["target"] for r in got}["a"] == 6.0


def test_nested_thresholds(spark):
    rows = spark.createDataFrame([("s", 10, (k * 7919 % 1000) << 50) for k in range(300)], "source string, size bigint, digest bigint")
    last = -1
    for target in (0.0, 100.0, 505.0, 1500.0, 2995.0):
        goals = spark.createDataFrame([("s", 3000, target)], "source string, source_size bigint, target double")
        r = mixing.thresholds(rows, goals).first()
        taken = 10 * rows.filter(rows.digest < r["threshold"]).count()
        assert abs(taken - target) <= 5 and r["threshold"] >= last and r["times"] == 0
        last = r["threshold"]


def test_empty(spark):
    assert mixing.shares(nothing(spark)).collect() == [] and mixing.mixed(nothing(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.shares(blank).collect()] == [(0, 0.0, 0)] * 2
