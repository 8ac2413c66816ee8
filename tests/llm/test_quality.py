import time
from collections import Counter

import numpy as np
import xxhash

from helpers import documents, nothing, words
from revlens.llm import quality


def measures(text):
    w, text = words(text), text or ""
    seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    inside = {j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_measures_of_all_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(10, 1, 0), (0, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.verdicts(docs, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((g["doc_id"], *[g[n] for n in names]) for g in got), key=key) == sorted(((r["doc_id"], *measures(r["text"])) for r in docs.collect()), key=key)
    for g in got:
        assert g["base_failed"] == (g["n_words"] < 20 or 100 * g["n_repeat_words"] > 30 * g["n_words"])
        assert g["kept"] == (not g["base_failed"] and g["score"] >= quality.THRESHOLD)


def buckets(text):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ends = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words(text)]
    return [h & quality.BUCKETS - 1 for h in [*ends, *[(a << 1) ^ b for a, b in zip(ends, ends[1:])]]]


def test_scores_against_plain_counts(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(10, 1, 0), (17, 1, 0)], "doc_id bigint, quality int, toxic int")
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for r in docs.collect():
        for b in buckets(r["text"]):
            raw[b] += 1
            target[b] += r["doc_id"] in (10, 17)
    ratio = np.log((target + 1) / (target.sum() + len(raw))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    want = {r["doc_id"]: np.mean([ratio[b] for b in buckets(r["text"])]) if buckets(r["text"]) else None for r in docs.collect()}
    for r in quality.verdicts(docs, labels).collect():
        assert (r["score"] is None) == (want[r["doc_id"]] is None)
        assert r["score"] is None or abs(r["score"] - want[r["doc_id"]]) < 1e-5


def test_kept_columns_and_no_trusted_text(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    kept = quality.kept(docs, none)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {15, 16} - {r["doc_id"] for r in quality.verdicts(docs, none).filter("base_failed").collect()}
    assert quality.verdicts(nothing(spark), none).collect() == []


def test_filters_stay_above_the_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    began = time.monotonic()
    want = sum(r["base_failed"] for r in quality.verdicts(docs, labels).collect())
    whole, began = time.monotonic() - began, time.monotonic()
    assert quality.verdicts(docs, labels).filter("base_failed or n_words > 100000").count() == want
    assert time.monotonic() - began < 10 + 2 * whole


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plan = quality.verdicts(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_labelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.verdicts(docs, labels).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg({"*": "count"}, ).collect()
    kept = quality.verdicts(docs, labels).filter("kept").join(labels, "doc_id").groupBy("quality").count().collect()
    all_, good = {r[0]: r[1] for r in rows}, {r[0]: r[1] for r in kept}
    assert good[1] >= 0.99 * all_[1] and good.get(0, 0) <= 0.1 * all_[0]
