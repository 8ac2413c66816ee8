import pytest
from pyspark.sql import functions as F

from revlens.functions.scores import best_label, bias_score, is_material
from revlens.operators import scoring
from revlens.plans import enrich


def shouting():
    """Toy model: the share of exclamation marks is the high class."""

    def classify(texts):
        return [{"Neutral": 1 - t.count("!") / len(t), "Highly Biased": t.count("!") / len(t)} for t in texts]

    return classify


def test_each_text_is_scored_once(spark):
    df = spark.createDataFrame([("a!",), ("a!",), ("b",), (" ",), (None,)], "t string")
    texts = scoring.distinct_texts(df, "t", "t")
    assert sorted(r["text"] for r in texts.collect()) == ["a!", "b"]
    scored = scoring.with_probabilities(df, scoring.function_scorer(shouting)(texts), "t", "p")
    found = {r["t"]: r["p"] for r in scored.collect()}
    assert found["a!"]["Highly Biased"] == 0.5 and found[" "] is None and found[None] is None
    labels = scoring.with_best_label(df, scoring.function_scorer(shouting)(texts), "t", "l").select("t", "l").distinct()
    assert {tuple(r) for r in labels.collect()} == {("a!", "Neutral"), ("b", "Neutral"), (" ", "N/A"), (None, "N/A")}


def test_gate_runs_the_model_once(spark):
    texts = spark.createDataFrame([("k", "x!!!")], "key string, text string")
    scored = scoring.function_scorer(shouting)(texts)
    gated = scored.withColumn("s", bias_score(F.col("probs"))).filter(is_material(F.lit(0.0), F.col("s")))
    plan = gated._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert gated.count() == 1


def test_naive_bayes_probabilities(spark):
    train = spark.createDataFrame([("s", "buy buy now"), ("h", "see you now"), ("h", "you")], "label string, text string")
    model = scoring.NaiveBayes.train(train, ["h", "s"])
    texts = spark.createDataFrame([("1", "buy now"), ("2", "unknown words"), ("3", "You see")], "key string, text string")
    probs = {r["key"]: r["probs"] for r in model(texts).collect()}
    # Vocabulary 4 (buy now see you); tokens per class: s 3, h 4.
    s = 1 / 3 * (3 / 7) * (2 / 7)
    h = 2 / 3 * (1 / 8) * (2 / 8)
    assert probs["1"]["s"] == pytest.approx(s / (s + h))
    assert probs["2"]["s"] == pytest.approx(1 / 3)
    assert sum(probs["3"].values()) == pytest.approx(1) and probs["3"]["h"] > 0.8
    assert model(texts).select("key", best_label("probs").alias("b")).filter("key = '3'").collect()[0]["b"] == "h"


def test_enrichment_end_to_end(spark):
    texts = ["Plain start.", "Plain start. Loud!!!!claim!!!!", "Plain start.", "Plain start. Loud!!!!claim!!!! {{T|1}}"]
    rows = [("https://en.wiki.example/wiki/X", i, 100 + i, "1.2.3.4" if i == 1 else "u", "2024-01-01T00:00:00Z", t) for i, t in enumerate(texts)]
    revs = spark.createDataFrame(rows, "article string, rev_seq long, revid long, user string, timestamp string, text string")
    scorer = scoring.function_scorer(shouting)
    pick = scoring.expression_scorer(lambda t: F.create_map(F.lit("Other"), F.lit(0.1), F.lit("Politics"), F.lit(0.9)))
    out = enrich.enrich(revs, scorer, pick, pick).collect()
    # Newest first: the sentence enters with revision 3; its removal and first insertion repeat it.
    assert [(r["id"], r["change_type"], r["diff_after"], r["ai_topic"], r["is_ip"]) for r in out] == [
        ("103-0001", "Text:Sentence:Insert", "Loud!!!!claim!!!!", "Politics", 0)
    ]
    stored = spark.createDataFrame(out, enrich.enrich(revs, scorer, pick, pick).schema)
    assert enrich.enrich(revs, scorer, pick, pick, stored).count() == 0


def test_tokens_are_counted_without_a_shuffle(spark):
    rows = [(1, "b a B c a a"), (2, None), (3, ""), (4, " \t "), (5, "Ä ä"), (6, "x" * 3), (1, "a")]
    counts = scoring.token_counts(spark.createDataFrame(rows, "key long, text string"), "key")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 1), (1, "a", 3), (1, "b", 2), (1, "c", 1), (5, "ä", 2), (6, "xxx", 1)]
