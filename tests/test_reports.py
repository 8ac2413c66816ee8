"""Edge rows of the reports: ties, one-sided labels, empty inputs, flat series."""

import pytest
from pyspark.sql import functions as F

from revlens.operators import agreement, dashboard, labels, review, survey, trends
from revlens.plans.report import report
from revlens.schema import ARTICLES, REVISIONS

NAMES = [f.name for f in REVISIONS.fields]


def revisions(spark, *rows):
    """Rows given as dicts; what is missing is NULL."""
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], REVISIONS)


def row(i, **values):
    return {"id": f"{i}-0001", "article_url": "u", "timestamp": "2024-01-01T00:00:00Z", **values}


def dicts(df):
    return [r.asDict() for r in df.collect()]


def test_labels_only_one_side_uses(spark):
    df = revisions(
        spark,
        row(1, manual_topic=" A ", ai_topic="A"),
        row(2, manual_topic="H", ai_topic="A"),
        row(3, manual_topic="A", ai_topic="M"),
        row(4, manual_topic="SKIPPED", manual_bias="SKIPPED", ai_topic="A"),
        row(5, manual_topic="", ai_topic="A"),
        row(6, manual_topic="A", ai_topic=None),
        row(7, ai_topic="A"),
    )
    counts = agreement.pair_counts(df, "topic")
    found = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in agreement.classification_report(counts).collect()}
    assert found == {
        "A": (pytest.approx(1 / 3), 0.5, pytest.approx(0.4), 2),
        "H": (0.0, 0.0, 0.0, 1),
        "M": (0.0, 0.0, 0.0, 0),
        "SKIPPED": (0.0, 0.0, 0.0, 1),
    }
    summary = agreement.report_summary(agreement.classification_report(counts)).collect()[0]
    assert summary["accuracy"] == 0.25 and summary["total"] == 4
    assert summary["macro_f1"] == pytest.approx(0.1) and summary["weighted_f1"] == pytest.approx(0.2)
    matrix = agreement.confusion_matrix(counts)
    assert matrix.count() == 16
    by_row = {r["human"]: r["n"] for r in matrix.groupBy("human").agg(F.sum("n").alias("n")).collect()}
    assert by_row == {"A": 2, "H": 1, "M": 0, "SKIPPED": 1}
    order = [(r["label"], r["diff"]) for r in agreement.distribution_bias(counts).collect()]
    assert order == [("A", 1), ("H", -1), ("M", 1), ("SKIPPED", -1)]
    shown = agreement.confusion_display(counts, ["A", "M"]).collect()
    assert shown[0].asDict() == {"human": "A", "A": 1, "M": 1}


def test_blank_label_is_a_class_of_its_own(spark):
    df = revisions(spark, row(1, manual_bias="  ", ai_political_stance="Neutral"))
    assert dicts(agreement.pair_counts(df, "stance")) == [{"human": "", "ai": "Neutral", "n": 1}]


def test_labelled_and_unlabelled_are_complements(spark):
    df = revisions(spark, row(1), row(2, manual_topic="x"), row(3, manual_bias="y"), row(4, manual_topic="", manual_bias=""))
    assert agreement.labelled(df).count() == 3 and survey.unlabelled(df).count() == 1


def test_article_agreement(spark):
    df = revisions(
        spark,
        row(3, manual_topic="b", ai_topic="b", bias_score_after=0.5),
        row(1, manual_topic="a", ai_topic="b", bias_score_after=None),
        row(2, manual_bias="s", ai_political_stance="", bias_score_after=0.1),
        row(4, article_url="orphan", manual_topic="a", ai_topic="a"),
    )
    articles = spark.createDataFrame([("u", "point(121 24)")], ARTICLES)
    found = {r["article_url"]: r for r in dicts(agreement.article_agreement(df, articles))}
    u, orphan = found["u"], found["orphan"]
    assert (u["lon"], u["lat"], u["topic_agreement"], u["topic_samples"]) == (121.0, 24.0, 0.5, 2)
    assert (u["stance_agreement"], u["stance_samples"], u["dominant_human_stance"]) == (0.0, 0, "N/A")
    # One vote each: the label of the smaller row id wins.
    assert (u["dominant_human_topic"], u["dominant_ai_topic"]) == ("a", "b")
    assert u["avg_bias_score"] == pytest.approx(0.3)
    assert orphan["lon"] is None and orphan["avg_bias_score"] == 0.0
    assert [r["article_url"] for r in dicts(agreement.article_agreement(df, articles, "u"))] == ["u"]


def test_top_ten_breaks_ties_by_label(spark):
    df = revisions(spark, *[row(i, ai_topic=f"label number {i % 12:02d}") for i in range(24)])
    found = dicts(dashboard.top_labels(df, "ai_topic"))
    assert [r["label"] for r in found] == [f"label number {i:02d}" for i in range(10)]
    assert {r["chart_label"] for r in found} == {"label numb.."}
    assert [r["label"] for r in dicts(survey.survey_topics(df))] == [r["label"] for r in found]


def test_survey_keeps_labels_untrimmed(spark):
    df = revisions(spark, row(1, ai_topic=" a"), row(2, ai_topic="a"), row(3, ai_topic=""), row(4))
    assert {r["label"] for r in dicts(survey.survey_topics(df))} == {" a", "a"}


def test_outliers(spark):
    flat = revisions(spark, *[row(m, timestamp=f"2024-{m:02d}-01T00:00:00Z", bias_score_after=0.5) for m in range(1, 7)])
    assert trends.monthly_outliers(flat).count() == 0
    one = revisions(spark, row(1, bias_score_after=0.5), row(2, bias_score_after=0.7))
    assert trends.monthly_outliers(one).count() == 0
    rows = [row(m, timestamp=f"2024-{m:02d}-01T00:00:00Z", bias_score_after=0.5) for m in range(1, 9)]
    rows += [row(100 + i, timestamp="2024-08-02T00:00:00Z", bias_score_after=0.9) for i in range(9)]
    rows += [row(200, timestamp="N/A"), row(201, timestamp=""), row(202, timestamp="2024-0"), row(203, timestamp=None)]
    found = dicts(trends.monthly_outliers(revisions(spark, *rows)))
    assert [(r["month"], r["reason"], r["value_text"]) for r in found] == [
        ("2024-08", "High Activity", "10 revs"),
        ("2024-08", "High Bias Score", "0.8600"),
    ]
    assert found[0]["context"] == "(Mean: 2.1)"


def test_bins_clamp(spark):
    df = revisions(spark, *[row(i, bias_score_after=s) for i, s in enumerate([None, 0.0, 1.0, -3.0, 9.0, 0.2])])
    assert [r["n"] for r in dicts(dashboard.bias_histogram(df).orderBy("bin"))] == [2, 1, 0, 0, 2]


def test_value_range(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert tuple(dashboard.value_range(df, "v").collect()[0]) == (2.0, 3.0)
    assert tuple(dashboard.value_range(df.limit(0), "v").collect()[0]) == (0.0, 1.0)


def test_daily_grid_keeps_labels_without_a_date(spark):
    df = revisions(spark, row(1, ai_topic="a"), row(2, ai_topic="b", timestamp="N/A"), row(3, timestamp="2024-01-05T00:00:00Z"))
    grid = {(str(r["date"]), r["label"]): r["n"] for r in dicts(trends.daily_label_grid(df, "ai_topic"))}
    assert grid == {("2024-01-01", "a"): 1, ("2024-01-01", "b"): 0, ("2024-01-05", "a"): 0, ("2024-01-05", "b"): 0}
    assert sorted(str(r["date"]) for r in dicts(trends.active_days(df))) == ["2024-01-01", "2024-01-05"]


def test_queue_drops_rows_with_null_after_the_limit(spark):
    full = {f.name: (0.5 if f.dataType.simpleString() == "double" else 1 if "int" in f.dataType.simpleString() else "x") for f in REVISIONS.fields}
    rows = [{**full, "id": f"r{i}", "bias_score_after": i / 10, "manual_bias": None} for i in range(5)]
    rows[4]["content"] = None
    df = revisions(spark, *rows)
    assert [r["id"] for r in dicts(review.review_queue(df, n=2))] == ["r3"]
    assert [r["id"] for r in dicts(review.review_queue(df, "no such order", topic="Any", n=3))] == ["r3", "r2"]
    assert review.review_queue(df, desc="other").count() == 0
    assert dicts(review.review_queue(df, "bias_asc", n=1))[0]["is_ip"] is True


def test_queue_is_a_top_n_with_pushed_filters(spark, tmp_path):
    path = str(tmp_path / "revisions")
    revisions(spark, row(1)).write.parquet(path)
    df = review.review_queue(spark.read.schema(REVISIONS).parquet(path), topic="a")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "IsNull(manual_bias)" in plan and "EqualTo(ai_topic,a)" in plan


def test_empty_description_takes_a_place(spark):
    df = revisions(spark, *[row(i, change_desc="") for i in range(3)], row(8, change_desc="b"), row(9, change_desc="c"))
    assert [r["label"] for r in dicts(review.description_facet(df, 2))] == ["b"]


def test_label_fold(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    one = ids.filter("id = 'a'")
    log = (
        labels.label_event(ids, F.lit("s1"), F.lit("t1"), F.lit(1))
        .unionByName(labels.clear_event(one, F.lit(2)))
        .unionByName(labels.label_event(one, F.lit("s2"), F.lit("t2"), F.lit(3)))
        .unionByName(labels.skip_event(one, F.lit(4)))
    )
    assert [tuple(r) for r in labels.label_state(log).collect()] == [("a", "SKIPPED", "SKIPPED", 4)]
    df = revisions(spark, {**row(1), "id": "a"}, {**row(2, manual_topic="old"), "id": "b"})
    merged = {r["id"]: (r["manual_bias"], r["manual_topic"]) for r in labels.with_labels(df, labels.label_state(log)).collect()}
    assert merged == {"a": ("SKIPPED", "SKIPPED"), "b": (None, None)}
    assert tuple(labels.label_progress(labels.with_labels(df, labels.label_state(log))).collect()[0]) == (2, 1)
    assert labels.training_export(labels.with_labels(df, labels.label_state(log))).count() == 0


def test_report_on_nothing(spark):
    parts = report(revisions(spark, row(1)).limit(0), spark.createDataFrame([], ARTICLES))
    sizes = {name: df.count() for name, df in parts.items()}
    assert {n for n, c in sizes.items() if c} == {"stance_summary", "topic_summary", "survey_totals"}
