from helpers import TEXTS, documents, nothing
from revlens.llm import licenses

MIT = "Permission is granted,\nfree of charge, to ANY person."


def test_spellings_and_scopes(spark):
    rows = [
        (1, "Copyright (c) 2020 Ann\nLICENSED under the Apache Licence -- version 2.0!"),
        (2, "some words\nReleased under the MIT license\nmore words\nReleased under the mit License."),
        (3, f"intro\n\n{MIT}\n\nend"), (4, MIT.replace("\n", " ")), (5, "released under the mit license today"), (6, None), (7, "(c) 1999 X"), (8, "..."),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = licenses.known(spark).union(spark.createDataFrame([("own", MIT), ("none", "  "), ("null", None)], "licence string, text string"))
    got = sorted((r["doc_id"], r["licence"], r["scope"], r["places"]) for r in licenses.scan(docs, known).collect())
    assert got == [(1, "Apache-2.0", "text", 1), (2, "MIT", "line", 2), (3, "own", "paragraph", 1), (4, "own", "text", 1)]


def test_odd_rows(spark):
    known = spark.createDataFrame([("cat", TEXTS[10])], "licence string, text string")
    got = sorted((r["doc_id"], r["scope"], r["places"]) for r in licenses.scan(documents(spark), known).collect())
    assert got == [(10, "text", 2), (11, "text", 2)]  # both rows repeat
    assert licenses.scan(nothing(spark), known).collect() == [] and licenses.scan(documents(spark), known.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(documents(spark), licenses.known(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
