import json
import os
from urllib.parse import quote

from pyspark.sql import functions as F

from revlens.functions import geo
from revlens.operators import discovery
from revlens.plans.report import write_maps
from revlens.schema import ARTICLES, REVISIONS, TOPICS
from revlens.sources import articles, categories, history, tables


def test_history_pages(spark, tmp_path):
    url = "https://en.wiki.example/wiki/A%20B"

    def land(address, number, body):
        folder = tmp_path / quote(address, safe="")
        folder.mkdir(exist_ok=True)
        (folder / f"{number}.json").write_text(json.dumps(body))

    land(url, 0, {"continue": {"rvcontinue": "x"}, "query": {"pages": {"7": {"title": "A B", "revisions": [
        {"revid": 4, "user": "u", "timestamp": "t4", "slots": {"main": {"*": "four"}}},
        {"revid": 3, "timestamp": "t3", "*": "three"}]}}}})
    land(url, 1, {"query": {"pages": {"7": {"revisions": [{"revid": 2, "user": "v"}, {"revid": 1, "slots": {"main": {"*": "one"}}}]}}}})
    land("https://en.wiki.example/wiki/None", 0, {"query": {"pages": {"-1": {"title": "None", "missing": ""}}}})
    land("https://en.wiki.example/wiki/Empty", 0, {"query": {"pages": {}}})
    rows = history.parse_pages(history.read_pages(spark, str(tmp_path))).orderBy(F.desc("rev_seq")).collect()
    assert [tuple(r) for r in rows] == [
        (url, 0, 4, "u", "t4", "four"),
        (url, -1, 3, "N/A", "t3", "three"),
        (url, -2, 2, "v", "N/A", ""),
        (url, -3, 1, "N/A", "N/A", "one"),
    ]


def test_page_texts_are_not_gathered_by_article(spark):
    """Without broadcast, texts are hashed by page; only page sizes are brought together per article."""
    pages = spark.createDataFrame([("a", 0, "{}")], "article string, page_no long, body string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = history.parse_pages(pages)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    exchanges = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    by_article_alone = [e for e in exchanges if "page_no" not in e.split(")")[0]]
    assert len(exchanges) == 3 and len(by_article_alone) == 1


def test_bindings(spark, tmp_path):
    path = tmp_path / "found.json"
    path.write_text(json.dumps({"results": {"bindings": [
        {"article": {"value": "u1"}, "coord": {"value": "Point(1 2)"}}, {"article": {"value": "u2"}}, {"article": {"value": "u1"}}]}}, indent=1))
    found = articles.read_bindings(spark, str(path))
    assert sorted((r["url"], r["coord"]) for r in found.filter("coord is not null or url = 'u2'").collect()) == [("u1", "Point(1 2)"), ("u2", None)]
    assert tuple(articles.ingest_totals(found).collect()[0]) == (3, 2)


def test_fill_draws_again_on_a_clash(spark):
    taken = spark.range(1).select(geo.synthetic_point(F.lit("b"), F.lit(0)).alias("c")).collect()[0]["c"]
    df = spark.createDataFrame([("a", taken.lower()), ("b", None), ("c", ""), ("d", "Point(1 2)")], ARTICLES)
    rows = {r["url"]: r for r in articles.fill_coordinates(df).collect()}
    assert rows["a"]["coord"] == taken and rows["b"]["coord"] not in (None, taken)
    assert {u for u, r in rows.items() if r["coord_is_synthetic"]} == {"b", "c"}
    lon, lat = (float(x) for x in rows["b"]["coord"][6:-1].split())
    assert 120.9 <= lon <= 121.4 and 24.5 <= lat <= 25.0


def test_upsert_last_write_wins(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], ARTICLES)
    writes = spark.createDataFrame([("b", "3", 1), ("b", None, 2), ("c", "4", 1)], "url string, coord string, seq int")
    assert sorted(map(tuple, articles.upsert(stored, writes, "url", "seq").collect())) == [("a", "1"), ("b", None), ("c", "4")]
    assert articles.needs_fetch(stored.limit(0)) and not articles.needs_fetch(stored)
    assert articles.first_articles(stored, 1).collect()[0]["url"] == "a" and articles.first_articles(stored, 0).count() == 2


def test_replaced_change_keeps_its_labels(spark):
    names = [f.name for f in REVISIONS.fields]

    def rev(i, **values):
        return tuple({"id": i, **values}.get(n) for n in names)

    stored = spark.createDataFrame([rev("1", manual_bias="s", content="old"), rev("2", manual_topic="t")], REVISIONS)
    fresh = spark.createDataFrame([rev("1", content="new"), rev("3")], REVISIONS).withColumn("seq", F.lit(1))
    merged = {r["id"]: (r["manual_bias"], r["manual_topic"], r["content"]) for r in tables.upsert_changes(stored, fresh, "seq").collect()}
    assert merged == {"1": ("s", None, "new"), "2": (None, "t", None), "3": (None, None, None)}


def test_tables_are_created_once(spark, tmp_path):
    spark.sql("create database if not exists made")
    for _ in range(2):
        tables.create_tables(spark, str(tmp_path), "made")
    assert spark.table("made.revisions").columns == [f.name for f in REVISIONS.fields]
    spark.sql("insert into made.articles values ('u', 'POINT(1 2)')")
    assert tables.read_articles(spark, str(tmp_path / "articles")).count() == 1
    spark.sql("drop database made cascade")


def test_read_revisions_derives_times(spark, tmp_path):
    names = [f.name for f in REVISIONS.fields]
    row = tuple({"id": "1", "timestamp": "2024-03-05T10:00:00Z"}.get(n) for n in names)
    spark.createDataFrame([row], REVISIONS).write.parquet(str(tmp_path / "r"))
    read = tables.read_revisions(spark, str(tmp_path / "r")).collect()[0]
    assert (str(read["event_date"]), read["event_month"]) == ("2024-03-05", "2024-03")
    tables.export_training(tables.read_revisions(spark, str(tmp_path / "r")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0


def test_categories(spark, tmp_path):
    path = tmp_path / "topics.json"
    path.write_text(json.dumps(list(TOPICS), indent=2))
    assert [tuple(r) for r in categories.read_categories(spark, str(path)).orderBy("pos").collect()] == list(enumerate(TOPICS))


def test_maps(spark, tmp_path):
    names = [f.name for f in REVISIONS.fields]
    row = {"id": "1", "article_url": "u", "manual_topic": "a", "ai_topic": "a", "bias_score_after": 0.12345}
    df = spark.createDataFrame([tuple(row.get(n) for n in names)], REVISIONS)
    places = spark.createDataFrame([("u", "POINT(121.5 24.5)")], ARTICLES)
    written = write_maps(df, places, str(tmp_path))
    assert [os.path.basename(p) for p in written] == ["agreement_map"]
    feature = json.loads(spark.read.text(written[0]).collect()[0]["value"])
    assert feature["geometry"] == {"type": "Point", "coordinates": [121.5, 24.5]}
    assert feature["properties"]["avg_bias_score"] == 0.1235 and len(feature["properties"]) == 10


def test_closure_ends_on_cycles_and_deep_chains(spark):
    edges = [(f"n{i}", "P131", f"n{i - 1}") for i in range(1, 25)] + [("n0", "P131", "n7"), ("x", "P131", "y")]
    triples = spark.createDataFrame(edges, "s string, p string, o string")
    regions = spark.createDataFrame([("n0",), ("y",)], "region string")
    found = {tuple(r) for r in discovery.region_closure(triples, regions).collect()}
    assert found == {("n0", f"n{i}") for i in range(25)} | {("y", "y"), ("y", "x")}


def test_articles_prefer_the_first_site(spark):
    rows = [
        ("i", "P625", "Point(1 2)"), ("i", "P131", "r"), ("j", "P159", "i"), ("k", "P625", "Point(3 4)"),
        ("zh1", "about", "i"), ("zh1", "isPartOf", "Z"), ("en1", "about", "i"), ("en1", "isPartOf", "E"),
        ("en2", "about", "j"), ("en2", "isPartOf", "E"), ("i", "label@en", "Eye"), ("i", "label@zh", "眼"),
    ]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    regions = spark.createDataFrame([("r",)], "region string")
    found = discovery.region_articles(triples, regions, ["Z", "E"], ["zh", "en"]).collect()
    assert {tuple(r) for r in found} == {("i", "眼", "Point(1 2)", "zh1"), ("j", "j", None, "en2")}


def test_scratch_tables_of_a_run_can_be_dropped(spark):
    """In a session of another application id, so that tables of other tests stay."""
    import os
    from unittest import mock

    from revlens import session

    folder = os.path.join(session.work_folder(spark), "revlens", "drop-test")
    with mock.patch.object(session, "_run_folder", lambda _: folder):
        table = session.written_table(spark.range(3), "kept")
        assert table.count() == 3 and os.path.isdir(folder)
        assert session.drop_scratch(spark) and not os.path.exists(folder)
