import collections
import math

import numpy as np
from helpers import documents, nothing
from revlens.llm import language

EN = "the house and the garden were quiet while the rain fell on the old stone wall "
DE = "das haus und der garten waren still und der regen fiel auf die alte mauer aus stein "


def rows(spark, data):
    return spark.createDataFrame(data, "id bigint, text string, declared string, host string")


def corpus():
    return [(k, EN + str(k), "en", f"h{k % 3}.site.com") for k in range(60)] + [(100 + k, DE + str(k), "de-AT", "x.seite.de") for k in range(60)]


def test_text_outweighs_a_wrong_declaration(spark):
    data = corpus() + [(500, DE * 3, "en", "h1.site.com"), (501, EN * 3, None, None), (502, "一二三 " * 300, "en", "h1.site.com")]
    got = {r["id"]: r for r in language.identify(rows(spark, data)).collect()}
    assert len(got) == len(data)
    assert got[500]["lang"] == "de" and got[501]["lang"] == "en" and got[502]["lang"] == "und" and not got[502]["accepted"]
    assert all(got[k]["lang"] == ("en" if k < 100 else "de") and got[k]["accepted"] for k in range(160) if k in got)


def test_a_rare_language_is_a_language(spark):
    """Twelve rows in 30,000 declare it: less than one in a thousand, and more English than the sample takes."""
    rare = "taloni on pieni ja puutarha hiljainen kun sade lankeaa vanhalle kivimuurille ja yö tulee "
    many = spark.range(30_000).selectExpr("id", f"concat('{EN}', id) as text", "'en' as declared", "concat('h', id % 7, '.site.com') as host")
    few = rows(spark, [(90_000 + k, rare + str(k), "fi", "talo.fi") for k in range(12)] + [(95_000, rare * 2, None, None), (95_001, "一二三 " * 300, "en", "h1.site.com"), (None, EN, "en", None)])
    got = language.identify(many.unionByName(few), sample=200)
    assert got.filter("id < 30000 and lang = 'en' and accepted").count() == 30_000
    rest = {r["id"]: (r["lang"], r["accepted"]) for r in got.filter("id is null or id >= 90000").collect()}
    assert {rest.pop(k) for k in [*range(90_000, 90_012), 95_000]} == {("fi", True)}
    assert rest == {95_001: ("und", False), None: ("en", True)}


def test_logarithms_without_the_own_row(spark):
    """Each row's logarithms against a model counted anew from all other rows that fit."""
    data = [(k, (EN if k % 2 else DE) * (1 + k % 3) + "é" * k, ["de", "en"][k % 2], None) for k in range(14)] + [(20, EN, None, None), (21, "ab", "en", None), (22, None, "de", None)]
    marked = language.sampled(rows(spark, data), 100)
    names, counts = language.fit(marked)
    assert names == ["de", "en"]
    for r in language.likelihoods(marked, names, counts).collect():
        text = {d[0]: (d[1] or "").encode().lower() for d in data}
        grams = lambda b: [g[0] for g in (language.trigrams(np.frombuffer(b[i:i + 3], np.uint8)) for i in range(len(b) - 2))]
        for k, name in enumerate(names):
            known = collections.Counter(g for i, _, d, _ in data if d == name and i != r["id"] for g in grams(text[i]))
            total = sum(known.values()) + language.SMOOTHING * language.BUCKETS
            want = sum(math.log((known[g] + language.SMOOTHING) / total) for g in grams(text[r["id"]])) / 3
            assert abs(r["ll"][k] - want) < 1e-3 * max(1, abs(want))


def test_hosts_and_suffix_decide_where_the_text_does_not(spark):
    data = corpus() + [(600, "", None, "x.seite.de"), (601, "", None, "new.seite.de"), (602, "", None, "other.de"), (603, "", "en", None), (604, None, None, None), (605, "", None, "h9.site.com")]
    got = {r["id"]: (r["lang"], r["confidence"]) for r in language.identify(rows(spark, data)).collect()}
    assert got[600][0] == got[601][0] == got[602][0] == "de" and got[603][0] == "en" and got[605][0] == "en"
    assert got[600][1] > got[602][1] > got[604][1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id as id", "text", "if(doc_id % 5 = 0, null, lang) as declared", "source as host", "lang")
    got = language.identify(docs).join(docs.select("id", "lang").withColumnRenamed("lang", "truth"), "id").filter("id % 5 = 0")
    n, good = got.count(), got.filter("lang = truth and accepted").count()
    assert good >= 0.98 * n


def test_odd_rows_and_empty(spark):
    docs = documents(spark)
    kept = language.in_known_language(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert language.in_known_language(nothing(spark)).collect() == []
    none = language.identify(rows(spark, [(1, "a b", None, None)])).collect()
    assert [(r["lang"], r["accepted"]) for r in none] == [(None, False)]


def test_page_parts(spark):
    page = "<html class='x' LANG=\"de-DE\"><script>var a='<p>';</script><p>Hallo <b>Welt</b></p><!-- <i> --></html>"
    df = spark.createDataFrame([(page, "https://me:pw@WWW.Example.DE:80/x?y"), (None, "nothing"), ("", None)], "html string, url string")
    host = language.host_of(df.url)
    got = df.select(language.markup_language(df.html), language.primary_tag(language.markup_language(df.html)), language.visible_text(df.html), host, language.site_of(host), language.suffix_of(host)).collect()
    assert got[0][:2] == ("de-DE", "de") and got[0][2].split() == ["Hallo", "Welt"] and tuple(got[0][3:]) == ("www.example.de", "example.de", "de")
    assert got[1][0] is None and got[1][3] is None and got[2][3] is None
    pages = df.selectExpr("1L as page_id", "url", "html")
    assert language.page_languages(pages).count() == 3 and language.page_languages(pages.limit(0)).count() == 0
