"""Views that make the given tables look like revisions, articles, label events and a graph.

Every mapping is row-wise or a plain aggregate of a given table, so the work of a query on
top grows with the data. The same expression text serves Spark and the SQL oracle wherever
both dialects agree; the two spellings that differ (hash, time format) are parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.schema import DISCOVERY_RESULT, STANCES
from revlens.session import spread, tune

SPARK_HASH = "round(cast(conv(substr(md5({0}),1,8),16,10) as bigint)/4294967296D, 6)"
DUCK_HASH = "round(('0x'||substr(md5({0}),1,8))::bigint/4294967296.0, 6)"
SPARK_ISO = "date_format({0}, 'yyyy-MM-dd\\'T\\'HH:mm:ss\\'Z\\'')"
DUCK_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"

DESCRIPTIONS = (
    "Inserted Sentence",
    "Removed Sentence",
    "Changed Sentence",
    "Template Infobox changed parameter",
    "Wikilink City changed title",
    "",
)


# Tables with costly work per row, and the key to spread them by when they are one small file.
SPREAD = {"documents": "doc_id", "events": "event_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, SPREAD[name]) if name in SPREAD else df


def pick(index: str, values) -> str:
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {index} {cases} end"


USER_URL = (
    "'https://' || case user_id % 3 when 0 then 'en' when 1 then 'zh' else 'de' end"
    " || '.wiki.example/wiki/U_' || cast(user_id as {text})"
)


def event_columns(h: str, iso: str, text: str) -> dict[str, str]:
    """Column -> expression over ``events`` with a column ``k`` added."""
    sid = f"cast(event_id as {text})"
    after = f"case when event_id % 23 = 0 then null else {h.format(f"('a' || {sid})")} end"
    before = h.format(f"('b' || {sid})")
    level = "case when {0} is null then null when {0} > 0.66 then 'Highly Biased' when {0} > 0.33 then 'Slightly Biased' else 'Neutral' end"
    stance_at = "(k + case when event_id % 5 = 0 then 1 else 0 end) % 6"
    return {
        "id": sid,
        "original_revid": "event_id",
        "article_url": USER_URL.format(text=text),
        "user": f"case when event_id % 97 = 0 then 'N/A' when event_id % 10 = 0 then '10.0.0.' || cast(user_id % 256 as {text}) else 'user_' || cast(user_id as {text}) end",
        "timestamp": f"case when event_id % 101 = 0 then 'N/A' when event_id % 103 = 0 then '' when event_id % 107 = 0 then '2024-0' else {iso.format('ts')} end",
        "diff_before": f"case when event_id % 6 = 0 then '' else 'old ' || event_type || ' ' || cast(k as {text}) end",
        "diff_after": f"case when event_id % 6 = 1 then '  ' else 'new ' || event_type || ' ' || cast(k as {text}) end",
        "change_type": "case event_id % 6 when 0 then 'Text:Sentence:Insert' when 1 then 'Text:Sentence:Remove' else 'Text:Sentence:Change' end",
        "change_desc": f"case when event_id % 41 = 0 then null else {pick('k % 6', DESCRIPTIONS)} end",
        "bias_score_before": before,
        "bias_score_after": after,
        "bias_delta": f"round({after} - {before}, 6)",
        "bias_label_before": level.format(f"({before})"),
        "bias_label_after": level.format(f"({after})"),
        "ai_topic": "case when event_id % 17 = 0 then null when event_id % 19 = 0 then '' else event_type end",
        "ai_political_stance": f"case when event_id % 29 = 0 then null when event_id % 31 = 0 then '' when event_id % 37 = 0 then 'N/A' else {pick('k % 6', STANCES)} end",
        "is_ip": "case when event_id % 97 <> 0 and event_id % 10 = 0 then 1 else 0 end",
        "manual_bias": f"case when event_id % 40 = 0 then 'SKIPPED' when event_id % 50 = 1 then '   ' when event_id % 4 <> 0 or event_id % 28 = 0 then null when event_id % 36 = 0 then 'Unclear' when event_id % 12 = 0 then ' ' || {pick(stance_at, STANCES)} else {pick(stance_at, STANCES)} end",
        "manual_topic": "case when event_id % 40 = 0 then 'SKIPPED' when event_id % 4 <> 0 then null when event_id % 12 = 0 then ' ' || event_type when event_id % 16 = 4 then 'view' else event_type end",
        "content": f"'lead ' || event_type || chr(10) || 'new ' || event_type || ' ' || cast(k as {text}) || chr(10) || 'new ' || event_type || ' ' || cast(k as {text}) || ' tail'",
    }


K_SPARK = "cast(regexp_extract(props, '\"k\": ([0-9]+)', 1) as int)"
K_DUCK = "cast(regexp_extract(props, '\"k\": ([0-9]+)', 1) as integer)"


def event_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rev_of(table(spark, sf_dir, "events"))


def event_rev_of(events: DataFrame) -> DataFrame:
    columns = event_columns(SPARK_HASH, SPARK_ISO, "string")
    return events.withColumn("k", F.expr(K_SPARK)).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def lineitem_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("l_discount").alias("bias_score_after"),
        F.concat(F.lit("https://en.wiki.example/wiki/P_"), F.col("l_partkey").cast("string")).alias("article_url"),
        F.col("l_returnflag").alias("ai_topic"),
    )


COORD_CASE = (
    "case when user_id % 11 = 0 then null"
    " when user_id % 13 = 0 then 'POINT(x)'"
    " when user_id % 17 = 0 then 'LINE(1 2)'"
    " when user_id % 7 = 0 then 'point(' || {lon} || ' ' || {lat} || ')'"
    " else 'POINT(' || {lon} || ' ' || {lat} || ')' end"
)


def articles_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per user; some without coordinate, some malformed, some missing."""
    # Some users have no article on purpose: the joins must keep their rows.
    users = table(spark, sf_dir, "events").filter("user_id % 29 <> 0").select("user_id").distinct()
    url = USER_URL.format(text="string")
    lon = f"cast(120 + {SPARK_HASH.format(f'({url})')} as string)"
    lat = f"cast(24 + {SPARK_HASH.format("('y' || " + url + ")")} as string)"
    return users.selectExpr(f"{url} as url", f"{COORD_CASE.format(lon=lon, lat=lat)} as coord")


def label_events_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to labels: one per event, a skip now and then, clears up to shortly before the newest event."""
    return label_events_of(table(spark, sf_dir, "events"))


#: The last clear is late enough that many users write nothing after it.
CLEARS = "event_id % 700 = 699"


def label_events_of(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.expr(K_SPARK)).selectExpr(
        "cast(user_id as string) as id",
        f"{pick('k % 6', STANCES)} as stance",
        "event_type as topic",
        "event_id as event_seq",
        f"case when {CLEARS} then 'clear' when event_id % 40 = 0 then 'skip' else 'label' end as kind",
    )


def chat_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as articles: revision k holds the turns k-2 .. k. (article, rev_seq, text)

    Each turn is handed to the three revisions it belongs to, so no window runs per conversation.
    """
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("article"), "turn", "text", F.explode(F.sequence("turn", F.col("turn") + 2)).alias("rev_seq")
    )
    in_order = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return (
        turns.groupBy("article", "rev_seq")
        .agg(F.max("turn").alias("last"), F.array_join(F.transform(in_order, lambda t: t["text"]), "\n").alias("text"))
        .filter(F.col("last") == F.col("rev_seq"))
        .drop("last")
    )


def doc_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: revision k holds the lines k-2 .. k. (article, rev_seq, text)

    Built inside the row: the array of lines is zipped with itself one and two steps back.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    none = F.array(F.lit(None).cast("string"))
    lines = F.col("lines")
    two = F.zip_with(lines, F.concat(none, lines), lambda a, b: F.concat_ws("\n", b, a))
    three = F.zip_with(two, F.concat(none, none, lines), lambda ab, c: F.concat_ws("\n", c, ab))
    texts = F.slice(three, F.lit(1), F.size(lines))
    return documents.select(F.col("doc_id").alias("article"), F.posexplode(texts).alias("rev_seq", "text")).select(
        "article", F.col("rev_seq").cast("long").alias("rev_seq"), "text"
    )


def wiki_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles with markup: revision k is line k behind or in front of nodes that hold k."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    n, line = F.col("k").cast("string"), F.col("line")
    infobox = F.concat(F.lit("{{Infobox|name=x|count="), n, F.lit("|[[Main|"), n, F.lit("]]}} "), line)
    city = F.concat(F.lit("[[City|town "), n, F.lit("]] "), line)
    reference = F.concat(line, F.lit('<ref name="s">src '), n, F.lit("</ref>"))
    nested = F.concat(F.lit("{{Outer|a={{Inner|"), n, F.lit("}}|b="), n, F.lit("}}"), line)
    only = F.concat(F.lit("'''"), line, F.lit("''' [[Only "), n, F.lit("]]"))
    kind = F.col("doc_id") % 5
    text = (
        F.when(kind == 0, infobox).when(kind == 1, city).when(kind == 2, reference).when(kind == 3, nested).otherwise(only)
    )
    return lines.select(F.col("doc_id").alias("article"), F.col("k").cast("long").alias("rev_seq"), text.alias("text"))


API_PAGE = 3


def api_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers of a history service, newest turn first, three per page.

    Even conversations nest the text, odd ones do not; some users are missing; every tenth
    conversation answers with page id -1.
    """
    turns = table(spark, sf_dir, "conversations")
    newest = turns.groupBy("conv_id").agg(F.max("turn").alias("newest"))
    at = F.col("newest") - F.col("turn")
    text = F.col("text")
    nested = F.struct(F.struct(text.alias("*")).alias("main"))
    rev = F.struct(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("revid"),
        F.when(F.col("turn") % 3 != 1, F.concat(F.col("role"), F.lit("_"), F.col("conv_id").cast("string"))).alias("user"),
        F.concat(F.lit("2024-01-0"), (F.col("turn") % 9 + 1).cast("string"), F.lit("T00:00:00Z")).alias("timestamp"),
        F.when(F.col("conv_id") % 2 == 0, nested).alias("slots"),
        F.when(F.col("conv_id") % 2 == 1, text).alias("*"),
    )
    paged = (
        turns.join(newest, "conv_id")
        .select("conv_id", (F.floor(at / API_PAGE)).cast("long").alias("page_no"), F.struct(at.alias("at"), rev.alias("rev")).alias("r"))
        .groupBy("conv_id", "page_no")
        .agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["rev"]).alias("revisions"))
    )
    missing = F.col("conv_id") % 10 == 9
    page_id = F.when(missing, F.lit("-1")).otherwise(F.col("conv_id").cast("string"))
    page = F.struct(
        F.concat(F.lit("T "), F.col("conv_id").cast("string")).alias("title"),
        F.when(~missing, F.col("revisions")).alias("revisions"),
    )
    body = F.to_json(F.struct(F.struct(F.create_map(page_id, page).alias("pages")).alias("query")))
    url = F.concat(F.lit("https://en.wiki.example/wiki/T_"), F.col("conv_id").cast("string"))
    return paged.select(url.alias("article"), "page_no", body.alias("body"))


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as search results, a hundred per document; each third has no coordinate."""
    key = F.col("c_custkey")
    value = lambda c: F.struct(c.alias("value"))
    url = F.concat(F.lit("https://en.wiki.example/wiki/C_"), (key % 1000).cast("string"))
    coord = F.concat(F.lit("Point("), (key % 180).cast("string"), F.lit(" "), (key % 90).cast("string"), F.lit(")"))
    found = F.when(key % 3 == 0, F.create_map(F.lit("article"), value(url))).otherwise(
        F.create_map(F.lit("article"), value(url), F.lit("coord"), value(coord))
    )
    documents = (
        table(spark, sf_dir, "customer")
        .groupBy(F.floor(key / 100).alias("d"))
        .agg(F.collect_list(found).alias("bindings"))
        .select(F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("body"))
    )
    return documents.select(F.from_json("body", DISCOVERY_RESULT).alias("r")).select("r.*")


ZH, EN = "https://zh.wiki.example/", "https://en.wiki.example/"


def triples_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph: customers in nations in regions (with one cycle), coordinates, seats, links, labels."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")

    def node(prefix: str, c):
        return F.concat(F.lit(prefix), c.cast("string"))

    key = F.col("c_custkey")
    item = node("C", key)
    place = node("N", F.col("c_nationkey"))

    def triple(s, p: str, o, wanted=F.lit(True)):
        return F.when(wanted, F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")))

    zh, en = node(ZH + "wiki/C_", key), node(EN + "wiki/C_", key)
    has_zh, has_en = key % 2 == 0, key % 5 != 0
    coord = F.concat(F.lit("Point("), (key % 180).cast("string"), F.lit(" 24.5)"))
    of_customer = F.array(
        triple(item, "P131", place, key % 3 != 1),
        triple(item, "P625", coord, key % 3 == 0),
        triple(item, "P159", place, key % 3 == 1),
        triple(zh, "about", item, has_zh),
        triple(zh, "isPartOf", F.lit(ZH), has_zh),
        triple(en, "about", item, has_en),
        triple(en, "isPartOf", F.lit(EN), has_en),
        triple(item, "label@zh", node("zh ", key), key % 4 == 0),
        triple(item, "label@en", node("en ", key), key % 3 != 2),
    )
    up = F.array(triple(node("N", F.col("n_nationkey")), "P131", node("R", F.col("n_regionkey"))))
    down = (
        nation.groupBy("n_regionkey")
        .agg(F.min("n_nationkey").alias("n"))
        .select(F.inline(F.array(triple(node("R", F.col("n_regionkey")), "P131", node("N", F.col("n"))))))
    )
    graph = customer.select(F.explode(of_customer).alias("t")).filter("t is not null").select("t.*")
    return graph.unionByName(nation.select(F.inline(up))).unionByName(down)


def regions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").filter(F.col("r_regionkey").isin(1, 2))
    return regions.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("region"))


USERS = (
    "case user_id % 9 when 0 then '1.2.3.' || cast(user_id as {0}) when 1 then '999.1.1.' || cast(user_id as {0})"
    " when 2 then 'fe80::' || cast(user_id as {0}) when 3 then '::1' when 4 then 'fe80::'"
    " when 5 then '[a:' || cast(user_id as {0}) || ']' when 6 then 'Cafe:Bad' when 7 then 'N/A'"
    " else 'user ' || cast(user_id as {0}) end"
)


def user_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(USERS.format("string")).alias("user"))


def hash_score(prefix: str, text: str) -> str:
    """Stand-in bias score of a text: 0 when blank, else from its digest."""
    return f"case when trim({text}) = '' then 0.0D else {SPARK_HASH.format(f"('{prefix}' || {text})")} end"
