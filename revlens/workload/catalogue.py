"""Registered queries: name -> function of (session, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import geo, markup, scores, web
from revlens.functions.text import changed_line, highlight
from revlens.operators import (
    agreement, dashboard, dedup, discovery, labels, review, scoring, survey, textdiff, trends, worddiff,
)
from revlens.plans import discover as discover_plan
from revlens.plans import enrich as enrich_plan
from revlens.schema import STANCES, TOPICS
from revlens.session import scratch_path, written_table
from revlens.sources import articles as article_source
from revlens.sources import categories, geojson, history
from revlens.streaming import ingest, live
from revlens.workload import fixtures as fx
from revlens.workload import stored

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _agreement_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for kind in agreement.PAIRS:

        def counts(spark, sf_dir, kind=kind):
            return agreement.pair_counts(fx.event_rev(spark, sf_dir), kind)

        def report(spark, sf_dir, counts=counts):
            return agreement.classification_report(counts(spark, sf_dir))

        out[f"{kind}_confusion"] = lambda s, d, c=counts: agreement.confusion_matrix(c(s, d))
        out[f"{kind}_distribution_bias"] = lambda s, d, c=counts: agreement.distribution_bias(c(s, d))
        out[f"{kind}_report"] = lambda s, d, r=report: rounded(r(s, d).drop("hit_n"), "precision", "recall", "f1")
        out[f"{kind}_report_summary"] = lambda s, d, r=report: rounded(
            agreement.report_summary(r(s, d)),
            "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1",
        )
    return out


def article_agreement(spark, sf_dir):
    df = agreement.article_agreement(fx.event_rev(spark, sf_dir), fx.articles_fx(spark, sf_dir))
    return rounded(df, "topic_agreement", "stance_agreement", "avg_bias_score", places=4)


def _first_article(rows: DataFrame) -> str | None:
    return rows.agg(F.min("article_url")).first()[0]


def single_article_agreement(spark, sf_dir):
    """The agreement report of one article, the first labelled one by address."""
    rev = fx.event_rev(spark, sf_dir)
    url = _first_article(agreement.labelled(rev, None))
    return rounded(agreement.article_agreement(rev, fx.articles_fx(spark, sf_dir), url), "topic_agreement", "stance_agreement", "avg_bias_score", places=4)


def single_article_survey(spark, sf_dir):
    """The survey of one article, the first unlabelled one by address."""
    rev = fx.event_rev(spark, sf_dir)
    return survey.survey_articles(rev, fx.articles_fx(spark, sf_dir), _first_article(survey.unlabelled(rev)))


def agreement_geojson(spark, sf_dir):
    df = agreement.article_agreement(fx.event_rev(spark, sf_dir), fx.articles_fx(spark, sf_dir))
    return geojson.agreement_features(df)


def survey_articles(spark, sf_dir):
    df = survey.survey_articles(fx.event_rev(spark, sf_dir), fx.articles_fx(spark, sf_dir))
    return rounded(df, "avg_ai_bias", places=4)


def survey_geojson(spark, sf_dir):
    df = survey.survey_articles(fx.event_rev(spark, sf_dir), fx.articles_fx(spark, sf_dir))
    return geojson.survey_features(df)


def _queue(sort: str, **filters) -> Query:
    return lambda s, d: review.review_queue(fx.event_rev(s, d), sort, seed=7, **filters)


def _review_queries() -> dict[str, Query]:
    out = {
        f"review_queue_{sort}": _queue(sort)
        for sort in ("bias_desc", "bias_asc", "delta_desc", "delta_asc", "time_newest", "time_oldest", "random")
    }
    out["review_queue_filtered"] = _queue("bias_desc", desc="Inserted Sentence", topic="click", stance="Neutral")
    for sort in ("bias_asc", "delta_asc"):  # few rows without a score stand first here
        out[f"review_queue_filtered_{sort}"] = _queue(sort, desc="Inserted Sentence", stance="Neutral")
    out["facet_desc"] = lambda s, d: review.description_facet(fx.event_rev(s, d))
    out["facet_topic"] = lambda s, d: review.label_facet(fx.event_rev(s, d), "ai_topic")
    out["facet_stance"] = lambda s, d: review.label_facet(fx.event_rev(s, d), "ai_political_stance")
    return out


def daily_bias(spark, sf_dir):
    return as_text(rounded(trends.daily_bias(fx.event_rev(spark, sf_dir)), "avg_score"), "date")


def segment_pairs(spark, sf_dir):
    series = trends.daily_bias(fx.event_rev(spark, sf_dir))
    return as_text(rounded(trends.segment_pairs(series, "date", "avg_score"), "y1", "y2"), "x1", "x2")


def score_range(spark, sf_dir):
    series = trends.daily_bias(fx.event_rev(spark, sf_dir))
    return rounded(dashboard.value_range(series, "avg_score"), "min_value", "max_value")


def monthly_outliers(spark, sf_dir):
    found = trends.monthly_outliers(fx.lineitem_rev(spark, sf_dir))
    return rounded(found.select("month", "reason", "value", "mean", "z"), "value", "mean", "z")


def labelled_revisions(spark, sf_dir):
    state = labels.label_state(fx.label_events_fx(spark, sf_dir))
    both = labels.with_labels(fx.event_rev(spark, sf_dir), state)
    return both.select("id", "article_url", "manual_bias", "manual_topic")


def url_parts(spark, sf_dir):
    url = F.col("url")
    return fx.table(spark, sf_dir, "pages").select(
        "page_id",
        web.title(url).alias("title"),
        web.domain(url).alias("domain"),
        web.language(url).alias("lang"),
        web.api_url(url).alias("api_url"),
    )


def user_is_ip(spark, sf_dir):
    return fx.user_fx(spark, sf_dir).select("event_id", "user", web.is_ip(F.col("user")).alias("is_ip"))


def coord_parse(spark, sf_dir):
    coord = F.col("coord")
    return fx.articles_fx(spark, sf_dir).select(
        "url", geo.normalised(coord).alias("coord"), geo.longitude(coord).alias("lon"), geo.latitude(coord).alias("lat")
    )


def coord_fill(spark, sf_dir):
    return article_source.fill_coordinates(fx.articles_fx(spark, sf_dir))


def revision_pairs(spark, sf_dir):
    return textdiff.revision_pairs(fx.doc_rev(spark, sf_dir)).drop("bucket")


def sentence_edits(spark, sf_dir):
    return textdiff.sentence_edits(textdiff.revision_pairs(fx.doc_rev(spark, sf_dir))).drop("bucket")


def node_edits(spark, sf_dir):
    return textdiff.node_edits(textdiff.revision_pairs(fx.wiki_rev(spark, sf_dir))).drop("bucket")


def context_window(spark, sf_dir):
    pairs = textdiff.revision_pairs(fx.chat_rev(spark, sf_dir))
    return textdiff.with_context(textdiff.sentence_edits(pairs), pairs).drop("bucket")


def changed_lines(spark, sf_dir):
    content, after = F.col("content"), F.col("diff_after")
    return fx.event_rev(spark, sf_dir).select("id", changed_line(content, after).alias("line"))


def highlighted(spark, sf_dir):
    content, after = F.col("content"), F.col("diff_after")
    return fx.event_rev(spark, sf_dir).select("id", highlight(content, after).alias("marked"))


def plain_text(spark, sf_dir):
    return fx.wiki_rev(spark, sf_dir).select("article", "rev_seq", markup.plain_text(F.col("text")).alias("plain"))


def page_plain_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", markup.plain_text(F.col("html")).alias("plain"))


def _event_probs(side: str):
    """Class probabilities per event; half of them under the second label naming."""
    p, q = (F.expr(fx.SPARK_HASH.format(f"('{x}{side}' || id)")) for x in "pq")
    named = F.create_map(F.lit("Neutral"), F.lit(0.5), F.lit("Slightly Biased"), p, F.lit("Highly Biased"), q)
    coded = F.create_map(F.lit("LABEL_0"), F.lit(0.5), F.lit("LABEL_1"), p, F.lit("LABEL_2"), q)
    return F.when(F.col("original_revid") % 2 == 0, named).otherwise(coded)


def _scored_events(spark, sf_dir):
    rev = fx.event_rev(spark, sf_dir).select("id", "original_revid", "diff_before", "diff_after")
    out = rev
    for side in ("before", "after"):
        text, probs = F.col(f"diff_{side}"), _event_probs(side)
        out = out.withColumn(f"bias_score_{side}", scores.score_or_default(text, probs)).withColumn(
            f"bias_label_{side}", scores.label_or_default(text, probs)
        )
    return out.drop("original_revid", "diff_before", "diff_after")


def bias_scored(spark, sf_dir):
    return rounded(_scored_events(spark, sf_dir), "bias_score_before", "bias_score_after", places=7)


def material_changes(spark, sf_dir):
    scored = enrich_plan.material_changes(_scored_events(spark, sf_dir))
    delta = F.col("bias_score_after") - F.col("bias_score_before")
    return scored.select("id", F.round(delta, 7).alias("bias_delta"))


def delta_direction(spark, sf_dir):
    return fx.event_rev(spark, sf_dir).select("id", scores.delta_direction(F.col("bias_delta")).alias("direction"))


def saved_changes(spark, sf_dir):
    edits = textdiff.sentence_edits(textdiff.revision_pairs(fx.doc_rev(spark, sf_dir)))
    scored = edits.select(
        "article",
        "rev_seq",
        "change_type",
        "diff_before",
        "diff_after",
        textdiff.change_order(F.col("rev_seq"), F.col("change_seq")).alias("change_ord"),
        (F.col("article") * 1000000 + F.col("rev_seq")).alias("original_revid"),
        F.expr(fx.hash_score("s", "diff_before")).alias("bias_score_before"),
        F.expr(fx.hash_score("s", "diff_after")).alias("bias_score_after"),
    )
    gated = written_table(enrich_plan.material_changes(scored), "gated", "zstd")
    saved = dedup.saved_with_id(gated)
    return saved.select("id", "article", "rev_seq", "change_type", "diff_before", "diff_after")


def _hash_labels(prefix: str, names):
    """Scorer that spreads texts over the labels by digest."""

    def probs(text):
        share = F.conv(F.substring(F.md5(F.concat(F.lit(prefix), text)), 1, 8), 16, 10).cast("long") % len(names)
        return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), (share == i).cast("double"))])

    return scoring.expression_scorer(probs)


def _hash_bias(text):
    h = F.conv(F.substring(F.md5(F.concat(F.lit("s"), text)), 1, 8), 16, 10).cast("long") / 4294967296
    return F.create_map(F.lit("Neutral"), F.lit(0.5), F.lit("Highly Biased"), F.round(h, 6))


def enriched_changes(spark, sf_dir):
    """The whole acquisition path, from service answers to rows of the revision table."""
    revisions = written_table(history.parse_pages(fx.api_pages(spark, sf_dir)), "revisions")
    rows = enrich_plan.enrich(
        revisions, scoring.expression_scorer(_hash_bias), _hash_labels("t", TOPICS), _hash_labels("c", STANCES)
    )
    return rounded(rows, "bias_score_before", "bias_score_after", "bias_delta")


def api_revisions(spark, sf_dir):
    return history.parse_pages(fx.api_pages(spark, sf_dir))


def _labelled_documents(spark, sf_dir):
    labelled = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", "text").join(labelled, "doc_id")


def _naive_bayes(spark, sf_dir):
    return scoring.NaiveBayes.train(_labelled_documents(spark, sf_dir).select("label", "text"), ["0", "1"])


def nb_train(spark, sf_dir):
    model = _naive_bayes(spark, sf_dir)
    per_class = [F.struct(F.lit(c).alias("label"), F.col(f"n{i}").alias("n")) for i, c in enumerate(model.classes)]
    used = model.counts.select("token", F.inline(F.array(*per_class))).filter("n > 0")
    return used.select("token", "label", F.round(F.log(F.col("n") + 1), 6).alias("weight"))


def nb_score(spark, sf_dir):
    texts = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    found = _naive_bayes(spark, sf_dir).saved().log_scores(texts)
    return found.select(
        F.col("key").alias("doc_id"),
        F.round(F.element_at("scores", F.lit("1")) - F.element_at("scores", F.lit("0")), 6).alias("log_odds"),
    )


def quality_report(spark, sf_dir):
    """Naive Bayes against the true labels of the documents it was trained on."""
    documents = _labelled_documents(spark, sf_dir)
    probs = _naive_bayes(spark, sf_dir).saved()(documents.select(F.col("doc_id").alias("key"), "text"))
    guessed = probs.select(F.col("key").alias("doc_id"), scores.best_label(F.col("probs")).alias("ai"))
    counts = (
        documents.select("doc_id", F.col("label").alias("human"))
        .join(guessed, "doc_id")
        .groupBy("human", "ai")
        .agg(F.count("*").alias("n"))
    )
    return rounded(agreement.classification_report(counts).drop("hit_n"), "precision", "recall", "f1")


def zero_shot_topic(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    candidates = scoring.label_centroids(vectors, "label", "embedding")
    guessed = scoring.nearest_label(vectors, candidates, "embedding", "ai")
    return guessed.groupBy(F.col("label").alias("human"), "ai").agg(F.count("*").alias("n"))


def region_closure(spark, sf_dir):
    return discovery.region_closure(fx.triples_fx(spark, sf_dir), fx.regions_fx(spark, sf_dir))


def region_articles(spark, sf_dir):
    return discovery.region_articles(
        fx.triples_fx(spark, sf_dir), fx.regions_fx(spark, sf_dir), [fx.ZH, fx.EN], ["zh", "en"]
    )


def discovered_articles(spark, sf_dir):
    return discover_plan.discover(
        fx.triples_fx(spark, sf_dir), fx.regions_fx(spark, sf_dir), [fx.ZH, fx.EN], ["zh", "en"]
    )


def topic_categories(spark, sf_dir):
    listed = categories.category_frame(spark, ("view", "click", "purchase", "refund", "error"))
    return categories.category_counts(listed, fx.event_rev(spark, sf_dir), "ai_topic")


def stance_categories(spark, sf_dir):
    listed = categories.category_frame(spark, STANCES)
    return categories.category_counts(listed, fx.event_rev(spark, sf_dir), "ai_political_stance")


def articles_upsert(spark, sf_dir):
    """Every event moves the article of its user, the last move counts; a third of the users write at a new address."""
    address = F.expr(fx.USER_URL.format(text="string"))
    moves = fx.table(spark, sf_dir, "events").select(
        F.when(F.expr("user_id % 3 = 0"), F.concat(address, F.lit("_new"))).otherwise(address).alias("url"),
        F.concat(F.lit("POINT("), F.col("event_id").cast("string"), F.lit(" 1)")).alias("coord"),
        F.col("event_id").alias("seq"),
    )
    return article_source.upsert(fx.articles_fx(spark, sf_dir), moves, "url", "seq")


def articles_refresh(spark, sf_dir):
    """Landed search results become the new article table."""
    found = article_source.parse_bindings(fx.bindings(spark, sf_dir))
    return discover_plan.article_table(found)


def ingest_totals(spark, sf_dir):
    return article_source.ingest_totals(article_source.parse_bindings(fx.bindings(spark, sf_dir)))


def first_articles(spark, sf_dir):
    return article_source.first_articles(fx.articles_fx(spark, sf_dir), 50)


def word_diff(spark, sf_dir):
    found = worddiff.word_diff(textdiff.revision_pairs(fx.chat_rev(spark, sf_dir)))
    signs = F.transform("script", lambda o: F.concat(F.substring(o["op"], 1, 1), F.lit(":"), o["word"]))
    return found.select("article", "rev_seq", F.array_join(signs, " ").alias("script"))


def change_word_diff(spark, sf_dir):
    """The edit script of the stored text pair of each change."""
    found = worddiff.word_diff(fx.event_rev(spark, sf_dir).select("id", "diff_before", "diff_after"), "diff_before", "diff_after")
    signs = F.transform("script", lambda o: F.concat(F.substring(o["op"], 1, 1), F.lit(":"), o["word"]))
    return found.select("id", F.array_join(signs, " ").alias("script"))


def word_churn(spark, sf_dir):
    return worddiff.word_churn(textdiff.revision_pairs(fx.doc_rev(spark, sf_dir)), "article")


def _event_stream(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drain(stream, mode, transform=None):
    """Run a stream over the files that are there and read back what it published."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    live.publish(stream, f"{path}/out", f"{path}/checkpoint", mode, transform).awaitTermination()
    return live.published(spark, f"{path}/out", stream.schema)


def stream_daily_topics(spark, sf_dir):
    revisions = fx.event_rev_of(_event_stream(spark, sf_dir))
    return as_text(live.newest_batch(_drain(live.live_daily_labels(revisions, "ai_topic"), "complete")), "date")


def stream_histogram(spark, sf_dir):
    revisions = fx.event_rev_of(_event_stream(spark, sf_dir))
    return live.newest_batch(_drain(live.live_histogram(revisions), "complete"))


def stream_label_state(spark, sf_dir):
    events = fx.label_events_of(_event_stream(spark, sf_dir))
    return live.current_labels(_drain(live.live_label_writes(events), "update"))


def _timed(spark, sf_dir):
    return _event_stream(spark, sf_dir).withColumn("event_ts", F.col("ts").cast("timestamp"))


def stream_first_seen(spark, sf_dir):
    """The delay covers the whole data, so the keys of all rows come out once."""
    rows = _timed(spark, sf_dir).select("user_id", "event_type", "event_ts")
    seen = live.first_seen(rows, ["user_id", "event_type"], "event_ts", "3650 days")
    return _drain(seen, "append").select("user_id", "event_type")


def stream_daily_window(spark, sf_dir):
    counts = live.daily_windows(_timed(spark, sf_dir), "event_ts", F.col("event_type"), "1 hour")
    return as_text(_drain(counts, "append").drop(live.BATCH), "date")


def stream_ingest(spark, sf_dir):
    revisions = fx.event_rev_of(_event_stream(spark, sf_dir))
    changes = enrich_plan.material_changes(revisions).select(
        F.col("article_url").alias("article"),
        "original_revid",
        F.col("original_revid").alias("change_ord"),
        "diff_before",
        "diff_after",
    )
    path = scratch_path(spark, "ingest")
    ingest.ingest_changes(changes, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table/rows").select("id", "article", "diff_before", "diff_after")


def queries() -> dict[str, Query]:
    return {
        "monthly_outliers": monthly_outliers,
        "monthly_activity": lambda s, d: rounded(trends.monthly_activity(fx.lineitem_rev(s, d)), "avg_score"),
        **_agreement_queries(),
        "article_agreement": article_agreement,
        "agreement_geojson": agreement_geojson,
        "single_article_agreement": single_article_agreement,
        "single_article_survey": single_article_survey,
        "survey_totals": lambda s, d: rounded(survey.survey_totals(fx.event_rev(s, d)), "avg_score"),
        "survey_topics": lambda s, d: survey.survey_topics(fx.event_rev(s, d)),
        "survey_stances": lambda s, d: survey.survey_stances(fx.event_rev(s, d)),
        "survey_articles": survey_articles,
        "survey_geojson": survey_geojson,
        **_review_queries(),
        "topic_top10": lambda s, d: dashboard.top_labels(fx.event_rev(s, d), "ai_topic"),
        "stance_top10": lambda s, d: dashboard.top_labels(fx.event_rev(s, d), "ai_political_stance"),
        "bias_histogram": lambda s, d: dashboard.bias_histogram(fx.event_rev(s, d)),
        "score_range": score_range,
        "daily_bias": daily_bias,
        "daily_activity": lambda s, d: as_text(trends.daily_activity(fx.event_rev(s, d)), "date"),
        "daily_topic_grid": lambda s, d: as_text(trends.daily_label_grid(fx.event_rev(s, d), "ai_topic"), "date"),
        "daily_stance_grid": lambda s, d: as_text(
            trends.daily_label_grid(fx.event_rev(s, d), "ai_political_stance"), "date"
        ),
        "segment_pairs": segment_pairs,
        "label_state": lambda s, d: labels.label_state(fx.label_events_fx(s, d)),
        "labelled_revisions": labelled_revisions,
        "label_progress": lambda s, d: labels.label_progress(fx.event_rev(s, d)),
        "training_export": lambda s, d: labels.training_export(fx.event_rev(s, d)),
            "url_parts": url_parts,
        "user_is_ip": user_is_ip,
        "coord_parse": coord_parse,
        "coord_fill": coord_fill,
        "revision_pairs": revision_pairs,
        "sentence_edits": sentence_edits,
        "node_edits": node_edits,
        "context_window": context_window,
        "changed_line": changed_lines,
        "highlighted": highlighted,
        "plain_text": plain_text,
        "page_plain_text": page_plain_text,
        "bias_scored": bias_scored,
        "material_changes": material_changes,
        "delta_direction": delta_direction,
        "saved_changes": saved_changes,
        "enriched_changes": enriched_changes,
        "api_revisions": api_revisions,
        "nb_train": nb_train,
        "nb_score": nb_score,
        "quality_report": quality_report,
        "zero_shot_topic": zero_shot_topic,
        "region_closure": region_closure,
        "region_articles": region_articles,
        "discovered_articles": discovered_articles,
        "topic_categories": topic_categories,
        "stance_categories": stance_categories,
        "articles_upsert": articles_upsert,
        "articles_refresh": articles_refresh,
        "ingest_totals": ingest_totals,
        "first_articles": first_articles,
        "word_diff": word_diff,
        "change_word_diff": change_word_diff,
        "word_churn": word_churn,
            "stream_daily_topics": stream_daily_topics,
        "stream_histogram": stream_histogram,
        "stream_label_state": stream_label_state,
        "stream_first_seen": stream_first_seen,
        "stream_daily_window": stream_daily_window,
        "stream_ingest": stream_ingest,
        **stored.queries(),
    }
