"""Quality verdicts: fixed rules, then a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The one- and two-grams of words are hashed into BUCKETS buckets. Two multinomials are counted
over the buckets, one from trusted texts and one from all texts. A text's score is the mean over its grams of log(trusted / raw); it is kept at THRESHOLD or more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.shared import WORD, free
from revlens.session import written_table

BUCKETS = 1 << 16
THRESHOLD = -0.3
#: Trusted texts the target model is fitted on at most: those whose ids have the smallest digests.
TRUSTED = 20_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 0.3
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def with_digests(df: DataFrame, words: str, out: str) -> DataFrame:
    return df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))


def _joined(e: Column, step: int) -> Column:
    """Digests of each place with the one ``step`` places on: of 2n places if those are of n = step."""
    n = F.greatest(F.size(e) - step, F.lit(0))
    return F.zip_with(F.slice(e, 1, n), F.slice(e, step + 1, n), lambda a, b: F.xxhash64(a, b))


def with_grams(df: DataFrame, digests: str, out: str) -> DataFrame:
    """Add the buckets of the one- and two-grams of words."""
    e, n = F.col(digests), F.greatest(F.size(digests) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(e, 1, n), F.slice(e, 2, n), lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b))
    return df.withColumn(out, F.transform(F.concat(e, pairs), lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")))


def with_repeats(df: DataFrame, digests: str, out: str) -> DataFrame:
    """Add the number of words in a WINDOW-word window that is found at another place of the text too.

    Digests of windows are made by doubling, so WINDOW is a power of two. Steps that are used more
    than once are columns of their own, so that Spark computes them once.
    """
    windows, twice, ordered, places = free(df, "windows", "twice", "ordered", "places")
    df, step = df.withColumn(windows, F.col(digests)), 1
    while step < WINDOW:
        df, step = df.withColumn(windows, _joined(F.col(windows), step)), 2 * step
    df = df.withColumn(twice, F.size(F.array_distinct(windows)) < F.size(windows))
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(ordered, F.when(F.col(twice), F.sort_array(pairs)))

    def place(x, k):
        near = [F.coalesce(F.get(F.col(ordered), k + step)["h"] == x["h"], F.lit(False)) for step in (-1, 1)]
        return F.when(near[0] | near[1], x["i"])

    df = df.withColumn(places, F.sort_array(F.array_compact(F.transform(ordered, place))))
    at = F.col(places)
    gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda s, x: s + x)
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop(windows, twice, ordered, places)


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The other counts of the fixed rules; text must not be null."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRUSTED) -> np.ndarray:
    """log(trusted / raw) of every bucket, both smoothed by one; zeros if there is no trusted text.

    ``trusted`` (id_col) names the trusted rows. The array has BUCKETS numbers at any size of input.
    """
    ids = trusted.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(most).withColumn("hit", F.lit(1))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most TRUSTED ids are sent to all tasks
    marked = texts.join(F.broadcast(ids), "id", "left").select(words(F.col("text")).alias("words"), F.coalesce("hit", F.lit(0)).alias("hit"))
    # a plain explode would put a test of its array below all steps, which then cut and hash the words again
    grams = with_grams(with_digests(marked, "words", "digests"), "digests", "grams").select(F.explode_outer("grams").alias("bucket"), "hit")
    counted = grams.filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("hit").alias("target"))
    rows = written_table(counted, "grams").collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column ``verdict`` (longer if taken): the measures, base_failed, score, kept.

    A null text has no words. Rows with fewer than MIN_WORDS words, or with more than MAX_REPEAT
    of them in repeated windows, fail the fixed rules. A text without words has a null score.
    Repeated rows are each judged; an id that is trusted once is trusted. An empty table gives no
    rows. Columns added on the way have names that docs does not use. A row number, which Spark
    must not move, holds filters on the verdict above the steps that compute it.
    """
    table = F.lit(np.round(ratios(docs, trusted, id_col, text_col), 6))
    verdict, text, split, digests, buckets, repeats, row = free(docs, "verdict", "text", "words", "digests", "buckets", "repeats", "row")
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(split, words(F.col(text)))
    rows = with_digests(rows, split, digests)
    rows = with_grams(with_repeats(rows, digests, repeats), digests, buckets)
    total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b))
    score = F.when(F.size(buckets) > 0, total / F.size(buckets))
    found = measures(F.col(text), F.col(split)) | {"n_repeat_words": F.col(repeats), "score": score}
    rows = rows.withColumn(verdict, F.struct(*[c.alias(k) for k, c in found.items()])).drop(text, split, digests, buckets, repeats)
    v = F.col(verdict)
    failed = (v["n_words"] < MIN_WORDS) | (100 * v["n_repeat_words"] > F.lit(round(100 * MAX_REPEAT)) * v["n_words"])
    rows = rows.withColumn(verdict, v.withField("base_failed", failed))
    rows = rows.withColumn(verdict, v.withField("kept", ~v["base_failed"] & (F.coalesce(v["score"], F.lit(0.0)) >= threshold)))
    rows = rows.withColumn(row, F.monotonically_increasing_id())
    return rows.withColumn(verdict, F.when(F.col(row) >= 0, v)).drop(row)


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every row."""
    rows = judge(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels.filter("quality = 1"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return rows.select("doc_id", *[F.col("verdict")[k].alias(k) for k in names])


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a good verdict, with their own columns."""
    (verdict,) = free(docs, "verdict")
    return judge(docs, labels.filter("quality = 1"), id_col, text_col).filter(F.col(verdict)["kept"]).select(*docs.columns)
