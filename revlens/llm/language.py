"""Language identification that fuses four kinds of evidence by Bayes' rule.

- text: byte trigrams, lower-cased and hashed into BUCKETS buckets, a multinomial for each
  language; its logarithm is divided by three, as neighbouring trigrams share bytes;
- declared markup language: P(declared | language) from a table of declared against text language;
- address: the suffix, then the site (last two labels), then the host, each a Dirichlet prior
  over languages whose mean is the level above, counted by grouped aggregation;
- the class ``und``, whose trigrams are all as likely, takes texts that fit no language.

The text model is fitted on about SAMPLE rows of each declared language, chosen by a digest of id
and text, so that a rare language has as good a model as a frequent one. A row that is in the
sample is judged without its own trigrams, as it is without its own place in the prior of its
host. All counts of hosts and declarations cover all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.shared import free
from revlens.llm.words import text_bytes
from revlens.session import written_table

BUCKETS = 1 << 16
#: Labelled rows of each declared language that the text model is fitted on, about.
SAMPLE = 5_000
#: Rows from which a declared code is a language of the model; fewer say too little of its trigrams.
LEAST_ROWS = 5
#: Added to every count of a bucket; small, so that foreign text stays below the even odds of ``und``.
SMOOTHING = 0.05
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.001
STRENGTH = 5.0
MIN_CONFIDENCE = 0.5
PIECE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def primary_tag(declared: Column) -> Column:
    """The first part of a language tag in lower case, if it has two or three letters, else null."""
    tag = F.regexp_extract(F.lower(declared), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)
    return F.when(tag != "", tag)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host != "", F.lower(host))


def site_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def visible_text(html: Column) -> Column:
    """Markup replaced by blanks, without scripts and styles."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")


def markup_language(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    return F.when(found != "", found)


def trigrams(data: np.ndarray) -> np.ndarray:
    b = _LOWER[data]
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def _counts(data: np.ndarray) -> np.ndarray:
    """How often each bucket occurs in one text."""
    sums = np.zeros(BUCKETS, np.int64)
    for s in range(0, len(data) - 2, PIECE):
        sums += np.bincount(trigrams(data[s:s + PIECE + 2]), minlength=BUCKETS)
    return sums


def sampled(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """rows (id, text, declared, ...) with ``fits``: about ``sample`` rows of each declared language.

    All rows of a language with no more than that. Rows that repeat id and text fit together;
    rows without an id are told apart by their text. Rows that declare nothing do not fit.
    """
    tags = rows.filter("declared is not null").groupBy("declared").agg(F.count("*").alias("n"))
    edge = (F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")) * (1 << 32)).cast("bigint")
    tags = written_table(tags.select("declared", edge.alias("edge")), "tags")
    # tags have two or three letters: at most 18,252 rows
    joined = rows.join(F.broadcast(tags), "declared", "left")
    drawn = F.xxhash64("id", "text").bitwiseAND(F.lit(0xFFFFFFFF)) < F.col("edge")
    return joined.withColumn("fits", F.coalesce(drawn, F.lit(False))).drop("edge")


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, counts: BUCKETS x languages) from rows (text, declared, fits), of those that fit.

    Null and empty texts count as rows without trigrams. 512 kB a language reach the driver; there are as
    many languages as two- and three-letter codes with LEAST_ROWS rows, whatever their share of the table.
    """
    def count(batches):
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            tags = np.array(batch.column("declared").to_pylist(), object)
            for tag in sorted(set(tags)):
                sums = np.zeros(BUCKETS, np.int64)
                for k in np.flatnonzero(tags == tag):
                    sums += _counts(data[at[k]:at[k + 1]])
                some = np.flatnonzero(sums)
                n = int((tags == tag).sum())
                yield pa.RecordBatch.from_pydict(
                    {"tag": [tag] * (len(some) + 1), "bucket": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(sums[some], n), pa.int64())}
                )

    chosen = rows.filter("fits").select("text", "declared")
    counted = chosen.mapInArrow(count, "tag string, bucket int, n bigint").groupBy("tag", "bucket").agg(F.sum("n").alias("n"))
    counted = written_table(counted, "trigrams")
    names = sorted(r["tag"] for r in counted.filter((F.col("bucket") == -1) & (F.col("n") >= LEAST_ROWS)).collect())
    place = {name: k for k, name in enumerate(names)}
    table = np.zeros((BUCKETS, len(names)), np.int64)
    for r in counted.filter(F.col("tag").isin(names) & (F.col("bucket") >= 0)).toLocalIterator():  # at most BUCKETS rows a language
        table[r["bucket"], place[r["tag"]]] = r["n"]
    return names, table


def logarithms(counts: np.ndarray) -> np.ndarray:
    """Log-likelihoods, BUCKETS x languages and ``und``."""
    table = np.full((BUCKETS, counts.shape[1] + 1), -math.log(BUCKETS))
    table[:, :-1] = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS))
    return table.astype(np.float32)


def likelihoods(rows: DataFrame, names: list[str], counts: np.ndarray) -> DataFrame:
    """(id, declared, host, ll, text_lang) of rows (id, text, declared, host, fits).

    ll has the logarithms for each language and ``und``, text_lang is the likeliest language, null
    without three bytes of text. Where a row fits, its trigrams are taken from the language it declares.
    """
    place = {name: k for k, name in enumerate(names)}
    model = rows.sparkSession.sparkContext.broadcast(counts)  # see fit for its size

    def run(batches):
        known, table = model.value, logarithms(model.value)
        totals = known.sum(0)

        def without(data, k):
            """The logarithm for language k, fitted without this text."""
            own = _counts(data)
            some = np.flatnonzero(own)
            left = np.log((known[some, k] - own[some] + SMOOTHING) / (totals[k] - own.sum() + SMOOTHING * BUCKETS))
            return float((own[some] * left).sum())

        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            out = np.zeros((batch.num_rows, table.shape[1]))
            for k, (declared, fits) in enumerate(zip(batch.column("declared").to_pylist(), batch.column("fits").to_pylist())):
                for s in range(int(at[k]), int(at[k + 1]) - 2, PIECE):
                    out[k] += table[trigrams(data[s:min(s + PIECE + 2, int(at[k + 1]))])].sum(0, dtype=np.float64)
                if fits and declared in place and at[k + 1] - at[k] > 2:
                    out[k, place[declared]] = without(data[at[k]:at[k + 1]], place[declared])
            best = out[:, :-1].argmax(1) if names else np.zeros(len(out), int)
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, table.shape[1], dtype=np.int32), pa.array((out / 3).ravel()))
            seen = [names[b] if names and at[k + 1] - at[k] > 2 else None for k, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "declared", "host")], lists, pa.array(seen, pa.string())], names=["id", "declared", "host", "ll", "text_lang"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "declared", "host", "text", "fits").mapInArrow(run, f"id {kind}, declared string, host string, ll array<double>, text_lang string")


def _levels(found: DataFrame, names: list[str]) -> DataFrame:
    """(host, n0..): rows by language of each host plus STRENGTH times the mean of the levels above."""
    cols = [f"n{k}" for k in range(len(names))]
    hosts = found.groupBy("host").agg(*[F.sum((F.col("text_lang") == name).cast("double")).alias(c) for name, c in zip(names, cols)])
    hosts = hosts.na.fill(0.0).withColumn("site", F.coalesce(site_of(F.col("host")), F.lit(""))).withColumn("suffix", F.coalesce(suffix_of(F.col("host")), F.lit("")))
    hosts = written_table(hosts, "hosts")
    sites = hosts.groupBy("site", "suffix").agg(*[F.sum(c).alias(c) for c in cols])
    suffixes = sites.groupBy("suffix").agg(*[F.sum(c).alias(c) for c in cols])
    whole = suffixes.agg(*[F.sum(c).alias(c) for c in cols]).first()
    total = sum((whole[c] or 0.0) for c in cols)
    top = [F.lit(((whole[c] or 0.0) + 1.0) / (total + len(cols))) for c in cols]

    def smoothed(df, above):
        size = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
        return df.withColumns({f"p{k}": (F.col(c) + STRENGTH * above[k]) / (size + STRENGTH) for k, c in enumerate(cols)})

    means = [F.col(f"p{k}") for k in range(len(cols))]
    ps = [f"p{k}" for k in range(len(cols))]
    suffixes = smoothed(suffixes, top).select("suffix", *ps)
    sites = smoothed(sites.join(suffixes, "suffix"), means).select("site", "suffix", *ps)
    joined = hosts.join(sites, ["site", "suffix"])
    return joined.select("host", *[(F.col(c) + STRENGTH * F.col(p)).alias(c) for c, p in zip(cols, ps)])


def identify(rows: DataFrame, sample: int = SAMPLE, least: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, declared, text_lang, lang, confidence, accepted) of rows (id, text, declared, host).

    A null declaration or host is no evidence; an empty text leaves the other kinds. ``accepted``
    says that the likeliest class is a language and has at least ``least`` of the probability;
    without any language in the labelled sample, lang is null and nothing is accepted. Rows that
    repeat count and come out each, null ids included. The own row does not count in the prior of
    its host, nor in the trigrams of the language it declares.
    """
    rows = sampled(rows.withColumn("declared", primary_tag(F.col("declared"))), sample)
    names, counts = fit(rows)
    found = written_table(likelihoods(rows, names, counts), "likelihoods")
    if not names:
        return found.select("id", "declared", "text_lang", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    said = found.filter("declared is not null and text_lang is not null").groupBy("declared").agg(
        *[F.sum((F.col("text_lang") == name).cast("double")).alias(f"d{k}") for k, name in enumerate(names)]
    )
    said = written_table(said, "declared")
    whole = said.agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(len(names))], F.count("*").alias("tags")).first()
    odds = [F.log((F.coalesce(F.col(f"d{k}"), F.lit(0.0)) + 0.1) / ((whole[f"d{k}"] or 0.0) + 0.1 * max(1, whole["tags"]))) for k in range(len(names))]
    odds = [F.when(F.col("declared").isNull(), 0.0).otherwise(o) for o in odds]
    hosts = written_table(_levels(found, names), "priors")
    # tags have two or three letters: at most 18,252 rows
    both = found.join(F.broadcast(said), "declared", "left").join(hosts, found["host"].eqNullSafe(hosts["host"]), "left").drop(hosts["host"])
    own = [F.coalesce((F.col("text_lang") == name).cast("double"), F.lit(0.0)) for name in names]
    pseudo = [F.greatest(F.coalesce(F.col(f"n{k}") - own[k], F.lit(1.0)), F.lit(1e-6)) for k in range(len(names))]
    size = sum(pseudo[1:], pseudo[0])
    terms = [F.get("ll", k) + odds[k] + F.log((1 - UNKNOWN_PRIOR) * pseudo[k] / size) for k in range(len(names))]
    unknown = F.get("ll", len(names)) + F.when(F.col("declared").isNull(), 0.0).otherwise(-math.log(max(1, whole["tags"]))) + math.log(UNKNOWN_PRIOR)
    posts = both.select("id", "declared", "text_lang", F.array(*terms, unknown).alias("post"))
    posts = posts.select("*", F.array_max("post").alias("most"))
    posts = posts.select("*", F.element_at(F.lit([*names, UNKNOWN]), F.array_position("post", F.col("most")).cast("int")).alias("lang"))
    sure = 1 / F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    posts = posts.select("id", "declared", "text_lang", "lang", sure.alias("confidence"))
    return posts.select("*", ((F.col("lang") != UNKNOWN) & (F.col("confidence") >= least)).alias("accepted"))


def page_languages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """identify() for web pages: the id column, declared, text_lang, lang, confidence, accepted.

    Null html is empty text without a declaration; null and repeated ids come out as often as they go in.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), visible_text(html).alias("text"), markup_language(html).alias("declared"), host_of(F.col(url_col)).alias("host"))
    return identify(rows).withColumnRenamed("id", id_col)


def in_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of docs whose language is known, with their own columns; equal (id, text) share one verdict."""
    one, two, digest = free(docs, "_id", "_text", "_digest")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"), F.col(declared_col).alias("declared"), F.col(host_col).alias("host"))
    verdicts = identify(rows)
    bad = written_table(verdicts.filter(~F.col("accepted")).select(F.col("id.id").alias(one), F.col("id.digest").alias(digest)).distinct(), "rejected")
    marked = docs.withColumn(two, F.xxhash64(text_col))
    same = marked[id_col].eqNullSafe(bad[one]) & (marked[two] == bad[digest])
    return marked.join(bad, same, "left_anti").select(*docs.columns)
