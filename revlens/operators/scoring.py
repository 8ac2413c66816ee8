"""Classifying texts: pluggable scorers, each distinct text scored once.

A scorer takes (key, text) and returns (key, probs) with probs a map label -> probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.scores import best_label
from revlens.functions.text import non_blank, run_starts, text_key, words
from revlens.schema import NOT_AVAILABLE
from revlens.session import written_table

Scorer = Callable[[DataFrame], DataFrame]


def expression_scorer(probs: Callable[[Column], Column]) -> Scorer:
    """Scorer made of a column expression."""
    return lambda texts: texts.select("key", probs(F.col("text")).alias("probs"))


def function_scorer(load: Callable[[], Callable[[list[str]], list[dict[str, float]]]]) -> Scorer:
    """Scorer around an outside model.

    ``load`` runs once per Python worker and gives a function from a batch of texts to their
    probabilities. The UDF is declared non-deterministic, so that a filter on its result is
    not copied below it and the model does not run twice.
    """

    @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.tolist()), dtype="object")

    once = classify.asNondeterministic()
    return lambda texts: texts.select("key", once("text").alias("probs"))


def distinct_texts(df: DataFrame, *columns: str) -> DataFrame:
    """(key, text) of the non-blank values of the columns, each text once."""
    values = df.select(F.explode(F.array(*columns)).alias("text")).filter(non_blank(F.col("text")))
    keyed = values.select(text_key(F.col("text")).alias("key"), "text")
    return keyed.groupBy("key").agg(F.any_value("text").alias("text"))


def with_probabilities(df: DataFrame, scores: DataFrame, column: str, name: str) -> DataFrame:
    """Join probabilities back by digest; a blank or unscored text gets NULL."""
    looked_up = scores.select(F.col("key").alias("_key"), F.col("probs").alias(name))
    return (
        df.withColumn("_key", text_key(F.col(column))).join(looked_up, "_key", "left").drop("_key")
    )


def with_best_label(df: DataFrame, scores: DataFrame, column: str, name: str) -> DataFrame:
    """Best label of a text column, ``N/A`` for blank or unscored texts."""
    scored = with_probabilities(df, scores, column, "_probs")
    label = F.when(non_blank(F.col(column)), best_label(F.col("_probs")))
    return scored.withColumn(name, F.coalesce(label, F.lit(NOT_AVAILABLE))).drop("_probs")


def tokens(text: Column) -> Column:
    return words(F.lower(text))


def token_counts(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, n): how often each text uses each token, counted inside its row, so nothing is shuffled."""
    listed = texts.select(*keys, F.array_sort(tokens(F.col("text"))).alias("_t"))
    starts = listed.withColumn("_s", run_starts(F.col("_t")))
    runs = F.transform(
        "_s",
        lambda s, k: F.struct(
            F.get("_t", s).alias("token"), (F.coalesce(F.get("_s", k + 1), F.size("_t")) - s).cast("long").alias("n")
        ),
    )
    return starts.select(*keys, F.inline(runs))


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing, trained and applied as joins.

    ``counts``: (token, n0, n1, ...), how often each class uses the token.
    ``docs``: one row (d0, d1, ...), texts per class. Columns follow the order of ``classes``.
    """

    def __init__(self, counts: DataFrame, docs: DataFrame, classes: Sequence[str]):
        self.counts, self.docs, self.classes = counts, docs, list(classes)

    @classmethod
    def train(cls, texts: DataFrame, classes: Sequence[str]) -> "NaiveBayes":
        """``texts``: (label, text). One shuffle, by token, after combining on the map side."""

        def per_class(prefix: str) -> list[Column]:
            return [F.count_if(F.col("label") == c).alias(f"{prefix}{i}") for i, c in enumerate(classes)]

        exploded = texts.select("label", F.explode(tokens(F.col("text"))).alias("token"))
        return cls(exploded.groupBy("token").agg(*per_class("n")), texts.agg(*per_class("d")), classes)

    def saved(self) -> "NaiveBayes":
        """The same model on written tables.

        Training then runs once, and the join sees a table of known size: small ones are
        broadcast, otherwise both sides are shuffled and a token of every text can be split.
        """
        return NaiveBayes(written_table(self.counts, "tokens"), written_table(self.docs, "classes"), self.classes)

    def log_scores(self, texts: DataFrame) -> DataFrame:
        """(key, scores) with scores a map class -> log likelihood plus prior; (key, text) in.

        Tokens outside the vocabulary do not count. A text without any known token gets the priors.
        """
        every = range(len(self.classes))
        # log((n + 1) / (tokens + vocabulary)) is summed as log(n + 1) here and a multiple of the rest below.
        sums = (
            token_counts(texts, "key")
            .join(self.counts, "token")
            .groupBy("key")
            .agg(F.sum("n").alias("known"), *[F.sum(F.col("n") * F.log(F.col(f"n{i}") + 1)).alias(f"s{i}") for i in every])
        )
        sizes = self.counts.agg(F.struct(F.count("*").alias("v"), *[F.sum(f"n{i}").alias(f"t{i}") for i in every]))
        docs = self.docs.select(F.struct(*[f"d{i}" for i in every]))
        joined = (
            texts.select("key")
            .join(sums, "key", "left")
            .withColumn("t", sizes.scalar())
            .withColumn("d", docs.scalar())
        )
        all_docs = sum((F.col(f"d.d{i}") for i in every), F.lit(0))

        def score(i: int) -> Column:
            prior = F.log(F.col(f"d.d{i}") / all_docs)
            size = F.log(F.coalesce(F.col(f"t.t{i}"), F.lit(0)) + F.col("t.v"))
            return prior + F.coalesce(F.col(f"s{i}") - F.col("known") * size, F.lit(0.0))

        pairs = [x for i, c in enumerate(self.classes) for x in (F.lit(c), score(i))]
        return joined.select("key", F.create_map(*pairs).alias("scores"))

    def __call__(self, texts: DataFrame) -> DataFrame:
        top = F.array_max(F.map_values("scores"))
        powers = F.transform_values("scores", lambda _, v: F.exp(v - top))
        total = F.aggregate(F.map_values(F.col("e")), F.lit(0.0), lambda a, b: a + b)
        return (
            self.log_scores(texts)
            .select("key", powers.alias("e"))
            .select("key", F.transform_values("e", lambda _, v: v / total).alias("probs"))
        )


def label_centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, direction): unit vector towards the mean of each label."""
    means = (
        vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg("x").alias("x"))
    )
    centre = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    return (
        means.groupBy("label")
        .agg(centre.alias("c"))
        .select("label", F.transform("c", lambda x: x / F.sqrt(dot(F.col("c"), F.col("c")))).alias("direction"))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def nearest_label(vectors: DataFrame, candidates: DataFrame, vector: str, name: str) -> DataFrame:
    """Candidate label whose direction is closest by cosine; the smaller label on ties.

    The candidate list is a label dimension; it reaches every row as one array value, and the
    length of the row's own vector does not change which label wins.
    """
    listed = candidates.agg(F.sort_array(F.collect_list(F.struct("label", "direction")))).scalar()
    scored = F.transform(
        F.col("_labels"),
        lambda c, i: F.struct(dot(F.col(vector), c["direction"]).alias("s"), (-i).alias("i"), c["label"].alias("label")),
    )
    return vectors.withColumn("_labels", listed).withColumn(name, F.array_max(scored)["label"]).drop("_labels")
