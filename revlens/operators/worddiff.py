"""Word-level edit scripts of text pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.lcs import common_words, edit_script
from revlens.functions.text import words

SCRIPT_TYPE = T.ArrayType(
    T.StructType([T.StructField("op", T.StringType()), T.StructField("word", T.StringType())])
)


#: Words in the pairs that a task holds as Python objects at once; a longer pair is taken alone.
WORDS_AT_ONCE = 1 << 17


def _slices(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[list[tuple[list[str], list[str]]]]:
    """The pairs in order, few enough at once; an Arrow batch is bounded by rows, whatever their length."""
    for before, after in batches:
        sizes = np.add(*(side.value_lengths().to_numpy(zero_copy_only=False) for side in (before, after)))
        upto = np.append(0, np.cumsum(sizes))
        k = 0
        while k < len(sizes):
            stop = max(k + 1, int(np.searchsorted(upto, upto[k] + WORDS_AT_ONCE, "right")) - 1)
            yield list(zip(before[k:stop].to_pylist(), after[k:stop].to_pylist()))
            k = stop


@F.arrow_udf(SCRIPT_TYPE)
def _script(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for some in _slices(pairs):
        ends, ops, found = [0], [], []
        for a, b in some:
            for op, word in edit_script(a, b):
                ops.append(op)
                found.append(word)
            ends.append(len(ops))
        entries = pa.StructArray.from_arrays([pa.array(ops, pa.string()), pa.array(found, pa.string())], names=["op", "word"])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)


@F.arrow_udf(T.LongType())
def _common(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for some in _slices(pairs):
        yield pa.array([common_words(a, b) for a, b in some], pa.int64())


def _word_list(c: Column) -> Column:
    return words(F.coalesce(c, F.lit("")))


def word_script(before: Column, after: Column) -> Column:
    """array<struct<op, word>>: eq and del give back the before-words, eq and ins the after-words."""
    return _script(_word_list(before), _word_list(after))


def word_diff(pairs: DataFrame, before: str = "previous", after: str = "current") -> DataFrame:
    """The edit script of each pair; works on revision pairs and on stored changes alike."""
    return pairs.withColumn("script", word_script(F.col(before), F.col(after)))


def word_counts(pairs: DataFrame, before: str = "previous", after: str = "current") -> DataFrame:
    """Add words_kept, words_added and words_removed of each pair.

    Only the common length crosses into Python; a pair without any shared word, such as the
    first revision of an article, does not go there at all.
    """
    old, new = _word_list(F.col(before)), _word_list(F.col(after))
    shared = F.arrays_overlap(old, new)
    none = F.array().cast("array<string>")
    kept = _common(F.when(shared, old).otherwise(none), F.when(shared, new).otherwise(none))
    return (
        pairs.withColumn("words_kept", kept)
        .withColumn("words_added", F.size(new) - F.col("words_kept"))
        .withColumn("words_removed", F.size(old) - F.col("words_kept"))
    )


def word_churn(pairs: DataFrame, *keys: str) -> DataFrame:
    """Words kept, added and removed per key, and the number of revisions."""
    counted = word_counts(pairs)
    names = ("words_kept", "words_added", "words_removed")
    return counted.groupBy(*keys).agg(F.count("*").alias("revisions"), *[F.sum(n).alias(n) for n in names])
