"""Order inside an article, without one task per article.

An article may hold a third of all revisions, so no window is partitioned by article alone.
Positions are cut into buckets of consecutive numbers; windows run per (article, bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_WIDTH = 64


def with_previous(df: DataFrame, key: str, seq: str, value: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Add ``bucket`` and ``previous``: the value at ``seq - 1`` of the same key, '' at the start.

    ``seq`` must be dense. The last row of each bucket is copied into the next bucket, where
    it only serves its neighbour. One shuffle; everything later that groups by (key, bucket,
    ...) finds its rows already together.
    """
    here = F.floor(F.col(seq) / F.lit(width)).cast("long")
    own = F.struct(here.alias("bucket"), F.lit(False).alias("is_copy"))
    ahead = F.struct((here + 1).alias("bucket"), F.lit(True).alias("is_copy"))
    at_end = F.pmod(F.col(seq) + 1, F.lit(width)) == 0
    spread = df.select("*", F.inline(F.when(at_end, F.array(own, ahead)).otherwise(F.array(own))))
    window = W.partitionBy(key, "bucket").orderBy(seq)
    return (
        spread.withColumn("previous", F.coalesce(F.lag(value).over(window), F.lit("")))
        .filter(~F.col("is_copy"))
        .drop("is_copy")
    )


def dense_sequence(df: DataFrame, key: str, order: str, name: str, width: int = BUCKET_WIDTH * 64) -> DataFrame:
    """Number the rows of a key 0, 1, 2, ... by a unique integer ``order`` that may have gaps.

    Rows are counted per (key, order range); the running total over those ranges gives the
    offset of each, so the only window over a whole key sees one narrow row per range.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)).cast("long"))
    sizes = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # Hashed by key alone after the window; left so, the join would bring a whole key together again.
    offsets = offsets.repartition(key, "_range")
    inside = W.partitionBy(key, "_range").orderBy(order)
    return (
        ranged.join(offsets, [key, "_range"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_range", "_offset")
    )
