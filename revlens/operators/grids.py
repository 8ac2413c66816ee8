"""Dense grids without a join of everything with everything.

Only the list of distinct labels travels as one value; the grid is exploded from it
where the rows are, and counts arrive by an ordinary equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_labels(df: DataFrame, *labels: Column) -> DataFrame:
    """One row with the sorted array of all values the label columns take."""
    sets = [F.collect_set(c) for c in labels]
    merged = sets[0]
    for s in sets[1:]:
        merged = F.array_union(merged, s)
    return df.agg(F.array_sort(merged).alias("labels"))


def label_square(counts: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Every label by every label, 0 where ``counts`` has no cell."""
    labels = distinct_labels(counts, F.col(row), F.col(col))
    cells = labels.select("labels", F.explode("labels").alias(row)).select(row, F.explode("labels").alias(col))
    return cells.join(counts, [row, col], "left").select(row, col, F.coalesce(value, F.lit(0)).alias(value))


def dense_series(days: DataFrame, counts: DataFrame, day: str, label: str, value: str) -> DataFrame:
    """Every day of ``days`` by every label of ``counts``, 0 where there is no count."""
    labels = distinct_labels(counts, F.col(label))
    cells = days.select(day).withColumn(label, F.explode(labels.scalar()))
    return cells.join(counts, [day, label], "left").select(day, label, F.coalesce(value, F.lit(0)).alias(value))
