"""Connected components of a link table, as rounds of joins on Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import written_table


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes along the links (a[i], b[i])."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _star(links: DataFrame, below: bool) -> DataFrame:
    """Point neighbours of every node at the smallest one: those above the node, or the node and those below."""
    both = links if below else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if below:
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        turned = both.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return turned.unionByName(low.select("a", F.col("low").alias("b"))).filter("a > b").distinct()
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of the component.

    Alternates the two star operations of Kiveris et al. (2014) until nothing moves; the
    number of rounds grows with the logarithm of the longest chain. Every round is a written
    table, so a lost executor costs at most one round. Loops and repeated links are allowed,
    a null end drops the link, no links give no rows.
    """
    now = written_table(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = seen
        now = written_table(_star(_star(now, below=False), below=True), "links")
