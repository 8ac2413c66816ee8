"""Mixing sources to target weights by nested hash thresholds.

Every source has a target in words. A document is taken ``times`` = floor(target / size of its
source) times, and once more if its digest lies below a threshold of its source. The threshold
is found without sorting: words are summed by source and leading digest bits, the bucket in
which the rest of the budget runs out is the boundary, and only that bucket is cut further,
BITS at a time. Thresholds of a smaller budget are below those of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.shared import WORD, free
from revlens.session import written_table

#: Digest bits used, and bits of one step.
DIGEST, BITS = 60, 15
WEIGHTS = (1, 2, 3)
MOST = 3
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest_of(*cols: Column) -> Column:
    """The first 60 bits of an MD5, which SQL engines agree on."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, DIGEST // 4), 16, 10).cast("long")


def ranked(df: DataFrame, key: str, out: str) -> DataFrame:
    """Number the rows from 1 by key, nulls last, without one task that sees them all."""
    order = F.col(key).asc_nulls_last()
    parts = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    parts = written_table(parts, "ranked")
    before, seen = {}, 0
    for r in parts.groupBy("_part").count().orderBy("_part").collect():  # one row a partition
        before[r["_part"]], seen = seen, seen + r["count"]
    offset = F.lit(0)
    for part, n in before.items():
        offset = F.when(F.col("_part") == part, n).otherwise(offset)
    number = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn(out, number + offset).drop("_part")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Weights go round by the code points of the sources, null last. Targets share the sum of all
    sizes by weight; one above ``most`` times its source's size stops there, and the rest is
    shared anew until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, "source", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    sources = written_table(sources.withColumn("weight", weight.cast("double")).drop("place"), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, capped = None, -1
    while True:
        full = F.lit(False) if share is None else F.col("weight") * share >= most * F.col("source_size")
        row = sources.agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("n"), F.sum(F.when(full, most * F.col("source_size"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if (row["n"] or 0) == capped or not row["open"]:
            break
        capped, share = row["n"] or 0, (total - (row["used"] or 0)) / row["open"]
    limit = (most * F.col("source_size")).cast("double")
    target = limit if share is None else F.least(limit, F.col("weight") * F.lit(float(share)))
    return sources.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, times, threshold) for rows (source, size, digest) and their targets.

    At full depth the boundary is one digest; it is taken if that comes nearer to the budget.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = written_table(goals.withColumn("times", times.cast("long")).withColumn("left", F.col("target") - F.col("times") * F.col("source_size")), "goals")
    state = goals.select("source", F.lit(0).cast("long").alias("prefix"), "left")
    rows = sizes.filter("size > 0")
    for depth in range(BITS, DIGEST + 1, BITS):
        bucket = F.shiftright("digest", DIGEST - depth)
        sums = rows.groupBy("source", bucket.alias("prefix")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("prefix"))
        sums = sums.withColumn("upto", upto)
        same = sums["source"].eqNullSafe(state["source"])
        edge = sums.join(state.drop("prefix"), same).drop(state["source"]).filter("upto > `left` and upto - words <= `left`")
        state = written_table(edge.select("source", "prefix", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "words"), "edges")
        if depth < DIGEST:
            inside = bucket == state["prefix"]  # a hot source is spread over its buckets
            rows = rows.join(state.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")) & inside).select("source", "size", "digest")
            rows = written_table(rows, "inside")
            state = state.drop("words")
    found = state.select(F.col("source").alias("s"), (F.col("prefix") + (2 * F.col("left") > F.col("words")).cast("long")).alias("threshold"))
    joined = goals.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("source", "source_size", "target", "times", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"))


def _salted(found: DataFrame) -> DataFrame:
    """Each source under SALTS keys, so that the rows of a hot one meet it in many tasks."""
    return written_table(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "thresholds")


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row; taken: copies times size.

    Null texts have size 0, the null source is a source; equal rows share a digest and are taken
    together. No row is dropped; reruns agree.
    """
    text = F.col(text_col)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text).alias("size"), digest_of(F.col(id_col), text).alias("digest"))
    sizes = written_table(sizes, "sizes")
    found = thresholds(sizes, targets(sizes))
    mix = _salted(found).withColumnRenamed("source", "s")
    joined = sizes.withColumn("t", (F.col("digest") % SALTS).cast("int")).join(mix, F.col("source").eqNullSafe(F.col("s")) & (F.col("t") == F.col("salt")))
    copies = F.col("times") + (F.col("digest") < F.col("threshold")).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, with ``copies`` (longer if taken): how often each stands in it.

    Null texts have size 0, the null source is a source. The digest is of id and text, so equal
    rows share it and are taken together. A text without words is never taken. Reruns agree.
    """
    mix, size, digest, copies = free(docs, "mix", "size", "digest", "copies")
    text = F.col(text_col)
    marked = docs.withColumns({size: size_of(text), digest: digest_of(F.col(id_col), text)})
    narrow = written_table(marked.select(F.col(source_col).alias("source"), F.col(size).alias("size"), F.col(digest).alias("digest")), "sizes")
    found = _salted(thresholds(narrow, targets(narrow))).select(F.struct("*").alias(mix))
    m = F.col(mix)
    joined = marked.join(found, F.col(source_col).eqNullSafe(m["source"]) & ((F.col(digest) % SALTS).cast("int") == m["salt"]))
    times = m["times"] + (F.col(digest) < m["threshold"]).cast("long")
    return joined.withColumn(copies, times).filter((F.col(copies) > 0) & (F.col(size) > 0)).select(*docs.columns, copies)
