"""Articles of a region from a graph of triples (s, p, o)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import cut_lineage, written_table


@dataclass(frozen=True)
class Predicates:
    """Names the graph uses; the defaults are the property names of the public graph."""

    located_in: str = "P131"
    coordinate: str = "P625"
    headquarters: str = "P159"
    about: str = "about"
    part_of: str = "isPartOf"
    label_prefix: str = "label@"


def relation(triples: DataFrame, predicate: str, s: str, o: str) -> DataFrame:
    return triples.filter(F.col("p") == predicate).select(F.col("s").alias(s), F.col("o").alias(o))


def region_closure(triples: DataFrame, regions: DataFrame, names: Predicates = Predicates()) -> DataFrame:
    """(region, node): every node that reaches the region in zero or more located-in steps.

    ``regions`` has one column ``region``. Each round joins only the nodes found last with
    the edges; nodes seen before are left out, so cycles end. The edges are a written table
    without a partitioning of its own: a short frontier is broadcast, and a parent that
    holds a large share of all nodes can be split by the skew join.
    """
    edges = written_table(relation(triples, names.located_in, "child", "parent").distinct(), "edges")
    frontier = cut_lineage(regions.select("region", F.col("region").alias("node")).distinct())
    visited = frontier
    rounds = 0
    while True:
        reached = (
            edges.join(frontier, edges["parent"] == frontier["node"])
            .select("region", F.col("child").alias("node"))
            .distinct()
        )
        frontier = cut_lineage(reached.join(visited, ["region", "node"], "left_anti"))
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)
        rounds += 1
        if rounds % 10 == 0:
            visited = cut_lineage(visited)


def region_items(triples: DataFrame, closure: DataFrame, names: Predicates = Predicates()) -> DataFrame:
    """(item, coord): items placed in the region, and items with headquarters there (no coord)."""
    nodes = closure.select("node").distinct()
    placed = relation(triples, names.coordinate, "item", "coord").join(
        nodes.withColumnRenamed("node", "item"), "item", "left_semi"
    )
    seated = (
        relation(triples, names.headquarters, "item", "place")
        .join(nodes.withColumnRenamed("node", "place"), "place", "left_semi")
        .select("item")
    )
    return placed.unionByName(seated, allowMissingColumns=True).distinct()


def preferred_links(triples: DataFrame, sites: list[str], names: Predicates = Predicates()) -> DataFrame:
    """(item, article): links of the first site that has any for the item.

    The site with the best rank is found per item by an aggregate and matched back, so links
    of different sites are never paired with each other.
    """
    rank = F.create_map(*[x for i, site in enumerate(sites) for x in (F.lit(site), F.lit(i))])
    links = (
        relation(triples, names.about, "link", "item")
        .join(relation(triples, names.part_of, "link", "site").filter(F.col("site").isin(sites)), "link")
        .select("item", F.col("link").alias("article"), F.try_element_at(rank, F.col("site")).alias("rank"))
    )
    best = links.groupBy("item").agg(F.min("rank").alias("rank"))
    return links.join(best, ["item", "rank"]).select("item", "article")


def item_labels(triples: DataFrame, languages: list[str], names: Predicates = Predicates()) -> DataFrame:
    """(item, label): the label in the first language that has one."""
    wanted = {f"{names.label_prefix}{lang}": lang for lang in languages}
    labels = triples.filter(F.col("p").isin(list(wanted)))
    per_item = labels.groupBy(F.col("s").alias("item")).agg(
        *[F.min(F.when(F.col("p") == p, F.col("o"))).alias(lang) for p, lang in wanted.items()]
    )
    return per_item.select("item", F.coalesce(*[F.col(lang) for lang in languages]).alias("label"))


def region_articles(
    triples: DataFrame,
    regions: DataFrame,
    sites: list[str],
    languages: list[str],
    names: Predicates = Predicates(),
) -> DataFrame:
    """Distinct (item, label, coord, article); items without an article drop out."""
    items = region_items(triples, region_closure(triples, regions, names), names)
    linked = items.join(preferred_links(triples, sites, names), "item")
    labelled = linked.join(item_labels(triples, languages, names), "item", "left")
    return labelled.select(
        "item", F.coalesce("label", "item").alias("label"), "coord", "article"
    ).distinct()
