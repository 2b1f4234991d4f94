"""Connected components of a graph held in a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _ordered(both.where("v > u").join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these."""
    smallest = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(smallest, "b")
    return _ordered(joined.select(F.col("a"), F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def star_components(links: DataFrame) -> tuple[DataFrame, int]:
    """The components of ``links`` and the number of rounds it took; see ``components``."""
    edges = stored(_ordered(links.where(F.col("a").isNotNull() & F.col("b").isNotNull())))
    rounds, before = 0, _signature(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)))
        rounds += 1
        after = _signature(edges)
        if after == before:
            break
        before = after
    # Converged, the links are stars, each from the smallest node of a component to each of its other nodes.
    labels = edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
    return labels, rounds


def components(links: DataFrame) -> DataFrame:
    """For every node of ``links (a, b)`` its ``label``: the smallest node of its component.

    Large-star links each node's larger neighbours to the smallest of its closed neighbourhood, small-star
    links a node and its smaller neighbours to the smallest of these; alternated until the links no longer
    change, they leave one star per component around its smallest node, in a number of rounds logarithmic
    in the size of the component for chains, stars and combs alike (Kiveris et al., 2014). Smallest
    neighbours are partial minima, so a node with very many links is no one task; each round is written
    to the checkpoint folder. Rows with nulls and links of a node to itself are left out; without links
    the result is empty.
    """
    return star_components(links)[0]
