"""Connected components of a table of links, by joins only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.sources.shared import shared_table


def _towards_minimum(edges: DataFrame) -> DataFrame:
    """Edges with ``v``'s replaced: each ``u`` with the least of its own ``v``s."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``u > v``.

    Both only move edges towards smaller nodes of the same component. A hub's edges are reduced to
    its minimum before they meet, and joined back with that one row, which Spark can split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _towards_minimum(both).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u > v").distinct()
    small = _towards_minimum(large)
    moved = large.join(small, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every linked node; ``component`` is the component's smallest node.

    Links may repeat, point either way or to themselves (those are ignored); null ends are ignored.
    Rounds end when the edges stay the same, after a logarithmic number of rounds. Every round is
    a table in the shared folder; two numbers come to the driver.
    """
    ends = F.col(a), F.col(b)
    edges = shared_table(
        links.select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v"))
        .filter((F.col(a).isNotNull() & F.col(b).isNotNull()) & (F.col("u") != F.col("v")))
        .select("u", "v").distinct(),
        "links",
    )
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = shared_table(_round(edges), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
