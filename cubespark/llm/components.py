"""Connected components of a table of links, by alternating stars.

No link, component or label is gathered in one place: each round is two
aggregations with map-side minima and two joins, and its result is written to
the shared folder.  A node with very many links is one aggregate and a join
whose large partitions Spark splits.  The rounds grow with the logarithm of
the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node of the neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written before it is joined: both sides of the join are then dealt anew, and Spark splits what a hub makes large.
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them; links run from larger to smaller."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    return links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least).distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): the least node of its component for every node that has a link; links: two bigint columns.

    Links of a node to itself and links with a null count for nothing; an empty table gives an empty table.
    """
    a, b = links.columns
    edges = links.dropna().select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = stored(edges, name)
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        seen = state
        edges = stored(_small_star(_large_star(edges)), name)
