"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import BROADCAST_LIMIT, bounded_join, materialise


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
    told = ends.groupBy("node").agg(F.min("to").alias("a"), F.max("to").alias("b"), F.count("to").alias("n"), F.count(F.lit(1)).alias("all"))
    return told.where("a <> b or (n > 0 and n < all)").isEmpty()


def _with_least(rows: DataFrame, edges: DataFrame, small: bool) -> DataFrame:
    """Rows with the least v of their u among the edges.

    It is broadcast where the edges are few; else it is written first, so that
    the join deals both sides itself and can split a hot node.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return rows.join(F.broadcast(least), "u") if small else bounded_join(rows, materialise(least, "least"), ["u"], "inner")


def _large(edges: DataFrame, small: bool) -> DataFrame:
    """Tie every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tied = _with_least(both.where("v > u"), both, small)
    return tied.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, small: bool) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them; u is the larger end."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    tied = _with_least(down, down, small)
    return tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links(u, v); the root is its component's least node.

    Alternates large-star and small-star steps, with the tables of each round
    written in the shared folder, until every node points at a root.
    """
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not _settled(edges):
        # Both ends of so many edges, each with its least neighbour, stay within the limit.
        if edges.count() * 2 * 16 <= BROADCAST_LIMIT:
            edges = materialise(_small(_large(edges, True), True), "edges")
        else:
            edges = materialise(_small(materialise(_large(edges, False), "edges"), False), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
