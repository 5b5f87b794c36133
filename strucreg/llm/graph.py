"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strucreg.llm.common import Tables


def _state(edges: DataFrame):
    """Count and sum of hashes of the edges, which tell two rounds apart."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node reachable. Alternating star
    contraction: every node hands its larger, then its smaller neighbours to its smallest one, until all edges point at the smallest
    node of their component. A round is two shuffles with map-side minima; the number of rounds grows with the logarithm of the longest chain."""
    edges = tables.keep(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(edges)
    while True:
        # large star: the larger neighbours of a node go to the smallest of it and its neighbours. The minima are written, so that
        # the join reads both sides anew and the rows of a node with very many neighbours can be split
        both = edges.union(edges.select("v", "u"))
        least = tables.keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
        large = edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = tables.keep(small.filter("u != v").distinct())
        now = _state(edges)
        if now == before:
            smallest = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return smallest.union(smallest.select("component", "component")).distinct()
        before = now
