"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import drop_table, materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``links`` (a, b); no rows without links.

    Each round sends every edge's ends to the least neighbour of a node; the
    number of rounds grows with the logarithm of the longest path.  A node
    with very many neighbours is handled by partial aggregation and by joins
    that can be split.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        # large star: every neighbour larger than the node goes to the node's least neighbour
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.min("hi").alias("m")).select(F.col("lo").alias("u"), F.least("lo", "m").alias("m"))
        large = both.filter("hi > lo").join(least, F.col("lo") == F.col("u")).select(F.col("m").alias("lo"), "hi").distinct()
        # small star: a node and all its smaller neighbours go to the least of these
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).filter("lo <> hi").distinct()
        old, edges = edges, materialize(small, "edges")
        drop_table(old)
        now = _state(edges)
        if before == now:
            break
        before = now
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0))).first())
