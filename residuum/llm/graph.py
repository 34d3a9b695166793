"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from residuum.llm.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: equal roots, equal component.

    In each round every node moves to the neighbour (or itself) that comes first in
    an order drawn anew by hash, and the edges are renamed and deduplicated. Each
    round is expected to shrink the graph by a constant factor, chains included, so
    rounds grow with the logarithm of the size. A hub's edges are reduced map-side
    by the aggregate. Only an emptiness test reaches the driver.
    """
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    roots, turn = None, -1
    while not edges.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("rank"), F.col(c).alias("to"))  # noqa: E731, B023
        both = edges.selectExpr("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b"))
        hop = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", rank("a"))["to"].alias("to"))
        hop = stage(hop, "cc-hop")
        first = hop.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        second = hop.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        edges = stage(edges.join(first, "a").join(second, "b").where("a_to <> b_to")
                      .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "cc-edges")
        roots = hop.selectExpr("node", "to AS root") if roots is None else stage(
            roots.join(hop.selectExpr("node AS root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
    return edges.selectExpr("a AS node", "b AS root") if roots is None else roots
