"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.shared import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node links its larger (large) or all its smaller (small) neighbours to its least one.

    The least neighbour is an aggregate that is combined before the shuffle and joined back, so the rows of a node of
    very many neighbours are never sorted in one task; the join splits them where it finds skew.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    seen = both.join(least, "a").select("a", "b", F.least("m", "a").alias("m"))
    if large:
        out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).union(seen.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a long, b long), root being the least node of its component.

    Rounds end when the edge table no longer changes, which takes a logarithmic number of them. Each round's table
    is written to the shared folder, so lineage stays short. Self-edges and repeated edges have no effect; no edges
    give an empty result.
    """
    now, print_before = cut(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    while True:
        now = cut(_stars(_stars(now, True), False), "edges")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == print_before or row[0] == 0:
            break
        print_before = tuple(row)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
