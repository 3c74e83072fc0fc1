"""Connected components of a graph of long ids, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernspan.llm.tables import stored


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    key = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(key), F.bit_xor(F.xxhash64(key))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) with the smallest id of each component, for nodes with an edge.

    ``edges`` has long columns a and b; order, repeats and self loops do not matter.
    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest of them, which takes a logarithmic number of rounds and keeps no more
    edges than there were. A node of many neighbours is only ever aggregated
    (``min``), never gathered. Rounds are written to the shared folder.
    """
    current = stored(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = (
            both.where("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b")
        )
        star = larger.distinct()
        smallest = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(smallest, "a")
        linked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))
        )
        following = stored(linked.where("a != b").distinct(), "edges")
        settled = _digest(following) == _digest(current)
        current = following
        if settled:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
