"""Connected components of a graph given as an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterbox.llm._common import cut, drop_cut


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node with an edge; root is the component's smallest node.

    ``edges``: columns a, b of one comparable type. A large star hangs the greater neighbours of a node on
    its smallest neighbour, a small star the smaller ones; a logarithmic number of rounds leaves stars.
    Neighbour lists are never gathered: each step is a minimum by node (combined before the shuffle) and a
    join on it, whose hot keys adaptive execution splits. Every round is written to the shared folder.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        large = cut(large, "edges")
        # small star: the node and its smaller neighbours hang on the smallest of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select("m", "u")).filter("a < b").distinct()
        small = cut(small, "edges")
        same = _same(now, small)
        drop_cut(now)
        drop_cut(large)
        now = small
        if same:
            break
    else:
        raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Two edge sets are taken as equal when count, and sums of two hashes of their rows, agree."""

    def sums(df: DataFrame):
        return df.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("decimal(38,0)"))).first()

    return sums(x) == sums(y)
