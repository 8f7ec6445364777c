"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.sources.scratch import stage


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """Columns ``node`` and ``root`` for all nodes of ``links`` (longs ``a`` and ``b``); the root is the smallest node reachable.

    Alternates two steps until nothing changes: every node sends its larger neighbours to its smallest one, then its smaller neighbours
    and itself. The number of rounds grows with the logarithm of a component's size. Each round is written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = stage(edges, f"{name}-links")
    state = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least"))
        least = least.select("hub", F.least("hub", "least").alias("least"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("hub"))
        large = large.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        smallest = large.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least"))
        small = large.join(smallest, F.col("a") == F.col("hub"))
        moved = small.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b")
        kept = smallest.select(F.col("hub").alias("a"), F.col("least").alias("b"))
        edges = stage(moved.unionAll(kept).distinct(), f"{name}-round")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]
