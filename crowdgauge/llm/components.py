"""Connected components of a graph given as pairs, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge.runtime import pin, unpin


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node of ``pairs(a, b)`` can reach.

    Every round each node points at the neighbour that a seeded hash ranks first, follows the
    pointer of that neighbour too, and the graph is contracted along the pointers. The expected
    number of nodes falls by a constant factor a round, also on long paths. Nothing is collected;
    each round is pinned, and the round before is deleted. Rounds end when no edge is left.
    """
    edges = pin(
        pairs.select("a", "b")
        .unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a <> b")
        .distinct()
    )
    labels = pin(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    turn = 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        best = edges.groupBy("a").agg(F.min(rank("b")).alias("first"))
        first = pin(
            best.select("a", F.least("first", rank("a"))["n"].alias("to"))
        )
        onward = first.select(F.col("a").alias("to"), F.col("to").alias("further"))
        moved = pin(first.join(onward, "to").select("a", F.col("further").alias("to")))
        ends = moved.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        smaller = pin(
            edges.join(moved.withColumnRenamed("to", "to_a"), "a")
            .join(ends, "b")
            .filter("to_a <> to_b")
            .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            .distinct()
        )
        relabelled = pin(
            labels.join(moved.withColumnRenamed("a", "root"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
        )
        unpin(edges, labels, first, moved)
        edges, labels, turn = smaller, relabelled, turn + 1
    names = labels.groupBy("root").agg(F.min("node").alias("component"))
    settled = pin(labels.join(names, "root").select("node", "component"))
    unpin(edges, labels)
    return settled
