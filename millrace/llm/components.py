"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.session import checkpointed


#: Edges that one task of a round reads.
TASK_EDGES = 200_000


def _large_star(edges):
    """Every larger neighbour of a node is linked to the smallest node it sees."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges):
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").select("b", "m").where("b <> m")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    ).distinct()


def _state(edges):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _tasks(count):
    """Partitions for `count` edges: few of them are not worth many tasks and small files."""
    return max(1, -(-count // TASK_EDGES))


def components(edges):
    """(node, root) of every node in `edges` (a, b), a <> b; root is the smallest node reachable.

    Roots appear too. No group is gathered: all steps are minima and joins on a
    node, which are split when a node has many edges. An empty table gives one. A round
    has no more edges than the one before, so its result is stored in as many partitions
    as those need, if that is fewer than the shuffle has.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    edges = edges.coalesce(_tasks(before[0]))
    while before[0]:
        edges = checkpointed(_small_star(_large_star(edges)).coalesce(_tasks(before[0])))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
