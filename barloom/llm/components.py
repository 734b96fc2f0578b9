"""Connected components of a link table."""

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger, then smaller neighbours move to its least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    small = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node reachable.

    Least values are aggregated before they are shuffled and joined back, so
    a node with very many links needs no group of its own. Each round's links
    are written to the shared folder; the number of rounds is logarithmic in
    practice. Links of a node to itself, repeated and null ones are ignored.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = stored(pairs, "links")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        state = stored(_stars(state), "links")
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
