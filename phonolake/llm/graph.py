"""Connected components of an edge table, without ever gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import materialize, release


#: A path of n nodes settles in a number of rounds that grows as log n squared at most.
ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node reachable.

    Alternating stars: each node hands its neighbours its smallest neighbour, first
    to the larger ones, then to the smaller ones; a few rounds leave one star for
    each component. Every round is two aggregations by node and two joins, cut from
    their lineage by tables in the shared folder; only a count and a checksum reach
    the driver. Self-loops keep lone nodes.
    """
    star = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    last = None
    for turn in range(ROUNDS):
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least neighbours are tables of their own, so that the joins with them may split a star's hub.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(least, f"least{turn}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.where("u = v"))
        # Nodes that are the smallest of their neighbours have no larger-star row of their own.
        large = materialize(large.union(least.where("u = m").select("u", F.col("m").alias("v"))).distinct(), f"large{turn}")
        release(least)
        down = large.where("v < u")
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), f"lower{turn}")
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        made = materialize(small.union(large.where("u = v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"star{turn}")
        for done in (large, least, star):
            release(done)
        star = made
        mark = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    # A table of its own, so that joins with it may split a crowded node.
    found = materialize(star.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")), "components")
    release(star)
    return found
