"""Connected components of edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least reachable node) for every node of edges(src, dst).

    Alternating large-star and small-star steps (Kiveris et al. 2014) on a table that is written
    after each round; the number of rounds grows with the logarithm of the number of nodes. Nodes
    with many neighbours are aggregated before the shuffle, and the join back to their neighbours
    is an ordinary equi join that adaptive execution may split. Null ends are ignored.
    """
    links = materialize(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    both = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node IS NOT NULL").distinct()
    before = None
    for _ in range(rounds):
        # large star: neighbours above u go to the least of u and its neighbours
        sides = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = materialize(small, "links")
        # stars only: every node points at one root that points nowhere
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    else:
        raise RuntimeError("the components did not settle")
    return both.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
