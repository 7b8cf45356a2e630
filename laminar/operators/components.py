"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.scratch import written

ROUNDS = 60
#: A node of more edges than this is a hub; hubs of a round are HUBS at most, whatever the number of edges.
DEGREE, HUBS = 200, 50_000


def with_least(edges: DataFrame, n_edges: int, own: bool = False) -> DataFrame:
    """edges (u, v, and what else they have) with m, the least v of their u, or u itself where that is less and `own`.

    Minima are taken map-side. A hub's minimum is broadcast to its edges, which stay where they are: at most
    n_edges / degree nodes can have more edges than `degree`, so the table is bounded. Other edges meet theirs in a
    shuffled join, in which no node has many rows."""
    degree = max(DEGREE, -(-n_edges // HUBS))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if own:
        least = least.withColumn("m", F.least("m", "u"))
    hubs = least.where(F.col("n") > degree).select("u", F.col("m").alias("hub_m"))
    others = least.where(F.col("n") <= degree).select(F.col("u").cast("long").alias("o_u"), F.col("m").alias("o_m"))
    met = edges.join(F.broadcast(hubs), "u", "left")
    # A hub's edges have their minimum already; they go through the join under the hash of their other end.
    dealt = met.withColumn("dealt_u", F.when(F.col("hub_m").isNull(), F.col("u").cast("long")).otherwise(F.xxhash64("v")))
    return dealt.join(others.hint("merge"), F.col("dealt_u") == F.col("o_u"), "left").select(*edges.columns, F.coalesce("hub_m", "o_m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node that has an edge.

    Rounds grow with the logarithm of the largest component; each is written to the shared folder, so a lost executor
    costs no earlier round. Null ends are dropped, self loops name their node."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()
    pairs = written(pairs, "edges")
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    stars = pairs.where("u <> v")
    for _ in range(ROUNDS):
        n = stars.count()
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * n, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "stars-large")
        small = with_least(large, n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        found = written(small, "stars")
        # Stars: every node on the left once, and no centre on the left.
        centres = found.select(F.col("v").alias("u")).distinct()
        open_ends = found.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").unionByName(found.select("u").distinct().join(centres, "u", "left_semi"))
        stars = found
        if open_ends.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
