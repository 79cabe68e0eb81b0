"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitframe.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    links = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """The smallest node that each node reaches.

    ``edges`` has the long columns ``u`` and ``v``; direction does not matter,
    loops, nulls and repeats are ignored.  Returns ``node``, ``root`` for every
    node with an edge.  Each round keeps at most as many edges as before and
    is written to the shared folder; the number of rounds grows with the
    logarithm of the graph.  A hub's edges are split by Spark's skew joins, as
    each of them needs only the hub's least neighbour.
    """
    edges = cut(
        edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    )
    state = None
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
