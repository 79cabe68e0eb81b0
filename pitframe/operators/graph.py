"""Causal graphs as edge tables: neighbours and simple paths by recursive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge per pair of nodes: the last by ``order`` wins."""
    last = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc(order)))
    return edges.withColumn("_k", last).where("_k = 1").drop("_k")


def causes_of(edges: DataFrame, target: str) -> DataFrame:
    return edges.where(F.col("target") == target)


_GROW = """
with recursive p(path, last, steps) as (
  select path, last, 0 from {{starts}}
  union all
  select concat(p.path, array(e.{to})), e.{to}, steps + 1 from p join {{edges}} e on p.last = e.{by}
  where steps < {most} and not array_contains(p.path, e.{to}){stop}
)
select path, last, steps from p
"""


def _grown(starts: DataFrame, edges: DataFrame, most: int, back: bool = False, stop: str | None = None) -> DataFrame:
    """``path, last, steps`` of all simple paths of at most ``most`` edges from ``starts`` (path, last), by the engine's own recursion."""
    spark = edges.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the number of steps bounds the recursion
    by, to = ("target", "source") if back else ("source", "target")
    return spark.sql(_GROW.format(by=by, to=to, most=most, stop="" if stop is None else " and p.last <> {stop}"), starts=starts, edges=edges, **({} if stop is None else {"stop": stop}))


def simple_paths(edges: DataFrame, starts: DataFrame, end: str | None = None, cutoff: int = 6) -> DataFrame:
    """All paths of at most ``cutoff`` edges from the nodes ``start`` that visit no node twice.

    A recursive query grows the paths, one shuffle join a step.  With ``end``,
    paths to that node only, which are not followed beyond it: halves are
    grown from both sides and meet in the middle, so no path of more than half
    the length is made that does not lead there.  Unknown and null nodes have
    no paths.
    """
    e = edges.select("source", "target").where("source is not null and target is not null").distinct()
    first = starts.select("start").where("start is not null").distinct().select(F.array("start").alias("path"), F.col("start").alias("last"))
    if end is None:
        found = _grown(first, e, cutoff).where("steps > 0").select("path", F.col("steps").alias("edges"))
    else:
        there = e.where(F.col("target") == end).select(F.array("target").alias("path"), F.col("target").alias("last")).distinct()
        ahead = _grown(first, e, (cutoff + 1) // 2, stop=end).where("steps > 0")
        behind = _grown(there, e, cutoff // 2, back=True).select(F.col("path").alias("rest"), F.col("last").alias("meet"), F.col("steps").alias("more"))
        # A path of n edges is met once, where its first half, the longer one of an odd number, ends.
        met = ahead.join(behind, (F.col("last") == F.col("meet")) & F.col("more").isin(F.col("steps"), F.col("steps") - 1))
        whole = F.concat("path", F.slice(F.reverse("rest"), F.lit(2), F.greatest(F.size("rest"), F.lit(1))))
        found = met.select(whole.alias("path"), (F.col("steps") + F.col("more")).alias("edges")).where(F.size(F.array_distinct("path")) == F.size("path"))
    return found.select(F.element_at("path", 1).alias("start"), F.element_at("path", -1).alias("end"), "path", "edges")
