"""Connected components on DataFrames only (no UDFs, no RDD code).

Alternating large-star / small-star contraction: every round is two grouped
minima and two equi-joins, the number of rounds is logarithmic in the longest
path, and no vertex's neighbours are ever gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def _star(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Relink every neighbour v of u to the least vertex around u.

    ``low`` was written and read again, so both sides of the join come straight
    from a shuffle and AQE may split the rows of a hub over many tasks.
    """
    return edges.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list.

    component is the least node of the component. Loops and null ends are
    ignored, repeated edges are harmless, an empty list gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b and a is not null and b is not null").distinct()
    cur, before = materialise(e, "cc"), None
    state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if state == before or not state[0]:
            break
        before = state
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-low")
        large = materialise(_star(both.where("v > u"), low).distinct(), "cc-large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low2 = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = _star(down, low2).unionByName(low2.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = materialise(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
        drop(cur, low, large, low2)
        cur = new
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
