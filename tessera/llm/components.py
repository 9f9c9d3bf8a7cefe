"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of ``edges`` that isn't itself the smallest of its component.

    ``edges`` holds two long columns in any order, repeats and self-loops allowed; rows with a null end
    are ignored. A node that is missing from the result is its own component. Every round is two joins on
    node ids with minima combined before the shuffle and is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = written(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # large star: the larger neighbours of u move to the smallest of u and its neighbours
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: the smaller neighbours of u, and u, move to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = written(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == seen:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
