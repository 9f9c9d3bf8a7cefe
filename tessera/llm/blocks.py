"""Groups of any size as blocks of bounded size, and the pairs of blocks to be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(rows: DataFrame, keys: list[str], item: Column, salt: Column, size: int, weight: Column | None = None, least: int = 2) -> DataFrame:
    """(keys, parts, part, a): each group of ``keys`` in ceil(n / size) blocks of about ``size`` items, dealt by ``salt``.

    Groups of fewer than ``least`` rows go: one row has nothing to be compared with. With ``weight``, ``size`` bounds the sum of the items'
    weights.
    """
    items = rows.select(*keys, item.alias("item"), salt.alias("salt"))
    measured = rows.select(*keys, (F.lit(1) if weight is None else weight).alias("weight"))
    counts = measured.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("whole")).where(F.col("n") >= least).drop("n")
    parts = F.ceil(F.col("whole") / size).cast("int")
    dealt = items.join(counts, keys).withColumn("parts", parts).withColumn("part", F.pmod(F.col("salt"), F.col("parts")).cast("int"))
    return dealt.groupBy(*keys, "parts", "part").agg(F.collect_list("item").alias("a"))


def block_pairs(rows: DataFrame, keys: list[str], item: Column, salt: Column, size: int, weight: Column | None = None) -> DataFrame:
    """(keys, a, b): all pairs of ``blocks`` within each group of ``keys``; b is null where a is compared with itself.

    No row of the result holds more than two blocks, so a hot group becomes many rows of bounded size instead of one task. Blocks are shuffled:
    Spark sizes them as if ``rows`` had the size of the files behind it, and would broadcast them, whatever their number.
    """
    made = blocks(rows, keys, item, salt, size, weight)
    alone = made.select(*keys, "a", F.lit(None).cast(made.schema["a"].dataType).alias("b"))
    many = made.where("parts > 1")
    left = many.withColumn("other", F.explode(F.expr("sequence(part, parts - 1)"))).where("other > part")
    right = many.select(*keys, F.col("part").alias("other"), F.col("a").alias("b")).hint("merge")
    return alone.union(left.join(right, [*keys, "other"]).select(*keys, "a", "b"))
