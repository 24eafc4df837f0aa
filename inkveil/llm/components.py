"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import written


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``component``, the smallest node that its links reach; nodes without links don't appear.

    Each step is one aggregate and one equi-join, which adaptive execution splits at nodes with many links;
    the links are written after each step. Nulls and links of a node with itself are ignored.
    """
    links = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    links = written(links.where("u <> v").distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: all neighbours are smaller now, so a node and its neighbours move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = low.select("u", F.col("m").alias("v"))
        links = written(small.unionByName(kept).where("u <> v").distinct(), "links")
        before, state = state, _state(links)
        if before == state:
            break
    named = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return named.unionByName(roots)
