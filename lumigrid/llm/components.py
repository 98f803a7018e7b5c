"""Connected components of a link table by alternating large and small stars (Kiveris et al., 2014).

Each round replaces links by links to smaller ids; the least ids are aggregated with map-side combination and
joined back from a checkpoint, so that adaptive execution can split the rows of a hub. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import cut


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    return row[0], row[1] or 0


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v), both ways for a large star and v below u for a small one."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = pairs.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(own).where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every linked id but the components' least ids; the component is the least id reached.

    Links may repeat, run either way and join an id to itself; links with a null are no links.
    """
    now = cut(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null and a != b").distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = cut(_star(both, True))
        now = cut(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
