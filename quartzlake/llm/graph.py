"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouping and a join of the links, so the graph never leaves the executors. The grouping is written first, so
that Spark can split the links of a hub in the join. Nodes are any integers.
An empty link table has no components. Links may repeat and may point either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WRITE_BYTES, cut, release, written_bytes

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least", links)
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), least


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = cut(links.groupBy("hi").agg(F.min("lo").alias("m")), "links-least", links)
    moved = links.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), least


def _dealt(state: DataFrame) -> DataFrame:
    """The links of one small file's size stay in one task, in which they need no shuffle; more are dealt out."""
    if written_bytes(state) > WRITE_BYTES:
        return state
    found = state.coalesce(1)
    found.written_to = state.written_to
    return found


def components(links: DataFrame, *like: DataFrame) -> DataFrame:
    """node, root: for each node of the links (hi, lo), the least node that it is connected with. like: the written tables that the links come from, if they are."""
    state = cut(links.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi > lo").distinct(), "links", *like)
    mark = None
    for _ in range(MAX_ROUNDS):
        before, tables = state, []
        for star in (_large_star, _small_star):
            moved, least = star(_dealt(state))
            state = cut(moved, "links", state)
            tables += [least, state]
        release(before, *tables[:-1])
        seen = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(state.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
