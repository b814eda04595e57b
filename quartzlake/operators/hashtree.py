"""A checksum of a table in the order of its rows: a hash tree over ranges of a key.

A leaf is SHA-256 over the row digests of one range of the key, in the order of key and digest; a further node is SHA-256 over the
digests of up to `fanout` nodes below it, in order; the root is over the last nodes that are at most `fanout`. So a row that is
changed, lost, added or moved to another key changes its leaf, the nodes above it and the root, and no other leaf.

Spark shuffles by range and sorts in the tasks; a leaf's rows stream through one task, whose state is one running hash, also where
a range or a key has very many rows. Levels have a `fanout`-th of the nodes each, so the rounds are few.

Defined cases: null keys are a range of their own, before all others; repeated rows count each; rows of one key are in the order of
their digests; an empty table has a root over nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzlake.durable import written

WIDTH, FANOUT = 1 << 17, 1 << 10


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row's values as text, null as nothing, with a bar between them."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def leaves(rows: DataFrame, key: str, digest: Column, width: int = WIDTH) -> DataFrame:
    """node, n, digest of each range of `width` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, state, begun = None, 0, hashlib.sha256(), False
        for batch in batches:
            done = []
            for node, found in zip(batch.column("node").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                if begun and node != held:
                    done.append((held, n, state.hexdigest()))
                    n, state = 0, hashlib.sha256()
                held, begun = node, True
                n += 1
                state.update(found.encode())
            yield table(done)
        if begun:
            yield table([(held, n, state.hexdigest())])

    def table(done: list[tuple]) -> pa.RecordBatch:
        node, n, found = zip(*done, strict=True) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.string())], names=["node", "n", "digest"])

    keyed = rows.select(F.floor(F.col(key) / F.lit(width)).cast("long").alias("node"), F.col(key).alias("key"), digest.alias("digest"))
    return keyed.repartition("node").sortWithinPartitions("node", "key", "digest").mapInArrow(run, "node long, n long, digest string")


def _joined() -> list[Column]:
    """n and digest of the nodes of a group; it has few."""
    below = F.array_sort(F.collect_list(F.struct("node", "digest")))
    return [F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(below, lambda x: x["digest"]), ""), 256).alias("digest")]


def tree(rows: DataFrame, key: str, digest: Column, width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """level, node, n, digest of all nodes; leaves are level 0, the root is alone on the highest level and its node is 0."""
    if fanout < 2:
        raise ValueError("a node has two nodes below it at least")
    level, at = written(leaves(rows, key, digest, width), "hash-leaves"), 0
    found = level.withColumn("level", F.lit(0))
    while level.count() > fanout:
        at += 1
        parent = level.withColumn("up", F.floor(F.col("node") / F.lit(fanout)).cast("long"))
        level = written(parent.groupBy("up").agg(*_joined()).select(F.col("up").alias("node"), "n", "digest"), "hash-nodes")
        found = found.unionByName(level.withColumn("level", F.lit(at)))
    root = level.agg(*_joined()).select(F.lit(at + 1).alias("level"), F.lit(0).cast("long").alias("node"), "n", "digest")
    return found.unionByName(root).select("level", "node", "n", "digest")


def differing(source: DataFrame, target: DataFrame) -> DataFrame:
    """node, source_rows, target_rows of the ranges whose leaves (node, n, digest) are not the same in both."""
    side = lambda t, k: t.select("node", F.col("n").alias(f"{k}_rows"), F.col("digest").alias(k))
    a, b = side(source, "source").alias("a"), side(target, "target").alias("b")
    met = a.join(b, F.col("a.node").eqNullSafe(F.col("b.node")), "full_outer").where(~F.col("source").eqNullSafe(F.col("target")))
    return met.select(F.coalesce("a.node", "b.node").alias("node"), *(F.coalesce(f"{k}_rows", F.lit(0)).alias(f"{k}_rows") for k in ("source", "target")))
