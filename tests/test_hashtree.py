"""The hash tree against plain Python, and what a changed row changes."""

import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quartzlake.operators import hashtree

ROWS = [(k, f"v{k % 7}") for k in range(0, 300, 3)] + [(30, "b"), (30, "b"), (30, None), (None, "x"), (None, None), (-5, "low")]
SCHEMA, WIDTH, FANOUT = "k long, v string", 10, 4


@pytest.fixture(params=[3, 10_000], autouse=True)
def rows_in_a_batch(spark, request):
    """A leaf's hash must pass from one Arrow batch to the next."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def first(node):
    return (node is not None, node or 0)


def top(tree):
    return max(tree, key=lambda x: x[0])


def plain(rows):
    """(level, node, n, digest) of every node by loops over lists."""
    digests = [(None if k is None else k // WIDTH, k, sha(f"{'' if k is None else k}|{v or ''}")) for k, v in rows]
    digests.sort(key=lambda r: (first(r[0]), first(r[1]), r[2]))
    level = [(node, [d for *_, d in of]) for node, of in groupby(digests, key=lambda r: r[0])]
    level = [(node, len(ds), sha("".join(ds))) for node, ds in level]
    out, at = [(0, *x) for x in level], 0
    while len(level) > FANOUT:
        at += 1
        ups = [(up, list(of)) for up, of in groupby(level, key=lambda x: None if x[0] is None else x[0] // FANOUT)]
        level = [(up, sum(n for _, n, _ in of), sha("".join(d for *_, d in of))) for up, of in ups]
        out += [(at, *x) for x in level]
    return {*out, (at + 1, 0, sum(n for _, n, _ in level), sha("".join(d for *_, d in level)))}


def built(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("clash")).withColumn("node", F.lit(1))
    return {tuple(r) for r in hashtree.tree(table, "k", hashtree.row_digest(F.col("k"), F.col("v")), WIDTH, FANOUT).collect()}


@pytest.mark.parametrize("rows", [ROWS, ROWS[:5], []])
def test_the_tree_is_that_of_plain_loops(spark, rows):
    assert built(spark, rows) == plain(rows)


def test_a_changed_lost_or_moved_row_changes_the_root_and_one_path(spark):
    whole = plain(ROWS)
    root = top(whole)[3]
    changed = [(k, "other" if k == 150 else v) for k, v in ROWS]
    lost = [r for r in ROWS if r[0] != 150]
    moved = [(151 if k == 150 else k, v) for k, v in ROWS]
    for rows in (changed, lost, moved):
        found = built(spark, rows)
        assert top(found)[3] != root
        assert len({x[:2] for x in found - whole}) == top(found)[0] + 1  # one node of each level
    assert built(spark, ROWS[::-1]) == whole


def test_differing_names_the_ranges(spark):
    digest = hashtree.row_digest(F.col("k"), F.col("v"))
    of = lambda rows: hashtree.leaves(spark.createDataFrame(rows, SCHEMA), "k", digest, WIDTH)
    target = [r for r in ROWS if r[0] is not None and r[0] not in (-5, 150)] + [(999, "new")]
    found = {tuple(r) for r in hashtree.differing(of(ROWS), of(target)).collect()}
    assert found == {(None, 2, 0), (-1, 1, 0), (15, 4, 3), (99, 0, 1)}
