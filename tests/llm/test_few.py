"""Small tables of the rounds are written by few tasks, whatever the session's parts of a shuffle."""

import re

import pytest

from quartzlake.llm import graph
from quartzlake.llm.shared import cut, few


@pytest.fixture
def many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_rounds_write_few_files(many_parts, monkeypatch):
    files, keep = [], graph.cut

    def counted(*args):
        found = keep(*args)
        files.append(len({re.sub(r"/_.*", "", x) for x in found.inputFiles()}))
        return found

    monkeypatch.setattr(graph, "cut", counted)
    links = cut(many_parts.createDataFrame([(i + 1, i) for i in range(300) if i % 100 != 99], "hi long, lo long"), "test-links")
    got = {r["node"]: r["root"] for r in graph.components(links, links).collect()}
    assert got == {i: i // 100 * 100 for i in range(300)}
    assert max(files) <= 4


def test_parts_stay_where_sizes_are_not_known(many_parts):
    rows = many_parts.range(1000).repartition(64, "id")
    assert few(rows, rows).rdd.getNumPartitions() == 64
    assert few(rows, cut(rows, "test-rows")).rdd.getNumPartitions() == 4
