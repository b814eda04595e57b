"""Filings without a predecessor are not dealt out by it."""

from pyspark.sql import functions as F

from quartzlake.operators import records


def test_filings_without_predecessor_spread_over_tasks(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        filings = spark.range(4000).select(F.col("id").alias("notification_id"), F.when(F.col("id") % 100 == 7, F.col("id") - 1).alias("previous_notification_id"), F.lit(1).alias("seq"))
        stored = spark.range(0, 4000, 6).select(F.col("id").alias("notification_id"), F.lit(3).alias("version_no"))
        found = records.insert_disclosures(filings, stored)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
        got = {r["notification_id"]: (r["outcome"], r["version_no"]) for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    told = lambda i: ("duplicate", None) if i % 6 == 0 else ("revision_chain", 4 if (i - 1) % 6 == 0 else 1) if i % 100 == 7 else ("inserted", 1)
    assert got == {i: told(i) for i in range(4000)}
