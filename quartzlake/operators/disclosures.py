"""Disclosures: feed, details, matching, revision chains, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzlake.operators import graph
from quartzlake.operators.identity import resolve


def since(feed: DataFrame, cutoff) -> DataFrame:
    """Items published after the cutoff, strictly; an item without a time passes."""
    return feed.where(F.col("published_at").isNull() | (F.col("published_at") > F.lit(cutoff).cast("timestamp_ntz")))


def with_details(items: DataFrame, details: DataFrame, fields: list[str]) -> DataFrame:
    """Detail fields override item fields, with nulls too, where there is a detail row; each id's detail is taken once."""
    once = details.dropDuplicates(["notification_id"]).select("notification_id", F.lit(True).alias("there"), *[F.col(f).alias(f"detail_{f}") for f in fields])
    rows = items.join(once, "notification_id", "left")
    own = [c for c in items.columns if c not in fields]
    return rows.select(*own, *[F.when(F.col("there"), F.col(f"detail_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def revision_status(cancels: Column, revises: Column) -> Column:
    return F.when(cancels.isNotNull(), "CANCELLED").when(revises.isNotNull(), "REVISED").otherwise("ORIGINAL")


def attachments(raw: Column) -> Column:
    """Array of attachment structs with distinct URLs, none of them fetched."""
    kept = F.filter(raw, lambda a: a["url"].isNotNull())
    first = F.filter(kept, lambda a, i: ~F.exists(F.slice(kept, 1, i), lambda b: b["url"] == a["url"]))
    return F.transform(first, lambda a: F.struct(a["url"].alias("url"), a["file_name"].alias("file_name"), F.lit(False).alias("fetched")))


def match(feed: DataFrame, symbols: DataFrame, universe: DataFrame) -> DataFrame:
    """notification_id, stock_id, status: MATCHED, OUT_OF_UNIVERSE, MATCH_AMBIGUOUS or UNMATCHED."""
    found = resolve(feed.select(F.col("notification_id").alias("query_id"), F.lit("bist").alias("platform"), "symbol"), symbols)
    rows = found.join(universe.select("stock_id", F.lit(True).alias("listed")), "stock_id", "left")
    status = F.when(F.col("n_owners") > 1, "MATCH_AMBIGUOUS").when(F.col("n_owners") == 0, "UNMATCHED").when(F.col("listed"), "MATCHED").otherwise("OUT_OF_UNIVERSE")
    return rows.select(F.col("query_id").alias("notification_id"), F.when(status == "MATCHED", F.col("stock_id")).alias("stock_id"), status.alias("status"))


def chains(items: DataFrame) -> DataFrame:
    """notification_id, root, version_no, superseded_by, missing_target.

    Revisions point back; one whose target is not there starts a chain of its own."""
    known = items.select("notification_id", "previous_notification_id")
    have = known.select(F.col("notification_id").alias("target"))
    rows = known.join(have, known["previous_notification_id"] == have["target"], "left")
    nodes = rows.select("notification_id", "target", (F.col("previous_notification_id").isNotNull() & F.col("target").isNull()).alias("missing_target"))
    found = graph.ends(nodes.where("target IS NOT NULL").select(F.col("notification_id").alias("node"), F.col("target").alias("up")))
    after = known.where("previous_notification_id IS NOT NULL").groupBy(F.col("previous_notification_id").alias("notification_id")).agg(F.min("notification_id").alias("superseded_by"))
    rows = nodes.join(found.withColumnRenamed("node", "notification_id"), "notification_id", "left").join(after, "notification_id", "left")
    return rows.select("notification_id", F.coalesce("far", "notification_id").alias("root"), (F.coalesce("steps", F.lit(0)) + 1).cast("int").alias("version_no"), "superseded_by", "missing_target")


def readiness(items: DataFrame) -> DataFrame:
    """stock_id, ready: no filing of a stock that still counts lacks its body."""
    return items.groupBy("stock_id").agg((~F.bool_or(F.col("body").isNull())).alias("ready"), F.count_if(F.col("body").isNull()).alias("missing_bodies"))


def health(outcomes: DataFrame) -> DataFrame:
    """Collection status and health of each run from its source outcomes (run_id, outage, error)."""
    down, errors, n = F.bool_or("outage"), F.count_if("error"), F.count(F.lit(1))
    all_down = F.bool_and("outage")
    return outcomes.groupBy("run_id").agg(
        F.when(all_down, "FAILED").when(down | (errors > 0), "PARTIAL").otherwise("COMPLETED").alias("status"), F.when(down, "DOWN").when(errors > 0, "DEGRADED").otherwise("OK").alias("health"), n.alias("sources")
    )


def ordered(items: DataFrame) -> DataFrame:
    """items with their position among their stock's: by day, then by id."""
    return items.withColumn("position", F.row_number().over(Window.partitionBy("stock_id").orderBy("published_on", "notification_id")))


def match_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
