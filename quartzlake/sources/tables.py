"""Readers: tables of a data set, and the domain views that the queries run over.

Bars keep the first and last price of a day by a total order of the source rows, through `min_by` and `max_by`, so a
view is one grouping with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(rows: DataFrame, order: list[str], volume, currency: str, source: str) -> DataFrame:
    at = F.struct(*order)
    return rows.groupBy("stock_id", "trade_date").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        volume.cast("long").alias("volume"), F.lit(currency).alias("currency"), F.lit(source).alias("source"),
    )


def bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each supplier and shipping day: some 500 days for each of them."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("stock_id"), F.to_date("l_shipdate").alias("trade_date"), F.col("l_extendedprice").alias("px"), "l_quantity", "l_orderkey", "l_linenumber", "l_partkey"
    )
    return _daily(rows, ["l_orderkey", "l_linenumber", "l_partkey", "px"], F.sum("l_quantity"), "TRY", "licensed")


def bars_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each user and day of events: at most 30 days."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stock_id"), F.to_date("ts").alias("trade_date"), F.col("value").alias("px"), "ts", "event_id")
    return _daily(rows, ["ts", "event_id"], F.count(F.lit(1)), "TRY", "yfinance")


def bars_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars_short with planted faults: missing and negative values, a high below the low, a wrong currency."""
    k = F.col("stock_id") * 7 + F.dayofyear("trade_date")
    bars = bars_short(spark, sf_dir)
    return bars.select(
        "stock_id", "trade_date",
        F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, -F.col("open")).otherwise(F.col("open")).alias("open"),
        F.when(k % 19 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", "close",
        F.when(k % 29 == 0, F.lit(None)).when(k % 23 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        F.when(k % 31 == 0, "usd").otherwise(F.col("currency")).alias("currency"), "source",
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions made from parts."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_stocks"))
    kind = F.col("p_size") % 5
    pick = lambda *v: F.when(kind == 0, v[0]).when(kind == 1, v[1]).when(kind == 2, v[2]).when(kind == 3, v[3]).otherwise(v[4])
    return table(spark, sf_dir, "part").crossJoin(F.broadcast(n)).select(  # one row on the other side
        F.col("p_partkey").alias("seq"), (F.col("p_partkey") % F.col("n_stocks")).alias("stock_id"),
        pick("dividend", "split", "bonus", "rights", "other").alias("action_type"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("p_partkey") % 2400).cast("int")).alias("effective_date"),
        pick("1.5", "2:1", "1:1", "1:4", "1:2").alias("ratio"), F.concat(F.lit("KAP-"), F.col("p_partkey").cast("string")).alias("kap_notice_no"),
    )


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings made from orders; a revised one names the filing before it."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_stocks"))
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").crossJoin(F.broadcast(n)).select(  # one row on the other side
        key.alias("notification_id"), (F.col("o_custkey") % F.col("n_stocks")).alias("stock_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "FR").when(F.col("o_orderpriority").startswith("2"), "ODA").otherwise("DG").alias("notification_type"),
        F.when(status == "P", "REVISED").otherwise("ORIGINAL").alias("revision_status"), F.when(status == "P", key - 1).alias("previous_notification_id"),
        F.when(key % 11 != 0, F.concat(F.lit("body "), key.cast("string"))).alias("body"), F.to_date("o_orderdate").alias("published_on"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with their validity [valid_from, valid_to); every seventh stock had an old one."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    date = lambda x: F.lit(x).cast("date")
    now = s.select(key.alias("stock_id"), F.lit("bist").alias("platform"), F.concat(F.lit("S"), key.cast("string")).alias("symbol"), F.when(key % 7 == 0, date("1998-01-01")).otherwise(date("1995-01-01")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    old = s.where(key % 7 == 0).select(key.alias("stock_id"), F.lit("bist").alias("platform"), F.concat(F.lit("OLD"), key.cast("string")).alias("symbol"), date("1995-01-01").alias("valid_from"), date("1998-01-01").alias("valid_to"))
    return now.unionByName(old)


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("source_id"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("response_ms"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News made from documents: the title is the first sentence of the first line."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("news_id"), F.trim(F.split_part(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("."), F.lit(1))).alias("title"), F.col("text").alias("body"), F.col("source").alias("source_name"), F.col("doc_id").alias("published_min"))


def stock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        F.col("c_name").alias("symbol"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"),
        F.when(key % 3 == 0, "READY").when(key % 3 == 1, "PARTIAL_DATA").otherwise("FAILED").alias("scan_status"),
        F.when(key % 17 != 0, (key * 7 % 101).cast("double")).alias("confidence"), (key % 2 == 0).alias("has_kap"),
        F.when(key % 5 == 0, F.lit(None)).when(key % 2 == 0, "2024-06-28-TARAMA-R2").otherwise("2024-06-28-TARAMA-R10").alias("scan_run_id"),
    )
