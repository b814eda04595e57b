"""Append-only storage: insert-or-ignore, versions, re-checks, source fallback, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["stock_id", "trade_date", "source", "data_version"]


def new_rows(incoming: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows of incoming that an insert-or-ignore writes: the first of each key that the target does not have."""
    first = incoming.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("rn = 1").drop("rn")
    return first.join(target.select(*key), key, "left_anti")


def append_report(incoming: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    written = new_rows(incoming, target, key).agg(F.count(F.lit(1)).alias("written"))
    return incoming.agg(F.count(F.lit(1)).alias("n")).crossJoin(written).select("written", (F.col("n") - F.col("written")).alias("skipped"))  # one row on each side


def latest(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The latest version of each key by insertion order, never by the version's text."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("rn = 1").drop("rn")


def last_records(rows: DataFrame, n: int) -> DataFrame:
    """The last n records of a stock: (date, source) records, not days."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("stock_id").orderBy(F.desc("trade_date"), "source"))).where(F.col("rn") <= n).drop("rn")


def next_version(version: Column) -> Column:
    number = version.try_cast("int")
    return F.coalesce((number + 1).cast("string"), F.concat(version, F.lit("-recheck")))


def recheck(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stock_id, trade_date, old_version, new_version for stored records that a fresh reading changes."""
    values = ["open", "high", "low", "close", "volume"]
    rows = stored.alias("s").join(fresh.alias("f"), ["stock_id", "trade_date", "source"])
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(f"s.{v}").eqNullSafe(F.col(f"f.{v}"))
    return rows.where(changed).select("stock_id", "trade_date", F.col("s.data_version").alias("old_version"), next_version(F.col("s.data_version")).alias("new_version"))


def fallback(candidates: DataFrame, universe: DataFrame) -> DataFrame:
    """stock_id, source_used, bars, reason: the first source by priority that has a bar that survives (ok).

    candidates: stock_id, source, priority, ok. The reason tells why the first source was passed over."""
    by = candidates.groupBy("stock_id", "source", "priority").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("good"))
    best = by.groupBy("stock_id").agg(
        F.min_by("source", F.when(F.col("good") > 0, F.col("priority"))).alias("source_used"), F.min_by("good", F.when(F.col("good") > 0, F.col("priority"))).alias("bars"),
        F.min(F.when(F.col("good") > 0, F.col("priority"))).alias("used"), F.max(F.when(F.col("priority") == 1, F.col("n"))).alias("first_n"),
    )
    reason = F.when(F.col("used") == 1, F.lit(None)).when(F.col("first_n").isNull(), "empty").otherwise("all_rejected")
    return universe.join(best, "stock_id", "left").select("stock_id", "source_used", F.coalesce("bars", F.lit(0)).alias("bars"), reason.alias("reason"))


def stale(bars: DataFrame, as_of, days: int) -> DataFrame:
    old = F.date_diff(F.lit(as_of).cast("date"), F.max("trade_date"))
    return bars.groupBy("stock_id").agg(old.alias("days_old"), (old > days).alias("is_stale"))


def manifest(tables: dict[str, DataFrame], row_hash=lambda df: F.xxhash64(*df.columns)) -> DataFrame:
    """table_name, row_count and a checksum of every table that does not depend on the order of its rows."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count"), F.bit_xor(row_hash(df)).alias("checksum")).select(F.lit(name).alias("table_name"), "row_count", "checksum")
        out = row if out is None else out.unionByName(row)
    return out


def data_loss(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables of which the target has fewer rows than the source."""
    rows = source.select("table_name", F.col("row_count").alias("a")).join(target.select("table_name", F.col("row_count").alias("b")), "table_name", "full_outer")
    return rows.where("coalesce(b, 0) < coalesce(a, 0)").select("table_name", F.coalesce("a", F.lit(0)).alias("source_rows"), F.coalesce("b", F.lit(0)).alias("target_rows"))
