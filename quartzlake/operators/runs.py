"""Runs and operations: revisions, state changes, alerts, phases, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzlake.config import DEFAULT, Thresholds
from quartzlake.durable import written

from . import scan

# The phases of a morning (start, end in seconds of the day; equal for a point in time), in order.
PHASES = (
    ("PRECHECK", 28800, 28800), ("COLLECTION", 28800, 31500), ("CLEANING", 31500, 32400), ("RECOVERY", 32400, 34200),
    ("PACKAGING", 34200, 34500), ("ANOMALY_CHECK", 34500, 34800), ("DATA_CUTOFF", 34800, 34800), ("CRITICAL_RESCAN", 34800, 35100),
)
RETRY_DELAYS = (0, 30, 90)
# The states of a stock in a scan and those that may follow each; FAILED to WAITING needs the reason below.
COLLECTING = ("COLLECTING_PRICE", "COLLECTING_KAP", "COLLECTING_NEWS", "COLLECTING_ACTIONS", "COLLECTING_RESTRICTIONS")
FOLLOWING = {
    "WAITING": (*COLLECTING, "INACTIVE"),
    "COLLECTING_PRICE": ("COLLECTING_KAP", "VALIDATING", "PARTIAL_DATA", "FAILED"),
    "COLLECTING_KAP": ("COLLECTING_NEWS", "VALIDATING", "PARTIAL_DATA", "FAILED"),
    "COLLECTING_NEWS": ("COLLECTING_ACTIONS", "VALIDATING", "PARTIAL_DATA", "FAILED"),
    "COLLECTING_ACTIONS": ("COLLECTING_RESTRICTIONS", "VALIDATING", "PARTIAL_DATA", "FAILED"),
    "COLLECTING_RESTRICTIONS": ("VALIDATING", "PARTIAL_DATA", "FAILED"),
    "VALIDATING": ("READY", "PARTIAL_DATA", "FAILED"),
    "PARTIAL_DATA": ("VALIDATING", "READY"),
}
RESCAN = "conscious_rescan"


def source_alerts(events: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """source_id, alert_at: when a run of errors of a source reaches the limit, once for each run."""
    by = Window.partitionBy("source_id").orderBy("ts", "event_id")
    rows = events.withColumn("island", F.sum(F.col("ok").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("NOT ok").withColumn("streak", F.row_number().over(Window.partitionBy("source_id", "island").orderBy("ts", "event_id")))
    return rows.where(F.col("streak") == limits.alert_streak).select("source_id", F.col("ts").alias("alert_at"), "event_id")


def run_revisions(starts: DataFrame) -> DataFrame:
    """run_id and parent of each run of a day (run_date, seq)."""
    by = Window.partitionBy("run_date").orderBy("seq")
    rows = starts.withColumn("revision", F.row_number().over(by))
    run_id = F.concat(F.date_format("run_date", "yyyy-MM-dd"), F.lit("-TARAMA-R"), F.col("revision").cast("string"))
    rows = rows.withColumn("run_id", run_id)
    return rows.withColumn("parent", F.lag("run_id").over(by))


def illegal_transitions(states: DataFrame, following: dict[str, tuple[str, ...]] = FOLLOWING, rescan: str = RESCAN) -> DataFrame:
    """Consecutive states of a stock (stock_id, seq, state, reason) that the table does not permit; FAILED to WAITING needs the rescan's reason."""
    rows = states.withColumn("old", F.lag("state").over(Window.partitionBy("stock_id").orderBy("seq"))).withColumnRenamed("state", "new").where("old IS NOT NULL")
    ok = (F.col("old") == "FAILED") & (F.col("new") == "WAITING") & F.coalesce(F.col("reason") == rescan, F.lit(False))
    for old, allowed in following.items():
        ok = ok | ((F.col("old") == old) & F.col("new").isin(*allowed))
    return rows.where(~ok).select("stock_id", "seq", "old", "new")


def trading_day(date: Column, holidays: tuple[str, ...] = ()) -> Column:
    closed = date.isin(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.lit(False)
    return (F.weekday(date) < 5) & ~closed


def phase(ts: Column, zone: str = "Europe/Istanbul") -> Column:
    """Phase of a UTC time in local time; points win by order, microseconds are dropped; null outside."""
    local = F.from_utc_timestamp(ts, zone)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    out = F.lit(None).cast("string")
    for name, start, end in reversed(PHASES):
        out = F.when((second == start) if start == end else (second >= start) & (second < end), name).otherwise(out)
    for name, start, end in PHASES:
        if start == end:
            out = F.when(second == start, name).otherwise(out)
    return out


def retry_times(starts: DataFrame, delays=RETRY_DELAYS) -> DataFrame:
    """Attempts of each start: the delays add up."""
    at = [sum(delays[: k + 1]) for k in range(len(delays))]
    return starts.select("*", F.posexplode(F.array(*map(F.lit, at))).alias("attempt", "after_s")).withColumn("attempt", F.col("attempt") + 1)


def disk_level(used: Column, total: Column) -> Column:
    share = F.try_divide(used * 100.0, total)
    return F.when((total <= 0) | (share < 80), "OK").when(share >= 95, "CRITICAL").otherwise("WARN")


def retention(files: DataFrame, as_of, limits: Thresholds = DEFAULT) -> DataFrame:
    """kind, deleted, kept: raw kinds older than the limit are deleted, structured ones never."""
    old = F.col("kind").startswith("raw") & (F.date_diff(F.lit(as_of).cast("date"), "written_on") > limits.retention_days)
    return files.groupBy("kind").agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


def calls_in_window(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """Each call with the number of calls of its source in the last `seconds`, its own included."""
    by = Window.partitionBy("source_id").orderBy("second").rangeBetween(1 - seconds, 0)
    return calls.withColumn("recent", F.count(F.lit(1)).over(by))


def limited(calls: DataFrame, most: int, window: int = 60_000_000) -> DataFrame:
    """calls (source_id, call_id, at: microseconds) with waited, wait and total: which of them wait for a place among the `most` of a window,
    how long, and how long those of their source waited so far. Each source is one scan in order of time.

    total is a long wherever a long holds all of them, else a decimal of 38 digits: waits grow with the calls before, so sums with their square.
    The call number i (from 0) of a source waits i // most windows at most, which tells that few calls stay far below; otherwise the sums are looked at."""
    fold = lambda kind: scan.folded(calls, ["source_id"], ["at", "call_id"], ["at"], lambda: scan.Limiter(most, window), f"waited boolean, wait long, total {kind}")
    n = calls.groupBy("source_id").count().agg(F.max("count")).first()[0] or 0
    if n * (n - 1) // (2 * most) * window < 1 << 62:
        return fold("long")
    found = written(fold("decimal(38)"), "limited")
    if found.agg(F.max("total")).first()[0] < 1 << 63:
        return found.withColumn("total", F.col("total").cast("long"))
    return found


def recovered(found: DataFrame) -> DataFrame:
    """Runs (owner, seq, status, alive) after a restart: an ACTIVE one is ABORTED, but for the last of an owner that is alive."""
    last = F.lead("seq").over(Window.partitionBy("owner").orderBy("seq")).isNull()
    cut_off = (F.col("status") == "ACTIVE") & ~(last & F.coalesce("alive", F.lit(False)))
    return found.withColumn("status", F.when(cut_off, "ABORTED").otherwise(F.col("status")))
