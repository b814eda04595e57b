"""Volume: a missing, a zero and an estimated value are three different things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzlake.config import DEFAULT, Thresholds


def missing_reason(explicit: Column, source_error: Column, holiday: Column, units: Column) -> Column:
    """An explicit reason first, then a source error, a holiday, and no data; null where there is a value."""
    return F.coalesce(explicit, F.when(source_error, "SOURCE_ERROR"), F.when(holiday, "HOLIDAY"), F.when(units.isNull(), "NO_DATA"))


def valid_volume(units: Column, reason: Column, trading_day: Column) -> Column:
    return F.when(units.isNotNull() & reason.isNull() & F.coalesce(trading_day, F.lit(True)), units)


def ratios(bars: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """stock_id, last_volume, avg20, used_days, ratio.

    The average is over the last valid days before the last bar, not over calendar days. Ranks are taken in one window
    by stock; the rest is one grouping on the same key."""
    by = Window.partitionBy("stock_id")
    rows = bars.select("stock_id", "trade_date", F.col("volume").alias("v"), F.row_number().over(by.orderBy(F.desc("trade_date"))).alias("back"))
    earlier = F.col("v").isNotNull() & (F.col("back") > 1)
    rows = rows.withColumn("rank", F.when(earlier, F.sum(earlier.cast("int")).over(by.orderBy(F.desc("trade_date")))))
    used = F.col("rank") <= limits.volume_window
    out = rows.groupBy("stock_id").agg(F.max(F.when(F.col("back") == 1, F.col("v"))).alias("last_volume"), F.sum(F.when(used, F.col("v"))).alias("total"), F.count_if(used).alias("used_days"))
    out = out.withColumn("avg20", F.when(F.col("used_days") > 0, F.col("total") / F.col("used_days")))
    ratio = F.when(F.col("used_days") >= limits.volume_min_days, F.try_divide(F.col("last_volume").cast("double"), F.col("avg20")))
    return out.select("stock_id", "last_volume", "avg20", "used_days", ratio.alias("ratio"))


def trailing_average(bars: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """For every bar with a volume, the mean of the valid volumes before it, over at most the window's number of them."""
    frame = Window.partitionBy("stock_id").orderBy("trade_date").rowsBetween(-limits.volume_window, -1)
    return bars.where("volume IS NOT NULL").select("stock_id", "trade_date", "volume", F.sum("volume").over(frame).alias("total"), F.count("volume").over(frame).alias("used_days"))


def classify(volume: Column, ratio: Column, explained: Column, used_days: Column | None = None, limits: Thresholds = DEFAULT) -> tuple[Column, Column]:
    """(status, reason) of the last volume."""
    rising, high, odd = limits.volume_steps
    undefined = F.lit("RATIO_UNDEFINED") if used_days is None else F.when(used_days < limits.volume_min_days, "INSUFFICIENT_WINDOW").otherwise("RATIO_UNDEFINED")
    status = (
        F.when(volume.isNull(), "MISSING").when((volume == 0) & explained, "NORMAL").when(volume == 0, "REVIEW_REQUIRED").when(ratio.isNull(), "REVIEW_REQUIRED")
        .when(ratio >= odd, "ANOMALOUS").when(ratio >= high, "HIGH").when(ratio >= rising, "INCREASING").otherwise("NORMAL")
    )
    reason = F.when(volume.isNull(), "LAST_VOLUME_MISSING").when((volume == 0) & explained, "ZERO_VOLUME_EXPLAINED").when(volume == 0, "ZERO_VOLUME_WITHOUT_EXPLANATION").when(ratio.isNull(), undefined)
    return status, reason


def status(bars: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    rows = ratios(bars, limits)
    kind, reason = classify(F.col("last_volume"), F.col("ratio"), F.lit(False), F.col("used_days"), limits)
    return rows.select("stock_id", kind.alias("status"), reason.alias("reason"))


def turnover(bars: DataFrame, official: str = "turnover") -> DataFrame:
    """A reported turnover keeps its column; an estimate, mean price times volume, goes to another one."""
    mean = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    guess = F.when(F.col(official).isNull(), mean * F.col("volume"))
    kind = F.when(F.col(official).isNotNull(), "PROVIDER").when(guess.isNotNull(), "ESTIMATED").otherwise("MISSING")
    return bars.select("stock_id", "trade_date", F.col(official).alias("turnover_try"), guess.alias("estimated_turnover_try"), kind.alias("turnover_type"))


def gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """stock_id, kind, n and the days: calendar days (trade_date, holiday) without a bar, and bars with a real zero."""
    span = bars.groupBy("stock_id").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = span.join(F.broadcast(calendar), (F.col("trade_date") >= F.col("a")) & (F.col("trade_date") <= F.col("b")))  # one row for a day: bounded
    rows = days.join(bars.select("stock_id", "trade_date", "volume", F.lit(True).alias("there")), ["stock_id", "trade_date"], "left")
    kind = F.when(F.col("volume") == 0, "REAL_ZERO").when(F.col("there").isNull() & F.col("holiday"), "HOLIDAY").when(F.col("volume").isNull(), "NO_DATA")
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    return rows.groupBy("stock_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("trade_date")).alias("days"))


def order_violations(bars: DataFrame) -> DataFrame:
    """Rows whose date repeats the one before it or is smaller, in the order of seq."""
    before = F.lag("trade_date").over(Window.partitionBy("stock_id").orderBy("seq"))
    return bars.withColumn("before", before).where("trade_date <= before").select("stock_id", "seq", F.when(F.col("trade_date") == F.col("before"), "DUPLICATE_DATE").otherwise("SERIES_ORDER").alias("problem"))
