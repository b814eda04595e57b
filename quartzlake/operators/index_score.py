"""The index score, from its written rules: trend, momentum, breadth, close quality, regime. Open points are arguments.

EMA(n) has alpha 2 / (n + 1) and starts at the first close; the rules leave both open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

MIN_ROWS = {5: 10, 20: 40, 50: 100}
# Score bounds with their regime and greatest weight.
REGIMES = ((80, "STRONG_UP", 100), (65, "UP", 85), (50, "NEUTRAL", 65), (35, "WEAK", 40), (0, "DOWN", 20))


def ema(bars: DataFrame, spans: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    """stock_id, trade_date, close, n and ema<span>, null before the least number of rows. Each stock's bars go through one scan, in order; a null close leaves the averages as they are."""

    found = scan.folded(bars.select("stock_id", "trade_date", "close"), ["stock_id"], ["trade_date", "close"], ["close"], lambda: scan.Averages(spans, MIN_ROWS), "n long, " + ", ".join(f"ema{s} double" for s in spans))
    return found.select("stock_id", "trade_date", "close", "n", *[f"ema{s}" for s in spans])


def trend(emas: DataFrame) -> DataFrame:
    """trend: 30 for a close above EMA20, 20 for EMA5 above it, 25 for it above EMA50, 15 for its rise over 5 days, 10 for a close above the middle of 20 days."""
    by = Window.partitionBy("stock_id").orderBy("trade_date")
    last20 = by.rowsBetween(-19, 0)
    middle = (F.max("close").over(last20) + F.min("close").over(last20)) / 2
    points = ((F.col("close") > F.col("ema20"), 30), (F.col("ema5") > F.col("ema20"), 20), (F.col("ema20") > F.col("ema50"), 25), (F.col("ema20") > F.lag("ema20", 5).over(by), 15), (F.col("close") > middle, 10))
    return emas.withColumn("trend", sum(F.when(ok, n).otherwise(0) for ok, n in points)).withColumn("trend", F.when(F.col("ema50").isNotNull(), F.col("trend")))


def returns(bars: DataFrame, days: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    by = Window.partitionBy("stock_id").orderBy("trade_date")
    return bars.select("stock_id", "trade_date", "close", *[(F.try_divide(F.col("close"), F.lag("close", d).over(by)) - 1).alias(f"r{d}") for d in days])


def percentile(rows: DataFrame, column: str, window: int = 252) -> DataFrame:
    """rows with <column>_pct: the share of the last `window` rows' values that are at most the row's own."""
    return scan.trailing_share(rows, "stock_id", "trade_date", column, window, f"{column}_pct")


def breadth(bars: DataFrame) -> DataFrame:
    """trade_date, advancers, non_decliners: shares among the stocks that have a bar that day and one before."""
    moved = returns(bars, (1,)).where("r1 IS NOT NULL")
    return moved.groupBy("trade_date").agg(F.avg((F.col("r1") > 0).cast("double")).alias("advancers"), F.avg((F.col("r1") >= 0).cast("double")).alias("non_decliners"), F.count(F.lit(1)).alias("n"))


def close_quality(bars: DataFrame) -> DataFrame:
    """0 to 100: where the close is between low and high; 50 and less sure if they are equal."""
    q = F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")) * 100
    return bars.select("stock_id", "trade_date", F.coalesce(q, F.lit(50.0)).alias("quality"), (F.col("high") == F.col("low")).alias("flat"))


def relative_strength(bars: DataFrame, index: DataFrame, days: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Returns of a series less the index's on the same day (trade_date, close)."""
    own = returns(bars, days)
    base = returns(index.withColumn("stock_id", F.lit(0)), days).select("trade_date", *[F.col(f"r{d}").alias(f"base{d}") for d in days])
    return own.join(base, "trade_date").select("stock_id", "trade_date", *[(F.col(f"r{d}") - F.col(f"base{d}")).alias(f"rs{d}") for d in days])


def total_score(categories: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """(score, available): earned over available weight times 100; a null category counts in neither."""
    earned = sum(F.coalesce(v, F.lit(0.0)) * w / 100 for v, w in categories.values())
    available = sum(F.when(v.isNotNull(), w).otherwise(0) for v, w in categories.values())
    return F.try_divide(earned, available) * 100, available


def regime(score: Column) -> tuple[Column, Column]:
    name, weight = F.lit(None).cast("string"), F.lit(None).cast("int")
    for low, label, most in reversed(REGIMES):
        name, weight = F.when(score >= low, label).otherwise(name), F.when(score >= low, most).otherwise(weight)
    return name, weight


def gate(available: Column) -> Column:
    return F.when(available < 65, "STAY_IN_CASH").when(available < 80, "WARNING").otherwise("OK")


# Categories with their greatest points, 100 together.
WEIGHTS = {"direction": 30, "futures": 15, "volume": 15, "sectors": 10, "currency": 15, "world": 10, "geopolitics": 5}


def check_weights(weights: dict[str, float] = WEIGHTS) -> dict[str, float]:
    if set(weights) != set(WEIGHTS) or abs(sum(weights.values()) - 100) > 1e-9:
        raise ValueError("INVALID_WEIGHT_SUM")
    return weights


def interest_quadrant(price_change: Column, interest_change: Column) -> Column:
    """Label of a futures price and its open interest together; null if either is unknown or does not move."""
    up, more = price_change > 0, interest_change > 0
    moved = (price_change != 0) & (interest_change != 0)
    return F.when(moved & up & more, "STRONG_POSITIVE").when(moved & up, "WEAK_POSITIVE").when(moved & ~more, "MEDIUM_NEGATIVE").when(moved, "STRONG_NEGATIVE")


def basis(futures: DataFrame, window: int = 60, extreme: float = 0.95) -> DataFrame:
    """series, trade_date, basis by day to expiry, its share among the last `window`, and a flag at either extreme.

    futures: series, trade_date, future, spot, days_left. The rules ask for a correction by the days left and give no
    formula; here the basis is divided by them, so contracts near their end are comparable."""
    rows = futures.withColumn("basis", F.try_divide(F.col("future") - F.col("spot"), F.greatest(F.col("days_left"), F.lit(1)).cast("double")))
    flag = F.when(F.col("share") >= extreme, "CROWDED").when(F.col("share") <= 1 - extreme, "FEAR")
    return scan.trailing_share(rows, "series", "trade_date", "basis", window, "share").select("series", "trade_date", "basis", "share", flag.alias("flag"))


def volume_confirmation(bars: DataFrame, cap: float = 0.1, window: int = 20) -> DataFrame:
    """trade_date, capped_volume, advancing_share, verdict: index and volume together.

    A stock's volume counts up to a share `cap` of the day's total (the rules leave the cap open), so one large stock
    cannot make the day. The index is the mean close."""
    day, by = Window.partitionBy("trade_date"), Window.partitionBy("stock_id").orderBy("trade_date")
    rows = bars.withColumn("rises", F.col("close") > F.lag("close").over(by)).withColumn("capped", F.least(F.col("volume").cast("double"), F.sum("volume").over(day) * cap))
    daily = rows.groupBy("trade_date").agg(F.avg("close").alias("level"), F.sum("capped").alias("capped_volume"), F.try_divide(F.sum(F.when(F.col("rises"), F.col("capped"))), F.sum(F.when(F.col("rises").isNotNull(), F.col("capped")))).alias("advancing_share"))
    days = Window.orderBy("trade_date")  # a row for each day only
    mean = F.avg("capped_volume").over(days.rowsBetween(-window, -1))
    up, busy = F.bround("level", 6) > F.bround(F.lag("level").over(days), 6), F.col("capped_volume") > mean
    verdict = F.when(up & busy, "CONFIRMED_RISE").when(up & ~busy, "UNCONFIRMED_RISE").when(~up & busy, "STRONG_SELLING").when(~up & ~busy, "WEAK_SELLING")
    return daily.select("trade_date", "capped_volume", "advancing_share", verdict.alias("verdict"))


def rates(series: DataFrame, window: int = 252, jump: float = 3.0) -> DataFrame:
    """series, trade_date, changes over 1, 5 and 20 days, 20-day volatility, percentile among the last `window`, sudden jumps."""
    by = Window.partitionBy("series").orderBy("trade_date")
    rows = series
    for d in (1, 5, 20):
        rows = rows.withColumn(f"d{d}", F.try_divide(F.col("value"), F.lag("value", d).over(by)) - 1)
    rows = rows.withColumn("vol20", F.stddev_pop("d1").over(by.rowsBetween(-19, 0)))
    rows = rows.withColumn("jump", F.abs("d1") > jump * F.lag("vol20").over(by))
    return scan.trailing_share(rows, "series", "trade_date", "value", window, "percentile")


def joint_risk(currency: DataFrame, swaps: DataFrame, yields: DataFrame, factor: float = 1.25) -> DataFrame:
    """trade_date, spread (10 less 2 years) and multiplier: a factor over 1 where currency, swaps and yields all get worse."""
    rows = currency.select("trade_date", F.col("d1").alias("fx")).join(swaps.select("trade_date", F.col("d1").alias("cds")), "trade_date").join(yields, "trade_date")
    worse = (F.col("fx") > 0) & (F.col("cds") > 0) & (F.col("y10_change") > 0)
    return rows.select("trade_date", (F.col("y10") - F.col("y2")).alias("spread"), F.when(worse, factor).otherwise(1.0).alias("multiplier"))


def rotation(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """sector, trade_date, rel1, rel5, rel20: a sector's mean return less the market's, over 1, 5 and 20 days together."""
    moved = returns(bars).join(sectors, "stock_id")
    mean = lambda d: F.avg(f"r{d}").alias(f"m{d}")
    own, market = moved.groupBy("sector", "trade_date").agg(*map(mean, (1, 5, 20)), F.count("r1").alias("n")), moved.groupBy("trade_date").agg(*[F.avg(f"r{d}").alias(f"a{d}") for d in (1, 5, 20)])
    return own.join(market, "trade_date").select("sector", "trade_date", *[(F.col(f"m{d}") - F.col(f"a{d}")).alias(f"rel{d}") for d in (1, 5, 20)], "n")


def event_gate(events: DataFrame, least: float = 0.7) -> DataFrame:
    """event_id, outcome: an event without a source is not used, one of low model confidence goes to a manager."""
    sourced = F.coalesce(F.size("source_urls") > 0, F.lit(False))
    sure = F.coalesce(F.col("model_confidence") >= least, F.lit(False))
    return events.select("event_id", F.when(~sourced, "IGNORED").when(~sure, "MANAGER_REVIEW").otherwise("SCORED").alias("outcome"))


def regime_labels(broad: Column, narrow: Column, own: Column, breadth: Column, futures: Column, volume: Column, world: Column) -> Column:
    """Labels of a day from the signs (-1, 0, 1) of three indices and four categories."""
    up, down = (broad > 0) & (narrow > 0) & (own > 0), (broad < 0) & (narrow < 0) & (own < 0)
    return F.array_compact(
        F.array(
            F.when(down, "ALL_NEGATIVE"), F.when((broad > 0) & (own < 0), "MARKET_FIT_REDUCED"), F.when((own > 0) & (broad < 0), "RELATIVE_STRENGTH"), F.when((narrow > 0) & (breadth < 0), "NARROW_RISE"),
            F.when(up & (futures < 0) & (volume < 0), "UNCONFIRMED_RISE"), F.when(down & (volume < 0) & (futures == 0), "WEAK_SELLING"), F.when(up & (futures > 0) & (volume > 0) & (world > 0), "BROAD_POSITIVE"),
        )
    )


def anomalies(scores: DataFrame, total: float = 25, category: float = 70) -> DataFrame:
    """Rows (series, seq, score, parts) whose score moved by more than `total`, or one of whose parts by more than `category`."""
    by = Window.partitionBy("series").orderBy("seq")
    rows = scores.withColumn("before", F.lag("score").over(by)).withColumn("parts_before", F.lag("parts").over(by))
    far = F.exists(F.zip_with("parts", "parts_before", lambda a, b: F.abs(a - b) > category), lambda x: F.coalesce(x, F.lit(False)))
    codes = F.array_compact(F.array(F.when(F.abs(F.col("score") - F.col("before")) > total, "TOTAL_JUMP"), F.when(far, "CATEGORY_JUMP")))
    return rows.withColumn("codes", codes).where(F.size("codes") > 0).select("series", "seq", "codes")


def backtest(scores: DataFrame, prices: DataFrame, days: tuple[int, ...] = (1, 5)) -> DataFrame:
    """regime, n and mean forward returns, and their correlation with the score: a score meets only closes of later days."""
    by = Window.partitionBy("series").orderBy("trade_date")
    ahead = prices.select("series", "trade_date", *[(F.try_divide(F.lead("close", d).over(by), F.col("close")) - 1).alias(f"f{d}") for d in days])
    rows = scores.withColumn("regime", regime(F.col("score"))[0]).join(ahead, ["series", "trade_date"])
    return rows.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"f{d}").alias(f"mean_f{d}") for d in days], *[F.corr("score", f"f{d}").alias(f"corr_f{d}") for d in days])
