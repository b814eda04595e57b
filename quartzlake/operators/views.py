"""What pages show of a stock: summary, price ranges, markers, states without data, thinned series, and the parts of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzlake.operators import api, corporate

RANGES = (30, 60, 90, 180, 260)
MARKERS = {"dividend": "T", "split": "B", "bonus": "B", "rights": "R"}


def stock_summary(universe: DataFrame, bars: DataFrame, ratios: DataFrame, verdicts: DataFrame, filings: DataFrame, news: DataFrame, actions: DataFrame, restrictions: DataFrame) -> DataFrame:
    """The 17 columns of a stock's line; a missing value is null, a count without rows 0.

    universe: stock_id, symbol, name, sector; bars: validated; verdicts: stock_id, data_confidence, state, two readiness flags."""
    by = Window.partitionBy("stock_id").orderBy("trade_date")
    moved = bars.withColumn("before", F.lag("close").over(by))
    at = lambda c: F.max_by(c, "trade_date").alias(c)
    last = moved.groupBy("stock_id").agg(F.max("trade_date").alias("last_trade_date"), at("close"), at("before"), at("volume"), at("turnover_try"), at("turnover_type"))
    count = lambda df, name: df.groupBy("stock_id").agg(F.count(F.lit(1)).alias(name))
    rows = universe.join(last, "stock_id", "left").join(ratios.select("stock_id", "ratio"), "stock_id", "left").join(verdicts, "stock_id", "left")
    for df, name in ((filings, "kap_count"), (news, "news_count"), (actions, "action_count"), (restrictions, "restriction_count")):
        rows = rows.join(count(df, name), "stock_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    change = F.try_divide(F.col("close") - F.col("before"), F.col("before")) * 100
    return rows.select(
        "symbol", "name", "sector", F.col("close").alias("last_close"), "last_trade_date", change.alias("daily_change"), F.col("volume").alias("units"), "turnover_try", "turnover_type", F.col("ratio").alias("volume_ratio"),
        "data_confidence", "state", number("kap_count"), number("news_count"), (F.coalesce("action_count", F.lit(0)) > 0).alias("has_action"), (F.coalesce("restriction_count", F.lit(0)) > 0).alias("has_restriction"), "scoring_ready", "favorite_eligible",
    )


def price_range(bars: DataFrame, n: int | None = None) -> DataFrame:
    """The last n bars of each stock, or all of them; days without a bar stay away."""
    if n is None:
        return bars
    if n not in RANGES:
        raise api.InvalidParameter("range")
    return bars.withColumn("rn", F.row_number().over(Window.partitionBy("stock_id").orderBy(F.desc("trade_date")))).where(F.col("rn") <= n).drop("rn")


def event_markers(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """stock_id, trade_date, marker: the letter of the first action (by seq) that takes effect on a bar's day."""
    letter = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    first = actions.groupBy("stock_id", F.col("effective_date").alias("trade_date")).agg(F.min_by("action_type", "seq").alias("kind"))
    return bars.select("stock_id", "trade_date").join(first, ["stock_id", "trade_date"]).select("stock_id", "trade_date", F.coalesce(F.try_element_at(letter, F.col("kind")), F.lit("D")).alias("marker"))


def raw_and_adjusted(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Closes with their adjusted ones; a stock without a usable action has none, they are never copied from the raw ones."""
    found = corporate.adjusted(bars, factors)
    has = factors.where("error IS NULL").select("stock_id").distinct().withColumn("has", F.lit(True))
    return found.join(has, "stock_id", "left").select("stock_id", "trade_date", "close", F.when(F.col("has"), F.col("adjusted_close")).alias("adjusted_close"), F.coalesce("has", F.lit(False)).alias("can_toggle"))


def no_data_state(label: Column, review: Column, halted: Column) -> Column:
    """What stands in place of a chart, or null: a halt first, then review, then what the history lacks."""
    return (
        F.when(halted, "TRADING_HALTED").when(review | (label == "REVIEW_REQUIRED"), "UNDER_REVIEW").when(label.isNull() | (label == "PRICE_DATA_MISSING"), "NO_PRICE_DATA")
        .when(label == "NEW_LISTING", "NEW_LISTING").when(label == "INSUFFICIENT_FOR_TECHNICAL", "TOO_SHORT")
    )


def thinned(bars: DataFrame, points: int = 500) -> DataFrame:
    """For drawing only: stocks of more bars than points get that many groups of neighbouring bars, each as one bar."""
    by = Window.partitionBy("stock_id")
    rows = bars.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("rn", F.row_number().over(by.orderBy("trade_date")))
    group = F.when(F.col("n") > points, F.floor((F.col("rn") - 1) * points / F.col("n"))).otherwise(F.col("rn") - 1)
    return rows.groupBy("stock_id", group.alias("point")).agg(
        F.max("trade_date").alias("trade_date"), F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars")
    )


def canonical_only(news: DataFrame) -> DataFrame:
    """News that are canonical, or not marked either way."""
    return news.where(F.coalesce("canonical", F.lit(True)))


def answer(rows: DataFrame, universe: DataFrame, order: list[str]) -> DataFrame:
    """What an endpoint of one kind returns: rows of visible symbols, in order, without private columns."""
    return api.publishable(api.visible(rows, universe).withColumn("position", F.row_number().over(Window.partitionBy("symbol").orderBy(*order))))


def looked_up(asked: DataFrame, stocks: DataFrame, universe: DataFrame) -> DataFrame:
    """asked (request_id, asked) with the symbol of the visible stock that is meant, null without one.

    A symbol is looked up as it is written, then in upper, then in lower case, and the first one that there is counts. A stock (symbol,
    active) is visible unless it is inactive, or missing from the universe (symbol, in any case) while that has rows. Each text is looked
    up once, however often it is asked for; a null one means no stock."""
    tries = F.array_distinct(F.array("asked", F.upper("asked"), F.lower("asked")))
    keyed = asked.where("asked IS NOT NULL").select("asked").distinct().select("asked", F.posexplode(tries).alias("turn", "symbol"))
    met = keyed.join(stocks.select("symbol", "active"), "symbol").groupBy("asked").agg(F.min(F.struct("turn", "symbol", "active")).alias("s")).select("asked", "s.symbol", "s.active")
    listed = universe.where("symbol IS NOT NULL").select(F.upper("symbol").alias("key"), F.lit(True).alias("listed")).distinct()
    some = F.broadcast(listed.agg((F.count(F.lit(1)) > 0).alias("some")))  # one row
    known = met.withColumn("key", F.upper("symbol")).join(listed, "key", "left").crossJoin(some)
    shown = known.where(F.coalesce("active", F.lit(True)) & (F.coalesce("listed", F.lit(False)) | ~F.col("some"))).select("asked", "symbol")
    return asked.select("request_id", "asked").join(shown, "asked", "left")


def single(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The answer to each request of `looked_up` from rows of one per symbol, without private columns, and its code."""
    held = api.publishable(rows).withColumn("_held", F.lit(True))
    code = F.when(F.col("symbol").isNull(), "SYMBOL_NOT_FOUND").when(F.col("_held").isNull(), "NOT_FOUND").otherwise("OK")
    return found.join(held, "symbol", "left").withColumn("code", code).drop("_held")


def envelopes(rows: DataFrame, run_id: str, generated_at: str) -> DataFrame:
    """symbol, run_id, status, total and generated_at of each symbol's answer; no row is OK with total 0 only if the symbol is listed."""
    return rows.groupBy("symbol").agg(F.count("position").alias("total")).select("symbol", F.lit(run_id).alias("scan_run_id"), F.when(F.col("total") > 0, "OK").otherwise("EMPTY").alias("status"), "total", F.lit(generated_at).alias("generated_at"))
