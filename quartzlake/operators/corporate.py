"""Corporate actions: factors, adjusted prices, versions, and trading restrictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzlake.config import DEFAULT, Thresholds

HALT = "TRADING_HALT"


def ratio_parts(ratio: Column) -> tuple[Column, Column]:
    """(a, b) of "a:b"; of a plain number, (null, number)."""
    text = F.trim(ratio.cast("string"))
    pair = text.contains(":")
    part = lambda k: F.expr("NULL") if k is None else F.split_part(text, F.lit(":"), F.lit(k)).try_cast("double")
    return F.when(pair, part(1)), F.when(pair, part(2)).otherwise(text.try_cast("double"))


def factor(kind: Column, ratio: Column, reference: Column) -> tuple[Column, Column]:
    """(factor, error) of an action: dividend (ref - amount) / ref, bonus and rights b / (a + b), split and others b / a."""
    a, b = ratio_parts(ratio)
    dividend = kind == "dividend"
    raw = (
        F.when(dividend, F.try_divide(reference - b, reference)).when(a.isNull(), b)
        .when(kind.isin("bonus", "capital_increase", "rights"), F.try_divide(b, a + b)).otherwise(F.try_divide(b, a))
    )
    error = (
        F.when(b.isNull() | (~dividend & ~F.coalesce(a != 0, F.lit(True))), "BAD_RATIO").when(dividend & reference.isNull(), "NO_REFERENCE")
        .when(dividend & (b >= reference), "AMOUNT_NOT_BELOW_REFERENCE").when(raw.isNull() | (raw <= 0), "NOT_POSITIVE")
    )
    return F.when(error.isNull(), raw), error


def with_factors(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """actions with reference_close (the last raw close before the effective date), factor and error.

    The as-of join is one window over actions and bars together, so it needs one shuffle by stock and no inequality join."""
    marks = actions.select("stock_id", F.col("effective_date").alias("at"), F.lit(1).alias("is_action"), F.struct(*actions.columns).alias("action"), F.lit(None).cast("double").alias("px"))
    points = bars.select("stock_id", F.col("trade_date").alias("at"), F.lit(0).alias("is_action"), F.lit(None).cast(marks.schema["action"].dataType).alias("action"), F.col("close").alias("px"))
    before = Window.partitionBy("stock_id").orderBy(F.col("at").cast("timestamp").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    rows = marks.unionByName(points).withColumn("reference_close", F.last("px", ignorenulls=True).over(before))
    rows = rows.where("is_action = 1").select("action.*", "reference_close")
    value, error = factor(F.col("action_type"), F.col("ratio"), F.col("reference_close"))
    return rows.withColumn("factor", value).withColumn("error", error)


def adjusted(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """stock_id, trade_date, close, factor, adjusted_close: the product of the factors that take effect after the bar.

    The actions of a stock are few, so they are one array for each stock, and the product is a fold in the row."""
    mine = factors.where("error IS NULL").groupBy("stock_id").agg(F.array_sort(F.collect_list(F.struct("effective_date", "seq", "factor"))).alias("actions"))
    rows = bars.select("stock_id", "trade_date", "close").join(mine, "stock_id", "left")
    later = F.filter("actions", lambda x: x["effective_date"] > F.col("trade_date"))
    product = F.coalesce(F.aggregate(later, F.lit(1.0), lambda acc, x: acc * x["factor"]), F.lit(1.0))
    return rows.select("stock_id", "trade_date", "close", product.alias("factor"), F.size(F.coalesce(later, F.array())).alias("n_actions")).withColumn("adjusted_close", F.bround(F.col("close") * F.col("factor"), 6))


def explain_outliers(bars: DataFrame, factors: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """stock_id, trade_date, diff_pct, reason of each bar's move against the bar before."""
    first = factors.withColumn("rn", F.row_number().over(Window.partitionBy("stock_id", "effective_date").orderBy("seq"))).where("rn = 1 AND error IS NULL")
    first = first.select("stock_id", F.col("effective_date").alias("trade_date"), "factor")
    rows = bars.select("stock_id", "trade_date", "close", F.lag("close").over(Window.partitionBy("stock_id").orderBy("trade_date")).alias("before"))
    rows = rows.join(first, ["stock_id", "trade_date"], "left")
    diff = F.try_divide(F.abs(F.col("close") - F.col("before")), F.col("before")) * 100
    expected = F.col("before") * F.col("factor")
    off = F.try_divide(F.abs(F.col("close") - expected), expected) * 100
    reason = (
        F.when(diff.isNull(), "NO_REFERENCE").when(diff <= limits.outlier_pct, "NO_OUTLIER").when(F.col("factor").isNull(), "UNEXPLAINED_OUTLIER")
        .when(off <= limits.explain_tolerance_pct, "CORPORATE_ACTION").otherwise("CORPORATE_ACTION_MISMATCH")
    )
    return rows.select("stock_id", "trade_date", diff.alias("diff_pct"), reason.alias("reason"))


def versions(announced: DataFrame) -> DataFrame:
    """Records (stock, type, effective_date, seq) as version chains: action-v1..n, all but the last superseded."""
    by = Window.partitionBy("stock_id", "action_type", "effective_date").orderBy("seq")
    n, last = F.row_number().over(by), F.lead("seq").over(by).isNull()
    return announced.withColumn("data_version", F.concat(F.lit("action-v"), n.cast("string"))).withColumn("status", F.when(last, F.coalesce("status", F.lit("ANNOUNCED"))).otherwise("SUPERSEDED"))


def transitions(requests: DataFrame) -> DataFrame:
    """Legality of status changes: ANNOUNCED to EFFECTIVE to COMPLETED, and no other way."""
    ok = ((F.col("old") == "ANNOUNCED") & (F.col("new") == "EFFECTIVE")) | ((F.col("old") == "EFFECTIVE") & (F.col("new") == "COMPLETED"))
    return requests.withColumn("outcome", F.when(ok, "status_updated").otherwise("INVALID_TRANSITION"))


def active_restrictions(restrictions: DataFrame, as_of) -> DataFrame:
    """Restrictions whose closed interval [start, end] holds the day; an open end never ends. The computed flag wins over a given one."""
    day = F.lit(as_of).cast("date")
    on = (F.col("start_date") <= day) & (F.col("end_date").isNull() | (day <= F.col("end_date")))
    return restrictions.withColumn("computed_active", on)


def suspension(restrictions: DataFrame, as_of) -> DataFrame:
    """stock_id, halted, scoring_ready, notes: a halt keeps the stock in the scan but not ready; others only leave a risk note."""
    live = active_restrictions(restrictions, as_of).where("computed_active")
    halted = F.coalesce(F.bool_or(F.col("restriction_type") == HALT), F.lit(False))
    notes = F.array_sort(F.collect_set(F.when(F.col("restriction_type") != HALT, F.concat(F.lit("RISK_NOTE:"), F.col("restriction_type")))))
    return live.groupBy("stock_id").agg(halted.alias("halted"), (~halted).alias("scoring_ready"), notes.alias("notes"))


def references(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """stock_id, trade_date, refs: the notices of the actions that take effect after a bar, in the order of their registration."""
    mine = factors.where("error IS NULL").groupBy("stock_id").agg(F.array_sort(F.collect_list(F.struct("seq", "effective_date", "kap_notice_no"))).alias("actions"))  # a stock has few
    later = F.filter(F.coalesce("actions", F.array()), lambda x: x["effective_date"] > F.col("trade_date"))
    return bars.select("stock_id", "trade_date").join(mine, "stock_id", "left").select("stock_id", "trade_date", F.transform(later, lambda x: x["kap_notice_no"]).alias("refs"))
