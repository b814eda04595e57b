"""Queries of the index score's further rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzlake.operators import index_score as score
from quartzlake.sources import tables as T

from .bars import joined
from .oracle_views import with_views

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df, **digits):
    return df.select(*[F.bround(c, digits[c]).alias(c) if c in digits else c for c in df.columns])


@query("""SELECT p_partkey AS k, CASE WHEN a = 0 OR b = 0 OR a IS NULL THEN NULL WHEN a > 0 AND b > 0 THEN 'STRONG_POSITIVE' WHEN a > 0 THEN 'WEAK_POSITIVE' WHEN b < 0 THEN 'MEDIUM_NEGATIVE' ELSE 'STRONG_NEGATIVE' END AS label FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 3 - 1 END AS a, p_partkey % 5 - 2 AS b FROM part)""")
def interest_quadrants(spark, d):
    k = F.col("p_partkey")
    return T.table(spark, d, "part").select(k.alias("k"), score.interest_quadrant(F.when(k % 11 != 0, k % 3 - 1), k % 5 - 2).alias("label"))


@query(with_views("bars_long", """SELECT series, trade_date, round_even(basis, 9) AS basis, round_even(share, 9) AS share, CASE WHEN share >= 0.95 THEN 'CROWDED' WHEN share <= 1 - 0.95 THEN 'FEAR' END AS flag FROM (SELECT *, len(list_filter(held, lambda x: x <= basis)) / len(held)::DOUBLE AS share
  FROM (SELECT *, list(basis) OVER (PARTITION BY series ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS held FROM (SELECT stock_id AS series, trade_date, (high - close) / greatest(30 - day(trade_date), 1)::DOUBLE AS basis FROM bars_long)))"""))
def futures_basis(spark, d):
    f = T.bars_long(spark, d).select(F.col("stock_id").alias("series"), "trade_date", F.col("high").alias("future"), F.col("close").alias("spot"), (30 - F.dayofmonth("trade_date")).alias("days_left"))
    return rounded(score.basis(f), basis=9, share=9)


@query(with_views("bars_long", """SELECT trade_date, round_even(capped_volume, 6) AS capped_volume, round_even(advancing_share, 9) AS advancing_share, CASE WHEN up AND busy THEN 'CONFIRMED_RISE' WHEN up AND NOT busy THEN 'UNCONFIRMED_RISE' WHEN NOT up AND busy THEN 'STRONG_SELLING' WHEN NOT up AND NOT busy THEN 'WEAK_SELLING' END AS verdict FROM (
  SELECT *, round_even(level, 6) > round_even(lag(level) OVER w, 6) AS up, capped_volume > avg(capped_volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS busy FROM (SELECT trade_date, avg(close) AS level, sum(capped) AS capped_volume, sum(capped) FILTER (rises) / sum(capped) FILTER (rises IS NOT NULL) AS advancing_share
  FROM (SELECT *, close > lag(close) OVER (PARTITION BY stock_id ORDER BY trade_date) AS rises, least(volume::DOUBLE, sum(volume) OVER (PARTITION BY trade_date) * 0.1) AS capped FROM bars_long) GROUP BY 1) WINDOW w AS (ORDER BY trade_date))"""))
def volume_confirmation(spark, d):
    return rounded(score.volume_confirmation(T.bars_long(spark, d)), capped_volume=6, advancing_share=9)


SERIES = """series AS (SELECT stock_id AS series, trade_date, close AS value FROM bars_long), moved AS (SELECT *, value / lag(value, 1) OVER w - 1 AS d1, value / lag(value, 5) OVER w - 1 AS d5, value / lag(value, 20) OVER w - 1 AS d20 FROM series WINDOW w AS (PARTITION BY series ORDER BY trade_date)),
rated AS (SELECT *, stddev_pop(d1) OVER (PARTITION BY series ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol20, list(value) OVER (PARTITION BY series ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS held FROM moved)"""


def series(spark, d):
    return T.bars_long(spark, d).select(F.col("stock_id").alias("series"), "trade_date", F.col("close").alias("value"))


@query(with_views("bars_long", """SELECT series, trade_date, value, round_even(d1, 9) AS d1, round_even(d5, 9) AS d5, round_even(d20, 9) AS d20, round_even(vol20, 6) AS vol20, round_even(len(list_filter(held, lambda x: x <= value)) / len(held)::DOUBLE, 9) AS percentile,
  abs(d1) > 3.0 * lag(vol20) OVER (PARTITION BY series ORDER BY trade_date) AS jump FROM rated""", SERIES))
def rate_measures(spark, d):
    return rounded(score.rates(series(spark, d)), d1=9, d5=9, d20=9, vol20=6, percentile=9)


@query(with_views("bars_long", """SELECT f.trade_date, round_even(y.high - y.low, 6) AS spread, CASE WHEN f.d1 > 0 AND c.d1 > 0 AND y.close > y.open THEN 1.25 ELSE 1.0 END::DOUBLE AS multiplier FROM moved f JOIN moved c USING (trade_date) JOIN bars_long y USING (trade_date) WHERE f.series = 1 AND c.series = 2 AND y.stock_id = 3""", SERIES))
def joint_risk(spark, d):
    r = score.rates(series(spark, d).where("series IN (1, 2)"))
    yields = T.bars_long(spark, d).where("stock_id = 3").select("trade_date", F.col("high").alias("y10"), F.col("low").alias("y2"), (F.col("close") - F.col("open")).alias("y10_change"))
    return rounded(score.joint_risk(r.where("series = 1"), r.where("series = 2"), yields), spread=6)


@query(with_views("bars_long", """SELECT sector, trade_date, round_even(m1 - a1, 9) AS rel1, round_even(m5 - a5, 9) AS rel5, round_even(m20 - a20, 9) AS rel20, n FROM (SELECT s_nationkey AS sector, trade_date, avg(d1) AS m1, avg(d5) AS m5, avg(d20) AS m20, count(d1) AS n FROM moved JOIN supplier ON s_suppkey = series GROUP BY 1, 2)
  JOIN (SELECT trade_date, avg(d1) AS a1, avg(d5) AS a5, avg(d20) AS a20 FROM moved GROUP BY 1) USING (trade_date)""", SERIES))
def sector_rotation(spark, d):
    sectors = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("stock_id"), F.col("s_nationkey").alias("sector"))
    return rounded(score.rotation(T.bars_long(spark, d), sectors), rel1=9, rel5=9, rel20=9)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'IGNORED' WHEN event_id % 7 = 0 OR event_id % 100 < 70 THEN 'MANAGER_REVIEW' ELSE 'SCORED' END AS outcome FROM events""")
def geopolitical_gate(spark, d):
    k = F.col("event_id")
    e = T.table(spark, d, "events").select("event_id", F.when(k % 2 == 0, F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("u")))).otherwise(F.when(k % 3 != 0, F.array(F.lit("u")))).alias("source_urls"), F.when(k % 7 != 0, (k % 100) / 100).alias("model_confidence"))
    return score.event_gate(e)


@query("""SELECT p_partkey AS k, concat_ws(',', CASE WHEN b < 0 AND n < 0 AND o < 0 THEN 'ALL_NEGATIVE' END, CASE WHEN b > 0 AND o < 0 THEN 'MARKET_FIT_REDUCED' END, CASE WHEN o > 0 AND b < 0 THEN 'RELATIVE_STRENGTH' END, CASE WHEN n > 0 AND w < 0 THEN 'NARROW_RISE' END, CASE WHEN b > 0 AND n > 0 AND o > 0 AND f < 0 AND v < 0 THEN 'UNCONFIRMED_RISE' END,
  CASE WHEN b < 0 AND n < 0 AND o < 0 AND v < 0 AND f = 0 THEN 'WEAK_SELLING' END, CASE WHEN b > 0 AND n > 0 AND o > 0 AND f > 0 AND v > 0 AND g > 0 THEN 'BROAD_POSITIVE' END) AS labels
  FROM (SELECT p_partkey, p_partkey % 3 - 1 AS b, p_partkey // 3 % 3 - 1 AS n, p_partkey // 9 % 3 - 1 AS o, p_partkey // 27 % 3 - 1 AS w, p_partkey // 2 % 3 - 1 AS f, p_partkey // 5 % 3 - 1 AS v, p_partkey // 7 % 3 - 1 AS g FROM part)""")
def day_labels(spark, d):
    k = F.col("p_partkey")
    sign = lambda n: F.floor(k / n) % 3 - 1
    return T.table(spark, d, "part").select(k.alias("k"), joined(score.regime_labels(sign(1), sign(3), sign(9), sign(27), sign(2), sign(5), sign(7))).alias("labels"))


@query("""SELECT series, seq, concat_ws(',', CASE WHEN abs(s - sb) > 25 THEN 'TOTAL_JUMP' END, CASE WHEN abs(a - ab) > 70 OR abs(b - bb) > 70 THEN 'CATEGORY_JUMP' END) AS codes FROM (SELECT *, lag(s) OVER w AS sb, lag(a) OVER w AS ab, lag(b) OVER w AS bb FROM (SELECT user_id AS series, event_id AS seq, event_id * 17 % 61 AS s, event_id * 13 % 101 AS a, CASE WHEN event_id % 4 <> 0 THEN event_id * 29 % 101 END AS b FROM events) WINDOW w AS (PARTITION BY series ORDER BY seq))
  WHERE abs(s - sb) > 25 OR abs(a - ab) > 70 OR abs(b - bb) > 70""")
def score_anomalies(spark, d):
    k = F.col("event_id")
    rows = T.table(spark, d, "events").select(F.col("user_id").alias("series"), k.alias("seq"), (k * 17 % 61).alias("score"), F.array(k * 13 % 101, F.when(k % 4 != 0, k * 29 % 101)).alias("parts"))
    return score.anomalies(rows).withColumn("codes", joined("codes"))


@query(with_views("bars_long", """SELECT CASE WHEN s >= 80 THEN 'STRONG_UP' WHEN s >= 65 THEN 'UP' WHEN s >= 50 THEN 'NEUTRAL' WHEN s >= 35 THEN 'WEAK' ELSE 'DOWN' END AS regime, count(*) AS n, round_even(avg(f1), 9) AS mean_f1, round_even(avg(f5), 9) AS mean_f5, round_even(corr(s, f1), 6) AS corr_f1, round_even(corr(s, f5), 6) AS corr_f5
  FROM (SELECT dayofyear(trade_date) * 7 % 101 AS s, lead(close, 1) OVER w / close - 1 AS f1, lead(close, 5) OVER w / close - 1 AS f5 FROM bars_long WINDOW w AS (PARTITION BY stock_id ORDER BY trade_date)) GROUP BY 1"""))
def regime_backtest(spark, d):
    prices = T.bars_long(spark, d).select(F.col("stock_id").alias("series"), "trade_date", "close")
    scores = prices.select("series", "trade_date", (F.dayofyear("trade_date") * 7 % 101).cast("double").alias("score"))
    return rounded(score.backtest(scores, prices), mean_f1=9, mean_f5=9, corr_f1=6, corr_f5=6)


@query("SELECT * FROM (VALUES ('direction', 30), ('futures', 15), ('volume', 15), ('sectors', 10), ('currency', 15), ('world', 10), ('geopolitics', 5)) v(category, points)")
def category_weights(spark, d):
    return spark.createDataFrame(list(score.check_weights().items()), "category string, points int")


@query(with_views("bars_long", "SELECT stock_id, trade_date, CASE WHEN i >= 10 THEN round_even(e5, 6) END AS ema5, CASE WHEN i >= 40 THEN round_even(e20, 6) END AS ema20 FROM e", """n AS (SELECT stock_id, trade_date, close, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date) AS i FROM bars_long),
e AS (SELECT stock_id, trade_date, close, i, close AS e5, close AS e20 FROM n WHERE i = 1 UNION ALL SELECT n.stock_id, n.trade_date, n.close, n.i, e.e5 + (n.close - e.e5) * (2.0::DOUBLE / 6), e.e20 + (n.close - e.e20) * (2.0::DOUBLE / 21) FROM e JOIN n ON n.stock_id = e.stock_id AND n.i = e.i + 1)"""))
def moving_averages(spark, d):
    return rounded(score.ema(T.bars_long(spark, d)).select("stock_id", "trade_date", "ema5", "ema20"), ema5=6, ema20=6)
