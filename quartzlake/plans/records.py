"""Queries over records at rest, runs, identity, actions and what the list pages show."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from quartzlake.durable import shared_dir
from quartzlake.functions import text
from quartzlake.operators import api, confidence, corporate, disclosures, identity, news, records, runs, storage, validation, views, volume
from quartzlake.sources import fetched
from quartzlake.sources import tables as T
from quartzlake.streaming import increments

from .bars import AS_OF, BATTERY, FACTORS, LABELS, RATIO, RESTRICTIONS, VERSIONED, checked, factors, joined, labels, restrictions, versioned
from .domain import NORM, SCAN, STOP, _scan, agency_sources
from .oracle_views import with_views

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def part(spark, d):
    return T.table(spark, d, "part"), F.col("p_partkey")


# --- records --------------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey AS stock_id, CASE WHEN k7 = 0 THEN NULL ELSE DATE '2024-01-02' END AS trade_date, CASE WHEN k5 = 0 THEN NULL ELSE p_size + 0.5 END AS close, CASE WHEN k11 = 0 THEN NULL ELSE 9.25 END AS adjusted_close, CASE WHEN k3 = 0 THEN 'TRY' ELSE 'USD' END AS currency,
  CASE WHEN k7 = 0 THEN 'missing_date' WHEN k5 = 0 OR k13 = 0 THEN 'missing_or_bad_field' WHEN k17 = 0 THEN 'invalid_bar' END AS skipped FROM (SELECT *, p_partkey % 3 AS k3, p_partkey % 5 AS k5, p_partkey % 7 AS k7, p_partkey % 11 AS k11, p_partkey % 13 AS k13, p_partkey % 17 AS k17 FROM part)""")
def normalised_records(spark, d):
    p, k = part(spark, d)
    price, day = F.col("p_size") + F.lit(0.5), F.lit("2024-01-02T10:00:00")
    raw = p.select(
        k.alias("stock_id"), F.when(k % 7 == 0, " ").when(k % 2 == 0, day).alias("date"), F.when(k % 7 == 0, F.lit(None)).when(k % 2 != 0, day).alias("trade_date"), price.cast("string").alias("open"), (price + 1).cast("string").alias("high"),
        F.when(k % 17 == 0, "-1").otherwise((price - 1).cast("string")).alias("low"), F.when(k % 5 == 0, "n/a").otherwise(price.cast("string")).alias("close"), F.when(k % 13 != 0, "100").alias("volume"),
        F.when(k % 11 == 0, "bad").when(k % 2 == 0, "9.25").alias("adjusted_close"), F.when((k % 11 != 0) & (k % 2 != 0), "9.25").alias("adj_close"), F.when(k % 3 == 0, "").otherwise("USD").alias("currency"),
    )
    return records.normalise(raw, "licensed").select("stock_id", "trade_date", "close", "adjusted_close", "currency", "skipped")


@query(with_views("bars_dirty", """SELECT stock_id, count(*) FILTER (code IS NULL) AS kept, count(code) AS dropped, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM (SELECT stock_id, CASE WHEN least(open, high, low, close) < 0 OR volume < 0 OR high < low
  OR (open IS NOT NULL AND close IS NOT NULL AND high < greatest(open, close)) OR NOT regexp_matches(currency, '^[A-Z]{3}$') THEN 'BAR_REJECTED' WHEN currency <> 'TRY' THEN 'WRONG_CURRENCY' END AS code
  FROM (SELECT * EXCLUDE (currency), CASE WHEN stock_id % 6 = 0 THEN 'EUR' ELSE currency END AS currency FROM bars_dirty)) GROUP BY 1"""))
def filtered_bars_log(spark, d):
    bars = T.bars_dirty(spark, d).withColumn("currency", F.when(F.col("stock_id") % 6 == 0, "EUR").otherwise(F.col("currency")))
    return records.filter_log(bars).withColumn("codes", joined("codes"))


@query(with_views("bars_long", "SELECT stock_id, trade_date, close FROM bars_long WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'"))
def source_date_range(spark, d):
    return records.between(T.bars_long(spark, d), "1996-01-01", "1996-03-31").select("stock_id", "trade_date", "close")


@query(with_views("bars_dirty", """SELECT stock_id, trade_date, concat_ws(',', nullif(failed_codes, ''), CASE WHEN stock_id % 4 = 1 THEN 'SYMBOL_OWNER_MISMATCH' END, CASE WHEN stock_id % 5 = 0 THEN 'UNEXPLAINED_OUTLIER' END, CASE WHEN stock_id % 6 = 0 THEN 'CORPORATE_UNCHECKED' END, CASE WHEN stock_id % 7 = 0 THEN 'SOURCE_DIVERGENCE' END) AS failed_codes,
  CASE WHEN failed_codes <> '' OR stock_id % 4 = 1 THEN 'REJECTED' WHEN stock_id % 5 = 0 OR stock_id % 7 = 0 THEN 'REVIEW_REQUIRED' ELSE 'CLEAN' END AS status FROM checked""", BATTERY))
def full_rule_battery(spark, d):
    k = F.col("stock_id")
    more = [validation.owner_rule(F.when(k % 4 == 1, k + 1).when(k % 4 == 2, k)), validation.outlier_rule(F.when(k % 3 != 0, k % 5 != 0).otherwise(F.when(k % 5 == 0, False))), validation.corporate_rule(F.when(k % 6 != 0, F.array())), validation.cross_rule(F.when(k % 7 == 0, 0.6).when(k % 2 == 0, 0.5))]
    return validation.validate(T.bars_dirty(spark, d), AS_OF, extra=more).select("stock_id", "trade_date", joined("failed_codes").alias("failed_codes"), "status")


@query(with_views("bars_dirty", """SELECT stock_id, trade_date, seq, seq = 2 AS repeated FROM bars_dirty, (VALUES (1), (2)) v(seq) WHERE stock_id % 2 = 0 OR seq = 1"""))
def repeated_bars(spark, d):
    bars = T.bars_dirty(spark, d).withColumn("seq", F.lit(1))
    twice = bars.unionByName(bars.where("stock_id % 2 = 0").withColumn("seq", F.lit(2)))
    return validation.validate(twice, AS_OF, order="seq").select("stock_id", "trade_date", "seq", F.array_contains("failed_codes", "DUPLICATE_DATE").alias("repeated"))


@query(with_views("bars_dirty", """SELECT stock_id, trade_date, CASE WHEN status = 'REJECTED' AND stock_id % 3 = 0 THEN 'REVIEW_REQUIRED' ELSE status END AS before, CASE WHEN status = 'REJECTED' AND stock_id % 3 = 0 THEN CASE WHEN stock_id % 2 = 0 THEN 'CLEAN' WHEN stock_id % 5 = 0 THEN 'REJECTED' ELSE 'REVIEW_REQUIRED' END ELSE status END AS status FROM checked""", BATTERY))
def resolved_reviews(spark, d):
    k = F.col("stock_id")
    bars = checked(spark, d).select("stock_id", "trade_date", F.when((F.col("status") == "REJECTED") & (k % 3 == 0), "REVIEW_REQUIRED").otherwise(F.col("status")).alias("status"))
    decisions = bars.select("stock_id", "trade_date", F.when(k % 2 == 0, "approve").when(k % 5 == 0, "reject").alias("decision")).where("decision IS NOT NULL")
    return validation.resolve_review(bars.withColumn("before", F.col("status")), decisions).select("stock_id", "trade_date", "before", "status")


@query("""SELECT p_partkey AS record_id, p_partkey % 20 AS batch_id, outcome, CASE WHEN outcome = 'PROMOTED' THEN sha256('{"data_layer":"raw","p_name":"' || p_name || '","p_size":' || p_size || ',"record_id":' || p_partkey || '}') END AS checksum_before,
  CASE WHEN outcome = 'PROMOTED' THEN sha256('{"data_layer":"clean","p_name":"' || p_name || '","p_size":' || p_size || ',"record_id":' || p_partkey || '}') END AS checksum_after
  FROM (SELECT *, CASE WHEN p_partkey % 40 = 7 THEN 'NOT_FOUND' WHEN p_partkey % 40 = 29 THEN 'WRONG_LAYER' WHEN p_partkey % 20 IN (7, 9) THEN 'BATCH_REFUSED' ELSE 'PROMOTED' END AS outcome FROM part)""")
def promoted_layers(spark, d):
    p, k = part(spark, d)
    rows = p.where(k % 40 != 7).select(k.alias("record_id"), "p_name", "p_size")
    rows = records.in_layer(rows.where("record_id % 40 <> 29"), "raw").unionByName(records.in_layer(rows.where("record_id % 40 = 29"), "clean"))
    return records.promote_layer(p.select((k % 20).alias("batch_id"), k.alias("record_id")), rows, "raw", "clean")


@query("""SELECT p_partkey AS k, sha256('{"k":' || p_partkey || ',"n":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"' || p_name || '"' END || '}') AS checksum FROM part""")
def row_checksums(spark, d):
    p, k = part(spark, d)
    return p.select(k.alias("k"), F.when(k % 3 != 0, F.col("p_name")).alias("n")).select("k", records.row_checksum("n", "k").alias("checksum"))


@query("""SELECT p_partkey AS stock_id, CASE WHEN p_size % 14 < 7 AND p_partkey % 4 <> 0 THEN 'skipped_fresh' ELSE 'checked' END AS outcome FROM part""")
def weekly_profile_checks(spark, d):
    p, k = part(spark, d)
    seen = p.where(k % 4 != 0).select(k.alias("stock_id"), F.expr("TIMESTAMP_NTZ'2024-06-28 09:00:00' - make_dt_interval(p_size % 14)").alias("checked_at"))
    return records.profile_checks(p.select(k.alias("stock_id")), seen, "2024-06-28 09:00:00")


@query(with_views("disclosures", """SELECT notification_id, 1 AS seq, CASE WHEN notification_id % 6 = 0 THEN 'duplicate' WHEN previous_notification_id IS NOT NULL THEN 'revision_chain' ELSE 'inserted' END AS outcome,
  CASE WHEN notification_id % 6 <> 0 THEN CASE WHEN previous_notification_id % 6 = 0 THEN 4 ELSE 1 END END AS version_no FROM disclosures
  UNION ALL SELECT notification_id, 2, 'duplicate', NULL FROM disclosures WHERE notification_id % 5 = 0"""))
def stored_disclosures(spark, d):
    items = T.disclosures(spark, d).select("notification_id", "previous_notification_id")
    incoming = items.withColumn("seq", F.lit(1)).unionByName(items.where("notification_id % 5 = 0").withColumn("seq", F.lit(2)))
    return records.insert_disclosures(incoming, items.where("notification_id % 6 = 0").select("notification_id", F.lit(3).alias("version_no")))


@query("SELECT o_custkey AS stock_id, min(o_orderkey) AS seq FROM orders GROUP BY 1")
def frozen_snapshots(spark, d):
    return records.frozen(T.table(spark, d, "orders").select(F.col("o_custkey").alias("stock_id"), F.col("o_orderkey").alias("seq")), ["stock_id"])


@query(with_views("actions bars_long", "SELECT 'adjusted' AS output, 0::BIGINT AS invented UNION ALL SELECT 'padded', count(DISTINCT stock_id) FROM bars_long"))
def invented_history(spark, d):
    """Adjusted bars make no day up; a series that is padded by a day is found out."""
    bars = T.bars_long(spark, d)
    padded = bars.groupBy("stock_id").agg(F.date_sub(F.min("trade_date"), 1).alias("trade_date"))
    count = lambda df, name: records.invented_dates(df, bars).agg(F.count(F.lit(1)).alias("invented")).select(F.lit(name).alias("output"), "invented")
    return count(corporate.adjusted(bars, factors(spark, d)), "adjusted").unionByName(count(padded, "padded"))


@query("SELECT o_custkey AS stock_id, o_orderkey AS seq, 'adj-v' || row_number() OVER w AS data_version, lead(o_orderkey) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def adjustment_versions(spark, d):
    return records.adjustment_versions(T.table(spark, d, "orders").select(F.col("o_custkey").alias("stock_id"), F.col("o_orderkey").alias("seq")))


@query(with_views("bars_long", "SELECT stock_id, count(*) AS rows_all_versions, max(trade_date) AS last_date FROM versioned GROUP BY 1", VERSIONED))
def rows_of_all_versions(spark, d):
    return versioned(spark, d).groupBy("stock_id").agg(F.count(F.lit(1)).alias("rows_all_versions"), F.max("trade_date").alias("last_date"))


@query(with_views("bars_long", "SELECT stock_id, trade_date, seq, 'DUPLICATE_DATE' AS problem FROM versioned WHERE data_version = '10' AND FALSE UNION ALL SELECT stock_id, trade_date, n, CASE WHEN trade_date = before THEN 'DUPLICATE_DATE' ELSE 'SERIES_ORDER' END FROM (SELECT *, lag(trade_date) OVER (PARTITION BY stock_id ORDER BY n) AS before FROM (SELECT stock_id, trade_date, (stock_id * 31 + dayofyear(trade_date) * 7919) % 100003 * 100000 + datediff('day', DATE '1990-01-01', trade_date) AS n FROM bars_long)) WHERE trade_date <= before", VERSIONED))
def order_violations(spark, d):
    n = (F.col("stock_id") * 31 + F.dayofyear("trade_date").cast("long") * 7919) % 100003 * 100000 + F.date_diff("trade_date", F.lit("1990-01-01").cast("date"))
    bars = T.bars_long(spark, d).select("stock_id", "trade_date", n.alias("seq"))
    return volume.order_violations(bars).join(bars, ["stock_id", "seq"]).select("stock_id", "trade_date", "seq", "problem")


@query("""SELECT table_name, a AS source_rows, b AS target_rows FROM (SELECT 'part' AS table_name, (SELECT count(*) FROM part) AS a, (SELECT count(*) FROM part WHERE p_size > 10) AS b UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 0 UNION ALL SELECT 'region', (SELECT count(*) FROM region), (SELECT count(*) FROM region)) WHERE b < a""")
def data_loss(spark, d):
    own = lambda names: storage.manifest({n: T.table(spark, d, n) for n in names})
    kept = storage.manifest({"part": T.table(spark, d, "part").where("p_size > 10"), "region": T.table(spark, d, "region")})
    return storage.data_loss(own(["part", "nation", "region"]), kept)


# --- identity -------------------------------------------------------------------------------------------------------
@query(with_views("symbols", "SELECT 's' || s_suppkey AS symbol, s_suppkey AS stock_id, NULL AS reason FROM supplier WHERE s_suppkey % 11 <> 0 UNION ALL SELECT 'none' || s_suppkey, NULL, 'UNRESOLVED' FROM supplier WHERE s_suppkey % 11 = 0"))
def universe_resolution(spark, d):
    s, k = T.table(spark, d, "supplier"), F.col("s_suppkey")
    listed = s.select(F.concat(F.when(k % 11 == 0, "none").otherwise("s"), k.cast("string")).alias("symbol"))
    found, queue = records.resolve_universe(listed, T.symbols(spark, d))
    return found.withColumn("reason", F.lit(None).cast("string")).unionByName(queue.withColumn("stock_id", F.lit(None).cast("long")))


MERGES = "m AS (SELECT s_suppkey AS old, s_suppkey - 1 AS final FROM supplier WHERE s_suppkey % 5 = 1)"


def merges(spark, d):
    k = F.col("s_suppkey")
    return T.table(spark, d, "supplier").where(k % 5 == 1).select(k.alias("old"), (k - 1).alias("final"))


@query(with_views("symbols", """SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 7 = 0 THEN coalesce(final, s_suppkey) END AS stock_id, CASE WHEN s_suppkey % 2 = 0 THEN FALSE WHEN s_suppkey % 7 = 0 THEN TRUE END AS historical FROM supplier LEFT JOIN m ON old = s_suppkey""", MERGES))
def historical_symbols(spark, d):
    k = F.col("s_suppkey")
    asked = T.table(spark, d, "supplier").select(k.alias("query_id"), F.concat(F.when(k % 2 == 0, "s").otherwise("old"), k.cast("string")).alias("symbol"))
    return records.resolve_historical(asked, T.symbols(spark, d), merges(spark, d))


@query(with_views("symbols", "SELECT stock_id, symbol, valid_from, CASE WHEN final IS NOT NULL AND valid_to IS NULL THEN DATE '2001-01-01' ELSE valid_to END AS valid_to, coalesce(final, stock_id) AS resolves_to FROM symbols LEFT JOIN m ON old = stock_id", MERGES))
def merged_symbols(spark, d):
    return records.merge_symbols(T.symbols(spark, d), merges(spark, d), "2001-01-01")


@query("SELECT o_custkey AS stock_id, o_orderkey % 3 AS query, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2")
def open_review_queue(spark, d):
    return identity.open_queue(T.table(spark, d, "orders").select(F.col("o_custkey").alias("stock_id"), (F.col("o_orderkey") % 3).alias("query"), F.col("o_orderkey").alias("seq")))


@query("""SELECT user_id AS stock_id, min(event_id) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT user_id % 50 AS user_id, event_id, event_type FROM events)) WHERE event_type = 'error') WHERE streak = 3 GROUP BY 1""")
def link_failure_queue(spark, d):
    return records.link_failures(T.table(spark, d, "events").select((F.col("user_id") % 50).alias("stock_id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok")))


@query(with_views("symbols", "SELECT stock_id, symbol, row_number() OVER (PARTITION BY stock_id ORDER BY valid_from, symbol) AS position FROM symbols"))
def symbol_history_order(spark, d):
    return identity.history(T.symbols(spark, d))


@query("SELECT count(*) FILTER (s_suppkey % 5 = 0) AS actual, 20::BIGINT AS expected, count(*) FILTER (s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0) AS n_extra, count(*) FILTER (s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0) AS n_missing, count(*) FILTER (s_suppkey % 5 = 0) = 20 AS ok FROM supplier")
def universe_count_check(spark, d):
    s = T.table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("symbol"))
    return records.count_check(s.where("s_suppkey % 5 = 0"), s.where("s_suppkey % 3 = 0"), 20)


# --- disclosures ----------------------------------------------------------------------------------------------------
@query(with_views("disclosures", "SELECT stock_id, notification_id, row_number() OVER (PARTITION BY stock_id ORDER BY published_on, notification_id) AS position FROM disclosures"))
def disclosure_order(spark, d):
    return disclosures.ordered(T.disclosures(spark, d)).select("stock_id", "notification_id", "position")


@query(with_views("disclosures symbols", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN count(DISTINCT s.stock_id) = 0 THEN 'UNMATCHED' WHEN min(s.stock_id) % 5 <> 0 THEN 'MATCHED' ELSE 'OUT_OF_UNIVERSE' END AS status FROM disclosures d LEFT JOIN (SELECT * FROM symbols WHERE valid_to IS NULL) s
  ON s.symbol = CASE WHEN d.notification_id % 13 = 0 THEN 'X' ELSE 'S' END || d.stock_id GROUP BY d.notification_id) GROUP BY 1"""))
def disclosure_match_counts(spark, d):
    symbol = F.concat(F.when(F.col("notification_id") % 13 == 0, "X").otherwise("S"), F.col("stock_id").cast("string"))
    universe = T.table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("stock_id"))
    return disclosures.match_counts(disclosures.match(T.disclosures(spark, d).withColumn("symbol", symbol), T.symbols(spark, d), universe))


@query("""SELECT p_size AS run_id, CASE WHEN bool_and(p_partkey % 3 = 0) THEN 'FAILED' WHEN bool_or(p_partkey % 3 = 0 OR p_partkey % 7 = 0) THEN 'PARTIAL' ELSE 'COMPLETED' END AS status, CASE WHEN bool_or(p_partkey % 3 = 0) THEN 'DOWN' WHEN bool_or(p_partkey % 7 = 0) THEN 'DEGRADED' ELSE 'OK' END AS health, count(*) AS sources FROM part GROUP BY 1""")
def collection_health(spark, d):
    p, k = part(spark, d)
    return disclosures.health(p.select(F.col("p_size").alias("run_id"), (k % 3 == 0).alias("outage"), (k % 7 == 0).alias("error")))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'u1,u2' WHEN p_partkey % 4 = 1 THEN 'u1' ELSE '' END AS urls, CASE WHEN p_partkey % 3 = 0 THEN 'CANCELLED' WHEN p_partkey % 2 = 0 THEN 'REVISED' ELSE 'ORIGINAL' END AS status FROM part""")
def attachment_lists(spark, d):
    p, k = part(spark, d)
    one = lambda url: F.struct(F.lit(url).cast("string").alias("url"), F.lit("f").alias("file_name"))
    raw = F.when(k % 4 == 0, F.array(one("u1"), one(None), one("u2"), one("u1"))).when(k % 4 == 1, F.array(one("u1"))).otherwise(F.array(one(None)))
    kept = disclosures.attachments(raw)
    return p.select(k.alias("k"), F.array_join(F.transform(kept, lambda a: a["url"]), ",").alias("urls"), disclosures.revision_status(F.when(k % 3 == 0, k), F.when(k % 2 == 0, k)).alias("status"))


# --- news -----------------------------------------------------------------------------------------------------------
@query(with_views("news", f"""SELECT news_id, arg_max(stock_id, (score, confirmed, -stock_id)) AS stock_id, max(score) AS score FROM (SELECT news_id, news_id * 7 % 11 AS stock_id, news_id % 60 AS score, FALSE AS confirmed FROM news UNION ALL SELECT news_id, news_id * 3 % 11, news_id % 45 + news_id % 31, TRUE FROM news) GROUP BY 1"""))
def best_stock_of_news(spark, d):
    n, k = T.news(spark, d), F.col("news_id")
    rows = n.select("news_id", (k * 7 % 11).alias("stock_id"), (k % 60).alias("score"), F.lit(False).alias("confirmed")).unionByName(n.select("news_id", (k * 3 % 11).alias("stock_id"), (k % 45 + k % 31).alias("score"), F.lit(True).alias("confirmed")))
    return news.best_match(rows)


@query(with_views("news", """SELECT news_id, news_id % 7 AS stock_id, CASE WHEN open AND v THEN news_id % 90 ELSE s END AS score, NOT conf AS confirmed, open AND v AS by_model FROM (SELECT news_id, news_id % 100 AS s, news_id % 3 <> 0 AS conf, news_id % 100 BETWEEN 55 AND 79 AND news_id % 3 <> 0 AS open, news_id % 4 < 2 AS v FROM news)"""))
def model_opinions(spark, d):
    """A model's answer counts for open matches only, if it is valid: a whole number of 0 to 100, not a text and not a truth value."""
    n, k = T.news(spark, d), F.col("news_id")
    matches = n.select("news_id", (k % 7).alias("stock_id"), (k % 100).alias("score"), (k % 3 == 0).alias("confirmed"))
    given = F.when(k % 4 < 2, (k % 90).cast("string")).when(k % 8 == 2, "true").when(k % 8 == 3, "101").when(k % 8 == 6, '"70"').otherwise("1.5")
    answers = n.select("news_id", (k % 7).alias("stock_id"), F.concat(F.lit('{"stock_id": "S", "score": '), given, F.lit(', "reason": "r"}')).alias("answer"))
    return news.with_opinions(matches, answers)


@query(with_views("news", f"""SELECT a.news_id, len(list_intersect(a.k, b.k)) AS shared, len(list_filter(a.k, lambda x: NOT list_contains(b.k, x))) AS only_first FROM keys a JOIN keys b ON b.news_id = a.news_id + 1""",
  f"keys AS (SELECT news_id, list_distinct(list_filter(string_split({NORM.format('title')}, ' '), lambda w: length(w) >= 4 AND NOT list_contains([{STOP}], w))) AS k FROM news)"))
def shared_title_tokens(spark, d):
    n = T.news(spark, d).select("news_id", text.significant(F.col("title")).alias("k"))
    following = n.select((F.col("news_id") - 1).alias("news_id"), F.col("k").alias("k2"))
    return n.join(following, "news_id").select("news_id", F.size(F.array_intersect("k", "k2")).cast("long").alias("shared"), F.size(F.array_except("k", "k2")).cast("long").alias("only_first"))


@query(with_views("news", """SELECT news_id, row_number() OVER (PARTITION BY news_id % 5 ORDER BY CASE WHEN news_id % 3 <> 0 THEN news_id * 7 % 100 END NULLS LAST, news_id) AS position, news_id % 97 = 0 AS excluded FROM news WHERE news_id % 2 = 0 OR news_id % 97 = 0"""))
def canonical_news_order(spark, d):
    """Canonical news and the price tables that stay out of the de-duplication, by time (no time last) and id."""
    n, k = T.news(spark, d), F.col("news_id")
    rows = n.select("news_id", (k % 5).alias("day"), F.when(k % 3 != 0, k * 7 % 100).alias("at"))
    return news.listed(rows.where("news_id % 2 = 0 AND news_id % 97 <> 0"), rows.where("news_id % 97 = 0"), "day").select("news_id", "position", "excluded")


@query(with_views("news", "SELECT news_id FROM news WHERE news_id % 3 <> 1"))
def canonical_only_news(spark, d):
    k = F.col("news_id")
    return views.canonical_only(T.news(spark, d).select("news_id", F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("canonical"))).select("news_id")


@query(with_views("news", f"SELECT news_id, stock_id, row_number() OVER (PARTITION BY news_id ORDER BY score DESC, stock_id) AS position FROM (SELECT news_id, unnest([news_id % 7, news_id % 5 + 10, news_id % 3 + 20]) AS stock_id, unnest([news_id % 4, news_id % 2, 1]) AS score FROM news)"))
def match_order(spark, d):
    n, k = T.news(spark, d), F.col("news_id")
    rows = n.select("news_id", F.inline(F.array(*[F.struct(a.alias("stock_id"), b.cast("long").alias("score")) for a, b in ((k % 7, k % 4), (k % 5 + 10, k % 2), (k % 3 + 20, F.lit(1)))])))
    return news.match_order(rows).select("news_id", "stock_id", "position")


# --- actions and restrictions ---------------------------------------------------------------------------------------
@query(with_views("actions bars_long", """SELECT b.stock_id, b.trade_date, coalesce(string_agg('KAP-' || f.seq, ',' ORDER BY f.seq), '') AS refs FROM bars_long b LEFT JOIN factors f ON f.stock_id = b.stock_id AND f.effective_date > b.trade_date AND f.error IS NULL WHERE b.trade_date < DATE '1996-01-01' GROUP BY 1, 2""", FACTORS))
def action_references(spark, d):
    bars = T.bars_long(spark, d).where("trade_date < DATE '1996-01-01'")
    return corporate.references(bars, factors(spark, d)).withColumn("refs", joined("refs"))


@query(with_views("actions", """SELECT seq, 'action' AS kind FROM (SELECT seq, lead(seq) OVER (PARTITION BY stock_id, action_type, date_trunc('year', effective_date) ORDER BY seq) AS later FROM actions) WHERE later IS NULL UNION ALL SELECT seq, 'cancellation' FROM actions WHERE seq % 9 = 0"""))
def current_actions(spark, d):
    told = T.actions(spark, d).withColumn("effective_date", F.trunc("effective_date", "year")).withColumn("status", F.lit("ANNOUNCED"))
    return records.current_actions(corporate.versions(told).select("seq", "status"), told.where("seq % 9 = 0").select("seq", F.lit("CANCELLED").alias("status"))).select("seq", "kind")


@query("""SELECT p_partkey AS seq, CASE WHEN (p_partkey % 3 = 0 AND p_partkey % 4 = 1) OR (p_partkey % 3 = 1 AND p_partkey % 4 = 2) THEN 'status_updated' ELSE 'INVALID_TRANSITION' END AS outcome FROM part""")
def action_transitions(spark, d):
    p, k = part(spark, d)
    names = F.array(*map(F.lit, ("ANNOUNCED", "EFFECTIVE", "COMPLETED", "CANCELLED")))
    return corporate.transitions(p.select(k.alias("seq"), F.get(names, (k % 3).cast("int")).alias("old"), F.get(names, (k % 4).cast("int")).alias("new"))).select("seq", "outcome")


@query(with_views("actions", """SELECT coalesce(a.stock_id, r.stock_id) AS stock_id, coalesce(raw, '') AS actions_raw, coalesce(ok, '') AS actions_validated, coalesce(live, '') AS restrictions_active, coalesce(halted, FALSE) AS halted
  FROM (SELECT stock_id, string_agg(seq, ',' ORDER BY seq) AS raw, string_agg(seq, ',' ORDER BY seq) FILTER (seq % 3 <> 0 OR seq % 4 = 0) AS ok FROM actions GROUP BY 1) a FULL JOIN (SELECT stock_id, string_agg(seq, ',' ORDER BY seq) FILTER (computed_active) AS live, bool_or(computed_active AND restriction_type = 'TRADING_HALT') AS halted FROM live GROUP BY 1) r ON a.stock_id = r.stock_id""", RESTRICTIONS))
def feed_packets(spark, d):
    k = F.col("seq")
    told = T.actions(spark, d).select("stock_id", "seq", F.when(k % 3 == 0, "ANNOUNCED").when(k % 3 == 1, "EFFECTIVE").otherwise("COMPLETED").alias("status"), F.when(k % 4 == 0, True).alias("marked"))
    out = records.packets(told, corporate.active_restrictions(restrictions(spark, d), "2024-01-15"))
    return out.select("stock_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("actions_raw", "actions_validated", "restrictions_active")], "halted")


# --- volume, operations, text ---------------------------------------------------------------------------------------
@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'MANUAL' WHEN p_partkey % 3 = 0 THEN 'SOURCE_ERROR' WHEN p_partkey % 7 = 0 THEN 'HOLIDAY' WHEN p_partkey % 2 = 0 THEN 'NO_DATA' END AS reason, CASE WHEN p_partkey % 2 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 THEN p_size END AS valid FROM part""")
def missing_volume_reasons(spark, d):
    p, k = part(spark, d)
    units = F.when(k % 2 != 0, F.col("p_size"))
    rows = p.select(k.alias("k"), units.alias("units"), volume.missing_reason(F.when(k % 5 == 0, "MANUAL"), k % 3 == 0, k % 7 == 0, units).alias("reason"))
    return rows.select("k", "reason", volume.valid_volume(F.col("units"), F.col("reason"), F.when(F.col("k") % 11 == 0, False).when(F.col("k") % 2 == 0, True)).alias("valid"))


@query("SELECT p_partkey AS k, attempt, [0, 30, 120][attempt] AS after_s FROM part, (VALUES (1), (2), (3)) v(attempt)")
def retry_schedule(spark, d):
    p, k = part(spark, d)
    return runs.retry_times(p.select(k.alias("k"))).select("k", "attempt", "after_s")


@query("SELECT event_id, isodow(ts) < 6 AND CAST(ts AS DATE) <> DATE '2024-01-01' AS open FROM events")
def trading_days(spark, d):
    return T.table(spark, d, "events").select("event_id", runs.trading_day(F.to_date("ts"), ("2024-01-01",)).alias("open"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'OK' WHEN p_size * 2 >= 95 THEN 'CRITICAL' WHEN p_size * 2 >= 80 THEN 'WARN' ELSE 'OK' END AS level FROM part")
def disk_levels(spark, d):
    p, k = part(spark, d)
    return p.select(k.alias("k"), runs.disk_level(F.col("p_size") * 2, F.when(k % 10 == 0, 0).otherwise(100)).alias("level"))


@query("""SELECT p_partkey AS k, replace(replace(replace('../' || p_name || '\\x', '..', '_'), '/', '_'), '\\', '_') AS file_name, 'call ' || CASE WHEN p_partkey % 2 = 0 THEN '***' ELSE 'open' END || ' now' AS redacted, '***' AS api_key, CASE WHEN p_partkey % 2 = 0 THEN '***' ELSE 'open' END AS note FROM part""")
def redacted_values(spark, d):
    p, k = part(spark, d)
    secret = F.when(k % 2 == 0, "s3cr3t.v(1)").otherwise("open")
    extra = text.redact_map(F.create_map(F.lit("api_key"), F.lit("abc"), F.lit("note"), secret), ("s3cr3t.v(1)",))
    return p.select(k.alias("k"), text.safe_filename(F.concat(F.lit("../"), F.col("p_name"), F.lit("\\x"))).alias("file_name"), text.redact(F.concat(F.lit("call "), secret, F.lit(" now")), ("s3cr3t.v(1)",)).alias("redacted"), extra["api_key"].alias("api_key"), extra["note"].alias("note"))


@query("SELECT name, weight * 100 / sum(weight) OVER () AS scaled, weight FROM (SELECT CAST(p_partkey AS VARCHAR) AS name, p_size::DOUBLE AS weight FROM part WHERE p_partkey <= 12)")
def scaled_weights(spark, d):
    p, k = part(spark, d)
    return confidence.scaled(p.where(k <= 12).select(k.cast("string").alias("name"), F.col("p_size").cast("double").alias("weight")))


@query("""SELECT * FROM (VALUES ('extra', 'spare'), ('missing', 'news_check')) v(side, name)""")
def weight_name_difference(spark, d):
    given = [n for n in confidence.WEIGHTS if n != "news_check"] + ["spare"]
    return confidence.name_difference(spark.createDataFrame([(n,) for n in given], "name string"))


@query("""SELECT o_orderkey AS seq, CASE WHEN o_orderstatus <> 'P' THEN 'COMPLETED' WHEN rn = 1 AND o_custkey % 2 = 0 THEN 'ACTIVE' ELSE 'ABORTED' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)""")
def recovered_runs(spark, d):
    """Runs after a restart: what still says ACTIVE was cut off, unless its process is alive (even ones here) and it is the last of its owner."""
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "P", "ACTIVE").otherwise("COMPLETED").alias("status"), (F.col("o_custkey") % 2 == 0).alias("alive"))
    return runs.recovered(o).select("seq", "status")


# --- list pages -----------------------------------------------------------------------------------------------------
@query(with_views("stock_rows", "SELECT symbol FROM stock_rows WHERE scan_run_id = '2024-06-28-TARAMA-R10'"))
def run_assertion(spark, d):
    """Rows that are not of the latest run by number: R10 comes before R11, which R2's rows stand for here."""
    starts = spark.createDataFrame([("2024-06-28-TARAMA-R10", 10), ("2024-06-28-TARAMA-R2", 11)], "run_id string, seq int")
    return records.run_mismatches(T.stock_rows(spark, d), starts).select("symbol")


STAGED = """staged AS (SELECT CASE WHEN k % 10 = 8 THEN 'LIVE-' ELSE 'STAGING-' END || (k % 10) AS run_id, k, n = 0 OR k % 70 = 3 AS missing, CASE WHEN k % 70 = 3 THEN 0 ELSE price END AS price,
  CASE WHEN k % 90 = 45 THEN NULL WHEN k % 90 = 54 THEN 101 ELSE data_confidence END AS sure, CASE WHEN k % 110 = 27 THEN NULL ELSE state END AS state, CASE WHEN k % 10 <> 6 THEN coalesce(filings, 0) + coalesce(moves, 0) + k % 10 % 3 ELSE 0 END AS items
  FROM part1 JOIN scan USING (symbol) LEFT JOIN (SELECT stock_id AS k, count(*) AS filings FROM disclosures GROUP BY 1) USING (k) LEFT JOIN (SELECT stock_id AS k, count(*) AS moves FROM actions GROUP BY 1) USING (k) WHERE k % 110 <> 17),
started AS (SELECT CASE WHEN c_custkey % 10 = 8 THEN 'LIVE-' ELSE 'STAGING-' END || (c_custkey % 10) AS run_id, count(*) AS expected FROM customer GROUP BY 1 UNION ALL SELECT 'STAGING-none', 5),
per AS (SELECT run_id, any_value(expected) AS expected, count(k) AS n, count(*) FILTER (k IS NOT NULL AND state IS NULL) AS open, count(*) FILTER (price > 0) AS prices, coalesce(sum(items), 0) AS items, count(*) FILTER (missing AND price = 0) AS zeroed,
  count(*) FILTER (k IS NOT NULL AND NOT coalesce(sure BETWEEN 0 AND 100, FALSE)) AS unsure, count(*) FILTER (state = 'FAILED') AS failed FROM started LEFT JOIN staged USING (run_id) GROUP BY 1)"""


@query(with_views("bars_dirty disclosures actions", """SELECT run_id, unnest(['UNIVERSE_VERIFIED','ALL_SCANNED','CHANNELS_COLLECTED','MISSING_NOT_ZEROED','CONFIDENCE_PER_STOCK','NO_STOCK_FAILED']) AS criterion,
  unnest([starts_with(run_id, 'STAGING-') AND n > 0, n = expected AND open = 0, prices > 0 AND items > 0, zeroed = 0, n > 0 AND unsure = 0, failed = 0]) AS passed FROM per""", BATTERY, SCAN, STAGED))
def completion_criteria(spark, d):
    """Ten runs over a tenth of the stocks each, with zeroed, unscanned, lost and unsure rows and a run without items; one run has no row at all."""
    k = F.col("stock_id")
    run = lambda key: F.concat(F.when(key % 10 == 8, "LIVE-").otherwise("STAGING-"), (key % 10).cast("string")).alias("run_id")
    count = lambda rows, name: rows.groupBy("stock_id").agg(F.count(F.lit(1)).alias(name))
    rows = _scan(spark, d).where(k % 110 != 17).join(count(T.disclosures(spark, d), "kap_count"), "stock_id", "left").join(count(T.actions(spark, d), "action_count"), "stock_id", "left")
    zero, dry = k % 70 == 3, k % 10 == 6
    rows = rows.select(
        run(k), F.when(k % 110 != 27, F.col("state")).alias("state"), F.when(k % 90 == 45, F.lit(None)).when(k % 90 == 54, 101).otherwise(F.col("data_confidence")).alias("data_confidence"), F.when(zero, 0.0).otherwise(F.col("last_price")).alias("last_price"), "volume",
        F.when(zero, F.array(F.lit("price_availability"))).otherwise(F.col("missing_fields")).alias("missing_fields"), F.when(~dry, F.col("kap_count")).alias("kap_count"), F.when(~dry, k % 10 % 3).alias("news_count"),
        F.when(~dry, F.col("action_count")).alias("action_count"), F.lit(None).cast("long").alias("restriction_count"),
    )
    started = T.table(spark, d, "customer").groupBy(run(F.col("c_custkey"))).agg(F.count(F.lit(1)).alias("expected"))
    return records.completion(rows, started.unionByName(spark.range(1).select(F.lit("STAGING-none").alias("run_id"), F.lit(5).cast("long").alias("expected"))))


# --- symbols of several stocks --------------------------------------------------------------------------------------
def shared_symbols(spark, d):
    """Symbols that stocks of like balances have in common; those of the first five nations are valid no more."""
    s = T.table(spark, d, "supplier")
    symbol = F.concat(F.lit("B"), F.floor(F.col("s_acctbal") / 100).cast("string"))
    closed = F.when(F.col("s_nationkey") < 5, F.lit("1996-01-01").cast("date"))
    return s.select(F.col("s_suppkey").alias("stock_id"), F.lit("bist").alias("platform"), symbol.alias("symbol"), F.lit("1995-01-01").cast("date").alias("valid_from"), closed.alias("valid_to"))


OWNERS = "owners AS (SELECT 'B' || CAST(floor(s_acctbal / 100) AS BIGINT) AS symbol, count(*) AS n, min(s_suppkey) AS owner FROM supplier WHERE s_nationkey >= 5 GROUP BY 1)"


@query(f"WITH {OWNERS} SELECT c_custkey AS query_id, CASE WHEN n = 1 THEN owner END AS stock_id, coalesce(n, 0) AS n_owners, CASE WHEN n = 1 THEN 'MATCHED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS status FROM customer LEFT JOIN owners ON symbol = 'B' || CAST(floor(c_acctbal / 100) AS BIGINT)")
def resolve_shared_symbols(spark, d):
    asked = T.table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.lit("bist").alias("platform"), F.concat(F.lit(" b"), F.floor(F.col("c_acctbal") / 100).cast("string")).alias("symbol"))
    return identity.resolve(asked, shared_symbols(spark, d)).select("query_id", "stock_id", "n_owners", "status")


@query(f"WITH {OWNERS} SELECT c_custkey AS symbol_of, 'b' || CAST(floor(c_acctbal / 100) AS BIGINT) AS listed, CASE WHEN n = 1 THEN owner END AS stock_id, CASE WHEN n = 1 THEN NULL WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS reason FROM customer LEFT JOIN owners ON symbol = 'B' || CAST(floor(c_acctbal / 100) AS BIGINT)")
def review_queue(spark, d):
    """Each listed symbol with its stock, or with the reason for which it waits for review."""
    rows = T.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol_of"), F.concat(F.lit("b"), F.floor(F.col("c_acctbal") / 100).cast("string")).alias("listed"))
    found, queue = records.resolve_universe(rows.select(F.col("listed").alias("symbol")).distinct(), shared_symbols(spark, d))
    told = found.select(F.col("symbol").alias("listed"), "stock_id", F.lit(None).cast("string").alias("reason")).unionByName(queue.select(F.col("symbol").alias("listed"), F.lit(None).cast("long").alias("stock_id"), "reason"))
    return rows.join(told, "listed").select("symbol_of", "listed", "stock_id", "reason")


# --- a source by its three calls ------------------------------------------------------------------------------------
FETCH_DAY = dt.date(1997, 3, 14)
FETCHED = "stock_id, trade_date, open, high, low, close, volume"


@query(with_views("bars_long", f"SELECT {FETCHED} FROM bars_long WHERE trade_date > DATE '{FETCH_DAY}' - 60 AND trade_date <= DATE '{FETCH_DAY}'"))
def source_history(spark, d):
    return fetched.fetch_history(fetched.records(spark, f"{d}/lineitem.parquet"), FETCH_DAY, 60)


@query(with_views("bars_long", f"SELECT {FETCHED}, 0 AS seq FROM bars_long"))
def pulled_bars(spark, d):
    """All records by the stream of the source into a table of bars; a second pull finds nothing after the marks and adds nothing."""
    place = f"{shared_dir(spark)}/pulled-{uuid.uuid4().hex}"
    for _ in range(2):
        increments.pull(spark, f"{d}/lineitem.parquet", f"{place}/bars", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/bars").select(*FETCHED.split(", "), "seq")


@query(with_views("bars_long", f"SELECT {FETCHED} FROM bars_long WHERE trade_date = DATE '{FETCH_DAY}'"))
def source_date(spark, d):
    return fetched.fetch_date(fetched.records(spark, f"{d}/lineitem.parquet"), FETCH_DAY)


@query(with_views("bars_long", f"SELECT {FETCHED} FROM bars_long WHERE trade_date <= DATE '{FETCH_DAY}' QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) = 1"))
def source_latest(spark, d):
    return fetched.fetch_latest(fetched.records(spark, f"{d}/lineitem.parquet"), FETCH_DAY)


@query("""SELECT symbol FROM (SELECT c_name AS symbol, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 END, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 4 > 0 END, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 8 > 3 END, FALSE) AS has FROM customer) WHERE has""")
def has_news_fallbacks(spark, d):
    """has_news where there is a flag, else its count, else its list."""
    k = F.col("c_custkey")
    rows = T.table(spark, d, "customer").select(F.col("c_name").alias("symbol"), F.when(k % 3 == 0, k % 2 == 0).alias("has_news"), F.when(k % 5 != 0, k % 4).alias("news_count"), F.when(k % 7 != 0, F.when(k % 8 > 3, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))).alias("news_items"))
    return rows.where(api.predicate(rows, api.FilterParams(has_news=True))).select("symbol")


@query(with_views("bars_long", "SELECT stock_id, trade_date, data_layer FROM (SELECT *, CASE stock_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'VALIDATED' WHEN 2 THEN 'raw' ELSE 'clean' END AS data_layer FROM bars_long QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 30) WHERE coalesce(lower(data_layer), 'validated') <> 'raw' AND stock_id % 3 <> 0"))
def price_page(spark, d):
    """Prices of visible stocks: the last 30 bars, in the layers that are shown."""
    k = F.col("stock_id")
    bars = T.bars_long(spark, d).withColumn("data_layer", F.when(k % 4 == 1, "VALIDATED").when(k % 4 == 2, "raw").when(k % 4 == 3, "clean")).withColumn("symbol", k.cast("string"))
    listed = T.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), (F.col("s_suppkey") % 3 != 0).alias("is_active"))
    return api.visible(api.price_layers(views.price_range(bars, 30)), listed).select("stock_id", "trade_date", "data_layer")


ENDPOINT = {"kap": ("disclosures", "notification_id", "published_on"), "corporate_actions": ("actions", "seq", "effective_date")}


@query(with_views("disclosures actions", " UNION ALL ".join(f"SELECT '{kind}' AS endpoint, CAST(stock_id AS VARCHAR) AS symbol, {key} AS id, row_number() OVER (PARTITION BY stock_id ORDER BY {at}, {key}) AS position FROM {view} WHERE stock_id % 3 <> 0" for kind, (view, key, at) in ENDPOINT.items())
  + " UNION ALL SELECT 'restrictions', CAST(p_partkey % 50 AS VARCHAR), p_partkey, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) FROM part WHERE p_partkey % 50 % 3 <> 0 AND p_partkey % 50 < (SELECT count(*) FROM supplier)"))
def endpoint_answers(spark, d):
    """What the filing, action and restriction endpoints give for each visible symbol, in order and without private columns."""
    listed = T.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), (F.col("s_suppkey") % 3 != 0).alias("is_active"))
    out = None
    for kind, rows, key, at in (("kap", T.disclosures(spark, d), "notification_id", "published_on"), ("corporate_actions", T.actions(spark, d), "seq", "effective_date"), ("restrictions", restrictions(spark, d), "seq", None)):
        found = views.answer(rows.withColumn("symbol", F.col("stock_id").cast("string")).withColumn("internal_notes", F.lit("x")), listed, [c for c in (at, key) if c])
        found = found.select(F.lit(kind).alias("endpoint"), "symbol", F.col(key).alias("id"), "position")
        out = found if out is None else out.unionByName(found)
    return out


@query(with_views("actions", "SELECT symbol, 'R1' AS scan_run_id, CASE WHEN n > 0 THEN 'OK' ELSE 'EMPTY' END AS status, n AS total, '2024-06-28' AS generated_at FROM (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, count(a.seq) AS n FROM supplier LEFT JOIN actions a ON a.stock_id = s_suppkey AND a.seq % 2 = 0 GROUP BY 1)"))
def answer_envelopes(spark, d):
    listed = T.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    rows = T.actions(spark, d).where("seq % 2 = 0").select(F.col("stock_id").cast("string").alias("symbol"), F.lit(1).alias("position"))
    return views.envelopes(listed.join(rows, "symbol", "left"), "R1", "2024-06-28")


@query(with_views("disclosures actions bars_long", """SELECT 'S' || s_suppkey AS symbol, s_name AS name, s_nationkey AS sector, b.close AS last_close, b.trade_date AS last_trade_date, round_even((b.close - before) / before * 100, 6) AS daily_change, b.volume AS units, round_even(b.close * b.volume, 4) AS turnover_try, CASE WHEN b.stock_id IS NOT NULL THEN 'PROVIDER' END AS turnover_type,
  round_even(CASE WHEN used_days >= 5 THEN last_volume / (total / used_days) END, 6) AS volume_ratio, s_suppkey % 101 AS data_confidence, 'READY' AS state, coalesce(k.n, 0) AS kap_count, coalesce(w.n, 0) AS news_count, coalesce(a.n, 0) > 0 AS has_action, coalesce(r.n, 0) > 0 AS has_restriction, s_suppkey % 2 = 0 AS scoring_ready, s_suppkey % 4 = 0 AS favorite_eligible
  FROM supplier LEFT JOIN (SELECT *, lag(close) OVER (PARTITION BY stock_id ORDER BY trade_date) AS before FROM bars_long QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) = 1) b ON b.stock_id = s_suppkey LEFT JOIN ratio q ON q.stock_id = s_suppkey
  LEFT JOIN (SELECT stock_id, count(*) AS n FROM disclosures GROUP BY 1) k ON k.stock_id = s_suppkey LEFT JOIN (SELECT doc_id % 50 AS stock_id, count(*) AS n FROM documents GROUP BY 1) w ON w.stock_id = s_suppkey
  LEFT JOIN (SELECT stock_id, count(*) AS n FROM actions GROUP BY 1) a ON a.stock_id = s_suppkey LEFT JOIN (SELECT stock_id, count(*) AS n FROM live WHERE computed_active GROUP BY 1) r ON r.stock_id = s_suppkey""", RATIO, RESTRICTIONS))
def stock_summary_lines(spark, d):
    bars, k = T.bars_long(spark, d), F.col("s_suppkey")
    s = T.table(spark, d, "supplier")
    verdicts = s.select(k.alias("stock_id"), (k % 101).alias("data_confidence"), F.lit("READY").alias("state"), (k % 2 == 0).alias("scoring_ready"), (k % 4 == 0).alias("favorite_eligible"))
    universe = s.select(k.alias("stock_id"), F.concat(F.lit("S"), k.cast("string")).alias("symbol"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("sector"))
    valued = bars.withColumn("turnover_try", F.col("close") * F.col("volume")).withColumn("turnover_type", F.lit("PROVIDER"))
    live = corporate.active_restrictions(restrictions(spark, d), "2024-01-15").where("computed_active")
    out = views.stock_summary(universe, valued, volume.ratios(bars), verdicts, T.disclosures(spark, d), T.table(spark, d, "documents").select((F.col("doc_id") % 50).alias("stock_id")), T.actions(spark, d), live)
    return out.withColumn("daily_change", F.bround("daily_change", 6)).withColumn("turnover_try", F.bround("turnover_try", 4)).withColumn("volume_ratio", F.bround("volume_ratio", 6))


SORTED = {"daily_change": "asc", "volume_ratio": "desc", "scan_status": "asc", "name": "desc"}
RANKED = """SELECT {key!r} AS sorted_by, symbol, row_number() OVER (ORDER BY {key} IS NULL, {key} {way}, CASE WHEN {key} IS NOT NULL THEN symbol END {way}, symbol) AS position FROM lines QUALIFY position BETWEEN 21 AND 40"""


@query(f"WITH lines AS (SELECT symbol, name, daily_change, volume_ratio, state AS scan_status FROM ({ORACLE_SQL['stock_summary_lines']})) " + " UNION ALL ".join(f"({RANKED.format(key=key, way=way)})" for key, way in SORTED.items()))
def sorted_summaries(spark, d):
    """The second page of the stocks' lines by each of four keys; lines without a value come last."""
    lines = stock_summary_lines(spark, d).withColumn("scan_status", F.col("state")).withColumn("scan_run_id", F.lit(None).cast("string"))
    out = None
    for key, way in SORTED.items():
        page = api.positions(lines, api.FilterParams(sort=key, direction=way, page=2, page_size=20)).select(F.lit(key).alias("sorted_by"), "symbol", "position")
        out = page if out is None else out.unionByName(page)
    return out


@query(with_views("bars_dirty", """SELECT request_id, upper(c_name) AS symbol, CASE WHEN c_name IS NULL THEN 'SYMBOL_NOT_FOUND' WHEN state IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS code, state, data_confidence FROM asked
  LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING' AND (c_nationkey = 7 OR c_acctbal >= 0)) ON upper(c_name) = upper(asked) LEFT JOIN (SELECT * FROM scan WHERE state <> 'INACTIVE') s ON s.symbol = c_name""", BATTERY, SCAN,
  """asked AS (SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'O' THEN lower(n) WHEN 'P' THEN upper(n) ELSE n END AS asked FROM (SELECT o_orderkey, o_orderstatus, 'Customer#' || lpad(CAST(o_custkey * 3 // 2 AS VARCHAR), 9, '0') AS n FROM orders))"""))
def single_stock_answers(spark, d):
    """Requests for one stock's last scan: symbols in any case, unknown, inactive or outside of the universe, and stocks without a scan."""
    c, n = T.table(spark, d, "customer"), F.concat(F.lit("Customer#"), F.lpad(F.expr("o_custkey * 3 div 2").cast("string"), 9, "0"))
    asked = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "O", F.lower(n)).when(F.col("o_orderstatus") == "P", F.upper(n)).otherwise(n).alias("asked"))
    stocks = c.select(F.upper("c_name").alias("symbol"), F.when(F.col("c_nationkey") != 7, F.col("c_acctbal") >= 0).alias("active"))
    scan = _scan(spark, d).where("state <> 'INACTIVE'").select(F.upper("symbol").alias("symbol"), "state", "data_confidence", F.lit("x").alias("internal_notes"))
    found = views.looked_up(asked, stocks, c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_name").alias("symbol")))
    return views.single(found, scan).select("request_id", "symbol", "code", "state", "data_confidence")


@query(with_views("news", """SELECT CAST(news_id % 50 AS VARCHAR) AS symbol, news_id, row_number() OVER (PARTITION BY news_id % 50 ORDER BY published_min DESC, news_id) AS position
  FROM (SELECT * FROM news QUALIFY news_id = first_value(news_id) OVER (PARTITION BY coalesce(md5(body), 'none ' || news_id) ORDER BY news_id % 5 <> 0, published_min, -length(body), news_id)) WHERE news_id % 50 % 3 <> 0 AND news_id % 50 < (SELECT count(*) FROM supplier)"""))
def news_answers(spark, d):
    """What the news endpoint gives for each visible symbol: canonical news, those that share no text unmarked, the latest first."""
    k = F.col("news_id")
    n = agency_sources(T.news(spark, d)).withColumn("digest", F.md5("body"))
    marks = news.canonical(n.where("digest IS NOT NULL"), "digest").where("n > 1").select("digest", "canonical_id")
    rows = n.join(marks, "digest", "left").withColumn("canonical", F.col("canonical_id") == k).withColumn("symbol", (k % 50).cast("string")).withColumn("raw_error", F.lit("x"))
    listed = T.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), (F.col("s_suppkey") % 3 != 0).alias("is_active"))
    return views.answer(views.canonical_only(rows), listed, [F.desc("published_min"), "news_id"]).select("symbol", "news_id", "position")


@query("SELECT 'S' || s_suppkey AS symbol, s_name AS name, 1 AS page, greatest(n, 1) AS page_size, n AS total, least(n, 1) AS total_pages FROM supplier, (SELECT count(*) AS n FROM supplier)")
def universe_answer(spark, d):
    """The universe in one page, with the meta of the list."""
    rows = T.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("admin_balance"))
    return api.publishable(rows).crossJoin(F.broadcast(api.whole_list(rows)))  # one row on the other side


@query(with_views("actions bars_long", """SELECT b.stock_id, b.trade_date, CASE arg_min(action_type, seq) WHEN 'dividend' THEN 'T' WHEN 'split' THEN 'B' WHEN 'bonus' THEN 'B' WHEN 'rights' THEN 'R' ELSE 'D' END AS marker FROM bars_long b JOIN actions a ON a.stock_id = b.stock_id AND a.effective_date = b.trade_date GROUP BY 1, 2"""))
def chart_markers(spark, d):
    return views.event_markers(T.bars_long(spark, d), T.actions(spark, d))


@query(with_views("actions bars_long", """SELECT b.stock_id, b.trade_date, b.close, CASE WHEN any_value(h.stock_id) IS NOT NULL THEN round_even(b.close * coalesce(product(factor), 1), 6) END AS adjusted_close, any_value(h.stock_id) IS NOT NULL AS can_toggle
  FROM bars_long b LEFT JOIN factors f ON f.stock_id = b.stock_id AND f.effective_date > b.trade_date AND f.error IS NULL AND f.stock_id % 2 = 0 LEFT JOIN (SELECT DISTINCT stock_id FROM factors WHERE error IS NULL AND stock_id % 2 = 0) h ON h.stock_id = b.stock_id GROUP BY 1, 2, 3""", FACTORS))
def raw_and_adjusted_prices(spark, d):
    return views.raw_and_adjusted(T.bars_long(spark, d), factors(spark, d).where("stock_id % 2 = 0"))


@query(with_views("bars_dirty", """SELECT stock_id, CASE WHEN stock_id % 20 = 7 THEN 'TRADING_HALTED' WHEN stock_id % 9 = 0 THEN 'UNDER_REVIEW' WHEN label = 'PRICE_DATA_MISSING' THEN 'NO_PRICE_DATA' WHEN label = 'NEW_LISTING' THEN 'NEW_LISTING' WHEN label = 'INSUFFICIENT_FOR_TECHNICAL' THEN 'TOO_SHORT' END AS state FROM labels""", BATTERY, LABELS))
def no_data_states(spark, d):
    k = F.col("stock_id")
    return labels(spark, d).select("stock_id", views.no_data_state(F.col("label"), k % 9 == 0, k % 20 == 7).alias("state"))


@query(with_views("bars_long", """SELECT stock_id, point, max(trade_date) AS trade_date, arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, trade_date) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS bars FROM (SELECT *, CASE WHEN n > 100 THEN (rn - 1) * 100 // n ELSE rn - 1 END AS point
  FROM (SELECT *, count(*) OVER (PARTITION BY stock_id) AS n, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date) AS rn FROM bars_long)) GROUP BY 1, 2"""))
def thinned_series(spark, d):
    return views.thinned(T.bars_long(spark, d), 100)
