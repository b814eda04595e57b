"""The domain views as SQL that DuckDB runs, for the side-by-side check."""

VIEWS = {
    "bars_long": """SELECT l_suppkey AS stock_id, CAST(l_shipdate AS DATE) AS trade_date,
  arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume, 'TRY' AS currency, 'licensed' AS source
  FROM lineitem GROUP BY 1, 2""",
    "bars_short": """SELECT user_id AS stock_id, CAST(ts AS DATE) AS trade_date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*) AS volume, 'TRY' AS currency, 'yfinance' AS source FROM events GROUP BY 1, 2""",
    "bars_dirty": """SELECT stock_id, trade_date, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN -open ELSE open END AS open,
  CASE WHEN k % 19 = 0 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN k % 29 = 0 THEN NULL WHEN k % 23 = 0 THEN -volume ELSE volume END AS volume,
  CASE WHEN k % 31 = 0 THEN 'usd' ELSE currency END AS currency, source FROM (SELECT *, stock_id * 7 + dayofyear(trade_date) AS k FROM bars_short)""",
    "actions": """SELECT p_partkey AS seq, p_partkey % (SELECT count(*) FROM supplier) AS stock_id,
  CASE p_size % 5 WHEN 0 THEN 'dividend' WHEN 1 THEN 'split' WHEN 2 THEN 'bonus' WHEN 3 THEN 'rights' ELSE 'other' END AS action_type,
  CAST(DATE '1995-01-02' + CAST(p_partkey % 2400 AS INT) AS DATE) AS effective_date,
  CASE p_size % 5 WHEN 0 THEN '1.5' WHEN 1 THEN '2:1' WHEN 2 THEN '1:1' WHEN 3 THEN '1:4' ELSE '1:2' END AS ratio, 'KAP-' || p_partkey AS kap_notice_no FROM part""",
    "disclosures": """SELECT o_orderkey AS notification_id, o_custkey % (SELECT count(*) FROM supplier) AS stock_id,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'FR' WHEN o_orderpriority LIKE '2%' THEN 'ODA' ELSE 'DG' END AS notification_type,
  CASE WHEN o_orderstatus = 'P' THEN 'REVISED' ELSE 'ORIGINAL' END AS revision_status, CASE WHEN o_orderstatus = 'P' THEN o_orderkey - 1 END AS previous_notification_id,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'body ' || o_orderkey END AS body, CAST(o_orderdate AS DATE) AS published_on FROM orders""",
    "symbols": """SELECT s_suppkey AS stock_id, 'bist' AS platform, 'S' || s_suppkey AS symbol, CASE WHEN s_suppkey % 7 = 0 THEN DATE '1998-01-01' ELSE DATE '1995-01-01' END AS valid_from, CAST(NULL AS DATE) AS valid_to FROM supplier
  UNION ALL SELECT s_suppkey, 'bist', 'OLD' || s_suppkey, DATE '1995-01-01', DATE '1998-01-01' FROM supplier WHERE s_suppkey % 7 = 0""",
    "source_events": "SELECT user_id % 10 AS source_id, ts, event_id, event_type <> 'error' AS ok, value AS response_ms FROM events",
    "news": "SELECT doc_id AS news_id, trim(split_part(split_part(text, chr(10), 1), '.', 1), ' ') AS title, text AS body, source AS source_name, doc_id AS published_min FROM documents",
    "stock_rows": """SELECT c_name AS symbol, c_name AS name, c_mktsegment AS sector, CASE c_custkey % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'PARTIAL_DATA' ELSE 'FAILED' END AS scan_status,
  CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey * 7 % 101 AS DOUBLE) END AS confidence, c_custkey % 2 = 0 AS has_kap,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN '2024-06-28-TARAMA-R2' ELSE '2024-06-28-TARAMA-R10' END AS scan_run_id FROM customer""",
}
NEEDS = {"bars_dirty": ("bars_short",)}


def with_views(names: str, body: str, *more: str) -> str:
    """body behind the CTEs of these views (space-separated) and further CTEs `name AS (...)`."""
    wanted = [v for n in names.split() for v in (*NEEDS.get(n, ()), n)]
    ctes = [f"{n} AS ({VIEWS[n]})" for n in dict.fromkeys(wanted)]
    return f"WITH RECURSIVE {', '.join([*ctes, *more])} {body}"
