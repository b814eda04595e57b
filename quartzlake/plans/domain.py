"""Queries over identity, disclosures, news, confidence, the list interface, runs and the index score."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzlake.functions import fuzzy, text
from quartzlake.operators import api, confidence, dedupe, disclosures, hashtree, identity, index_score, news, runs, storage
from quartzlake.sources import tables as T

from .bars import AS_OF, BATTERY, checked, joined
from .oracle_views import with_views

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- identity -------------------------------------------------------------------------------------------------------
ASKED = """asked AS (SELECT DISTINCT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, l_suppkey * 100000 + datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS query_id FROM lineitem),
q AS (SELECT query_id, CASE WHEN k % 11 = 0 THEN 'NONE' || k WHEN k % 7 = 0 AND query_id % 2 = 0 THEN 'old' || k ELSE 's' || k END AS symbol, d AS asked_on FROM asked)"""


@query(with_views("symbols", """SELECT query_id, min(s.stock_id) AS stock_id, count(DISTINCT s.stock_id) AS n_owners, CASE WHEN count(DISTINCT s.stock_id) = 1 THEN 'MATCHED' ELSE 'UNMATCHED' END AS status
  FROM q LEFT JOIN symbols s ON s.symbol = upper(q.symbol) AND s.valid_from <= asked_on AND (s.valid_to IS NULL OR asked_on < s.valid_to) GROUP BY 1""", ASKED))
def resolve_symbol_asof(spark, d):
    line = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("asked_on")).distinct()
    q = line.withColumn("query_id", F.col("k") * 100000 + F.date_diff("asked_on", F.lit("1990-01-01").cast("date")))
    key = F.col("k").cast("string")
    symbol = F.when(F.col("k") % 11 == 0, F.concat(F.lit("NONE"), key)).when((F.col("k") % 7 == 0) & (F.col("query_id") % 2 == 0), F.concat(F.lit("old"), key)).otherwise(F.concat(F.lit("s"), key))
    asked = q.select("query_id", F.lit("bist").alias("platform"), symbol.alias("symbol"), "asked_on")
    return identity.resolve(asked, T.symbols(spark, d), "asked_on").select("query_id", "stock_id", "n_owners", "status")


@query("""WITH n AS (SELECT s_suppkey AS stock_id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(s_name), '[A-Z0-9]+'))), ' ') AS key FROM supplier)
SELECT stock_id AS query_id, CASE WHEN n = 1 THEN owner END AS stock_id, n AS n_owners FROM n JOIN (SELECT key, count(DISTINCT stock_id) AS n, min(stock_id) AS owner FROM n GROUP BY 1) USING (key)""")
def resolve_company_name(spark, d):
    s = T.table(spark, d, "supplier")
    return identity.resolve_names(s.select(F.col("s_suppkey").alias("query_id"), F.lower("s_name").alias("name")), s.select(F.col("s_suppkey").alias("stock_id"), F.col("s_name").alias("name")))


@query("""WITH RECURSIVE m AS (SELECT s_suppkey AS old, s_suppkey // 2 AS new FROM supplier WHERE s_suppkey % 3 <> 0),
walk AS (SELECT old, new AS final FROM m UNION ALL SELECT w.old, m.new FROM walk w JOIN m ON m.old = w.final)
SELECT old, final FROM walk WHERE final NOT IN (SELECT old FROM m)""")
def merge_closure(spark, d):
    k = F.col("s_suppkey")
    return identity.merge_closure(T.table(spark, d, "supplier").where(k % 3 != 0).select(k.alias("old"), F.floor(k / 2).alias("new"))).drop("cycle")


@query("""WITH RECURSIVE m AS (SELECT c_custkey AS old, CASE WHEN c_custkey % 10 = 3 THEN c_custkey + 2 ELSE c_custkey - 1 END AS new FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey % 100 = 50),
walk AS (SELECT old, new AS here, [old] AS seen FROM m UNION ALL SELECT w.old, m.new, list_append(w.seen, w.here) FROM walk w JOIN m ON m.old = w.here WHERE NOT list_contains(w.seen, w.here))
SELECT old, here AS final, list_contains(seen, here) AS cycle FROM walk WHERE list_contains(seen, here) OR here NOT IN (SELECT old FROM m)""")
def merge_cycles(spark, d):
    """Customers that point to their predecessor, but for one in ten that points forward again: circles of three with tails, beside chains that end."""
    k = F.col("c_custkey")
    rows = T.table(spark, d, "customer").where((k % 10 != 0) | (k % 100 == 50))
    return identity.merge_closure(rows.select(k.alias("old"), F.when(k % 10 == 3, k + 2).otherwise(k - 1).alias("new")))


@query(with_views("bars_long", """SELECT d.trade_date, count(u.symbol) AS members FROM (SELECT DISTINCT trade_date FROM bars_long) d
  LEFT JOIN (SELECT s_suppkey AS symbol, DATE '1995-01-02' + (s_suppkey * 13 % 900)::INT AS entered, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1995-01-02' + (s_suppkey * 13 % 900 + 400)::INT END AS exited FROM supplier) u
  ON u.entered <= d.trade_date AND (u.exited IS NULL OR d.trade_date < u.exited) GROUP BY 1"""))
def universe_membership(spark, d):
    k, day = F.col("s_suppkey"), F.lit("1995-01-02").cast("date")
    u = T.table(spark, d, "supplier").select(k.alias("symbol"), F.date_add(day, (k * 13 % 900).cast("int")).alias("entered"), F.when(k % 4 == 0, F.date_add(day, (k * 13 % 900 + 400).cast("int"))).alias("exited"))
    return identity.members(u, T.bars_long(spark, d).select("trade_date").distinct())


@query("""SELECT 'S' || s_suppkey AS symbol, CASE WHEN s_suppkey % 5 = 0 THEN 'extra' ELSE 'missing' END AS side FROM supplier WHERE (s_suppkey % 5 = 0) <> (s_suppkey % 3 = 0)""")
def universe_difference(spark, d):
    s = T.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return identity.universe_diff(s.where("s_suppkey % 5 = 0"), s.where("s_suppkey % 3 = 0"))


@query("""SELECT stock_id, symbol, valid_from, lead(valid_from) OVER w AS valid_to, lead(valid_from) OVER w IS NULL AS is_active FROM (SELECT o_custkey AS stock_id, 'C' || o_orderkey AS symbol, CAST(o_orderdate AS DATE) AS valid_from FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1) WINDOW w AS (PARTITION BY stock_id ORDER BY valid_from)""")
def symbol_history(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("stock_id"), F.lit("bist").alias("platform"), F.to_date("o_orderdate").alias("changed_on"), "o_orderkey")
    first = o.groupBy("stock_id", "platform", "changed_on").agg(F.concat(F.lit("C"), F.min("o_orderkey").cast("string")).alias("symbol"))
    return identity.scd2(first).drop("platform")


# --- disclosures ----------------------------------------------------------------------------------------------------
@query(with_views("disclosures symbols", """SELECT notification_id, CASE WHEN n = 1 AND owner % 5 <> 0 THEN owner END AS stock_id, CASE WHEN n = 0 THEN 'UNMATCHED' WHEN owner % 5 <> 0 THEN 'MATCHED' ELSE 'OUT_OF_UNIVERSE' END AS status
  FROM (SELECT d.notification_id, count(DISTINCT s.stock_id) AS n, min(s.stock_id) AS owner FROM disclosures d LEFT JOIN (SELECT * FROM symbols WHERE valid_to IS NULL) s
  ON s.symbol = CASE WHEN d.notification_id % 13 = 0 THEN 'X' ELSE 'S' END || d.stock_id GROUP BY 1)"""))
def disclosure_match(spark, d):
    symbol = F.concat(F.when(F.col("notification_id") % 13 == 0, "X").otherwise("S"), F.col("stock_id").cast("string"))
    universe = T.table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("stock_id"))
    return disclosures.match(T.disclosures(spark, d).withColumn("symbol", symbol), T.symbols(spark, d), universe)


@query(with_views("disclosures", """SELECT c.id AS notification_id, c.root, c.n AS version_no, s.later AS superseded_by, c.missing AS missing_target FROM chain c
  LEFT JOIN (SELECT previous_notification_id AS id, min(notification_id) AS later FROM disclosures WHERE previous_notification_id IS NOT NULL GROUP BY 1) s USING (id)""",
  """heads AS (SELECT d.notification_id AS id, d.previous_notification_id IS NOT NULL AS missing FROM disclosures d LEFT JOIN disclosures p ON p.notification_id = d.previous_notification_id WHERE p.notification_id IS NULL)""",
  """chain AS (SELECT id, id AS root, 1 AS n, missing FROM heads UNION ALL SELECT d.notification_id, c.root, c.n + 1, FALSE FROM chain c JOIN disclosures d ON d.previous_notification_id = c.id)"""))
def revision_chain(spark, d):
    return disclosures.chains(T.disclosures(spark, d))


@query(with_views("disclosures", "SELECT stock_id, NOT bool_or(body IS NULL) AS ready, count(*) FILTER (body IS NULL) AS missing_bodies FROM disclosures WHERE notification_type = 'FR' AND published_on >= DATE '1999-01-01' GROUP BY 1"))
def critical_body_block(spark, d):
    return disclosures.readiness(T.disclosures(spark, d).where("notification_type = 'FR' AND published_on >= DATE '1999-01-01'"))


@query(with_views("disclosures", """SELECT d.notification_id, CASE WHEN d.notification_id % 3 = 0 THEN CASE WHEN d.notification_id % 2 = 0 THEN 'detail ' || d.notification_id END ELSE d.body END AS body FROM disclosures d WHERE d.published_on > DATE '1996-01-01'"""))
def disclosure_details(spark, d):
    items = T.disclosures(spark, d).withColumn("published_at", F.col("published_on").cast("timestamp_ntz"))
    fresh = disclosures.since(items, "1996-01-01")
    details = fresh.where("notification_id % 3 = 0").select("notification_id", F.when(F.col("notification_id") % 2 == 0, F.concat(F.lit("detail "), F.col("notification_id").cast("string"))).alias("body"))
    return disclosures.with_details(fresh, details, ["body"]).select("notification_id", "body")


# --- news -----------------------------------------------------------------------------------------------------------
NORM = "trim(regexp_replace(lower(translate(trim({}, ' '), 'İIıŞşÇçĞğÖöÜü', 'iiissccggoouu')), '[^a-z0-9]+', ' ', 'g'), ' ')"
STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(with_views("news", f"""SELECT news_id, norm, len(string_split(norm, ' ')) - (norm = '')::INT AS n_tokens, len(list_distinct(list_filter(string_split(norm, ' '), lambda w: length(w) >= 4 AND NOT list_contains([{STOP}], w)))) AS n_significant
  FROM (SELECT news_id, {NORM.format('title')} AS norm FROM news)"""))
def normalize_text(spark, d):
    n = T.news(spark, d)
    return n.select("news_id", text.normalize(F.col("title")).alias("norm"), F.size(text.tokenize(F.col("title"))).cast("long").alias("n_tokens"), F.size(text.significant(F.col("title"))).cast("long").alias("n_significant"))


def tagged_news(spark, d):
    k, n = F.col("news_id"), T.news(spark, d)
    body = F.when(k % 17 == 0, "THYAO 12,5 %3 4 tl\nGARAN 5,1\n\nASELS 7").otherwise(F.col("body"))
    title = F.when(k % 17 == 0, "Gün Sonu Fiyat").when(k % 19 == 0, F.concat(F.lit("REKLAM: "), "title")).when(k % 23 == 0, F.concat(F.lit("Bir iş birliği "), "title")).otherwise(F.col("title"))
    url = F.when(k % 7 == 0, F.concat(F.lit("http://x/Konu/"), k.cast("string"))).otherwise(F.concat(F.lit("http://x/"), k.cast("string")))
    return n.select("news_id", title.alias("title"), body.alias("body"), "source_name", url.alias("original_url"))


@query(with_views("news", """SELECT news_id, CASE WHEN news_id % 17 = 0 THEN 'AUTO_PRICE_TABLE' WHEN news_id % 19 = 0 THEN 'ADVERTISEMENT' WHEN news_id % 23 = 0 THEN 'SPONSORED' WHEN news_id % 7 = 0 THEN 'FORUM' ELSE 'NEWS' END AS content_type,
  coalesce(nullif(concat_ws(',', CASE WHEN news_id % 17 = 0 THEN 'AUTO_PRICE_TABLE' END, CASE WHEN news_id % 17 <> 0 AND news_id % 19 = 0 THEN 'ADVERTISEMENT' END, CASE WHEN news_id % 17 <> 0 AND news_id % 19 <> 0 AND news_id % 23 = 0 THEN 'SPONSORED' END, CASE WHEN news_id % 7 = 0 THEN 'FORUM' END), ''), 'NEWS') AS tags FROM news"""))
def content_tags(spark, d):
    return news.tag(tagged_news(spark, d)).withColumn("tags", joined("tags"))


ALIASES = f"""aliases AS (SELECT DISTINCT news_id % 40 AS stock_id, CASE news_id % 3 WHEN 0 THEN 'CODE' WHEN 1 THEN 'BRAND' ELSE 'FULL_NAME' END AS method, norm
  FROM (SELECT news_id, {NORM.format("CASE WHEN news_id % 3 = 0 THEN substr(title, 1, 2) ELSE array_to_string(string_split(title, ' ')[1:news_id % 9 + 1], ' ') END")} AS norm FROM news) WHERE norm <> '' AND (news_id % 3 <> 0 OR NOT contains(norm, ' ')))"""


def aliases(spark, d):
    """One alias from the first words of each title: a code of two letters, a brand or a full name of up to nine words."""
    k = F.col("news_id")
    method = F.when(k % 3 == 0, "CODE").when(k % 3 == 1, "BRAND").otherwise("FULL_NAME")
    norm = text.normalize(F.when(k % 3 == 0, F.substring("title", 1, 2)).otherwise(F.array_join(F.slice(F.split("title", " "), F.lit(1), (k % 9 + 1).cast("int")), " ")))
    return T.news(spark, d).select("news_id", (k % 40).alias("stock_id"), method.alias("method"), norm.alias("norm")).where("norm <> '' AND (news_id % 3 <> 0 OR NOT contains(norm, ' '))").drop("news_id").distinct()


CONTEXT = ", ".join(f"'{w}'" for w in news.CONTEXT)


@query(with_views("news", f"""SELECT news_id, stock_id, method, norm AS alias FROM (SELECT news_id, string_split({NORM.format("title || ' ' || body")}, ' ') AS t FROM news) n JOIN aliases a
  ON contains(' ' || array_to_string(t, ' ') || ' ', ' ' || norm || ' ') WHERE method <> 'CODE' OR length(norm) > 2 OR list_has_any(t, [{CONTEXT}])""", ALIASES))
def alias_code_hits(spark, d):
    return news.alias_hits(T.news(spark, d), aliases(spark, d)).drop("context")


@query(with_views("news", f"""SELECT news_id, stock_id, score, score >= 80 AND NOT (score = top AND ties > 1) AS confirmed FROM (SELECT *, count(*) FILTER (score = top) OVER (PARTITION BY news_id) AS ties FROM (SELECT *, max(score) OVER (PARTITION BY news_id) AS top FROM (
  SELECT news_id, stock_id, least(95, max(base) + CASE WHEN count(DISTINCT method) >= 2 THEN 10 ELSE 0 END + CASE WHEN bool_and(method = 'BRAND') AND bool_or(context) THEN 10 ELSE 0 END) AS score FROM (
  SELECT news_id, stock_id, method, CASE method WHEN 'CODE' THEN 70 WHEN 'BRAND' THEN 75 ELSE 95 END AS base, list_has_any(t, [{CONTEXT}]) AS context
  FROM (SELECT news_id, string_split({NORM.format("title || ' ' || body")}, ' ') AS t FROM news) n JOIN aliases a ON contains(' ' || array_to_string(t, ' ') || ' ', ' ' || norm || ' ') WHERE method <> 'CODE' OR length(norm) > 2 OR list_has_any(t, [{CONTEXT}])) GROUP BY 1, 2)))""", ALIASES))
def match_scores(spark, d):
    return news.combine(news.alias_hits(T.news(spark, d), aliases(spark, d), named=False)).drop("method")


@query(with_views("news", "SELECT norm, count(DISTINCT stock_id) AS n_owners FROM aliases GROUP BY 1 HAVING count(DISTINCT stock_id) > 1", ALIASES))
def ambiguous_aliases(spark, d):
    return news.ambiguous_aliases(aliases(spark, d))


def agency_sources(n):
    """News whose sources are an agency's for every fifth row."""
    k = F.col("news_id")
    return n.withColumn("source_name", F.when(k % 15 == 0, "Anadolu Ajansı").when(k % 15 == 5, "Haber REUTERS servisi").when(k % 15 == 10, "Jones & Dow").otherwise(F.concat(F.lit("site "), F.col("source_name"))))


@query(with_views("news", """SELECT md5(body) AS digest, arg_min(news_id, ((news_id % 5 <> 0)::INT, published_min, -length(body), news_id)) AS canonical_id, count(*) AS n FROM news GROUP BY 1"""))
def exact_text_groups(spark, d):
    return news.canonical(agency_sources(T.news(spark, d)).withColumn("digest", F.md5("body")), "digest")


@query("""SELECT url, min(page_id) AS canonical_id, count(*) AS n FROM (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS url FROM pages) GROUP BY 1""")
def duplicate_urls(spark, d):
    pages = T.table(spark, d, "pages").select("page_id", F.lower(F.regexp_replace("url", r"[?#].*$", "")).alias("url"))
    return pages.groupBy("url").agg(F.min("page_id").alias("canonical_id"), F.count(F.lit(1)).alias("n"))


def deduped(n):
    """News with URLs, minutes, agencies and content types for the de-duplication."""
    k = F.col("news_id")
    url = F.when(k % 6 == 1, F.concat(F.lit("http://x/"), F.floor(k / 18).cast("string"))).when(k % 6 == 2, "")
    return agency_sources(n).select("news_id", "title", "body", "source_name", url.alias("url"), F.when(k % 10 != 3, k * 7 % 4000).alias("at"), F.when(k % 97 == 0, "AUTO_PRICE_TABLE").otherwise("NEWS").alias("content_type"))


def confirmed_stocks(n):
    return n.where("news_id % 4 <> 0").select("news_id", (F.col("news_id") % 3).alias("stock_id"))


@query()
def near_duplicate_news(spark, d):
    n = T.news(spark, d)
    return dedupe.dedupe(deduped(n), confirmed_stocks(n)).withColumn("reasons", joined("reasons"))


DEDUPED = f"""e AS (SELECT news_id, CASE WHEN news_id % 6 = 1 THEN 'http://x/' || news_id // 18 END AS url, CASE WHEN news_id % 10 <> 3 THEN news_id * 7 % 4000 END AS mins, news_id % 5 = 0 AS agency, {NORM.format("title")} AS title, {NORM.format("body")} AS nbody, body,
    CASE WHEN news_id % 4 <> 0 THEN news_id % 3 END AS stock FROM news WHERE news_id % 97 <> 0),
keyed AS (SELECT *, list_distinct(list_filter(string_split(title, ' '), lambda w: length(w) >= 4 AND NOT list_contains([{STOP}], w))) AS keys FROM e),
pairs AS (SELECT a.news_id AS a, b.news_id AS b, a.url = b.url AS u, a.title = b.title AND a.title <> '' AND a.nbody = b.nbody AND a.nbody <> '' AS t, a.title = b.title AND a.title <> '' AND abs(a.mins - b.mins) <= 30 AS m,
    a.stock = b.stock AND abs(a.mins - b.mins) <= 360 AND len(list_intersect(a.keys, b.keys)) >= 2 AS s FROM keyed a JOIN keyed b ON a.news_id < b.news_id AND (a.url = b.url OR a.title = b.title OR a.stock = b.stock)),
edges AS (SELECT * FROM pairs WHERE u OR t OR m OR s), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk AS (SELECT news_id AS node, news_id AS root FROM e UNION SELECT x.b, w.root FROM walk w JOIN both_ways x ON x.a = w.node AND x.b > w.root),
label AS (SELECT node, min(root) AS root FROM walk GROUP BY 1),
grp AS (SELECT root, arg_min(news_id, ((NOT agency)::INT, (mins IS NULL)::INT, coalesce(mins, 0), -length(body), news_id)) AS canonical_id, arg_min(agency, ((NOT agency)::INT, (mins IS NULL)::INT, coalesce(mins, 0), -length(body), news_id)) AS lead, count(*) AS n, bool_or(agency) AND bool_or(NOT agency) AS mixed FROM e JOIN label ON node = news_id GROUP BY 1),
why AS (SELECT root, bool_or(u) AS u, bool_or(t) AS t, bool_or(m) AS m, bool_or(s) AS s FROM edges JOIN label ON node = a GROUP BY 1),
told AS (SELECT news_id, canonical_id, n AS group_size, CASE WHEN n > 1 THEN concat_ws(',', CASE WHEN u THEN 'DUPLICATE_SAME_URL' END, CASE WHEN t THEN 'DUPLICATE_TEXT' END, CASE WHEN m THEN 'DUPLICATE_EVENT_TIME' END, CASE WHEN s THEN 'DUPLICATE_SAME_EVENT' END, CASE WHEN mixed THEN 'AGENCY_COPY' END) ELSE '' END AS reasons,
    NOT (n > 1 AND mixed AND lead AND NOT agency) AS credit FROM e JOIN label ON node = news_id JOIN grp USING (root) LEFT JOIN why USING (root)
    UNION ALL SELECT news_id, news_id, 1, '', TRUE FROM news WHERE news_id % 97 = 0)"""


@query(with_views("news", "SELECT * FROM told", DEDUPED))
def news_groups(spark, d):
    """Groups over URLs, equal texts, times and events: all reasons but the fuzzy ratios, so that SQL can say it too."""
    n = T.news(spark, d)
    return dedupe.dedupe(deduped(n), confirmed_stocks(n), alike=False).withColumn("reasons", joined("reasons"))


@query(with_views("news", """SELECT canonical_id, news_id % 3 AS stock_id, max((news_id % 50, news_id % 4 <> 0))[1] AS score, max((news_id % 50, news_id % 4 <> 0))[2] AS confirmed FROM told JOIN news USING (news_id) GROUP BY 1, 2""", DEDUPED))
def matches_of_canonical(spark, d):
    n, k = T.news(spark, d), F.col("news_id")
    grouped = dedupe.dedupe(deduped(n), confirmed_stocks(n), alike=False)
    return dedupe.merge_matches(grouped, n.select("news_id", (k % 3).alias("stock_id"), (k % 50).alias("score"), (k % 4 != 0).alias("confirmed")))


@query(with_views("news", """SELECT greatest(a.news_id, b.news_id) AS hi, least(a.news_id, b.news_id) AS lo FROM news a JOIN news b ON b.news_id = a.news_id + 3 OR b.news_id = a.news_id + 4 WHERE a.news_id % 4 <> 0 AND b.news_id % 4 <> 0 AND a.news_id % 3 = b.news_id % 3"""))
def pairs_with_shared_stock(spark, d):
    n, k = T.news(spark, d).select("news_id"), F.col("news_id")
    there = n.select(k.alias("hi"))
    pairs = n.select(k.alias("lo"), F.explode(F.array(k + 3, k + 4)).alias("hi")).join(there, "hi", "left_semi")
    return dedupe.shared_stocks(pairs, confirmed_stocks(T.news(spark, d)))


@query()
def fuzzy_best_name(spark, d):
    """Every news title against the names of parts, by their best ratio."""
    names = T.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("name_id"))
    return news.best_names(T.news(spark, d).select("news_id", "title"), names.select("name_id", "name"))


@query()
def partial_name_ratio(spark, d):
    """The best aligned ratio of each part's name with its brand and type."""
    p = T.table(spark, d, "part")
    return p.select("p_partkey", fuzzy.column(fuzzy.partial_ratio)(text.normalize(F.col("p_name")), text.normalize(F.concat_ws(" ", "p_brand", "p_type"))).alias("partial"), fuzzy.column(fuzzy.ratio)(text.normalize(F.col("p_name")), text.normalize(F.col("p_type"))).alias("plain"))


# --- confidence -----------------------------------------------------------------------------------------------------
def component_inputs(spark, d):
    k, pick = F.col("c_custkey"), lambda m, *v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("c_custkey") % m).cast("int"))
    return T.table(spark, d, "customer").select(
        k.alias("stock_id"), F.when(k % 17 != 0, F.col("c_acctbal")).alias("last_price"), pick(5, "VALIDATED", "PENDING", "MISMATCH", None, "odd").alias("source_validation"),
        F.when(k % 13 != 0, k % 6).alias("volume"), pick(6, "SUFFICIENT_DATA", "LIMITED_DATA", "NEW_LISTING", "INSUFFICIENT_FOR_TECHNICAL", "PRICE_DATA_MISSING", None).alias("sufficiency_label"),
        pick(4, "OK", "PENDING", "ERROR", None).alias("kap_status"), (k % 7 != 0).alias("kap_required"), pick(3, "DONE", "PARTIAL", "COMPLETED").alias("news_status"), pick(2, "OK", "odd").alias("corporate_status"),
        pick(8, "OK", "OK", "OK", "OK", "PENDING", "FAILED", None, "OK").alias("restriction_status"), (k % 9 == 0).alias("trading_halt_active"), pick(4, "VERIFIED", "VERIFIED", "SYMBOL_VERIFICATION_PENDING", "OTHER").alias("verification_status"),
        F.when(k % 19 != 0, F.date_sub(F.lit(AS_OF).cast("date"), (k % 8).cast("int"))).alias("last_data_date"), (k % 5).cast("int").alias("anomaly_count"),
        F.when(k % 23 == 0, F.lit(None)).when(k % 11 == 0, F.array(F.lit("close"))).otherwise(F.array().cast("array<string>")).alias("critical_missing"),
        *[(k % m != 0).alias(c) for m, c in zip((29, 31, 37, 41, 43, 4, 5, 6, 7, 8, 9), confidence.CONDITIONS.values(), strict=True)],
    )


INPUTS = f"""inputs AS (SELECT c_custkey AS k, c_acctbal AS price FROM customer),
parts AS (SELECT k, [CASE WHEN k % 17 = 0 THEN 'MISSING' WHEN price <= 0 THEN 'FAILED' ELSE 'OK' END, ['OK','UNVERIFIED','FAILED','MISSING','UNVERIFIED'][k % 5 + 1], CASE WHEN k % 13 = 0 THEN 'MISSING' WHEN k % 6 = 0 THEN 'UNVERIFIED' ELSE 'OK' END,
  ['OK','UNVERIFIED','UNVERIFIED','FAILED','MISSING','MISSING'][k % 6 + 1], CASE WHEN k % 7 = 0 THEN 'NOT_APPLICABLE' ELSE ['OK','UNVERIFIED','FAILED','MISSING'][k % 4 + 1] END, ['OK','UNVERIFIED','OK'][k % 3 + 1], ['OK','UNVERIFIED'][k % 2 + 1],
  CASE k % 8 WHEN 4 THEN 'UNVERIFIED' WHEN 5 THEN 'FAILED' WHEN 6 THEN 'MISSING' ELSE CASE WHEN k % 9 = 0 THEN 'FAILED' ELSE 'OK' END END, ['OK','OK','UNVERIFIED','FAILED'][k % 4 + 1], CASE WHEN k % 19 = 0 THEN 'MISSING' WHEN k % 8 > 5 THEN 'STALE' ELSE 'OK' END,
  CASE WHEN k % 5 >= 3 THEN 'FAILED' ELSE 'OK' END, CASE WHEN k % 23 = 0 THEN 'MISSING' WHEN k % 11 = 0 THEN 'FAILED' ELSE 'OK' END] AS s FROM inputs),
scored AS (SELECT k, s, [15,10,10,8,8,6,7,7,8,8,8,5] AS w FROM parts),
rated AS (SELECT k, s, list_sum(list_transform(range(1, 13), lambda i: CASE WHEN s[i] = 'NOT_APPLICABLE' THEN 0 ELSE w[i] END)) AS total,
  list_sum(list_transform(range(1, 13), lambda i: CASE s[i] WHEN 'OK' THEN w[i] WHEN 'UNVERIFIED' THEN w[i] * 0.5 WHEN 'STALE' THEN w[i] * 0.5 ELSE 0 END)) AS earned FROM scored),
capped AS (SELECT k, s, CASE WHEN s[12] = 'FAILED' THEN least(60, c) ELSE c END::INT AS data_confidence FROM (SELECT k, s, CASE WHEN list_contains(s, 'MISSING') THEN least(99, r) ELSE r END AS c FROM (SELECT k, s, round_even(earned::DOUBLE / total::DOUBLE * 100, 0) AS r FROM rated)))"""
NAMES = "[" + ", ".join(f"'{n}'" for n in confidence.WEIGHTS) + "]"


@query(f"WITH {INPUTS} SELECT k AS stock_id, array_to_string(s, ',') AS statuses FROM parts")
def confidence_components(spark, d):
    rows = confidence.evaluate(component_inputs(spark, d), AS_OF)
    return rows.select("stock_id", F.array_join(F.transform("components", lambda x: x["status"]), ",").alias("statuses"))


@query(f"""WITH {INPUTS} SELECT k AS stock_id, data_confidence, array_to_string(list_filter({NAMES}, lambda n, i: s[i] = 'MISSING'), ',') AS missing_fields, array_to_string(list_filter({NAMES}, lambda n, i: s[i] = 'STALE'), ',') AS stale_components,
  concat_ws(',', CASE WHEN s[12] = 'FAILED' THEN 'CRITICAL_DATA' END, CASE WHEN list_contains(s, 'STALE') THEN 'STALE_DATA' END, CASE WHEN k % 6 = 2 THEN 'NEW_LISTING' END, CASE WHEN k % 9 = 0 THEN 'TRADING_HALT' END) AS warnings FROM capped""")
def confidence_score(spark, d):
    v = confidence.verdict(component_inputs(spark, d), AS_OF)
    return v.select("stock_id", "data_confidence", joined("missing_fields").alias("missing_fields"), joined("stale_components").alias("stale_components"), joined("warnings").alias("warnings"))


FLAGS = """flags AS (SELECT k, s, k % 29 <> 0 AND k % 31 <> 0 AND k % 37 <> 0 AND k % 41 <> 0 AND k % 43 <> 0 AND k % 4 <> 0 AND k % 5 <> 0 AND k % 6 <> 0 AND k % 7 <> 0 AND k % 8 <> 0 AND k % 9 <> 0 AS technical FROM parts),
ready AS (SELECT k, s, technical, technical AND k % 9 <> 0 AND (k % 11 <> 0 OR k % 23 = 0) AND s[12] <> 'FAILED' AND s[8] <> 'FAILED' AS scoring, technical AND k % 9 <> 0 AND (k % 11 <> 0 OR k % 23 = 0) AND NOT list_contains(s, 'STALE') AND k % 6 <> 2 AND s[12] <> 'FAILED' AS favorite FROM flags)"""


@query(f"WITH {INPUTS}, {FLAGS} SELECT k AS stock_id, technical AS technical_ready, scoring AS scoring_ready, favorite AS favorite_eligible FROM ready")
def readiness_flags(spark, d):
    return confidence.verdict(component_inputs(spark, d), AS_OF).select("stock_id", "technical_ready", "scoring_ready", "favorite_eligible")


def _scan(spark, d):
    """Every stock of the universe with its last clean bar, checks and restrictions as of the day."""
    bars = checked(spark, d).where("status = 'CLEAN'")
    last = bars.groupBy("stock_id").agg(F.max("trade_date").alias("last_data_date"), F.max_by("close", "trade_date").alias("last_price"), F.max_by("volume", "trade_date").alias("volume"), F.count(F.lit(1)).alias("n_bars"))
    universe = T.table(spark, d, "customer").select(F.col("c_custkey").alias("stock_id"), F.col("c_name").alias("symbol"))
    k, n = F.col("stock_id"), F.coalesce("n_bars", F.lit(0))
    rows = universe.join(last, "stock_id", "left").select(
        "stock_id", "symbol", "last_data_date", "last_price", "volume", F.when(n == 0, "PRICE_DATA_MISSING").when(n >= 12, "LIMITED_DATA").otherwise("INSUFFICIENT_FOR_TECHNICAL").alias("sufficiency_label"),
        F.when(n > 0, "VALIDATED").alias("source_validation"), F.lit("OK").alias("kap_status"), F.lit(True).alias("kap_required"), F.when(k % 3 == 0, "PENDING").otherwise("OK").alias("news_status"), F.lit("OK").alias("corporate_status"),
        F.lit("OK").alias("restriction_status"), (k % 20 == 7).alias("trading_halt_active"), F.lit("VERIFIED").alias("verification_status"), F.lit(0).alias("anomaly_count"), F.array().cast("array<string>").alias("critical_missing"),
        F.lit(True).alias("symbol_verified"), F.lit(True).alias("xk100_member"), F.col("last_price").isNotNull().alias("has_valid_price"), F.col("volume").isNotNull().alias("has_valid_volume"), F.col("last_data_date").isNotNull().alias("has_last_trade_date"),
        F.lit(True).alias("kap_check_ok"), (k % 3 != 0).alias("news_check_ok"), F.lit(True).alias("corporate_check_ok"), F.lit(True).alias("restriction_check_ok"), (n > 0).alias("source_validation_ok"), F.lit(True).alias("sufficiency_label_present"),
    )
    return confidence.scan_state(confidence.verdict(rows, AS_OF))


SCAN = f"""last AS (SELECT stock_id, max(trade_date) AS d, arg_max(close, trade_date) AS price, arg_max(volume, trade_date) AS vol, count(*) AS n FROM checked WHERE status = 'CLEAN' GROUP BY 1),
base AS (SELECT c_custkey AS k, c_name AS symbol, d, price, vol, coalesce(n, 0) AS n FROM customer LEFT JOIN last ON stock_id = c_custkey),
part1 AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE 10 END + CASE WHEN price IS NULL THEN 0 ELSE 15 END + CASE WHEN vol IS NULL THEN 0 WHEN vol = 0 THEN 5 ELSE 10 END + CASE WHEN n >= 12 THEN 4 ELSE 0 END + 8 + CASE WHEN k % 3 = 0 THEN 3 ELSE 6 END + 7
  + CASE WHEN k % 20 = 7 THEN 0 ELSE 7 END + 8 + CASE WHEN d IS NULL THEN 0 WHEN DATE '{AS_OF}' - d > 5 THEN 4 ELSE 8 END + 8 + 5 AS earned FROM base),
scan AS (SELECT symbol, CASE WHEN n = 0 THEN 'price_availability,price_source_validation,volume_availability,history_sufficiency,data_freshness' ELSE '' END AS missing_fields,
  CASE WHEN k % 20 = 7 THEN 'INACTIVE' WHEN price IS NULL THEN 'FAILED' ELSE 'READY' END AS state, CASE WHEN n = 0 THEN least(99, earned) ELSE earned END::INT AS data_confidence FROM part1)"""


@query(with_views("bars_dirty", "SELECT * FROM scan", BATTERY, SCAN))
def full_day_scan(spark, d):
    return _scan(spark, d).select("symbol", joined("missing_fields").alias("missing_fields"), "state", "data_confidence")


@query(with_views("bars_dirty", """SELECT count(*) AS n_stocks, count(*) FILTER (state = 'READY') AS n_ready, count(*) FILTER (state = 'PARTIAL_DATA') AS n_partial, count(*) FILTER (state = 'FAILED') AS n_failed, count(*) FILTER (state = 'INACTIVE') AS n_inactive,
  round_even(avg(data_confidence), 4) AS avg_confidence, CASE WHEN count(*) = 0 THEN 'NOT_RUN' WHEN bool_and(state = 'FAILED') THEN 'FAILED' WHEN bool_and(state = 'READY') THEN 'OK' ELSE 'PARTIAL' END AS status FROM scan""", BATTERY, SCAN))
def scan_summary(spark, d):
    return confidence.summary(_scan(spark, d))


# --- list interface -------------------------------------------------------------------------------------------------
ALIGNED = "aligned AS (SELECT * FROM stock_rows WHERE scan_run_id IS NULL OR scan_run_id = (SELECT max(scan_run_id) FROM stock_rows))"


@query(with_views("stock_rows", "SELECT symbol, sector, confidence, row_number() OVER (ORDER BY confidence IS NULL, confidence DESC, CASE WHEN confidence IS NOT NULL THEN symbol END DESC, symbol) AS position FROM aligned WHERE lower(sector) = 'building' AND has_kap QUALIFY position BETWEEN 11 AND 20", ALIGNED))
def list_stocks_page(spark, d):
    p = api.FilterParams(sector="BUILDING", has_kap=True, sort="confidence", direction="desc", page=2, page_size=10)
    return api.positions(T.stock_rows(spark, d), p).select("symbol", "sector", "confidence", "position")


@query(with_views("stock_rows", "SELECT count(*) AS total, ceil(count(*) / 50.0)::BIGINT AS total_pages FROM aligned WHERE contains(lower(symbol), '7') AND confidence >= 40 AND scan_status = 'READY'", ALIGNED))
def list_stocks_meta(spark, d):
    return api.list_page(T.stock_rows(spark, d), api.FilterParams(search="7", minimum_confidence=40, scan_status="ready"))[1]


@query(with_views("stock_rows", "SELECT symbol, sector, confidence FROM stock_rows"))
def publishable_columns(spark, d):
    rows = T.stock_rows(spark, d).select("symbol", "sector", "confidence", F.lit("x").alias("internal_notes"), F.struct(F.lit(1).alias("debug")).alias("admin_info"))
    return api.publishable(rows)


@query(r"""SELECT event_id, regexp_replace(CASE event_id % 5 WHEN 0 THEN 'token=***' WHEN 1 THEN 'token ***' WHEN 2 THEN 'passwd : ***' WHEN 3 THEN 'X-Admin-Token' || chr(9) || '***' ELSE 'the api-key *** not ' || user_id END || ' Bearer ' || event_type || ' at /tmp/../x', 'Bearer \S+', 'Bearer ***') AS masked FROM events""")
def masked_secrets(spark, d):
    k, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    named = F.when(k == 0, F.lit("token=")).when(k == 1, "token ").when(k == 2, "passwd : ").when(k == 3, "X-Admin-Token\t").otherwise("the api-key is not ")
    raw = F.concat(named, user, F.lit(" Bearer "), F.col("event_type"), F.lit(" at /tmp/../x"))
    return T.table(spark, d, "events").select("event_id", text.mask_secrets(raw).alias("masked"))


# --- runs and operations --------------------------------------------------------------------------------------------
@query(with_views("source_events", """SELECT source_id, ts AS alert_at, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, island ORDER BY ts, event_id) AS streak FROM (SELECT *, sum(ok::INT) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS island FROM source_events) WHERE NOT ok) WHERE streak = 3"""))
def source_error_alerts(spark, d):
    return runs.source_alerts(T.source_events(spark, d))


@query("""SELECT o_orderkey AS seq, strftime(run_date, '%Y-%m-%d') || '-TARAMA-R' || rn AS run_id, CASE WHEN rn > 1 THEN strftime(run_date, '%Y-%m-%d') || '-TARAMA-R' || (rn - 1) END AS parent FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS run_date, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn FROM orders)""")
def run_revisions(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("run_date"))
    return runs.run_revisions(o).select("seq", "run_id", "parent")


STATES = ["WAITING", *runs.COLLECTING, "VALIDATING", "READY", "PARTIAL_DATA", "FAILED", "INACTIVE"]
LEGAL = " OR ".join(f"(old = '{old}' AND new IN ({', '.join(repr(n) for n in allowed)}))" for old, allowed in runs.FOLLOWING.items())


@query(f"""SELECT stock_id, seq, old, new FROM (SELECT user_id AS stock_id, event_id AS seq, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS old, state AS new, event_id % 2 = 0 AS said FROM (SELECT user_id, event_id, {STATES}[event_id * 7 % 11 + 1] AS state FROM events))
  WHERE old IS NOT NULL AND NOT ({LEGAL} OR (old = 'FAILED' AND new = 'WAITING' AND said))""")
def fsm_violations(spark, d):
    k = F.col("event_id")
    e = T.table(spark, d, "events").select(F.col("user_id").alias("stock_id"), k.alias("seq"), F.get(F.array(*map(F.lit, STATES)), (k * 7 % 11).cast("int")).alias("state"), F.when(k % 2 == 0, runs.RESCAN).alias("reason"))
    return runs.illegal_transitions(e)


@query("""SELECT event_id, CASE WHEN s = 28800 THEN 'PRECHECK' WHEN s = 34800 THEN 'DATA_CUTOFF' WHEN s BETWEEN 28800 AND 31499 THEN 'COLLECTION' WHEN s BETWEEN 31500 AND 32399 THEN 'CLEANING' WHEN s BETWEEN 32400 AND 34199 THEN 'RECOVERY'
  WHEN s BETWEEN 34200 AND 34499 THEN 'PACKAGING' WHEN s BETWEEN 34500 AND 34799 THEN 'ANOMALY_CHECK' WHEN s BETWEEN 34800 AND 35099 THEN 'CRITICAL_RESCAN' END AS phase FROM (SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 10800) % 86400 AS s FROM events)""")
def phase_of_time(spark, d):
    return T.table(spark, d, "events").select("event_id", runs.phase(F.col("ts").cast("timestamp")).alias("phase"))


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'raw_html' WHEN p_partkey % 3 = 1 THEN 'raw_json' ELSE 'daily' END AS kind, count(*) FILTER (p_partkey % 3 <> 2 AND p_size > 14) AS deleted, count(*) FILTER (NOT (p_partkey % 3 <> 2 AND p_size > 14)) AS kept FROM part GROUP BY 1""")
def retention_candidates(spark, d):
    k = F.col("p_partkey") % 3
    files = T.table(spark, d, "part").select(F.when(k == 0, "raw_html").when(k == 1, "raw_json").otherwise("daily").alias("kind"), F.date_sub(F.lit("2024-06-28").cast("date"), "p_size").alias("written_on"))
    return runs.retention(files, "2024-06-28")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in T.TABLES))
def table_manifest(spark, d):
    return storage.manifest({t: T.table(spark, d, t) for t in T.TABLES}).drop("checksum")


@query("SELECT 'part_keys' AS table_name, count(*) AS row_count, CAST(bit_xor((p_partkey * 2654435761 % 4294967296) * 31 + p_size) AS BIGINT) AS checksum FROM part")
def table_checksum(spark, d):
    """The manifest's checksum with a row hash that SQL has too."""
    row = (F.col("p_partkey") * 2654435761 % 4294967296) * 31 + F.col("p_size")
    return storage.manifest({"part_keys": T.table(spark, d, "part")}, lambda df: row)


ORDER_DIGEST = "sha256(concat_ws('|', o_orderkey, o_custkey, coalesce(o_orderstatus, ''), CAST(round(o_totalprice * 100) AS BIGINT), strftime(o_orderdate, '%Y-%m-%d'), coalesce(o_orderpriority, '')))"
HASH_LEAVES = "SELECT CAST(o_orderkey // 500 AS BIGINT) AS node, count(*) AS n, sha256(string_agg(digest, '' ORDER BY o_orderkey, digest)) AS digest"


def _digested_orders(spark, d):
    """Orders with the digest of each row: the values of all columns."""
    cents, day = F.round(F.col("o_totalprice") * 100).cast("long"), F.to_date("o_orderdate")
    digest = hashtree.row_digest(*map(F.col, ("o_orderkey", "o_custkey", "o_orderstatus")), cents, day, F.col("o_orderpriority"))
    return T.table(spark, d, "orders"), digest


@query(with_views("", """SELECT level, node, n, digest FROM nodes UNION ALL SELECT max(level) + 1, 0, CAST(sum(n) AS BIGINT), sha256(string_agg(digest, '' ORDER BY node)) FROM nodes WHERE level = (SELECT max(level) FROM nodes)""",
  f"leaves AS ({HASH_LEAVES} FROM (SELECT *, {ORDER_DIGEST} AS digest FROM orders) GROUP BY 1)",
  """nodes AS (SELECT 0 AS level, node, n, digest FROM leaves UNION ALL SELECT level + 1, up, CAST(sum(n) AS BIGINT), sha256(string_agg(digest, '' ORDER BY node)) FROM (SELECT *, CAST(node // 8 AS BIGINT) AS up, count(*) OVER () AS width FROM nodes) WHERE width > 8 GROUP BY level, up)"""))
def order_hash_tree(spark, d):
    """The hash tree of the orders by ranges of 500 keys, eight nodes below each node."""
    rows, digest = _digested_orders(spark, d)
    return hashtree.tree(rows, "o_orderkey", digest, 500, 8)


@query(with_views("", "SELECT coalesce(a.node, b.node) AS node, coalesce(a.n, 0) AS source_rows, coalesce(b.n, 0) AS target_rows FROM a FULL JOIN b ON a.node = b.node WHERE a.digest IS DISTINCT FROM b.digest",
  f"a AS ({HASH_LEAVES} FROM (SELECT *, {ORDER_DIGEST} AS digest FROM orders) GROUP BY 1)",
  f"b AS ({HASH_LEAVES} FROM (SELECT *, {ORDER_DIGEST} AS digest FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 4999 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey % 3989 <> 5)) GROUP BY 1)"))
def damaged_ranges(spark, d):
    """Ranges of keys in which a copy of the orders lost or changed a row."""
    rows, digest = _digested_orders(spark, d)
    k = F.col("o_orderkey")
    copy = rows.where(k % 3989 != 5).withColumn("o_orderstatus", F.when(k % 4999 == 7, "X").otherwise(F.col("o_orderstatus")))
    return hashtree.differing(*(hashtree.leaves(t, "o_orderkey", digest, 500) for t in (rows, copy)))


@query("""SELECT source_id, event_id, count(*) OVER (PARTITION BY source_id ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT user_id % 10 AS source_id, event_id, epoch(ts)::BIGINT - (CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END) AS second FROM events)""")
def calls_in_window(spark, d):
    calls = T.source_events(spark, d).select("source_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return runs.calls_in_window(calls).select("source_id", "event_id", "recent")


LIMITED = """calls AS (SELECT user_id % 10 AS source_id, event_id AS call_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS i FROM events),
bucket AS (SELECT source_id, call_id, moment, i, [moment] AS times, FALSE AS waited, 0::BIGINT AS wait, 0::BIGINT AS total FROM calls WHERE i = 1
  UNION ALL SELECT source_id, call_id, moment, i, CASE WHEN len(held) < 2 THEN list_append(held, moment) ELSE list_append(held[2:], held[1] + 3600000000) END, len(held) >= 2,
    CASE WHEN len(held) >= 2 THEN greatest(0, held[1] + 3600000000 - moment) ELSE 0 END, total + CASE WHEN len(held) >= 2 THEN greatest(0, held[1] + 3600000000 - moment) ELSE 0 END
  FROM (SELECT c.source_id, c.call_id, c.moment, c.i, b.total, list_filter(b.times, lambda x: x > c.moment - 3600000000) AS held FROM bucket b JOIN calls c ON c.source_id = b.source_id AND c.i = b.i + 1))"""


@query(f"WITH RECURSIVE {LIMITED} SELECT source_id, call_id, waited, wait, total FROM bucket")
def limited_calls(spark, d):
    """The calls of each source against a limit of two an hour: who waits, how long, and how long all of them waited so far."""
    calls = T.source_events(spark, d).select("source_id", F.col("event_id").alias("call_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return runs.limited(calls, 2, 3_600_000_000).drop("at")


# --- index score (from its written rules) ---------------------------------------------------------------------------
EMA = """n AS (SELECT stock_id, trade_date, close, row_number() OVER (PARTITION BY stock_id ORDER BY trade_date) AS i FROM bars_long),
e AS (SELECT stock_id, trade_date, close, i, close AS e5, close AS e20, close AS e50 FROM n WHERE i = 1 UNION ALL SELECT n.stock_id, n.trade_date, n.close, n.i, e.e5 + (n.close - e.e5) * (2.0::DOUBLE / 6), e.e20 + (n.close - e.e20) * (2.0::DOUBLE / 21), e.e50 + (n.close - e.e50) * (2.0::DOUBLE / 51)
  FROM e JOIN n ON n.stock_id = e.stock_id AND n.i = e.i + 1)"""


@query(with_views("bars_long", """SELECT stock_id, trade_date, CASE WHEN i >= 100 THEN (CASE WHEN close > e20 THEN 30 ELSE 0 END) + (CASE WHEN e5 > e20 THEN 20 ELSE 0 END) + (CASE WHEN e20 > e50 THEN 25 ELSE 0 END) + (CASE WHEN e20 > back THEN 15 ELSE 0 END) + (CASE WHEN close > mid THEN 10 ELSE 0 END) END AS trend
  FROM (SELECT *, lag(e20, 5) OVER w AS back, (max(close) OVER f + min(close) OVER f) / 2 AS mid FROM e WINDOW w AS (PARTITION BY stock_id ORDER BY trade_date), f AS (PARTITION BY stock_id ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""", EMA))
def trend_score(spark, d):
    return index_score.trend(index_score.ema(T.bars_long(spark, d))).select("stock_id", "trade_date", "trend")


@query(with_views("bars_long", """SELECT trade_date, round_even(avg((close > before)::INT), 9) AS advancers, round_even(avg((close >= before)::INT), 9) AS non_decliners, count(*) AS n FROM (SELECT trade_date, close, lag(close) OVER (PARTITION BY stock_id ORDER BY trade_date) AS before FROM bars_long) WHERE before IS NOT NULL GROUP BY 1"""))
def breadth(spark, d):
    b = index_score.breadth(T.bars_long(spark, d))
    return b.select("trade_date", F.bround("advancers", 9).alias("advancers"), F.bround("non_decliners", 9).alias("non_decliners"), "n")


@query(with_views("bars_long", "SELECT stock_id, trade_date, CASE WHEN high = low THEN 50 ELSE round_even((close - low) / (high - low) * 100, 6) END::DOUBLE AS quality, high = low AS flat FROM bars_long"))
def close_quality(spark, d):
    return index_score.close_quality(T.bars_long(spark, d)).withColumn("quality", F.bround("quality", 6))


@query(with_views("bars_long", """SELECT stock_id, trade_date, round_even(len(list_filter(held, lambda x: x <= r)) / len(held)::DOUBLE, 9) AS r5_pct FROM (SELECT stock_id, trade_date, r, list(r) FILTER (r IS NOT NULL) OVER (PARTITION BY stock_id ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS held
  FROM (SELECT stock_id, trade_date, close / lag(close, 5) OVER (PARTITION BY stock_id ORDER BY trade_date) - 1 AS r FROM bars_long)) WHERE r IS NOT NULL"""))
def momentum_percentile(spark, d):
    rows = index_score.percentile(index_score.returns(T.bars_long(spark, d)), "r5")
    return rows.where("r5 IS NOT NULL").select("stock_id", "trade_date", F.bround("r5_pct", 9).alias("r5_pct"))


@query(with_views("bars_long", """SELECT o.stock_id, o.trade_date, round_even(o.r - i.r, 9) AS rs5 FROM (SELECT stock_id, trade_date, close / lag(close, 5) OVER (PARTITION BY stock_id ORDER BY trade_date) - 1 AS r FROM bars_long) o
  JOIN (SELECT trade_date, close / lag(close, 5) OVER (ORDER BY trade_date) - 1 AS r FROM (SELECT trade_date, max(close) AS close FROM bars_long GROUP BY 1)) i USING (trade_date)"""))
def relative_strength(spark, d):
    bars = T.bars_long(spark, d)
    rs = index_score.relative_strength(bars, bars.groupBy("trade_date").agg(F.max("close").alias("close")))
    return rs.select("stock_id", "trade_date", F.bround("rs5", 9).alias("rs5"))


@query("""SELECT k AS stock_id, round_even(earned / available * 100, 6) AS score, available, CASE WHEN available < 65 THEN 'STAY_IN_CASH' WHEN available < 80 THEN 'WARNING' ELSE 'OK' END AS gate,
  CASE WHEN s >= 80 THEN 'STRONG_UP' WHEN s >= 65 THEN 'UP' WHEN s >= 50 THEN 'NEUTRAL' WHEN s >= 35 THEN 'WEAK' WHEN s >= 0 THEN 'DOWN' END AS regime FROM (SELECT *, earned / available * 100 AS s FROM (SELECT c_custkey AS k,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 101 * 40 / 100.0 ELSE 0 END::DOUBLE + (c_custkey * 7 % 101 * 35 / 100.0)::DOUBLE + CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 3 % 101 * 25 / 100.0 ELSE 0 END::DOUBLE AS earned,
  CASE WHEN c_custkey % 3 <> 0 THEN 40 ELSE 0 END + 35 + CASE WHEN c_custkey % 5 <> 0 THEN 25 ELSE 0 END AS available FROM customer))""")
def score_regimes(spark, d):
    k = F.col("c_custkey")
    parts = {"trend": (F.when(k % 3 != 0, (k % 101).cast("double")), 40), "volume": ((k * 7 % 101).cast("double"), 35), "breadth": (F.when(k % 5 != 0, (k * 3 % 101).cast("double")), 25)}
    score, available = index_score.total_score(parts)
    return T.table(spark, d, "customer").select(k.alias("stock_id"), F.bround(score, 6).alias("score"), available.alias("available"), index_score.gate(available).alias("gate"), index_score.regime(score)[0].alias("regime"))
