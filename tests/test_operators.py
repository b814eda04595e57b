"""Boundary values of the market-data operators, hand-checked."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quartzlake.functions import fuzzy, text
from quartzlake.operators import api, confidence, corporate, dedupe, disclosures, identity, index_score, news, runs, storage, validation, volume

D = dt.date
BAR = "stock_id long, trade_date date, open double, high double, low double, close double, volume long, currency string, source string, seq long"


def bar(stock=1, day=D(2024, 1, 2), o=100.0, h=101.0, low=99.0, c=100.0, v=1000, cur="TRY", seq=1, source="licensed"):
    return (stock, day, o, h, low, c, v, cur, source, seq)


def failed(spark, *bars):
    rows = validation.validate(spark.createDataFrame(list(bars), BAR), "2024-06-28", holidays=("2024-01-01",), order="seq")
    return {r.seq: (r.status, set(r.failed_codes)) for r in rows.collect()}


def test_rules(spark):
    got = failed(
        spark, bar(seq=1), bar(seq=2, o=None), bar(seq=3, o=0.0), bar(seq=4, h=98.0, day=D(2024, 1, 3)), bar(seq=5, v=None, day=D(2024, 1, 4)), bar(seq=6, v=0, day=D(2024, 1, 5)), bar(seq=7, v=-1, day=D(2024, 1, 8)),
        bar(seq=8, day=D(2024, 1, 6)), bar(seq=9, day=D(2024, 1, 1)), bar(seq=10, day=D(2024, 7, 1)), bar(seq=11, day=None), bar(seq=12, cur="USD", day=D(2024, 1, 9)), bar(seq=13, o=100.0, h=100.0, low=100.0, c=100.0, day=D(2024, 1, 10)), bar(seq=14, source="other"),
    )
    assert got[1] == ("CLEAN", set()) and got[6] == ("CLEAN", set()) and got[13] == ("CLEAN", set()) and got[14] == ("CLEAN", set())
    assert got[2] == ("REJECTED", {"OPEN_NOT_POSITIVE", "DUPLICATE_DATE"}) and {"OPEN_NOT_POSITIVE", "LOW_GT_PRICE", "DUPLICATE_DATE"} == got[3][1]
    assert got[4][1] == {"HIGH_LT_PRICE", "LOW_GT_PRICE"} and got[5][1] == {"NEGATIVE_VOLUME"} == got[7][1]
    assert got[8][1] == {"NON_TRADING_DAY"} == got[9][1] == got[11][1] and got[10][1] == {"FUTURE_DATE"} and got[12][1] == {"CURRENCY_MISMATCH"}


def loop(closes):
    last, out = None, []
    for c in closes:
        review = last is not None and abs(c - last) / last * 100 > 20
        out.append("REVIEW_REQUIRED" if review else "CLEAN")
        last = last if review else c
    return out


def test_clean_chain_follows_clean_closes_only(spark):
    rng = random.Random(1)
    series = {1: [100.0, 120.0, 121.0, 150.0, 144.0, 145.3], 2: [100.0, 120.0001, 100.0], 3: [rng.uniform(50, 90) for _ in range(60)]}
    rows = [(s, D(2024, 1, 1) + dt.timedelta(days=i), c) for s, own in series.items() for i, c in enumerate(own)]
    for parts in (1, 5):
        got = validation.clean_chain(spark.createDataFrame(rows, "stock_id long, trade_date date, close double").repartition(parts)).orderBy("trade_date").collect()
        for s, own in series.items():
            assert [r.status for r in got if r.stock_id == s] == loop(own)
    explained = spark.createDataFrame([(1, D(2024, 1, 1), 100.0, False), (1, D(2024, 1, 2), 150.0, True), (1, D(2024, 1, 3), 151.0, False)], "stock_id long, trade_date date, close double, explained boolean")
    assert {r.status for r in validation.clean_chain(explained).collect()} == {"CLEAN"}


@pytest.mark.parametrize("n, review, age, label", [(0, 0, 0, "PRICE_DATA_MISSING"), (1, 0, 300, "INSUFFICIENT_FOR_TECHNICAL"), (59, 0, 300, "INSUFFICIENT_FOR_TECHNICAL"), (60, 0, 300, "LIMITED_DATA"), (259, 0, 300, "LIMITED_DATA"), (260, 0, 300, "SUFFICIENT_DATA"), (60, 1, 300, "REVIEW_REQUIRED"), (30, 0, 60, "NEW_LISTING"), (30, 0, 61, "INSUFFICIENT_FOR_TECHNICAL")])
def test_sufficiency(spark, n, review, age, label):
    as_of = D(2024, 6, 28)
    rows = [(1, as_of - dt.timedelta(days=age - min(i, age)), "CLEAN") for i in range(n)] + [(1, as_of, "REVIEW_REQUIRED")] * review
    got = validation.sufficiency(spark.createDataFrame([(1,)], "stock_id long"), spark.createDataFrame(rows, "stock_id long, trade_date date, status string"), str(as_of)).first()
    assert got.label == label


def test_source_tolerance_is_inclusive(spark):
    kind = "stock_id long, trade_date date, close double"
    own = spark.createDataFrame([(1, D(2024, 1, 2), 100.5), (2, D(2024, 1, 2), 100.51), (3, D(2024, 1, 2), 1.0)], kind)
    ref = spark.createDataFrame([(1, D(2024, 1, 2), 100.0), (2, D(2024, 1, 2), 100.0)], kind)
    assert {r.stock_id: r.status for r in validation.source_check(own, ref).collect()} == {1: "OK", 2: "SOURCE_DIVERGENCE_REVIEW", 3: "VALIDATION_SOURCE_UNAVAILABLE"}


def volumes(spark, *series):
    rows = [(s, D(2024, 1, 2) + dt.timedelta(days=i), v) for s, own in enumerate(series) for i, v in enumerate(own)]
    return spark.createDataFrame(rows, "stock_id long, trade_date date, volume long")


def test_volume_ratio(spark):
    rows = volumes(spark, list(range(1, 22)), [1, 2, None, 3, 4, 5], [1, 2, None, 3, 4, 5, 6], [0] * 10, [10] * 20 + [13], [10] * 20 + [50], [10] * 20 + [None])
    got = {r.stock_id: r for r in volume.ratios(rows).collect()}
    assert (got[0].avg20, got[0].used_days) == (10.5, 20) and got[0].ratio == 2.0
    assert (got[1].used_days, got[1].ratio) == (4, None) and got[1].avg20 == 2.5
    assert (got[2].used_days, got[2].ratio) == (5, 2.0) and got[3].ratio is None
    status = {r.stock_id: (r.status, r.reason) for r in volume.status(rows).collect()}
    assert status[0] == ("HIGH", None) and status[1] == ("REVIEW_REQUIRED", "INSUFFICIENT_WINDOW") and status[3] == ("REVIEW_REQUIRED", "ZERO_VOLUME_WITHOUT_EXPLANATION")
    assert status[4] == ("INCREASING", None) and status[5] == ("ANOMALOUS", None) and status[6] == ("MISSING", "LAST_VOLUME_MISSING")


def test_factors_and_adjusted_closes(spark):
    bars = spark.createDataFrame([(1, D(2024, 1, d), float(c)) for d, c in ((2, 100), (3, 100), (4, 50), (5, 51))], "stock_id long, trade_date date, close double")
    acts = spark.createDataFrame([
        (1, 1, "split", D(2024, 1, 4), "2:1"), (2, 1, "dividend", D(2024, 1, 5), "5"), (3, 1, "dividend", D(2024, 1, 5), "50"), (4, 1, "bonus", D(2024, 1, 3), "1:1"), (5, 1, "rights", D(2023, 1, 3), "1:4"),
        (6, 1, "split", D(2024, 1, 4), "0:1"), (7, 1, "other", D(2024, 1, 4), "x"), (8, 2, "dividend", D(2024, 1, 4), "1"), (9, 1, "split", D(2024, 1, 4), "-2"),
    ], "seq long, stock_id long, action_type string, effective_date date, ratio string")
    got = {r.seq: (r.factor, r.error) for r in corporate.with_factors(acts, bars).collect()}
    assert got == {
        1: (0.5, None), 2: (0.9, None), 3: (None, "AMOUNT_NOT_BELOW_REFERENCE"), 4: (0.5, None), 5: (0.8, None), 6: (None, "BAD_RATIO"), 7: (None, "BAD_RATIO"), 8: (None, "NO_REFERENCE"), 9: (None, "NOT_POSITIVE"),
    }
    two = corporate.with_factors(acts.where("seq IN (1, 2)"), bars)
    assert [(r.factor, r.adjusted_close) for r in corporate.adjusted(bars, two).orderBy("trade_date").collect()] == [(0.45, 45.0), (0.45, 45.0), (0.9, 45.0), (1.0, 51.0)]
    assert [r.reason for r in corporate.explain_outliers(bars, two).orderBy("trade_date").collect()] == ["NO_REFERENCE", "NO_OUTLIER", "CORPORATE_ACTION", "NO_OUTLIER"]


def test_intervals(spark):
    r = spark.createDataFrame([(d, D(2024, 6, 9), D(2024, 6, 12), "TRADING_HALT", d) for d in (1,)], "stock_id long, start_date date, end_date date, restriction_type string, seq long")
    active = lambda day: corporate.active_restrictions(r, day).first().computed_active
    assert [active(f"2024-06-{d:02d}") for d in (8, 9, 12, 13)] == [False, True, True, False]
    symbols = spark.createDataFrame([(1, "bist", "OLD", D(2020, 1, 1), D(2024, 1, 1)), (1, "bist", "NEW", D(2024, 1, 1), None), (2, "bist", "İş", D(2020, 1, 1), None), (3, "bist", "DUP", D(2020, 1, 1), None), (4, "bist", "dup", D(2020, 1, 1), None)], "stock_id long, platform string, symbol string, valid_from date, valid_to date")
    asked = spark.createDataFrame([(1, "bist", "old", D(2023, 12, 31)), (2, "bist", "old", D(2024, 1, 1)), (3, "bist", "new", D(2024, 1, 1)), (4, "bist", "IS", D(2024, 1, 1)), (5, "bist", "dup", D(2024, 1, 1))], "query_id long, platform string, symbol string, day date")
    got = {r.query_id: (r.stock_id, r.status) for r in identity.resolve(asked, symbols, "day").collect()}
    assert got == {1: (1, "MATCHED"), 2: (None, "UNMATCHED"), 3: (1, "MATCHED"), 4: (2, "MATCHED"), 5: (None, "AMBIGUOUS")}


def test_merge_chains(spark):
    got = {r.old: r.final for r in identity.merge_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "old long, new long")).collect()}
    assert got == {1: 4, 2: 4, 3: 4, 10: 11}


def test_versions(spark):
    rows = spark.createDataFrame([(1, "9"), (2, "10"), (3, "x")], "seq long, v string")
    assert [r.n for r in rows.orderBy("seq").select(storage.next_version(F.col("v")).alias("n")).collect()] == ["10", "11", "x-recheck"]
    stored = spark.createDataFrame([(1, D(2024, 1, 2), "a", "10", 1), (1, D(2024, 1, 2), "a", "9", 2)], "stock_id long, trade_date date, source string, data_version string, seq long")
    assert storage.latest(stored, ["stock_id", "trade_date", "source"]).first().data_version == "9"
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "notification_id long, previous_notification_id long")
    got = {r.notification_id: (r.root, r.version_no, r.superseded_by, r.missing_target) for r in disclosures.chains(chain).collect()}
    assert got == {1: (1, 1, 2, False), 2: (1, 2, 3, False), 3: (1, 3, None, False), 4: (4, 1, None, True)}


def test_text(spark):
    rows = spark.createDataFrame([("  İSTANBUL Işık Şirketi-ÇĞÖÜ  ",), (None,), ("IS ISLEM",)], "t string")
    assert [r.n for r in rows.select(text.normalize(F.col("t")).alias("n")).collect()] == ["istanbul isik sirketi cgou", "", "is islem"]
    got = rows.select(text.has_phrase(text.normalize(F.col("t")), "is").alias("a"), text.significant(F.col("t")).alias("s")).collect()
    assert [r.a for r in got] == [False, False, True] and got[0].s == ["cgou", "isik", "sirketi"]
    assert fuzzy.token_set_ratio("a b", "c d") == 0 and fuzzy.token_set_ratio("a b c", "a b") == 100 and fuzzy.token_set_ratio("", "a") == 0
    assert fuzzy.partial_ratio("bank", "big bank of it") == 100
    assert fuzzy.ratio("", "") == fuzzy.ratio("a", "") == fuzzy.partial_ratio("", "") == 0 and fuzzy.ratio("ab", "ab") == 100


def test_short_codes_need_context(spark):
    n = spark.createDataFrame([(1, "PK rises", ""), (2, "PK hisse rises", ""), (3, "islem", None)], "news_id long, title string, body string")
    alias = spark.createDataFrame([("pk", 7, "CODE"), ("is", 8, "BRAND"), ("pk hisse", 9, "FULL_NAME")], "norm string, stock_id long, method string")
    got = {(r.news_id, r.stock_id) for r in news.alias_hits(n, alias).collect()}
    assert got == {(2, 7), (2, 9)}
    tie = news.combine(spark.createDataFrame([(1, 1, "FULL_NAME", "x", False), (1, 2, "FULL_NAME", "y", False), (2, 1, "BRAND", "x", True), (2, 1, "CODE", "x", True)], "news_id long, stock_id long, method string, alias string, context boolean"))
    assert {(r.news_id, r.stock_id): (r.score, r.confirmed) for r in tie.collect()} == {(1, 1): (95, False), (1, 2): (95, False), (2, 1): (85, True)}


def test_near_duplicates_match_brute_force(spark):
    titles = ["Big bank profit rises", "Bank profit rises big time", "big bank profit rise", "Nothing alike here", "bank", "", "Profit falls at other bank"]
    n = spark.createDataFrame([(i, t, "b") for i, t in enumerate(titles)], "news_id long, title string, body string")
    norm = [t.lower() for t in titles]
    want = {(i, j) for i in range(len(titles)) for j in range(len(titles)) if i != j and fuzzy.token_set_ratio(norm[i], norm[j]) >= 85}
    rows = n.select(text.normalize(F.col("title")).alias("title")).where("title <> ''")
    rows = rows.select("title", F.array_sort(F.array_distinct(F.split("title", " "))).alias("t")).distinct()
    pairs = {frozenset((norm[i], norm[j])) for i, j in want if norm[i] != norm[j]}
    assert {frozenset((r.a, r.b)) for r in dedupe.title_pairs(rows).collect()} == pairs and pairs


def test_confidence(spark):
    def score(**status):
        row = [(n, status.get(n, "OK")) for n in confidence.WEIGHTS]
        return spark.createDataFrame([(row,)], "components array<struct<name:string,status:string>>").select(confidence.confidence().alias("c")).first().c

    everything = dict.fromkeys(confidence.WEIGHTS, "NOT_APPLICABLE")
    assert score() == 100 and score(**everything) == 100 and score(news_check="MISSING") == 94 and score(**everything | {"news_check": "MISSING"}) == 0
    assert score(critical_fields="FAILED") == 60 and score(critical_fields="UNVERIFIED") == 98 and score(corporate_check="UNVERIFIED", news_check="NOT_APPLICABLE") == 96
    with pytest.raises(ValueError, match="INVALID_WEIGHT_SUM"):
        confidence.confidence(confidence.WEIGHTS | {"news_check": 7})
    with pytest.raises(ValueError, match="INCOMPLETE_WEIGHTS"):
        confidence.confidence({"news_check": 100})
    assert sum(confidence.normalize_weights({"a": 1, "b": 3}).values()) == 100


def test_list(spark):
    rows = spark.createDataFrame([("A", 5.0, "R2"), ("B", None, "R2"), ("C", 5.0, "R2"), ("D", 9.0, "R10"), ("E", 1.0, None), ("AA", None, "R2")], "symbol string, confidence double, scan_run_id string")
    names = lambda **p: [r.symbol for r in api.list_page(rows, api.FilterParams(sort="confidence", **p))[0].collect()]
    assert names() == ["E", "A", "C", "AA", "B"] and names(direction="desc") == ["C", "A", "E", "AA", "B"]
    assert names(page=2, page_size=2) == ["C", "AA"] and names(page=9) == []
    assert api.list_page(rows, api.FilterParams(page_size=2))[1].first().asDict() == {"total": 5, "total_pages": 3}
    for wrong in ({"page_size": 201}, {"page": 0}, {"sort": "x"}, {"direction": "up"}, {"minimum_confidence": 101}):
        with pytest.raises(api.InvalidParameter):
            api.FilterParams(**wrong)
    assert api.FilterParams(page_size=200).page_size == 200
    nested = spark.createDataFrame([(1, "x", [(2, "y")])], "id long, raw_error string, parts array<struct<id:long,admin_note:string>>")
    assert api.publishable(nested).schema.simpleString() == "struct<id:bigint,parts:array<struct<id:bigint>>>" and api.private_paths(nested.schema) == ["raw_error", "parts.admin_note"]


def test_phases_and_states(spark):
    times = {"05:00:00": "PRECHECK", "05:00:01": "COLLECTION", "05:45:00": "CLEANING", "06:40:00": "DATA_CUTOFF", "06:40:01": "CRITICAL_RESCAN", "06:45:00": None, "04:59:59": None}
    rows = spark.createDataFrame([(f"2024-06-03 {t}",) for t in times], "t string").select(runs.phase(F.to_timestamp("t")).alias("p"))
    assert [r.p for r in rows.collect()] == list(times.values())
    allowed = {"WAITING": ("READY",)}
    states = spark.createDataFrame([(1, 1, "WAITING", None), (1, 2, "READY", None), (1, 3, "WAITING", None), (2, 1, "FAILED", None), (2, 2, "WAITING", runs.RESCAN), (3, 1, "FAILED", None), (3, 2, "WAITING", None)], "stock_id long, seq long, state string, reason string")
    assert {(r.stock_id, r.seq) for r in runs.illegal_transitions(states, allowed).collect()} == {(1, 3), (3, 2)}


def test_index_score(spark):
    bars = spark.createDataFrame([(1, D(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i) for i in range(120)], "stock_id long, trade_date date, close double")
    rows = index_score.trend(index_score.ema(bars)).orderBy("trade_date").collect()
    assert rows[8].ema5 is None and rows[9].ema5 is not None and rows[98].trend is None and rows[119].trend == 100
    e = 100.0
    for i in range(1, 120):
        e += (100.0 + i - e) * 2 / 6
    assert rows[119].ema5 == pytest.approx(e)
    assert index_score.percentile(index_score.returns(bars), "r1").orderBy(F.desc("trade_date")).first().r1_pct == pytest.approx(1 / 119)


def test_owners_of_a_symbol_are_counted_before_queries_meet_them(spark):
    asked = spark.createDataFrame([(i, "bist", s) for i, s in enumerate(["a", " A", "b", "c", None, "d"])], "query_id long, platform string, symbol string")
    rows = [(1, "A", None), (2, "a", None), (3, "B", None), (3, "b", None), (4, "C", D(2024, 1, 1))]
    symbols = spark.createDataFrame([(i, "bist", s, D(2020, 1, 1), to) for i, s, to in rows], "stock_id long, platform string, symbol string, valid_from date, valid_to date")
    found = identity.resolve(asked, symbols)
    ambiguous, none = (None, 2, "AMBIGUOUS"), (None, 0, "UNMATCHED")
    assert {r.query_id: (r.stock_id, r.n_owners, r.status) for r in found.collect()} == {0: ambiguous, 1: ambiguous, 2: (3, 1, "MATCHED"), 3: none, 4: none, 5: none}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    dated = asked.withColumn("at", F.lit("2023-06-01").cast("date"))
    assert {r.query_id: r.status for r in identity.resolve(dated, symbols, "at").collect()} == {0: "AMBIGUOUS", 1: "AMBIGUOUS", 2: "MATCHED", 3: "MATCHED", 4: "UNMATCHED", 5: "UNMATCHED"}
