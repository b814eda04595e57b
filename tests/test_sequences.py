"""Folds over sorted sequences and pointer chains with cycles, against plain loops."""

import datetime as dt
import random
from collections import deque

import duckdb
import pytest
from pyspark.sql import functions as F

from quartzlake.operators import graph, index_score, runs, scan, validation
from quartzlake.plans import catalogue

DAY = dt.date(2024, 1, 1)


@pytest.fixture(params=[3, 10_000], autouse=True)
def rows_in_a_batch(spark, request):
    """States must pass from one Arrow batch to the next."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def waits(times, most, window):
    """Each call alone: who is in the window decides, a waiting call counts from the time at which it gets through."""
    held, total, out = deque(), 0, []
    for at in times:
        held = deque(t for t in held if t > at - window)
        if len(held) < most:
            held.append(at)
            out.append((False, 0, total))
        else:
            free = held.popleft() + window
            held.append(free)
            total += free - at
            out.append((True, free - at, total))
    return out


@pytest.mark.parametrize("most", [1, 3])
def test_limiter_equals_a_loop(spark, most):
    rng = random.Random(most)
    calls = {s: sorted(rng.randrange(400) for _ in range(n)) for s, n in ((1, 60), (2, 1), (3, 25))}
    calls[4] = [5] * 9  # all at once
    rows = [(s, i, at) for s, own in calls.items() for i, at in enumerate(own)]
    found = runs.limited(spark.createDataFrame(rng.sample(rows, len(rows)), "source_id long, call_id long, at long").repartition(3), most, 60)
    got = {(r.source_id, r.call_id): (r.waited, r.wait, r.total) for r in found.collect()}
    assert got == {(s, i): w for s, own in calls.items() for i, w in enumerate(waits(own, most, 60))}
    assert any(w for w, _, _ in got.values())
    with pytest.raises(ValueError):
        scan.Limiter(0, 60)


@pytest.mark.parametrize(("window", "kind"), [(1 << 57, "bigint"), (1 << 58, "decimal(38,0)"), (1 << 40, "bigint")])
def test_sums_of_waits_over_the_largest_long(spark, window, kind):
    """Nine calls at once wait 36 windows in all, which a long cannot hold for one of the windows; a fitting sum stays a long."""
    rows = [(s, i, 5) for s, n in ((1, 9), (2, 2)) for i in range(n)]
    found = runs.limited(spark.createDataFrame(rows, "source_id long, call_id long, at long").repartition(3), 1, window)
    assert dict(found.dtypes)["total"] == kind
    got = {(r.source_id, r.call_id): (r.waited, r.wait, int(r.total)) for r in found.collect()}
    assert got == {(s, i): w for s, n in ((1, 9), (2, 2)) for i, w in enumerate(waits([5] * n, 1, window))}


def bars(spark, closes):
    rows = [(s, DAY + dt.timedelta(days=i), c) for s, own in closes.items() for i, c in enumerate(own)]
    return spark.createDataFrame(rows, "stock_id long, trade_date date, close double").repartition(3)


def test_rejected_closes_are_no_reference(spark):
    closes = {1: [0.0, 10.0], 2: [10.0, None, 100.0], 3: [10.0, -1.0, 11.0], 4: [None, None], 5: [10.0, 100.0, 101.0, 10.5]}
    got = {(r.stock_id, (r.trade_date - DAY).days): r.status for r in validation.clean_chain(bars(spark, closes)).collect()}
    want = {1: "RC", 2: "CRV", 3: "CRC", 4: "RR", 5: "CVVC"}
    names = {"R": "REJECTED", "C": "CLEAN", "V": "REVIEW_REQUIRED"}
    assert got == {(s, i): names[x] for s, word in want.items() for i, x in enumerate(word)}


def test_outlier_rule_alone_as_in_its_sql(spark, tmp_path):
    """Closes of zero, missing and negative ones, first in a series and later, against the query's SQL."""
    closes = {1: [10.0, 0.0, 11.0], 2: [0.0, 0.0, 5.0, None, 5.0, 50.0], 3: [-1.0, 100.0, 130.0], 4: [None, 3.0, 3.1], 5: [10.0, -1.0, 100.0]}
    at = lambda i: dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=i)
    rows = [(s * 100 + i, at(i), s, "click", c, "{}") for s, own in closes.items() for i, c in enumerate(own)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(f"SELECT stock_id, trade_date, status FROM ({catalogue.ORACLE_SQL['clean_chain_outliers']})").fetchall()
    got = catalogue.QUERIES["clean_chain_outliers"](spark, str(tmp_path)).select("stock_id", "trade_date", "status").collect()
    assert sorted(map(tuple, got)) == sorted(want) and ("REVIEW_REQUIRED" in {w[2] for w in want})


def test_verdicts_of_a_series(spark):
    """A second bar of a day and source, another source, a fatal and a warning rule, and an explained move."""
    columns = "stock_id long, trade_date date, source string, open double, high double, low double, close double, volume long, currency string, explained boolean"
    bar = lambda day, close, source="a", volume=1, explained=None: (1, DAY + dt.timedelta(days=day), source, close, close, close, close, volume, "TRY", explained)
    rows = [bar(0, 10.0), bar(1, 11.0), bar(1, 12.0), bar(1, 12.5, "b"), bar(2, 40.0, volume=-1), bar(3, 13.0), bar(8, 30.0, explained=True), bar(9, 31.0), bar(10, 90.0)]
    odd = ("MUCH_VOLUME", validation.WARN, F.col("close") != 31.0)
    found = validation.verdict_chain(spark.createDataFrame(rows, columns).repartition(2), "2024-06-01", extra=[odd]).orderBy("trade_date", "close").collect()
    assert [(r.close, r.status, r.reference, r.failed_codes) for r in found] == [
        (10.0, "CLEAN", None, []), (11.0, "CLEAN", 10.0, []), (12.0, "REJECTED", 11.0, ["DUPLICATE_DATE"]), (12.5, "CLEAN", 11.0, []), (40.0, "REJECTED", 12.5, ["NEGATIVE_VOLUME", "UNEXPLAINED_OUTLIER"]),
        (13.0, "CLEAN", 12.5, []), (30.0, "CLEAN", 13.0, []), (31.0, "REVIEW_REQUIRED", 30.0, ["MUCH_VOLUME"]), (90.0, "REVIEW_REQUIRED", 30.0, ["UNEXPLAINED_OUTLIER"]),
    ]
    assert validation.verdict_chain(spark.createDataFrame([], columns), "2024-06-01").count() == 0


def test_averages_of_a_series(spark):
    rng = random.Random(2)
    closes = {s: [rng.uniform(5, 9) for _ in range(n)] for s, n in ((1, 60), (2, 9), (3, 41))}
    found = {(r.stock_id, r.n): r for r in index_score.ema(bars(spark, closes)).collect()}
    assert len(found) == 110
    for s, own in closes.items():
        at = own[0]
        for i, close in enumerate(own, 1):
            at += (close - at) * (2 / 6)
            assert found[s, i].ema5 == (pytest.approx(at) if i >= 10 else None)
            assert (found[s, i].ema20 is None) == (i < 40) and found[s, i].ema50 is None


def walk(up, node):
    seen, at = [], node
    while at in up and at not in seen:
        seen.append(at)
        at = up[at]
    return at, seen.index(at) if at in seen and at != node else 0 if at == node else len(seen), at in seen


def test_chains_with_cycles(spark):
    up = {k: k - 1 for k in range(2, 70)} | {100: 101, 101: 100, 102: 100, 103: 102, 110: 110, 111: 110, 120: 121, 121: 122, 122: 123, 123: 121, 124: 120, 200: 201}
    rng = random.Random(4)
    up |= {k: rng.randrange(300, 420) for k in range(300, 400)}  # whatever chance makes
    found = graph.ends(spark.createDataFrame(list(up.items()), "node long, up long").repartition(3)).collect()
    assert {r.node: (r.far, r.steps, r.cycle) for r in found} == {n: walk(up, n) for n in up} and len(found) == len(up)
    assert 15 < sum(r.cycle for r in found) < len(up) - 70


def test_pointers_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, write = [], graph.written

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(graph, "written", seen)
    up = {k: k - 1 for k in range(2, 20)} | {30: 31, 31: 30, 32: 30}
    found = graph.ends(spark.createDataFrame(list(up.items()), "node long, up long")).collect()
    assert {r.node: (r.far, r.steps, r.cycle) for r in found} == {n: walk(up, n) for n in up}
    joined = [plan for label, plan in plans if label == "chain" and "Join" in plan]
    assert joined and not any("Broadcast" in plan for plan in joined)
