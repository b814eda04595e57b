"""The source of trading records: which filters it takes, which row groups it leaves out, and its three calls against plain loops."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan, LessThanOrEqual

from quartzlake.sources import fetched

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    """Two files of sorted days in small row groups, one with nulls, and their rows."""
    rng, folder, rows = random.Random(6), tmp_path_factory.mktemp("records"), []
    for part in range(2):
        own = sorted((DAY + dt.timedelta(days=40 * part + rng.randrange(40)), rng.randrange(1, 6), rng.randrange(1, 90) / 2, i) for i in range(120))
        rows += own + ([(None, 1, 5.0, 900), (DAY, None, 5.0, 901)] if part else [])
        own = rows[-122:] if part else own
        table = pa.table({"l_shipdate": pa.array([r[0] for r in own], pa.date32()), "l_suppkey": pa.array([r[1] for r in own], pa.int64()), "l_extendedprice": [r[2] for r in own], "l_quantity": [1.0] * len(own),
                          "l_orderkey": pa.array([r[3] for r in own], pa.int64()), "l_linenumber": pa.array([part] * len(own), pa.int64()), "l_partkey": pa.array([0] * len(own), pa.int64()), "l_comment": ["never read"] * len(own)})
        pq.write_table(table, f"{folder}/{part}.parquet", row_group_size=20)
    return str(folder), rows


def test_filters_and_partitions(source):
    folder, _ = source
    every = len(fetched.Reader(folder).partitions())
    assert every == 13
    reader = fetched.Reader(folder)
    left = list(reader.pushFilters([EqualTo(("trade_date",), DAY + dt.timedelta(days=60)), IsNotNull(("trade_date",)), GreaterThan(("px",), 3.0), In(("stock_id",), (1, 2))]))
    assert [type(f) for f in left] == [IsNotNull, GreaterThan]
    assert 1 <= len(reader.partitions()) < 5
    none = fetched.Reader(folder)
    assert not list(none.pushFilters([LessThan(("trade_date",), DAY - dt.timedelta(days=9))])) and none.partitions()[0].path == ""


@pytest.mark.parametrize("test, inside", [(EqualTo(("x",), 5), [(5, 9), (1, 5)]), (GreaterThan(("x",), 5), [(1, 6)]), (LessThanOrEqual(("x",), 5), [(5, 9)]), (LessThan(("x",), 5), [(4, 9)]), (In(("x",), (1, 8)), [(7, 9)])])
def test_bounds(test, inside):
    ranges = [(5, 9), (1, 5), (1, 6), (4, 9), (7, 9), (6, 7)]
    assert all(fetched.may_hold(*r, test) for r in inside)
    holds = {EqualTo: lambda v: v == 5, GreaterThan: lambda v: v > 5, LessThanOrEqual: lambda v: v <= 5, LessThan: lambda v: v < 5, In: lambda v: v in (1, 8)}[type(test)]
    assert all(fetched.may_hold(low, high, test) == any(holds(v) for v in range(low, high + 1)) for low, high in ranges)


def test_scan_equals_the_rows(spark, source):
    folder, rows = source
    found = fetched.records(spark, folder)
    key = lambda r: (r[0] or DAY, r[1] or 0, r[3])
    take = lambda df: sorted((tuple(r) for r in df.select("trade_date", "stock_id", "px", "order_key").collect()), key=key)
    assert take(found) == sorted(rows, key=key)
    since = DAY + dt.timedelta(days=33)
    some = found.where((F.col("trade_date") >= F.lit(since)) & F.col("stock_id").isin(2, 4) & (F.col("px") > 20))
    assert "PushedFilters: [GreaterThanOrEqual(trade_date," in some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert take(some) == sorted((r for r in rows if r[0] and r[0] >= since and r[1] in (2, 4) and r[2] > 20), key=key)
    assert take(found.where("stock_id IS NULL")) == [r for r in rows if r[1] is None]


def test_three_calls(spark, source):
    folder, rows = source
    found, as_of = fetched.records(spark, folder), DAY + dt.timedelta(days=50)
    bars = {}
    for day, stock, px, order in sorted((r for r in rows if r[0]), key=lambda r: (r[3], r[0] >= DAY + dt.timedelta(days=40))):
        o, h, low, _, n = bars.get((stock, day), (px, px, px, px, 0))
        bars[stock, day] = (o, max(h, px), min(low, px), px, n + 1)
    take = lambda df: {(r.stock_id, r.trade_date): (r.open, r.high, r.low, r.close, r.volume) for r in df.collect()}
    assert take(fetched.fetch_history(found, as_of, 7, [1, 3])) == {k: b for k, b in bars.items() if k[0] in (1, 3) and as_of - dt.timedelta(days=7) < k[1] <= as_of}
    day = max(k[1] for k in bars if k[1] <= as_of)
    assert take(fetched.fetch_date(found, day)) == {k: b for k, b in bars.items() if k[1] == day}
    newest = {s: max(d for x, d in bars if x == s and d <= as_of) for s in range(1, 6)}
    assert {k: b for k, b in take(fetched.fetch_latest(found, as_of)).items() if k[0]} == {k: b for k, b in bars.items() if k[0] and newest[k[0]] == k[1]}
    assert fetched.fetch_date(found, DAY - dt.timedelta(days=1)).count() == 0


def test_offsets_and_spans(source):
    folder, rows = source
    reader = fetched.StreamReader(folder, 5, fetched.FIRST)
    last = max(r[0] for r in rows if r[0])
    assert reader.initialOffset() == {"day": "0001-01-01"} and reader.latestOffset() == {"day": last.isoformat()} == reader.latestOffset()
    every = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(every) == 13 and {p.after for p in every} == {fetched.FIRST}
    days = lambda spans: sorted(d for p in spans for b in reader.read(p) for d in b.column("trade_date").to_pylist())
    assert days(every) == sorted(r[0] for r in rows if r[0])
    mark = last - dt.timedelta(days=3)
    some = reader.partitions({"day": mark.isoformat()}, {"day": last.isoformat()})
    assert len(some) < 6 and days(some) == sorted(r[0] for r in rows if r[0] and r[0] > mark - dt.timedelta(days=5))
    assert days(reader.partitions({"day": last.isoformat()}, {"day": last.isoformat()})) == []
