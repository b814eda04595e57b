import datetime as dt
import shutil
import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quartzlake.operators import runs, storage
from quartzlake.streaming import increments, stateful

T0 = dt.datetime(2024, 1, 1, 9)


def batches(spark, tmp_path, name, schema, parts):
    """A stream that reads one file of rows a batch."""
    path = str(tmp_path / name)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(writer, tmp_path, name):
    q = writer.option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def run_through(writer, tmp_path, name, rows):
    """A query in processing time plans batch after batch for its time to live, so it is stopped when it has read its rows."""
    q = writer.option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).start()
    for _ in range(400):
        if sum(p["numInputRows"] for p in q.recentProgress) >= rows:
            break
        time.sleep(0.1)
    q.stop()
    assert q.exception() is None


def test_replayed_rows_are_written_once(spark, tmp_path):
    rows = [(1, dt.date(2024, 1, 2), "a", "1", 1), (1, dt.date(2024, 1, 3), "a", "1", 2)]
    stream = batches(spark, tmp_path, "in", "stock_id long, trade_date date, source string, data_version string, seq long", [rows, rows + [(2, dt.date(2024, 1, 3), "a", "1", 3), (2, dt.date(2024, 1, 3), "a", "1", 4)]])
    target = str(tmp_path / "target")
    drain(stream.writeStream.foreachBatch(increments.append_new(target, storage.KEY)), tmp_path, "append")
    assert sorted(r.seq for r in spark.read.parquet(target).collect()) in ([1, 2, 3],)


def test_changed_bars_get_a_version(spark, tmp_path):
    schema = "stock_id long, trade_date date, source string, open double, high double, low double, close double, volume long, seq long"
    bar = lambda close, seq: (1, dt.date(2024, 1, 2), "a", 1.0, 2.0, 1.0, close, 5, seq)
    stream = batches(spark, tmp_path, "in", schema, [[bar(1.5, 1)]])
    target = str(tmp_path / "target")
    write = increments.append_versions(target)
    drain(stream.writeStream.foreachBatch(write), tmp_path, "first")
    write(spark.createDataFrame([bar(1.5, 2)], schema), 1)
    write(spark.createDataFrame([bar(1.7, 3)], schema), 2)
    assert [(r.close, r.data_version) for r in spark.read.parquet(target).orderBy("seq").collect()] == [(1.5, "1"), (1.7, "2")]


def test_alerts_match_the_batch_form(spark, tmp_path):
    ok = [True, False, False, False, False, True, False, False, True, False, False, False]
    rows = [(s, T0 + dt.timedelta(minutes=i), i, o ^ (s == 2 and i == 2)) for s in (1, 2) for i, o in enumerate(ok)]
    schema = "source_id long, ts timestamp, event_id long, ok boolean"
    stream = batches(spark, tmp_path, "in", schema, [rows[:3] + rows[12:17], rows[3:12] + rows[17:]])
    out = str(tmp_path / "out")
    drain(stateful.alerts(stream).writeStream.format("parquet").option("path", out), tmp_path, "alerts")
    want = {(r.source_id, r.event_id) for r in runs.source_alerts(spark.createDataFrame(rows, schema)).collect()}
    assert {(r.source_id, r.event_id) for r in spark.read.parquet(out).collect()} == want and want


def test_states_and_cutoff(spark, tmp_path):
    waves = stateful.WAVES
    rows = [(1, s, True) for s in waves] + [(2, s, s != "news") for s in waves] + [(3, s, s != "price") for s in waves] + [(4, "price", True)]
    stream = batches(spark, tmp_path, "in", "stock_id long, source string, ok boolean", [rows])
    found = {}
    write = lambda df, _: found.update({r.stock_id: r.state for r in df.collect()})
    drain(stateful.stock_states(stream).writeStream.outputMode("update").foreachBatch(write), tmp_path, "states")
    assert found == {1: "READY", 2: "PARTIAL_DATA", 3: "FAILED", 4: "WAITING"}
    events = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(hours=1))], "id long, ts timestamp")
    on_time, late = increments.split_at_cutoff(events, "2024-01-01 09:40:00")
    assert [r.id for r in on_time.collect()] == [1] and [r.id for r in late.collect()] == [2]


@pytest.mark.parametrize("n", [1])
def test_ids_once(spark, tmp_path, n):
    rows = [(1, T0), (1, T0 + dt.timedelta(minutes=1)), (2, T0)]
    stream = batches(spark, tmp_path, "in", "id long, ts timestamp", [rows[:1], rows[1:]])
    out = str(tmp_path / "out")
    drain(increments.once_by_id(stream, "id", "ts", "1 hour").writeStream.format("parquet").option("path", out), tmp_path, "ids")
    assert sorted(r.id for r in spark.read.parquet(out).select(F.col("id")).collect()) == [1, 2]


def test_only_what_is_past_the_mark_comes_in(spark, tmp_path):
    schema, target = "stock_id long, trade_date date, source string, seq long", str(tmp_path / "target")
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    write = increments.append_after_mark(target, overlap_days=3, partition="trade_date")
    write(spark.createDataFrame([(1, day(20), "a", 1), (1, day(20), "a", 2)], schema), 0)
    write(spark.createDataFrame([(1, day(17), "a", 3), (1, day(18), "a", 4), (1, day(20), "a", 5), (1, day(25), "a", 6), (2, day(1), "a", 7)], schema), 1)
    assert sorted(r.seq for r in spark.read.parquet(target).collect()) == [1, 4, 6, 7]


def test_marks_are_kept_beside_the_target(spark, tmp_path):
    """After the first batch neither marks nor repeats need the old partitions: one that cannot be read does no harm. A batch that
    is replayed, before or after its marks were written, writes nothing twice."""
    schema, target = "stock_id long, trade_date date, source string, seq long", tmp_path / "target"
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    stored = lambda low: sorted(r.seq for r in spark.read.schema(schema).parquet(str(target)).where(F.col("trade_date") >= day(low)).collect())
    write = increments.append_after_mark(str(target), overlap_days=3, partition="trade_date")
    write(spark.createDataFrame([(1, day(0), "a", 1), (1, day(20), "a", 2)], schema), 0)
    for part in (target / f"trade_date={day(0)}").glob("*.parquet"):
        part.write_bytes(b"not a table")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    second = spark.createDataFrame([(1, day(16), "a", 3), (1, day(21), "a", 4), (2, day(19), "b", 5)], schema)
    write(second, 1)
    assert stored(1) == [2, 4, 5]
    shutil.rmtree(f"{target}-marks/before=2")
    write(second, 1)  # it had stopped before its marks
    write(second, 1)  # and after them
    assert stored(1) == [2, 4, 5]
    write(spark.createDataFrame([(1, day(17), "a", 6), (2, day(17), "b", 7), (1, day(19), "a", 8)], schema), 2)
    assert stored(1) == [2, 4, 5, 7, 8]
    assert sorted(p.name for p in Path(f"{target}-marks").iterdir()) == ["before=2", "before=3"]


def test_a_source_is_pulled_after_its_marks(spark, tmp_path):
    """New days and late records of the overlap come in once; a batch that is written but not committed is run again and writes nothing twice."""
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    source, target, checkpoint = tmp_path / "source", str(tmp_path / "bars"), str(tmp_path / "checkpoint")
    source.mkdir()

    def arrive(name, rows):
        kinds = {"l_suppkey": pa.int64(), "l_shipdate": pa.date32(), "l_extendedprice": pa.float64()}
        table = {c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())}
        rest = {"l_quantity": pa.array([1.0] * len(rows)), **{c: pa.array(range(len(rows)), pa.int64()) for c in ("l_orderkey", "l_linenumber", "l_partkey")}}
        pq.write_table(pa.table(table | rest), source / f"{name}.parquet", row_group_size=2)

    def pulled():
        query = increments.pull(spark, str(source), target, checkpoint, overlap_days=4)
        query.awaitTermination(120)
        assert query.exception() is None

    stored = lambda: sorted((r.stock_id, r.trade_date, r.close) for r in spark.read.parquet(target).collect())
    arrive("a", [(1, day(0), 5.0), (1, day(0), 6.0), (2, day(1), 7.0), (1, day(10), 8.0), (None, day(3), 1.0), (2, None, 1.0)])
    pulled()
    first = [(1, day(0), 6.0), (1, day(10), 8.0), (2, day(1), 7.0)]
    assert stored() == first
    pulled()  # nothing new
    assert stored() == first
    arrive("b", [(1, day(2), 1.0), (1, day(8), 2.0), (1, day(10), 3.0), (1, day(11), 4.0), (3, day(9), 5.0)])
    pulled()
    want = sorted([*first, (1, day(8), 2.0), (1, day(11), 4.0), (3, day(9), 5.0)])
    assert stored() == want
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # the last batch was written, but not committed
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    pulled()
    assert stored() == want


def test_revisions_follow_what_is_stored(spark, tmp_path):
    schema, target = "notification_id long, previous_notification_id long, seq long", str(tmp_path / "target")
    write = increments.append_disclosures(target)
    write(spark.createDataFrame([(1, None, 1), (2, 9, 2)], schema), 0)
    write(spark.createDataFrame([(3, 1, 3), (1, None, 4), (3, 1, 5)], schema), 1)
    write(spark.createDataFrame([(4, 3, 6)], schema), 2)
    assert {(r.notification_id, r.version_no) for r in spark.read.parquet(target).collect()} == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_restrictions_expire_once(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    rows = [[(1, T0, T0 + 2 * hour), (2, T0, None), (3, T0, T0 + 90 * hour)], [(9, T0 + 5 * hour, None)], [(9, T0 + 6 * hour, None)]]
    stream = batches(spark, tmp_path, "in", "seq long, ts timestamp, ends_at timestamp", rows)
    out = str(tmp_path / "out")
    drain(stateful.expiries(stream).writeStream.format("parquet").option("path", out), tmp_path, "expiries")
    assert [(r.seq, r.expired_at) for r in spark.read.parquet(out).collect()] == [(1, T0 + 2 * hour)]


def test_state_lives_as_long_as_it_should(spark, tmp_path):
    """Two errors, a pause, two errors: three in a row for a state that lives on, and not for one that does not."""
    schema = "source_id long, ts timestamp, event_id long, ok boolean"
    rows = [(1, T0 + dt.timedelta(minutes=i), i, False) for i in range(4)]
    found = {}
    for name, live_ms in (("long", 3_600_000), ("short", 1)):
        stream, out = batches(spark, tmp_path, f"in-{name}", schema, [rows[:2]]), str(tmp_path / f"out-{name}")
        run_through(stateful.alerts(stream, 3, live_ms).writeStream.format("parquet").option("path", out), tmp_path, name, 2)
        stream = batches(spark, tmp_path, f"in-{name}", schema, [rows[2:]])
        run_through(stateful.alerts(stream, 3, live_ms).writeStream.format("parquet").option("path", out), tmp_path, name, 2)
        found[name] = [r.event_id for r in spark.read.schema(stateful.ALERT).parquet(out).collect()]
    assert found == {"long": [2], "short": []}
