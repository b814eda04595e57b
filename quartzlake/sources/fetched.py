"""A source of trading records as a Spark data source: partitions are row groups, filters on dates and stocks are pushed into the reading.

The reader says which filters it applies exactly (comparisons and equality on trade_date and stock_id, membership of stock_id); a row
group whose statistics exclude them is no partition at all, so a scan of one day reads the groups of that day. What it does not
know, Spark applies above it. Files are opened through Arrow's file systems by their URI, a batch at a time, in the tasks.

On it stand the three calls of a source: the history of the last days, the latest bar, and the bar of a date.

As a stream it gives the records of the days after its high mark. The mark is a day, so an offset has one size whatever the number of
stocks and files; it is found from the statistics of the row groups. A batch reads the row groups that hold days after the mark, less an overlap that is
read again for late records, which come with the next newer day. Between the same two marks a batch that is replayed reads the same days. Rows without a day are in no batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: The columns of the source by those of the file.
COLUMNS = {"l_suppkey": "stock_id", "l_shipdate": "trade_date", "l_extendedprice": "px", "l_quantity": "quantity", "l_orderkey": "order_key", "l_linenumber": "line", "l_partkey": "part_key"}
SCHEMA = "stock_id long, trade_date date, px double, quantity double, order_key long, line long, part_key long"
APPLIED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
FILTERED = ("trade_date", "stock_id")
OVERLAP_DAYS = 12
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


FIRST = dt.date(1, 1, 1)


@dataclass
class Group(InputPartition):
    path: str
    number: int


@dataclass
class Span(Group):
    """The days of a row group after one and up to another."""

    after: dt.date
    until: dt.date


def _opened(path: str) -> pq.ParquetFile:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return pq.ParquetFile(system.open_input_file(inner))


def _paths(path: str) -> list[str]:
    """A file, or the Parquet files of a folder."""
    scheme = path.partition(":")[0] + "://" if "://" in path else ""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    return [scheme + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".parquet")]


def _day(value) -> dt.date:
    return value.date() if isinstance(value, dt.datetime) else value


def may_hold(low, high, test: Filter) -> bool:
    """Whether a value from low to high can pass a filter."""
    if isinstance(test, In):
        return any(low <= v <= high for v in test.value)
    if isinstance(test, (GreaterThan, LessThanOrEqual)):
        return high > test.value if isinstance(test, GreaterThan) else low <= test.value
    if isinstance(test, (GreaterThanOrEqual, LessThan)):
        return high >= test.value if isinstance(test, GreaterThanOrEqual) else low < test.value
    return low <= test.value <= high


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in FILTERED and isinstance(f, (In, *APPLIED)) and f.value is not None:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Group]:
        own = {new: old for old, new in COLUMNS.items()}
        out = []
        for path in _paths(self.path):
            meta = _opened(path).metadata
            at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            for number in range(meta.num_row_groups):
                known = [(meta.row_group(number).column(at[own[f.attribute[0]]]).statistics, f) for f in self.tests]
                if all(s is None or not s.has_min_max or may_hold(_day(s.min), _day(s.max), f) for s, f in known):
                    out.append(Group(path, number))
        return out or [Group("", 0)]

    def read(self, partition: Group) -> Iterator:
        if not partition.path:
            return
        for batch in _opened(partition.path).iter_batches(row_groups=[partition.number], columns=list(COLUMNS)):
            batch = batch.select(list(COLUMNS)).rename_columns(list(COLUMNS.values()))
            kinds = {"long": "int64", "date": "date32", "double": "float64"}
            arrays = {c: batch.column(c).cast(kinds[k]) for c, k in (x.split() for x in SCHEMA.split(", "))}
            keep = None
            for f in self.tests:
                column = arrays[f.attribute[0]]
                hit = pc.is_in(column, pa.array(list(f.value), column.type)) if isinstance(f, In) else APPLIED[type(f)](column, pa.scalar(f.value, column.type))
                keep = hit if keep is None else pc.and_(keep, hit)
            found = batch.from_arrays(list(arrays.values()), names=list(arrays))
            yield found if keep is None else found.filter(keep)


def newest_day(path: str) -> dt.date:
    """The last day of a file's rows; where a row group has no statistics, its days are read."""
    opened, own = _opened(path), {new: old for old, new in COLUMNS.items()}["trade_date"]
    meta, found = opened.metadata, FIRST
    at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}[own]
    for number in range(meta.num_row_groups):
        known = meta.row_group(number).column(at).statistics
        last = known.max if known is not None and known.has_min_max else pc.max(opened.read_row_group(number, columns=[own]).column(own)).as_py()
        found = found if last is None else max(found, _day(last))
    return found


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, overlap: int, since: dt.date):
        self.path, self.overlap, self.since, self.known, self.high = path, overlap, since, set(), since

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": self.since.isoformat()}

    def latestOffset(self) -> dict:  # noqa: N802
        """The mark never goes back; a file is looked at once, as files do not change."""
        for path in set(_paths(self.path)) - self.known:
            self.high = max(self.high, newest_day(path))
            self.known.add(path)
        return {"day": self.high.isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        low, high = dt.date.fromisoformat(start["day"]), dt.date.fromisoformat(end["day"])
        if low >= high:
            return [Span("", 0, low, high)]
        low = low - dt.timedelta(days=self.overlap) if low > self.since and (low - FIRST).days >= self.overlap else low
        return [Span(g.path, g.number, low, high) for g in _reader(self.path, low, high).partitions()]

    def read(self, partition: Span) -> Iterator:
        return _reader(self.path, partition.after, partition.until).read(partition)


def _reader(path: str, after: dt.date, until: dt.date) -> Reader:
    reader = Reader(path)
    reader.tests = [GreaterThan(("trade_date",), after), LessThanOrEqual(("trade_date",), until)]
    return reader


class Records(DataSource):
    """Options: path, a Parquet file or a folder of them; of a stream also overlap_days, and since, the day after which it starts."""

    @classmethod
    def name(cls) -> str:
        return "trading_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        since = self.options.get("since")
        return StreamReader(self.options["path"], int(self.options.get("overlap_days", OVERLAP_DAYS)), dt.date.fromisoformat(since) if since else FIRST)


def stream(spark: SparkSession, path: str, overlap_days: int | None = None, since: dt.date | None = None) -> DataFrame:
    """The records as a stream of days after a high mark."""
    spark.dataSource.register(Records)
    options = {"path": path} | ({} if overlap_days is None else {"overlap_days": str(overlap_days)}) | ({"since": since.isoformat()} if since else {})
    return spark.readStream.format("trading_records").options(**options).load()


def records(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Records)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("trading_records").option("path", path).load()


def bars(rows: DataFrame) -> DataFrame:
    """A bar for each stock and day; its first and last price by a total order of the records."""
    at = F.struct("order_key", "line", "part_key", "px")
    return rows.groupBy("stock_id", "trade_date").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.sum("quantity").cast("long").alias("volume")
    )


def fetch_history(rows: DataFrame, as_of: dt.date, days: int, stocks: list[int] | None = None) -> DataFrame:
    """The bars of the last `days` calendar days up to as_of; of these stocks, if named."""
    found = rows.where((F.col("trade_date") > F.lit(as_of - dt.timedelta(days=days))) & (F.col("trade_date") <= F.lit(as_of)))
    return bars(found.where(F.col("stock_id").isin(stocks)) if stocks else found)


def fetch_date(rows: DataFrame, day: dt.date) -> DataFrame:
    """The bars of a day; a stock without one has no row."""
    return bars(rows.where(F.col("trade_date") == F.lit(day)))


def fetch_latest(rows: DataFrame, as_of: dt.date) -> DataFrame:
    """Each stock's newest bar up to as_of: its day is found first from two columns, then that day's records make the bar."""
    found = rows.where(F.col("trade_date") <= F.lit(as_of))
    newest = found.groupBy("stock_id").agg(F.max("trade_date").alias("trade_date"))
    return bars(found.join(newest, ["stock_id", "trade_date"], "left_semi"))
