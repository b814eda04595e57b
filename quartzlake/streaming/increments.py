"""Streams: appends without repeats, re-checks and late events.

Sinks that must look at what is stored run in `foreachBatch`; a batch that is replayed writes nothing twice, for its
rows are found in the target. What keeps a state for each key is in `stateful`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quartzlake.durable import release, remove, written
from quartzlake.operators import records, storage
from quartzlake.sources import fetched


def stored_at(batch: DataFrame, path: str, partition: str | None, schema=None) -> DataFrame:
    """The table at path, or an empty one; of a partitioned table only the range of partitions that the batch touches."""
    try:
        found = batch.sparkSession.read.schema(schema or batch.schema).parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return batch.sparkSession.createDataFrame([], schema or batch.schema)
    if partition is None:
        return found
    low, high = batch.agg(F.min(partition), F.max(partition)).first()
    return found.where(F.col(partition).between(low, high)) if low is not None else found.limit(0)


def _append(rows: DataFrame, path: str, partition: str | None) -> None:
    out = rows.write.mode("append")
    (out.partitionBy(partition) if partition else out).parquet(path)


def append_new(path: str, key: list[str], partition: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows whose key the table at path has not, first of each key in the batch."""

    def write(batch: DataFrame, _: int) -> None:
        _append(storage.new_rows(batch, stored_at(batch, path, partition), key), path, partition)

    return write


def _marks(batch: DataFrame, number: int, path: str, marks: str) -> DataFrame:
    """stock_id, mark: the marks before a batch; where there are none yet, those of the table itself."""
    try:
        return batch.sparkSession.read.parquet(f"{marks}/before={number}")
    except Exception as e:  # the first batch of a checkpoint
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return stored_at(batch, path, None).groupBy("stock_id").agg(F.max("trade_date").alias("mark"))


def append_after_mark(path: str, overlap_days: int = 12, partition: str | None = None, marks: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for incremental pulls: of each stock the bars after its high mark, less an overlap that is read again
    for gaps and late corrections; what is stored is not stored twice.

    The high marks are a small table beside the target (`marks`), one version for each batch, written after the batch's rows: a batch
    that is replayed starts from the marks that it started from, and finds its rows in the target. The last two versions stay. Of a
    partitioned target a batch reads the partitions of its fresh rows; only the first batch of a checkpoint reads all of it, for the marks."""
    key, marks = ["stock_id", "trade_date", "source"], marks or f"{path.rstrip('/')}-marks"

    def write(batch: DataFrame, number: int) -> None:
        before = _marks(batch, number, path, marks)
        fresh = batch.join(before, "stock_id", "left").where(F.col("mark").isNull() | (F.col("trade_date") > F.date_sub("mark", overlap_days))).drop("mark")
        _append(storage.new_rows(fresh, stored_at(fresh, path, partition), key), path, partition)
        moved = before.unionByName(batch.groupBy("stock_id").agg(F.max("trade_date").alias("mark"))).groupBy("stock_id").agg(F.max("mark").alias("mark"))
        moved.write.mode("overwrite").parquet(f"{marks}/before={number + 1}")
        remove(batch.sparkSession, f"{marks}/before={number - 1}")

    return write


def pull(spark: SparkSession, source: str, target: str, checkpoint: str, overlap_days: int = fetched.OVERLAP_DAYS, partition: Callable[[Column], Column] = F.year) -> StreamingQuery:
    """A started stream that brings what the source at a path has newly to the table of bars at target, and then ends.

    The source gives the days after its high mark and the overlap before it, the sink keeps the marks of the stocks; a day that
    is stored stays as it is. `seq` is the batch that brought a bar. The target is partitioned by a period of the day, and a batch reads the periods of its fresh bars alone."""
    write = append_after_mark(target, overlap_days, partition="period")

    def bars(batch: DataFrame, number: int) -> None:
        found = fetched.bars(batch.where("stock_id IS NOT NULL")).withColumn("source", F.lit("licensed")).withColumn("seq", F.lit(number).cast("long"))
        held = written(found.withColumn("period", partition(F.col("trade_date"))), "pulled")  # the source is read once
        write(held, number)
        release(held)

    records = fetched.stream(spark, source, overlap_days)
    return records.writeStream.foreachBatch(bars).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_disclosures(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for filings (notification_id, previous_notification_id, seq): each id once, a revision behind its
    stored predecessor; nothing that is stored changes, and what supersedes what is read from the chain."""

    def write(batch: DataFrame, _: int) -> None:
        stored = stored_at(batch, path, None, batch.withColumn("version_no", F.lit(1)).schema)
        done = records.insert_disclosures(batch, stored).where("outcome <> 'duplicate'")
        batch.join(done.select("notification_id", "seq", "version_no"), ["notification_id", "seq"]).select(*batch.columns, F.col("version_no").cast("int").alias("version_no")).write.mode("append").parquet(path)

    return write


def append_versions(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a changed bar becomes a new version behind the stored one, a new bar the first version."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        key = ["stock_id", "trade_date", "source"]
        try:
            stored = storage.latest(spark.read.parquet(path), key)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], batch.withColumn("data_version", F.lit("1")).schema)
        changed = storage.recheck(stored, batch).select("stock_id", "trade_date", F.col("new_version").alias("data_version"))
        newer = batch.join(changed, ["stock_id", "trade_date"])
        first = batch.join(stored.select(*key), key, "left_anti").withColumn("data_version", F.lit("1"))
        newer.unionByName(first).select(*stored.columns).write.mode("append").parquet(path)

    return write


def once_by_id(stream: DataFrame, id_column: str, time_column: str, delay: str) -> DataFrame:
    """Each id once, as long as its repeats come within the delay; the sink's anti-join covers later ones."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([id_column])


def split_at_cutoff(stream: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """(on time, late): events after the cutoff go to the second run of the day."""
    late = F.col("ts") > F.lit(cutoff).cast("timestamp")
    return stream.where(~late), stream.where(late)
