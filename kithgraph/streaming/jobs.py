"""Incremental jobs with Structured Streaming: scans, buffers, progress, live views, duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.operators.tables import latest
from kithgraph.sources.storage import new_folder


def source(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """A folder of Parquet files, or a single file, as a stream with the schema of what is there."""
    there = spark.read.parquet(path)
    reader = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(file.endswith(f"/{name}") for file in there.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on the executors' disks and in the checkpoint, looked up by key: a batch reads the keys it touches."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def drain(stream: DataFrame, batch, mode: str = "append", state: str | None = None) -> None:
    """Run a stream over all that is there now."""
    state = state or new_folder(stream.sparkSession, "stream")
    stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()


def drain_to_files(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Run a stream over all that is there now into a folder whose log lists each batch's files once."""
    with rocksdb(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_scan(spark: SparkSession, path: str, key: str, status=None, state: str | None = None, max_files: int = 64) -> DataFrame:
    """Discover rows, skip known keys, set their status; a batch that runs again changes nothing.

    ``state`` is the folder of a scan that goes on from run to run: its stream reads only new files, and known keys are
    looked up in its state store.
    """
    folder = state or new_folder(spark, "scan")
    found = source(spark, path, max_files).select(key, (status if status is not None else F.lit("SCANNED")).alias("scan_status"))
    return drain_to_files(found.dropDuplicates([key]), f"{folder}/rows", f"{folder}/stream")


def progress(events: DataFrame, key: str) -> DataFrame:
    """Running totals of each scan: rows, failures, percent done, last failure, state.

    Views stand for rows that still wait, errors for failures with a message; a scan whose newest row is a signup is paused.
    """
    rows, failed, done = F.count("*"), F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") != "view")
    at = F.struct("ts", "event_id")
    message = F.concat(F.lit("row "), F.max_by("event_id", F.when(F.col("event_type") == "error", at)).cast("string"))
    state = scan_state(done == rows, F.max_by("event_type", at) == "signup", message)
    return events.groupBy(key).agg(rows.alias("rows"), failed.alias("failed"), F.max("value").alias("most"), F.floor(done * 100 / rows).cast("long").alias("percent"), message.alias("message"), state.alias("state"))


def scan_state(complete: Column, paused: Column, message: Column) -> Column:
    """A complete scan is complete whatever happened in it; a scan nothing is known of is idle."""
    return F.when(complete.isNull(), "IDLE").when(complete, "COMPLETE").when(paused, "PAUSED").when(message.isNotNull(), "ERROR").otherwise("SCANNING")


def complete(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The last complete result of an aggregating stream."""
    out = new_folder(spark, "complete")
    drain(stream, lambda batch, _: batch.write.mode("overwrite").parquet(out), "complete")
    return spark.read.parquet(out)


def dedup_stream(spark: SparkSession, events: DataFrame, key: str, state: str | None = None) -> DataFrame:
    """The first row of each key over all batches, however late; keys stay in the state store, so a batch never reads earlier ones."""
    folder = state or new_folder(spark, "dedup")
    return drain_to_files(events.dropDuplicates([key]), f"{folder}/rows", f"{folder}/stream")


def live_view(spark: SparkSession, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key of a change log, refreshed batch by batch."""
    out = new_folder(spark, "view")
    seen: list[str] = []

    def step(batch: DataFrame, number: int) -> None:
        if seen:
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(seen[-1]))
        path = f"{out}/v{number}"
        latest(batch, key, order).write.mode("overwrite").parquet(path)
        seen.append(path)

    drain(changes, step)
    return spark.read.parquet(seen[-1]) if seen else spark.createDataFrame([], changes.schema)


def stage_and_flush(stream: DataFrame, key: str, at: str, row_id: str, most: int = 50, seconds: int = 5, delay: int = 60) -> DataFrame:
    """Rows held in a buffer for each key until it has ``most`` of them or its interval of event time ends.

    Adds ``flush_second``, the end of the interval, and ``flush``, the buffer's number in it from 1. An interval is closed once
    a row is ``delay`` seconds past its end; what still waits when the stream is drained is flushed then. Rows that come after
    their interval was closed form further buffers of it, counted from 1 again. Rows without a time are flushed at once, with a
    null second. A buffer travels as a table of each batch, so a batch that runs again holds and flushes the same rows.
    """
    spark, columns = stream.sparkSession, stream.columns
    out = new_folder(spark, "staged")
    elapsed = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{at}`)")
    end = ((F.floor(elapsed / (seconds * 1_000_000)) + 1) * seconds).cast("long")
    place = F.row_number().over(W.partitionBy(key, "flush_second").orderBy(at, row_id))
    schema = stream.select("*", end.alias("flush_second"), F.lit(1).cast("long").alias("flush"), F.lit(True).alias("open")).schema
    last = []

    def step(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            before = spark.read.schema(schema).parquet(f"{out}/batch={number - 1:08d}")
            rows = rows.unionByName(before.filter("open").select(*columns))
        newest = rows.agg(F.max(elapsed)).first()[0]
        waits = F.coalesce(F.col("flush_second") > F.lit((newest or 0) // 1_000_000 - delay), F.lit(False))
        placed = rows.withColumn("flush_second", end).withColumn("flush", F.ceil(place / most).cast("long")).withColumn("open", waits)
        placed.write.mode("overwrite").partitionBy("open").parquet(f"{out}/batch={number:08d}")
        last[:] = [number]

    drain(stream, step)
    if not last:
        return spark.createDataFrame([], schema).drop("open")
    whole = spark.read.schema(schema.add("batch", "integer")).parquet(out)
    return whole.filter(~F.col("open") | (F.col("batch") == last[0])).select(*columns, "flush_second", "flush")
