"""Streams of change events: debouncing, quiet periods, sessions, deduplication.

Event times without a zone are read as UTC. Every operator takes and returns a
streaming DataFrame; ``drained`` runs one over all input there is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.storage import remove, settled, shared_folder


def table_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int = 100) -> DataFrame:
    """A table's file or folder as a stream; a bounded number of files a trigger keeps batches small."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def with_event_time(events: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def session_counts(events: DataFrame, key: str, ts: str, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Per key and session: first and last event and their number. A session is
    given once the watermark has passed its end."""
    timed = with_event_time(events, ts, late)
    out = timed.groupBy(F.col(key), F.session_window(ts, gap).alias("_w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return out.drop("_w")


def quiet_batches(events: DataFrame, key: str, ts: str, item: str, quiet: str = "1 second", late: str = "1 hour") -> DataFrame:
    """Per key the items that arrive without a pause of ``quiet``, in one sorted
    list per batch. A batch is given once the watermark has passed its pause."""
    timed = with_event_time(events, ts, late)
    by = timed.groupBy(F.col(key), F.session_window(ts, quiet).alias("_w"))
    return by.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.array_sort(F.collect_list(item)).alias("items")).drop("_w")


def tumbling_counts(events: DataFrame, ts: str, width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    timed = with_event_time(events, ts, late)
    out = timed.groupBy(F.window(ts, width).alias("_w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("_w.start").alias("window_start"), *by, "n")


def first_seen(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """One event per key within the watermark: work in flight is not queued twice."""
    return with_event_time(events, ts, late).dropDuplicatesWithinWatermark(keys)


def debounce(events: DataFrame, key: str, ts: str, order: str, gap_micros: int, forget_ms: int = 5000) -> DataFrame:
    """``(key, order)`` of the events at least ``gap_micros`` after the last one
    kept for their key. The state of a key is one time, dropped ``forget_ms``
    after the watermark has passed it. Inside a micro-batch events go by time."""

    def step(_, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(groups)).sort_values(["t", "o"])
        last = state.get[0] if state.exists else None
        kept = []
        for k, t, o in rows[["k", "t", "o"]].itertuples(index=False):
            if last is None or t - last >= gap_micros:
                kept.append((k, o))
                last = t
        if last is not None:
            state.update((int(last),))
            state.setTimeoutTimestamp(max(int(last) // 1000, state.getCurrentWatermarkMs()) + max(forget_ms, gap_micros // 1000))
        yield pd.DataFrame(kept, columns=["k", "o"])

    timed = with_event_time(events, ts).select(F.col(key).cast("string").alias("k"), F.unix_micros(ts).alias("t"), F.col(order).alias("o"), ts)
    out = timed.groupBy("k").applyInPandasWithState(step, "k string, o bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("k").alias(key), F.col("o").alias(order))


def _stored(spark: SparkSession, run) -> DataFrame:
    """What ``run(folder)`` leaves in ``folder``/rows, settled; the folder goes in any case."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    try:
        return settled(run(at))
    finally:
        remove(spark, at)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that ``stream`` gives for the input there is, as a stored table."""
    spark = stream.sparkSession

    def run(at):
        sink = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log")
        sink.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")

    return _stored(spark, run)


def drained_complete(stream: DataFrame) -> DataFrame:
    """The whole result of an aggregation over the input there is; each trigger
    replaces the stored table."""
    spark = stream.sparkSession

    def run(at):
        keep = lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/rows")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/log").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")

    return _stored(spark, run)


def in_batches(spark: SparkSession, rows: DataFrame, by: str, files: int):
    """Gives ``run(use)``: ``use(stream, folder)`` over ``rows`` as a stream of ``files``
    micro-batches in the order of ``by``; its result is settled and the folder goes."""

    def run(use) -> DataFrame:
        def filled(at):
            dealt = settled(rows.repartitionByRange(files, by).withColumn("_batch", F.spark_partition_id()))
            for k in range(files):  # one after the other: a stream takes files by their age
                dealt.where(F.col("_batch") == k).drop("_batch").write.mode("append").parquet(f"{at}/in")
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
            return use(stream, at)

        return _stored(spark, filled)

    return run


def run_batches(stream: DataFrame, write, log: str) -> None:
    """All input there is through ``write(batch, batch_id)``."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def batch_writer(path: str):
    """A ``foreachBatch`` function that commits each batch as a whole into
    ``path``: a batch that runs again replaces what it wrote before."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def persisted(stream: DataFrame) -> DataFrame:
    """All rows of ``stream`` through ``batch_writer``, with the batch_id that wrote them."""
    spark = stream.sparkSession

    def run(at):
        stream.writeStream.foreachBatch(batch_writer(f"{at}/rows")).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.withColumn("batch_id", F.lit(0)).schema).parquet(f"{at}/rows")

    return _stored(spark, run)
