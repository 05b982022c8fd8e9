"""Structured Streaming jobs over the landing folders and event tables (family W)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.functions.urls import DEFAULT_RULES, UrlRules
from leadloom.operators.leads import validate_leads
from leadloom.operators.ordering import first_per_key
from leadloom.operators.queue import company_keys
from leadloom.operators.rows import unnest
from leadloom.operators.store import upsert
from leadloom.rules.outreach import KNOWN_STATUSES, TRANSITIONS
from leadloom.sources.store import BucketedTable, GrowingTable
from leadloom.streaming import state as state_module

cloudpickle.register_pickle_by_value(state_module)

BatchFn = Callable[[DataFrame, int], None]


def read_landing_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New payload files only; folder columns as in the batch reader."""
    schema = "value string, query_rank int, request_pos int, label string"
    raw = spark.readStream.schema(schema).option("wholetext", True).option("maxFilesPerTrigger", max_files).text(path)
    return raw.withColumnRenamed("value", "payload")


def lead_batch_writer(
    store_path: str, to_leads: Callable[[DataFrame], DataFrame], rules: UrlRules = DEFAULT_RULES, max_rows: int | None = None
) -> BatchFn:
    """Validated leads whose site identity no earlier batch has, in buckets of that identity.

    The store is the state, so nothing grows in memory; a batch reads the identities of its own buckets only, and a
    repeated batch overwrites its own partitions. With ``max_rows`` the buckets split as the store grows
    (``GrowingTable``), otherwise there are 64.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if max_rows is None:
            store = BucketedTable(batch.sparkSession, store_path, ["identity"], replace=False)
        else:
            store = GrowingTable(batch.sparkSession, store_path, ["identity"], max_rows, replace=False)
        leads = validate_leads(to_leads(batch), rules)
        first = store.with_bucket(first_per_key(leads, ["identity"], ["source_rank", "pos"]), batch_id).persist()
        try:
            known = store.read(batch_id, first)
            fresh = first if known is None else first.join(known.select("bucket", "identity"), ["bucket", "identity"], "left_anti")
            store.write(fresh, batch_id)
        finally:
            first.unpersist()

    return write


def stream_leads(
    raw: DataFrame, store_path: str, checkpoint: str, to_leads: Callable[[DataFrame], DataFrame], max_rows: int | None = None
) -> StreamingQuery:
    return (
        raw.writeStream.foreachBatch(lead_batch_writer(store_path, to_leads, max_rows=max_rows))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def status_counts(events: DataFrame, status: str = "target", delay: str = "1 hour", start: str = "18 hours 30 minutes") -> DataFrame:
    """Rows per status and day in the display zone (UTC+5:30 days start at 18:30 UTC); late rows are cut off.

    The same job in batch and in a stream.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    watermarked = timed.withWatermark("ts", delay)
    return (
        watermarked.groupBy(F.window("ts", "1 day", startTime=start), F.col(status).alias("status"))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("day_start"), "status", "n")
    )


def replay_stream(events: DataFrame, edges: Sequence[tuple[str, str]] = TRANSITIONS, stale_ms: int | None = None) -> DataFrame:
    """Current state per item after every micro-batch (update mode)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if stale_ms is not None:
        timed = timed.withWatermark("ts", "1 hour")
    return timed.groupBy("item_id").transformWithStateInPandas(
        statefulProcessor=state_module.QueueReplay(tuple(edges), stale_ms=stale_ms),
        outputStructType=state_module.OUTPUT_SCHEMA,
        outputMode="Update",
        timeMode="EventTime" if stale_ms is not None else "None",
    )


def replay_in_event_time(
    events: DataFrame, edges: Sequence[tuple[str, str]] = TRANSITIONS, start: str = "PENDING",
    delay_s: int = 3600, late_s: int = 86_400, slot_s: int = 60,
) -> DataFrame:
    """State per item (item_id, event_id, ts, target) in event time: the rows of the batch twin whatever the batches.

    An event is applied once the stream is ``delay_s`` seconds beyond its slot of ``slot_s`` seconds, so events out of
    order within the delay fall into place. One that comes later, but within ``late_s`` more, is a row of the side output
    (late is true); Spark drops and counts those behind that. Each release gives the item's state after it; the last one
    is that with most events (accepted + rejected). What waits at the end of a stream is released by a row without
    target and a later ts (a heartbeat). Needs ``use_rocksdb``.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{delay_s + late_s} seconds")
    return timed.groupBy("item_id").transformWithStateInPandas(
        statefulProcessor=state_module.EventTimeReplay(tuple(edges), start, slot_s * 1000, late_s * 1000),
        outputStructType=state_module.EVENT_TIME_SCHEMA,
        outputMode="Update",
        timeMode="EventTime",
    )


def use_rocksdb(spark: SparkSession) -> None:
    """State store needed by the stateful replay."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def upsert_batch_writer(table: BucketedTable | GrowingTable, order: Sequence[Column | str]) -> BatchFn:
    """Upsert every micro-batch into the buckets of its keys; other buckets are neither read nor written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        keys = [*table.keys, "bucket"]
        new = table.with_bucket(first_per_key(batch, table.keys, order), batch_id).persist()
        try:
            old = table.read(batch_id, new)
            table.write(new if old is None else upsert(old, new, keys, order).drop("action"), batch_id)
        finally:
            new.unpersist()

    return write


def stream_upsert(source: DataFrame, table: BucketedTable | GrowingTable, order: Sequence[Column | str], checkpoint: str) -> StreamingQuery:
    return (
        source.writeStream.foreachBatch(upsert_batch_writer(table, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_known_filter(leads: DataFrame, queue: DataFrame) -> DataFrame:
    """Leads without a live queue row: stream-static anti join on the canonical site key.

    The static side is read once per query; inside ``foreachBatch`` it is read per batch.
    """
    active = (
        queue.filter(F.col("status").isin(*KNOWN_STATUSES)).select(F.col("company_id").cast("string").alias("_key")).distinct()
    )
    keyed = leads.withColumn("_key", F.get(company_keys(F.col("website")), F.lit(0)))
    return keyed.join(active, "_key", "left_anti").drop("_key")


def known_filter_writer(queue_path: str, out_path: str, key: str = "pos") -> BatchFn:
    """The same filter per batch against the current queue, over every lookup key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        queue = batch.sparkSession.read.parquet(queue_path)
        active = queue.filter(F.col("status").isin(*KNOWN_STATUSES)).select(F.col("company_id").cast("string").alias("_key")).distinct()
        blocked = unnest(batch, company_keys(F.col("website")), "_key", [key]).join(active, "_key", "left_semi").select(key).distinct()
        batch.join(blocked, key, "left_anti").write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return write


def latest_job_status(runs: DataFrame) -> DataFrame:
    """Last run per job, in batch or as a stateful aggregation (update or complete mode)."""
    last = F.max_by(F.struct("ts", "success", "value"), F.struct("ts", "event_id")).alias("_last")
    return runs.groupBy("job").agg(last, F.count("*").alias("runs")).select("job", "_last.ts", "_last.success", "_last.value", "runs")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream to the end of its input and keep its output as Parquet.

    Update and complete output goes through ``foreachBatch``, one folder per batch.
    """
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
