"""Streaming queries (family W): the stream runs to the end of its input, the SQL is its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadloom.operators import leads as L
from leadloom.operators import queue as K
from leadloom.plans.catalog_outreach import SQL_EVENTS, queue_events
from leadloom.plans.registry import query, table
from leadloom.rules.outreach import KNOWN_STATUSES, TRANSITIONS
from leadloom.session import ensure_checkpoint_dir
from leadloom.sources.store import BucketedTable, GrowingTable
from leadloom.streaming import jobs as W

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 100).parquet(sf_dir)


_TARGET = "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'APPROVED' WHEN 'click' THEN 'READY_TO_SEND' WHEN 'purchase' THEN 'SENT' ELSE 'FAILED' END"
_QUEUE = ["event_id", "cast(ts as timestamp) as ts", "user_id as item_id", f"{_TARGET} as target"]


@query(
    "w1_stream_leads",
    "select 'u' || user_id || '.io' as identity, min(event_id) as pos from events where event_type <> 'error' group by 1",
)
def w1(spark, sf_dir):
    def to_leads(batch):
        return batch.filter("event_type <> 'error'").selectExpr(
            "event_id as pos", "'n' as name", "'https://www.U' || cast(user_id as string) || '.io/' as website", "'events' as source", "1 as source_rank"
        )

    store, checkpoint = _folder(spark, "leads"), _folder(spark, "ckpt")
    W.stream_leads(_event_stream(spark, sf_dir), store, checkpoint, to_leads).awaitTermination()
    return spark.read.parquet(store).select("identity", "pos")


def _in_files(spark, sf_dir, parts: int):
    """The events as a stream of several files, one a batch."""
    landing = _folder(spark, "landed")
    table(spark, sf_dir, "events").repartitionByRange(parts, "event_id").write.parquet(landing)
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(landing)


@query(
    "w1_stream_leads_growing",
    "select 'e' || (event_id * 7919 % 4001) || '.io' as identity, min(event_id) as pos from events where event_type <> 'error' group by 1",
)
def w1_growing(spark, sf_dir):
    """Three batches into a store whose buckets split at 200 identities. Files are read in any order, so of an identity's
    rows the first batch's stays; the query keeps those batches in the order of the events."""
    def to_leads(batch):
        return batch.filter("event_type <> 'error'").selectExpr(
            "event_id as pos", "'n' as name", "'https://www.E' || cast(event_id * 7919 % 4001 as string) || '.io/' as website", "'events' as source", "1 as source_rank"
        )

    store, events = _folder(spark, "leads"), table(spark, sf_dir, "events")
    write = W.lead_batch_writer(store, to_leads, max_rows=200)
    third = events.selectExpr("max(event_id) div 3 + 1 as n").first()["n"]
    for batch in range(3):
        write(events.filter(F.expr(f"event_id div {third} = {batch}")), batch)
    return GrowingTable(spark, store, ["identity"], 200, replace=False).read().select("identity", "pos")


@query("w4_stream_upsert_growing", "select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2")
def w4_growing(spark, sf_dir):
    target = GrowingTable(spark, _folder(spark, "upsert"), ["user_id", "event_type"], max_rows=100)
    merged = [F.desc("event_id")]
    source = _in_files(spark, sf_dir, 3).select("user_id", "event_type", "value", "event_id")

    def write(batch, batch_id):  # a later batch may hold earlier events: only newer ones count
        old = target.read(batch_id, target.with_bucket(batch.select("user_id", "event_type"), batch_id))
        fresh = batch if old is None else batch.join(
            old.select("user_id", "event_type", F.col("event_id").alias("_seen")), ["user_id", "event_type"], "left").filter("_seen is null or event_id > _seen").drop("_seen")
        W.upsert_batch_writer(target, merged)(fresh, batch_id)

    source.writeStream.foreachBatch(write).option("checkpointLocation", _folder(spark, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    return target.read().select("user_id", "event_type", "event_id", "value")


_DAY = "time_bucket(interval 1 day, ts, timestamp '2000-01-01 18:30:00')"


@query(
    "w2_status_counts",
    f"select strftime({_DAY}, '%Y-%m-%d %H:%M') as day_start, target as status, count(*) as n from {SQL_EVENTS} group by 1, 2",
)
def w2(spark, sf_dir):
    return W.status_counts(queue_events(spark, sf_dir)).withColumn("day_start", F.date_format("day_start", "yyyy-MM-dd HH:mm"))


@query(
    "w2_stream_status_counts",
    f"""select strftime(d, '%Y-%m-%d %H:%M') as day_start, status, n from (select {_DAY} as d, target as status, count(*) as n from {SQL_EVENTS} group by 1, 2)
    where d + interval 1 day <= (select max(ts) - interval 1 hour from events)""",
)
def w2_stream(spark, sf_dir):
    out = _folder(spark, "counts")
    W.run_to_table(W.status_counts(_event_stream(spark, sf_dir).selectExpr(*_QUEUE)), out, _folder(spark, "ckpt"))
    return spark.read.parquet(out).withColumn("day_start", F.date_format("day_start", "yyyy-MM-dd HH:mm"))


def _sql_replay() -> str:
    """Step by step: the earliest legal event after the last move."""
    parts = ["with s0 as (select item_id, 'PENDING' as status, timestamp '1900-01-01' as ts, cast(-1 as bigint) as event_id, 0 as accepted, count(*) as events from " + SQL_EVENTS + " group by 1)"]
    edges = ", ".join(f"'{a}>{b}'" for a, b in TRANSITIONS)
    for i in range(3):
        parts.append(
            f"n{i} as (select e.item_id, min(row(e.ts, e.event_id, e.target)) as r from {SQL_EVENTS} e join s{i} s on s.item_id = e.item_id where row(e.ts, e.event_id) > row(s.ts, s.event_id) and s.status || '>' || e.target in ({edges}) group by 1)"
        )
        parts.append(
            f"s{i + 1} as (select s.item_id, case when r is null then s.status else r[3] end as status, case when r is null then s.ts else r[1] end as ts, case when r is null then s.event_id else r[2] end as event_id, s.accepted + case when r is null then 0 else 1 end as accepted, events from s{i} s left join n{i} n on n.item_id = s.item_id)"
        )
    return ", ".join(parts) + " select item_id, status, cast(accepted as int) as accepted, events - accepted as rejected, cast(case when status = 'FAILED' then 1 else 0 end as int) as retry_count from s3"


SQL_REPLAY = _sql_replay()


@query("w3_replay_queue", SQL_REPLAY)
def w3(spark, sf_dir):
    return K.replay_events(queue_events(spark, sf_dir)).drop("moved_at")


@query("w3_replay_stream", SQL_REPLAY)
def w3_stream(spark, sf_dir):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    W.use_rocksdb(spark)
    out = _folder(spark, "replay")
    try:
        W.run_to_table(W.replay_stream(_event_stream(spark, sf_dir).selectExpr(*_QUEUE)), out, _folder(spark, "ckpt"), "update")
    finally:
        spark.conf.set(key, before)
    rows = spark.read.parquet(out)
    last = rows.groupBy("item_id").agg(F.max_by(F.struct("status", "accepted", "rejected", "retry_count"), "batch_id").alias("s"))
    return last.select("item_id", "s.*")


@query("w3_event_time_stream", SQL_REPLAY)
def w3_event_time(spark, sf_dir):
    """The events in shuffled files, one file a batch: in event time the result is that of the batch job."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    landing, out, checkpoint = _folder(spark, "shuffled"), _folder(spark, "replay"), _folder(spark, "ckpt")
    events = queue_events(spark, sf_dir).select("event_id", "ts", "item_id", "target")
    for part in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(landing)
    schema = "event_id long, ts timestamp, item_id long, target string"
    W.use_rocksdb(spark)
    try:
        for heartbeat in (False, True):
            if heartbeat:
                end = events.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 90 days")).alias("ts"))
                end.select("event_id", "ts", F.lit(-1).cast("long").alias("item_id"), F.lit(None).cast("string").alias("target")).coalesce(1).write.mode("append").parquet(landing)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
            W.run_to_table(W.replay_in_event_time(stream, delay_s=40 * 86_400, slot_s=7 * 86_400), out, checkpoint, "update")
    finally:
        spark.conf.set(key, before)
    states = spark.read.parquet(out).where("not late")
    last = states.groupBy("item_id").agg(F.max_by(F.struct("status", "accepted", "rejected", "retry_count"), F.col("accepted") + F.col("rejected")).alias("s"))
    return last.select("item_id", "s.*")


@query("w4_stream_upsert", "select user_id, arg_max(value, event_id) as value, arg_max(event_type, event_id) as event_type from events group by 1")
def w4(spark, sf_dir):
    target = BucketedTable(spark, _folder(spark, "upsert"), ["user_id"])
    source = _event_stream(spark, sf_dir).select("user_id", "value", "event_type", "event_id")
    W.stream_upsert(source, target, [F.desc("event_id")], _folder(spark, "ckpt")).awaitTermination()
    return target.read().select("user_id", "value", "event_type")


@query(
    "w5_stream_known_filter",
    f"select event_id as pos from events where 'u' || user_id || '.io' not in (select 'u' || o_custkey || '.io' from orders where case o_orderpriority when '1-URGENT' then 'SENT' when '2-HIGH' then 'PENDING' else 'FAILED' end in ({', '.join(repr(s) for s in KNOWN_STATUSES)}))",
)
def w5(spark, sf_dir):
    queue = table(spark, sf_dir, "orders").selectExpr(
        "'u' || cast(o_custkey as string) || '.io' as company_id", "case o_orderpriority when '1-URGENT' then 'SENT' when '2-HIGH' then 'PENDING' else 'FAILED' end as status"
    )
    leads = _event_stream(spark, sf_dir).selectExpr("event_id as pos", "'https://www.u' || cast(user_id as string) || '.io' as website")
    out = _folder(spark, "known")
    W.run_to_table(W.stream_known_filter(leads, queue), out, _folder(spark, "ckpt"))
    return spark.read.parquet(out).select("pos")


_LATEST = "select event_type as job, strftime(arg_max(ts, row(ts, event_id)), '%Y-%m-%d %H:%M:%S') as ts, arg_max(event_id % 2 = 0, row(ts, event_id)) as success, arg_max(value, row(ts, event_id)) as value, count(*) as runs from events group by 1"


def _runs(df):
    return df.selectExpr("event_type as job", "cast(ts as timestamp) as ts", "event_id % 2 = 0 as success", "value", "event_id")


def _shown(df):
    return df.select("job", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "success", "value", "runs")


@query("w6_latest_job_status", _LATEST)
def w6(spark, sf_dir):
    return _shown(W.latest_job_status(_runs(table(spark, sf_dir, "events"))))


@query("w6_stream_latest_job_status", _LATEST)
def w6_stream(spark, sf_dir):
    out = _folder(spark, "jobs")
    W.run_to_table(W.latest_job_status(_runs(_event_stream(spark, sf_dir))), out, _folder(spark, "ckpt"), "complete")
    rows = spark.read.parquet(out)
    return _shown(rows.groupBy("job").agg(F.max_by(F.struct("ts", "success", "value", "runs"), "batch_id").alias("s")).select("job", "s.*"))


@query(
    "w1_batch_twin",
    "select 'u' || user_id || '.io' as identity, min(event_id) as pos from events group by 1",
)
def w1_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id as pos", "'n' as name", "'u' || cast(user_id as string) || '.io' as website", "'events' as source", "1 as source_rank")
    return L.dedupe_leads(L.validate_leads(rows)).select("identity", "pos")
