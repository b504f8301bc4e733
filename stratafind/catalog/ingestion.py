"""Queries of the ingestion loop: status as a stateful stream, keyed merges."""

import uuid

from pyspark.sql import functions as F

from ..common import shared_folder
from ..operators.buckets import BucketTable
from ..registry import query
from ..streaming import ingest, status as S
from .text import FILES, paths

# ---- status: the machine of each path over the whole log, one event after another

KIND = "CASE WHEN event_type IN ('signup', 'click') THEN 'scan' WHEN event_type = 'view' THEN 'start' WHEN event_type = 'purchase' THEN 'finish' WHEN event_type = 'error' THEN 'fail' END"
T, R = S.TIMEOUT_MS, S.RETRY_MS


def elapsed_sql(state: str, now: str) -> str:
    """The timers as SQL: a struct of status, since, attempts at a time."""
    return f"""CASE WHEN {state}.status = 'processing' AND {state}.since + {T} + {R} <= {now} THEN {{'status': 'pending', 'since': {state}.since + {T} + {R}, 'attempts': {state}.attempts + 1}}
        WHEN {state}.status = 'processing' AND {state}.since + {T} <= {now} THEN {{'status': 'error', 'since': {state}.since + {T}, 'attempts': {state}.attempts}}
        WHEN {state}.status = 'error' AND {state}.since + {R} <= {now} THEN {{'status': 'pending', 'since': {state}.since + {R}, 'attempts': {state}.attempts + 1}} ELSE {state} END"""


STATUS = f"""WITH RECURSIVE log AS MATERIALIZED (SELECT user_id::VARCHAR AS path, epoch_us(ts) // 1000 AS ms, {KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    run AS (SELECT path, 0::BIGINT AS r, {{'status': '', 'since': 0::BIGINT, 'attempts': 0::INT}} AS s, -1::BIGINT AS seen FROM (SELECT DISTINCT path FROM log)
        UNION ALL SELECT path, r, CASE WHEN kind = 'scan' AND e.status IN ('', 'error') THEN {{'status': 'pending', 'since': ms, 'attempts': e.attempts + 1}} WHEN kind = 'start' AND e.status = 'pending' THEN {{'status': 'processing', 'since': ms, 'attempts': e.attempts}}
            WHEN kind = 'finish' AND e.status = 'processing' THEN {{'status': 'done', 'since': ms, 'attempts': e.attempts}} WHEN kind = 'fail' AND e.status = 'processing' THEN {{'status': 'error', 'since': ms, 'attempts': e.attempts}} ELSE e END, ms
        FROM (SELECT log.path, log.r, kind, ms, {elapsed_sql('run.s', 'ms')} AS e FROM run JOIN log ON log.path = run.path AND log.r = run.r + 1)),
    ended AS (SELECT path, s, greatest(seen, (SELECT max(epoch_us(ts)) // 1000 - {S.DELAY_MS} FROM events)) AS now FROM run QUALIFY row_number() OVER (PARTITION BY path ORDER BY r DESC) = 1)
    SELECT path, e.status AS status, e.since AS since_ms, e.attempts AS attempts FROM (SELECT path, {elapsed_sql('s', 'now')} AS e FROM ended) WHERE e.status <> ''"""


@query("inc_status_stream", STATUS)
def inc_status_stream(t, spark):
    """The log as a stream through the status machine, with its timers; the last change of each path."""
    folder = f"{shared_folder(spark)}/status-{uuid.uuid4().hex}"
    log = t.stream("events").select(F.col("user_id").cast("string").alias("path"), "ts", "event_id", S.kind_of(F.col("event_type")).alias("kind"))
    S.follow(log, folder)
    return S.current(spark.read.schema(S.OUT).parquet(f"{folder}/changes"))


# ---- merges: orders as a keyed table, one in a hundred changed

UPSERT_BUCKETS = 256
CHANGED = "o_orderkey % 100 = 0"


def upserted(t, spark):
    table = BucketTable(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", "o_orderkey", UPSERT_BUCKETS)
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table.merge(orders)
    table.merge(orders.where(CHANGED).withColumn("o_orderstatus", F.lit("changed")))
    return table


query("inc_upsert", f"SELECT o_orderkey, CASE WHEN {CHANGED} THEN 'changed' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")(lambda t, s: upserted(t, s).read())
BUCKET = f"(('0x' || left(md5(o_orderkey::VARCHAR), 8))::BIGINT % {UPSERT_BUCKETS})::INT"
# which merge wrote a bucket's live files: the second only where one of its keys falls
query("inc_upsert_buckets", f"SELECT {BUCKET} AS bucket, max(CASE WHEN {CHANGED} THEN 2 ELSE 1 END)::INT AS version FROM orders GROUP BY 1")(lambda t, s: upserted(t, s).written())


# ---- files to their end: load, clean, categorise, summarise, merge; one that cannot be read ends in ERROR

#: The file of the smallest id is broken: its first byte is no UTF-8.
BROKEN = "doc_id = (SELECT min(doc_id) FROM documents)"


def raw_files(docs, broken):
    """Documents as files of bytes; broken(doc_id, first): the one whose bytes are no text."""
    bad = docs.join(F.broadcast(broken), F.col("doc_id") == F.col("first"), "left")
    content = F.when(F.col("first").isNotNull(), F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return paths(bad).select("path", content.alias("content")).withColumn("sha256", F.sha2("content", 256))


def smallest(t):
    return t("documents").agg(F.min("doc_id").alias("first"))


NAMED = f"SELECT path, {BROKEN} AS broken, sha, lower(replace(source, ' ', '_')) AS category FROM {FILES}"


@query("inc_process_file", f"SELECT path, category, CASE WHEN broken THEN 'ERROR' ELSE 'DONE' END AS status, CASE WHEN broken THEN 'not UTF-8' END AS error FROM ({NAMED})")
def inc_process_file(t, spark):
    """Each file to its end; a repeated run changes nothing."""
    table = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    found = raw_files(t("documents"), smallest(t))
    for _ in range(2):
        ingest.merge(spark, ingest.processed(found), table)
    return ingest.current(spark, table).select("path", "category", "status", "error")


@query("inc_scan_loop", f"SELECT path, 'DONE' AS status, CASE WHEN broken THEN 2 ELSE 1 END AS \"turn\" FROM ({NAMED})")
def inc_scan_loop(t, spark):
    """Three turns of the scan: the broken file ends in ERROR, is put right and queued again; what is DONE is not taken again."""
    table = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    nothing = smallest(t).where("false")
    for turn in (1, 2, 3):
        found = raw_files(t("documents"), smallest(t) if turn == 1 else nothing)
        known = ingest.current(spark, table)
        made = ingest.processed(ingest.queued(found, known)).withColumn("turn", F.lit(turn))
        ingest.merge(spark, made, table)
    return ingest.current(spark, table).select("path", "status", "turn")


@query("inc_worker_pool", f"SELECT category, count(*) FILTER (NOT broken) AS done, count(*) FILTER (broken) AS failed FROM ({NAMED}) GROUP BY category")
def inc_worker_pool(t, spark):
    """The documents as a stream of files, two at a time, each batch merged once: how many ended how, by category."""
    name = f"{shared_folder(spark)}/pool-{uuid.uuid4().hex}"
    first = smallest(t)

    def take(batch, number):
        ingest.scan_once(spark, raw_files(batch, first), f"{name}/table", token=("pool", number))

    t.stream("documents", maxFilesPerTrigger=2).writeStream.foreachBatch(take).option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start().awaitTermination()
    ended = ingest.current(spark, f"{name}/table")
    return ended.groupBy("category").agg(F.count_if(F.col("status") == "DONE").alias("done"), F.count_if(F.col("status") == "ERROR").alias("failed"))
