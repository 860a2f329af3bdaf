"""Streaming and stateful operators, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborlens.plans.analogue import claims, table
from arborlens.plans.registry import query
from arborlens.plans.scalars import _SRC_SQL, _sources
from arborlens.streaming import claim_store, tables
from arborlens.streaming.ledger import settle
from arborlens.workspace import new_path

N = lambda: F.count(F.lit(1))


def _events(spark, d, files: int = 8, a_batch: int = 2):
    """The events as they would come, in several files one after another, two of them a micro-batch."""
    rows, path = table(spark, d, "events"), new_path(spark, "events")
    rows.repartitionByRange(files, "event_id").write.parquet(path)
    return tables.file_stream(spark, path, rows.schema, a_batch)


@query("SELECT event_id, user_id, event_type FROM events WHERE value > 1 AND event_type <> 'error'")
def str_micro_batch(spark, d):
    """Validated rows appended batch by batch."""
    path = new_path(spark, "stream")
    rows = _events(spark, d).where("value > 1 and event_type <> 'error'").select("event_id", "user_id", "event_type")
    tables.run_into(rows, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{path}/rows").select("event_id", "user_id", "event_type")


@query("SELECT poll, count(*) AS n, max(event_id) AS last FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS poll FROM events) GROUP BY poll")
def str_highwater_poll(spark, d):
    """Two polls of a folder that grows in between: the checkpoint, not a clock, holds what has been read."""
    path = new_path(spark, "poll")
    rows = table(spark, d, "events").select("event_id", "ts")
    out = []
    for poll in (1, 2):
        rows.where(f"event_id % 2 = {poll - 1}").write.mode("append").parquet(f"{path}/in")
        stream = tables.file_stream(spark, f"{path}/in", rows.schema)
        tables.run_into(stream, f"{path}/out{poll}", f"{path}/checkpoint")
        out.append(spark.read.schema("event_id long").parquet(f"{path}/out{poll}").agg(F.lit(poll).alias("poll"), N().alias("n"), F.max("event_id").alias("last")))
    return out[0].unionByName(out[1])


_STORE_SQL = _SRC_SQL + """SELECT c.taxon, c.claim_type, version, c.id, supersedes, is_current, rated,
round(CASE WHEN rated > 0 THEN CAST(round(CAST(0.5 * CASE WHEN n = 0 THEN 0.30 ELSE least(0.98, cred_db * (1 + least(0.18, (n - 1) * 0.06)) + least(0.10, (kinds - 1) * 0.02)) END + 0.25 * coalesce(agree, 0.70) + 0.2 AS DECIMAL(12, 8)), 2) AS DOUBLE) ELSE c.confidence END, 6) AS confidence
FROM (
  SELECT m.*, (SELECT count(*) FROM claims r WHERE r.id % 5 = 4 AND r.taxon = m.taxon AND r.claim_type = m.claim_type AND r.id > m.id AND r.id < coalesce(m.next, r.id + 1)) AS rated FROM (
    SELECT taxon, claim_type, id, confidence, row_number() OVER w AS version, lag(id) OVER w AS supersedes, lead(id) OVER w AS next, lead(id) OVER w IS NULL AS is_current
    FROM claims WHERE id % 5 <> 4 WINDOW w AS (PARTITION BY taxon, claim_type ORDER BY id)
  ) m
) c JOIN g ON g.id = c.id"""


@query(_STORE_SQL.replace("is_current, rated,", "is_current, rated > 0 AS rated,", 1))
def str_claim_store(spark, d):
    """Claims created, superseded and rated again by commands that come in three polls, each taken up from the checkpoint of
    the one before: every version, and which is current."""
    path, rows = new_path(spark, "store"), claims(spark, d)
    most = rows.agg(F.max("id")).first()[0] or 0
    i = F.col("id")
    commands = rows.select(
        i.alias("command"), F.when(i % 5 == 4, "recalculate").when(i % 2 == 0, "create").otherwise("supersede").alias("action"), "taxon", "claim_type", "claim_value", "confidence",
        _sources().alias("sources"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=i)).alias("at"),
    )
    for poll in range(3):
        commands.where(F.floor(F.col("command") * 3 / (most + 1)) == poll).write.mode("append").parquet(f"{path}/in")
        claim_store.run_commands(tables.file_stream(spark, f"{path}/in", commands.schema, 1000), path, f"{path}/checkpoint")
    state = claim_store.current_state(spark, path)
    rated = F.col("updated") > F.col("created")
    return state.select("taxon", "claim_type", "version", "id", "supersedes", "is_current", rated.alias("rated"), F.round("confidence", 6).alias("confidence"))


@query("SELECT id, claim_type FROM claims WHERE current")
def str_full_reload(spark, d):
    path = new_path(spark, "reload")
    for rows in (claims(spark, d), claims(spark, d).where("current")):
        rows.select("id", "claim_type").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("SELECT event_type AS endpoint, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def str_call_counters(spark, d):
    """Running counts; each batch writes the counts that it changed, and the last ones stand."""
    path = new_path(spark, "counters")
    rows = _events(spark, d).groupBy(F.col("event_type").alias("endpoint"), F.to_date("ts").alias("day")).agg(N().alias("n"))
    tables.run_into(rows, f"{path}/rows", f"{path}/checkpoint", mode="update")
    return tables.latest(spark, f"{path}/rows", ["endpoint", "day"], "endpoint string, day date, n long")


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def str_rate_limit(spark, d):
    """Calls of a key in fixed windows, over the limit. A watermark bounds the state of the stream."""
    path = new_path(spark, "rate")
    stream = _events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "60 days")
    rows = stream.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(N().alias("n"))
    rows = rows.select("user_id", F.col("w.start").alias("hour"), "n")
    tables.run_into(rows, f"{path}/rows", f"{path}/checkpoint", mode="update")
    done = tables.latest(spark, f"{path}/rows", ["user_id", "hour"], "user_id long, hour timestamp, n long")
    return done.where("n > 1").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events")
def str_rate_limit_sliding(spark, d):
    """Calls of a key within the last 59 seconds of each call."""
    w = Window.partitionBy("user_id").orderBy(F.col("t")).rangeBetween(-59_000_000, 0)
    rows = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("event_id", N().over(w).alias("n"))


@query("SELECT user_id AS task, arg_max(event_type, (ts, event_id)) AS state, count(*) AS changes FROM events GROUP BY 1")
def str_queue_fsm(spark, d):
    """The state of each task is its last event's; state is one row a task."""
    path = new_path(spark, "queue")
    rows = _events(spark, d).groupBy(F.col("user_id").alias("task")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), N().alias("changes"))
    tables.run_into(rows, f"{path}/rows", f"{path}/checkpoint", mode="update")
    return tables.latest(spark, f"{path}/rows", ["task"], "task long, state string, changes long")


@query()
def str_tx_ledger(spark, d):
    moves = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, 100).otherwise(-70).alias("amount"))
    return settle(moves, "o_custkey", "amount", "o_orderkey", "o_orderdate", "o_orderkey")


@query("SELECT CAST(count(*) AS BIGINT) AS rows FROM events")
def str_sse_progress(spark, d):
    path = new_path(spark, "progress")
    tables.run_into(_events(spark, d).select("event_id"), f"{path}/rows", f"{path}/checkpoint")
    return tables.progress(spark, f"{path}/rows").agg(F.sum("rows").alias("rows"))
