"""Streams of more micro-batches than a query's reports keep."""

from pyspark.sql import functions as F

from arborlens.plans import stream_queries
from arborlens.plans.analogue import table
from arborlens.streaming import tables


def test_progress_counts_every_batch(spark, tmp_path):
    spark.range(18).selectExpr("id AS event_id").repartition(9).write.parquet(str(tmp_path / "events.parquet"))  # four batches of two files
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(kept, 1)
    try:
        assert [r.rows for r in stream_queries.str_sse_progress(spark, str(tmp_path)).collect()] == [18]
    finally:
        spark.conf.unset(kept)


def test_counts_carry_over_batches(spark, data, tmp_path):
    """State of keys that come in several micro-batches: every batch writes what it changed, the last one stands."""
    rows = stream_queries._events(spark, data).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    tables.run_into(rows, f"{tmp_path}/rows", f"{tmp_path}/checkpoint", mode="update")
    written = spark.read.parquet(f"{tmp_path}/rows")
    assert written.select("batch").distinct().count() >= 4 and written.groupBy("event_type").count().where("count > 2").count() > 0
    got = {r.event_type: r.n for r in tables.latest(spark, f"{tmp_path}/rows", ["event_type"], "event_type string, n long").collect()}
    assert got == {r.event_type: r["count"] for r in table(spark, data, "events").groupBy("event_type").count().collect()}


def test_watermark_drops_late_rows_only(spark, tmp_path):
    """A row behind the watermark counts no more; one that is late but within it does."""
    at = ["2024-01-01 10:00", "2024-01-01 10:30", "2024-01-05 00:00", "2024-01-01 10:10", "2024-01-04 23:50"]
    for k, ts in enumerate(at):
        spark.createDataFrame([(1, ts)], "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = tables.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1).withWatermark("ts", "1 day")
        rows = stream.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("hour"), "n")
        tables.run_into(rows, f"{tmp_path}/rows", f"{tmp_path}/checkpoint", mode="update")
    got = {str(r.hour): r.n for r in tables.latest(spark, f"{tmp_path}/rows", ["user_id", "hour"], "user_id long, hour timestamp, n long").collect()}
    assert got == {"2024-01-01 10:00:00": 2, "2024-01-05 00:00:00": 1, "2024-01-04 23:00:00": 1}


def _commands(spark, rows):
    from arborlens.streaming import claim_store

    at = lambda n: f"2024-01-01 00:00:{n:02d}"
    data = [(c, a, t, k, v, 0.5, [("u", "db", 0.9)], at(n)) for c, a, t, k, v, n in rows]
    frame = spark.createDataFrame(data, claim_store.COMMAND.replace("at timestamp_ntz", "at string"))
    return frame.withColumn("at", F.col("at").cast("timestamp_ntz"))


def test_claim_store_restarts_and_replays(spark, tmp_path):
    """A batch that is worked off again after its commit was lost, and a command that comes twice, change nothing."""
    import glob
    import os

    from arborlens.streaming import claim_store

    polls = [
        [(1, "create", 7, "h", "a", 1), (2, "create", 8, "h", "b", 2), (3, "recalculate", 7, "h", None, 3), (4, "supersede", 7, "h", "c", 4)],
        [(4, "supersede", 7, "h", "c", 4), (5, "supersede", 7, "h", "d", 5), (6, "recalculate", 9, "h", None, 6), (7, "create", None, "h", "x", 7), (8, "drop", 8, "h", "x", 8)],
    ]
    for rows in polls:
        frame = _commands(spark, rows)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        claim_store.run_commands(tables.file_stream(spark, f"{tmp_path}/in", frame.schema), str(tmp_path), f"{tmp_path}/checkpoint")
    show = lambda: {tuple(r) for r in claim_store.current_state(spark, str(tmp_path)).select("taxon", "version", "id", "claim_value", "confidence", "supersedes", "is_current").collect()}
    # one source of .9: half of it, a quarter of .7, a quarter of .8
    want = {(7, 1, 1, "a", 0.83, None, False), (7, 2, 4, "c", 0.5, 1, False), (7, 3, 5, "d", 0.5, 4, True), (8, 1, 2, "b", 0.5, None, True)}
    assert show() == want
    for commit in glob.glob(f"{tmp_path}/checkpoint/commits/1") + glob.glob(f"{tmp_path}/checkpoint/commits/.1.crc"):
        os.remove(commit)
    claim_store.run_commands(tables.file_stream(spark, f"{tmp_path}/in", frame.schema), str(tmp_path), f"{tmp_path}/checkpoint")
    assert show() == want


def test_chain_of_digests(spark):
    """One altered record, one lost one: they and all that follow in their chain fail, other chains hold."""
    import hashlib

    from arborlens.operators import chains

    rows = [(k, i, f"text {k} {i}") for k in (1, 2, None) for i in range(6)]
    frame = spark.createDataFrame(rows, "k int, i int, content string").repartition(4)
    archived = chains.chained(frame, "k", ["i"], "content")
    want = chains.START
    for r in archived.where("k = 1").orderBy("i").collect():
        assert r.previous == want
        want = hashlib.sha256(f"{want}:{r.content}".encode()).hexdigest()
        assert r.digest == want
    found = frame.where("not (k = 2 and i = 1)").withColumn("content", F.when(F.expr("k = 1 and i = 3"), "other").otherwise(F.col("content")))
    got = {(r.k, r.i): r.state for r in chains.verified(archived.where("k is not null"), found, "k", ["i"], ["k", "i"], "content").collect()}
    assert [got[1, i] for i in range(6)] == ["ok", "ok", "ok", "altered", "broken", "broken"]
    assert [got[2, i] for i in range(6)] == ["ok", "missing", *["broken"] * 4]


def test_ratings_of_a_key_are_not_paired_with_its_claims(spark):
    """2,000 ratings among 2,000 claims of one key: each rates the last claim before it, and no step makes all pairs."""
    import datetime as dt

    from arborlens.streaming import claim_store

    start = dt.datetime(2024, 1, 1)
    at = lambda i: start + dt.timedelta(seconds=i // 2)  # noqa: E731  # two commands a second: ties follow the number
    kinds = ["recalculate" if i % 4 in (0, 3) else "create" for i in range(4000)]
    rows = [(i, k, 1, "view", "v", 0.5, [], at(i)) for i, k in enumerate(kinds)] + [(5000, "recalculate", 1, "view", None, None, None, None)]
    out = claim_store.merged(spark.createDataFrame([], claim_store.CLAIM), spark.createDataFrame(rows, claim_store.COMMAND))
    want, current = {}, None
    for i, k in enumerate(kinds):
        if k == "create":
            current = i
            want[i] = at(i)
        elif current is not None:
            want[current] = max(want[current], at(i))
    assert {r.id: r.updated for r in out.collect()} == want
    assert [r.id for r in out.where("is_current").collect()] == [max(want)]
    assert "_made" in out._jdf.queryExecution().optimizedPlan().toString()
