import pytest
from pyspark.sql import functions as F

from eventledger import schemas as S
from eventledger.operators import persist
from eventledger.sources.record_log import read_log
from eventledger.streaming import persist_job as P
from eventledger.streaming.ingest_job import REJECTIONS, IngestJob
from eventledger.operators.reads import get_order
from eventledger.streaming.drain_job import DrainJob
from eventledger.streaming.replay_job import ReplayJob
from eventledger.streaming.retry import RetryPolicy, SinkError, sink_error, with_retry
from eventledger.streaming.store import (
    BUCKET, end_offsets, in_bucket_of, read_batches, stored_with, write_batch,
)
from helpers import event, log_frame, record, uid

QUICK = RetryPolicy(base_ms=1, max_ms=4, budget_ms=50)


def deliveries():
    """Two partitions with duplicates, a collision, bad ids and unreadable values."""
    rows = []
    for i in range(40):
        p = i % 2
        value = event(uid(f"e{i}"), uid(f"o{i}"))
        if i % 11 == 3:
            value = "{not json"
        elif i % 13 == 5:
            value = event(uid(f"e{i}"), "NOT-A-UUID")
        elif i % 9 == 8:
            value = event(uid(f"e{i}"), uid(f"o{i - 2}"))
        rows.append((p, value))
        if i % 4 == 0:
            rows.append((p, value))
    seen = [0, 0]
    out = []
    for p, value in rows:
        out.append(record(p, seen[p], value, key=f"k{p}"))
        seen[p] += 1
    return out


@pytest.fixture()
def log_folder(spark, folder):
    """The log as three files, oldest first."""
    rows = sorted(deliveries(), key=lambda r: r[4])
    size = -(-len(rows) // 3)
    for i in range(0, len(rows), size):
        log_frame(spark, rows[i : i + size]).coalesce(1).write.mode("append").parquet(folder + "/log")
    return folder


def job_of(spark, folder, **options):
    return P.PersistJob(
        spark, folder + "/store", folder + "/dlq", folder + "/outcomes", policy=QUICK,
        sleep=lambda s: None, **options,
    )


def drain(spark, folder, job, files=1, checkpoint="/cp"):
    log = read_log(spark, folder + "/log", streaming=True, maxFilesPerTrigger=files)
    query = job.start(log, folder + checkpoint)
    query.awaitTermination()
    return query


def state(spark, folder):
    store = read_batches(spark, folder + "/store", S.STORE)
    dead = read_batches(spark, folder + "/dlq", S.RECORD)
    counts = read_batches(spark, folder + "/outcomes", P.OUTCOMES)
    return (
        sorted(r.event_id for r in store.collect()),
        sorted((bytes(r.value), r.partition) for r in dead.collect()),
        {(r.outcome, r.reason): r.n for r in counts.groupBy("outcome", "reason").agg(F.sum("n").alias("n")).collect()},
    )


def batch_twin(spark, folder):
    classified = persist.classify(read_log(spark, folder + "/log"))
    counts = classified.groupBy("outcome", "reason").agg(F.count("*").alias("n")).collect()
    ids = classified.where("outcome = 'persisted'").select("event_id").collect()
    return sorted(r.event_id for r in ids), {(r.outcome, r.reason): r.n for r in counts}


@pytest.mark.parametrize("files", [1, 2])
def test_stream_equals_its_batch_twin(spark, log_folder, files):
    drain(spark, log_folder, job_of(spark, log_folder), files)
    ids, dead, counts = state(spark, log_folder)
    assert (ids, counts) == batch_twin(spark, log_folder)
    assert len(set(ids)) == len(ids)
    offsets = read_batches(spark, log_folder + "/dlq", S.RECORD)
    for p in {r.partition for r in offsets.collect()}:
        found = sorted(r.offset for r in offsets.where(F.col("partition") == p).collect())
        assert found == list(range(len(found)))


def test_failed_batch_comes_again_and_changes_nothing(spark, log_folder):
    """The query dies after the store write of two batches; each restart repeats that batch."""
    died = set()
    job = job_of(spark, log_folder)
    park = job._park

    def failing(classified):
        batches.append(1)
        if len(batches) in (1, 4):
            died.add(len(batches))
            raise RuntimeError("killed")
        return park(classified)

    job._park, batches = failing, []
    failures = 0
    for _ in range(3):
        try:
            drain(spark, log_folder, job)
        except Exception as err:
            assert "killed" in str(err)
            failures += 1
    assert failures == 2 and died == {1, 4}
    ids, _, counts = state(spark, log_folder)
    assert (ids, counts) == batch_twin(spark, log_folder)


def test_second_delivery_of_the_whole_log(spark, log_folder):
    job = job_of(spark, log_folder)
    drain(spark, log_folder, job)
    first = state(spark, log_folder)
    # a new checkpoint reads everything again, under later batch ids
    again = job_of(spark, log_folder)
    write = again.write
    again.write = lambda df, n: write(df, n + 100)
    drain(spark, log_folder, again, files=3, checkpoint="/cp2")
    second = state(spark, log_folder)
    assert second[0] == first[0]
    assert second[2][("duplicate", None)] == len(first[0]) + 2 * first[2][("duplicate", None)]


def test_store_that_recovers_within_the_budget(spark, log_folder):
    calls = []

    def shaky(rows, batch_id):
        calls.append(batch_id)
        if calls.count(batch_id) < 3:
            raise SinkError("57P01")

    drain(spark, log_folder, job_of(spark, log_folder, before_store_write=shaky), files=3)
    ids, _, counts = state(spark, log_folder)
    assert (ids, counts) == batch_twin(spark, log_folder) and len(calls) == 3


@pytest.mark.parametrize("sqlstate,reason", [("08006", "retries_exhausted"), ("", "retries_exhausted")])
def test_store_that_stays_away(spark, log_folder, sqlstate, reason):
    def gone(rows, batch_id):
        if batch_id == 0:
            raise SinkError(sqlstate)

    drain(spark, log_folder, job_of(spark, log_folder, before_store_write=gone), files=2)
    ids, dead, counts = state(spark, log_folder)
    records = read_log(spark, log_folder + "/log").count()
    assert sum(counts.values()) == records
    assert counts[("dead_letter", reason)] > 20
    assert len(ids) == counts[("persisted", None)] and len(dead) == records - len(ids) - counts.get(("duplicate", None), 0)


def test_one_refused_record_does_not_take_the_batch_down(spark, folder):
    """Five records, one of which the store refuses: four are stored, one is parked."""
    rows = [record(0, i, event(uid(f"e{i}"), uid(f"o{i}"))) for i in range(5)]
    log_frame(spark, rows).coalesce(1).write.parquet(folder + "/log")

    def picky(rows, batch_id):
        if not rows.where(F.col("event_id") == uid("e3")).isEmpty():
            raise SinkError("23514")

    drain(spark, folder, job_of(spark, folder, before_store_write=picky))
    ids, dead, counts = state(spark, folder)
    assert ids == sorted(uid(f"e{i}") for i in (0, 1, 2, 4)) and len(dead) == 1
    assert counts == {("persisted", None): 4, ("dead_letter", "poison"): 1}


def test_refused_record_makes_way_for_the_next_of_its_order(spark, folder):
    rows = [record(0, 0, event(uid("bad"), uid("o"))), record(0, 1, event(uid("good"), uid("o")))]
    log_frame(spark, rows).coalesce(1).write.parquet(folder + "/log")

    def picky(rows, batch_id):
        if not rows.where(F.col("event_id") == uid("bad")).isEmpty():
            raise SinkError("23514")

    drain(spark, folder, job_of(spark, folder, before_store_write=picky))
    assert state(spark, folder)[0] == [uid("good")]


def test_real_failures_are_taken_by_their_kind(spark):
    assert sink_error(OSError("disk")).retryable
    assert sink_error(ValueError("bug")) is None
    with pytest.raises(Exception) as caught:
        spark.range(1).write.parquet("/proc/1/nowhere/table")
    assert sink_error(caught.value).retryable
    with pytest.raises(Exception) as caught:
        spark.sql("SELECT CAST('x' AS INT)").collect()
    assert not sink_error(caught.value).retryable
    with pytest.raises(Exception) as caught:
        spark.sql("SELECT missing")
    assert sink_error(caught.value) is None


def test_ingest_persist_replay_persist_on_one_log(spark, folder):
    """Dead letters go back to the log that ingest wrote; every record is seen once."""
    good = '{"customer_id":"c","items":[{"sku":"s","quantity":1,"unit_price_cents":%d}]}'
    bodies = spark.createDataFrame([(i, good % i, f"key-{i}") for i in range(12)], "position bigint, body string, idempotency_key string")
    bodies = bodies.withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp"))
    bodies.coalesce(1).write.parquet(folder + "/bodies")
    stream = spark.readStream.schema(bodies.schema).parquet(folder + "/bodies")
    IngestJob(spark, folder + "/log", folder + "/rejections").start(stream, folder + "/cp-in").awaitTermination()

    def gone(rows, batch_id):
        raise SinkError("08006")

    drain(spark, folder, job_of(spark, folder, before_store_write=gone))
    assert state(spark, folder)[0] == []
    dlq = read_batches(spark, folder + "/dlq", S.RECORD)
    report = ReplayJob(spark).run(dlq, None, folder + "/log", folder + "/commits", apply=True).first()
    assert (report.replayed, report.failed) == (12, 0)
    drain(spark, folder, job_of(spark, folder))
    ids, _, counts = state(spark, folder)
    assert len(ids) == 12 and counts[("persisted", None)] == 12
    # a second ingest continues behind the replayed records
    more = spark.createDataFrame([(i, good % i, f"more-{i}") for i in range(5)], "position bigint, body string, idempotency_key string")
    IngestJob(spark, folder + "/log", folder + "/rejections").write(more.withColumn("occurred_at", F.lit("2024-01-02").cast("timestamp")), 1)
    log = read_batches(spark, folder + "/log", S.RECORD)
    assert log.count() == 29
    for (p,) in log.select("partition").distinct().collect():
        found = sorted(r.offset for r in log.where(F.col("partition") == p).collect())
        assert found == list(range(len(found)))
    ends = {r.partition: r.next_offset for r in end_offsets(spark, folder + "/log").collect()}
    assert ends == {r.partition: r.n for r in log.groupBy("partition").agg(F.count("*").alias("n")).collect()}


def test_a_log_from_before_there_were_commits(spark, folder):
    write_batch(log_frame(spark, [record(0, i, "x") for i in range(3)]), folder + "/log", 0)
    assert [tuple(r) for r in end_offsets(spark, folder + "/log").collect()] == [(0, 3)]
    # the log gets commits and goes on behind what it had
    job = IngestJob(spark, folder + "/log", folder + "/rejections", partitions=1)
    body = '{"customer_id":"c","items":[{"sku":"s","quantity":1,"unit_price_cents":1}]}'
    bodies = spark.createDataFrame([(0, body, "")], "position bigint, body string, idempotency_key string")
    job.write(bodies.withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp")), 0)
    assert [tuple(r) for r in end_offsets(spark, folder + "/log").collect()] == [(0, 4)]
    assert sorted(r.offset for r in read_batches(spark, folder + "/log", S.RECORD).collect()) == [0, 1, 2, 3]


def test_lookups_read_one_bucket(spark, log_folder):
    drain(spark, log_folder, job_of(spark, log_folder), files=3)
    ids = state(spark, log_folder)[0]
    store = read_batches(spark, log_folder + "/store", S.STORE)
    wanted = store.first()
    pruned = read_batches(spark, log_folder + "/store", S.STORE, only=in_bucket_of(wanted.order_id))
    found = get_order(pruned, wanted.order_id)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and BUCKET in plan.split("PartitionFilters")[1].split("]")[0]
    assert [r.event_id for r in found.collect()] == [wanted.event_id]
    asked = spark.createDataFrame([(None, ids[0])], "order_id string, event_id string")
    met = stored_with(spark, log_folder + "/store", asked)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert BUCKET in plan and [r.event_id for r in met.collect()] == [ids[0]]


def test_drain_holds_a_blocked_partition_and_moves_the_others(spark, folder):
    rows = [record(p, o, event(uid(f"e{p}-{o}"), uid(f"o{p}-{o}"))) for p in (0, 1) for o in range(6) if (p, o) != (1, 2)]
    log = log_frame(spark, [*rows, record(1, 2, "{not json")])
    paths = [folder + x for x in ("/store", "/dlq", "/commits")]
    tries = []

    class Down(DrainJob):
        """The dead-letter log does not take what comes from partition 1."""

        def append(self, letters, path):
            tries.append(path)
            if not letters.where("exists(headers, h -> h.key = 'dlq_source_partition' and string(h.value) = '1')").isEmpty():
                raise OSError("no route to the log")
            super().append(letters, path)

    down = Down(spark, *paths, policy=QUICK, sleep=lambda s: None)
    seen = {r.partition: (r.next_offset, r.blocked) for r in down.run(log).collect()}
    assert seen == {0: (6, False), 1: (2, True)} and len(tries) >= 2
    assert read_batches(spark, paths[0], S.STORE).count() == 8
    assert read_batches(spark, paths[1], S.RECORD).count() == 0
    # once it can be parked, the rest follows, in bounded steps
    job = DrainJob(spark, *paths, most_records=3)
    assert [(r.partition, r.next_offset) for r in job.run(log).collect()] == [(1, 5)]
    assert [(r.partition, r.next_offset) for r in job.run(log).collect()] == [(1, 6)]
    assert job.run(log).count() == 0
    assert read_batches(spark, paths[0], S.STORE).count() == 11
    assert read_batches(spark, paths[1], S.RECORD).count() == 1


def test_retry_budget():
    now, waits = [0.0], []

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    def fail():
        now[0] += 0.01
        raise SinkError("08006")

    attempts, error = with_retry(fail, RetryPolicy(10, 100, 500), sleep, lambda: now[0])
    assert error.sqlstate == "08006" and attempts == len(waits) + 1 > 3 and now[0] <= 0.52
    assert all(w <= 0.1 for w in waits)

    def broken():
        raise SinkError("23505")

    assert with_retry(broken, RetryPolicy(), sleep, lambda: 0.0)[0] == 1
    assert with_retry(lambda: None)[1] is None


def test_ingest_to_store(spark, folder):
    good = '{"customer_id":"c%d","items":[{"sku":"s","quantity":1,"unit_price_cents":%d}]}'
    rows = [(i, good % (i, i), f"key-{i // 2}" if i < 10 else "") for i in range(20)]
    rows += [(20, "{", ""), (21, "{}", ""), (22, good % (1, 1), "bad key")]
    bodies = spark.createDataFrame(rows, "position bigint, body string, idempotency_key string").withColumn(
        "occurred_at", F.lit("2024-01-01").cast("timestamp")
    )
    bodies.coalesce(1).write.parquet(folder + "/bodies")
    stream = spark.readStream.schema(bodies.schema).parquet(folder + "/bodies")
    IngestJob(spark, folder + "/log", folder + "/rejections").start(stream, folder + "/cp-in").awaitTermination()
    refused = {r.reason: r.n for r in read_batches(spark, folder + "/rejections", REJECTIONS).collect()}
    assert refused == {"malformed_body": 1, "validation": 2}

    drain(spark, folder, job_of(spark, folder))
    ids, dead, counts = state(spark, folder)
    assert counts == {("persisted", None): 15, ("duplicate", None): 5} and dead == []


def test_listener_sees_arrivals(spark, log_folder):
    listener = P.LagListener()
    spark.streams.addListener(listener)
    try:
        drain(spark, log_folder, job_of(spark, log_folder), files=2)
        import time

        for _ in range(50):
            if listener.records == len(deliveries()):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.records == len(deliveries())


@pytest.mark.parametrize("within", [None, "10 minutes"])
def test_dedup_in_the_stream(spark, log_folder, within):
    log = read_log(spark, log_folder + "/log", streaming=True, maxFilesPerTrigger=1)
    events = persist.decode_records(log).where("readable and event_id is not null").select(
        "event_id", F.col("event.occurred_at").alias("occurred_at")
    )
    query = (
        P.deduplicated(events, within).writeStream.format("parquet").option("path", log_folder + "/out")
        .option("checkpointLocation", log_folder + "/cp-d").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = [r.event_id for r in spark.read.parquet(log_folder + "/out").collect()]
    want = persist.decode_records(read_log(spark, log_folder + "/log")).where("readable and event_id is not null")
    assert sorted(got) == sorted(r.event_id for r in want.select("event_id").distinct().collect())


def test_live_rate(spark, folder):
    times = spark.range(100).select(F.timestamp_seconds(1_704_067_200 + F.col("id") * 2).alias("processed_at"))
    times.coalesce(1).write.parquet(folder + "/in")
    stream = spark.readStream.schema("processed_at timestamp").parquet(folder + "/in")
    query = (
        P.live_rate(stream, "30 seconds", "30 seconds", "0 seconds").writeStream.format("parquet").outputMode("append")
        .option("path", folder + "/out").option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(folder + "/out").collect()
    assert len(rows) == 6 and {r.rows for r in rows} == {15} and {r.rate for r in rows} == {0.5}
