import os

import pytest
from pyspark.sql import functions as F

from eventledger import schemas as S
from eventledger.functions import headers as H
from eventledger.operators import persist, replay
from eventledger.schemas import HEADERS
from eventledger.streaming import replay_job
from eventledger.streaming.replay_job import ReplayJob
from eventledger.streaming.retry import RetryPolicy, SinkError
from eventledger.streaming.store import read_batches, write_batch
from helpers import event, log_frame, record, uid


def dead(partition, offset, reason=S.RETRIES_EXHAUSTED, count=None, value=None):
    headers = [] if reason is None else [(S.DLQ_REASON, reason)]
    if count is not None:
        headers.append((S.REPLAY_COUNT, count))
    value = value or event(uid(f"e{partition}-{offset}"), uid(f"o{partition}-{offset}"))
    return record(partition, offset, value, headers)


def decisions(df):
    return [(r.decision, r.replay_count) for r in df.orderBy("partition", "offset").collect()]


@pytest.mark.parametrize(
    "reason,count,reasons,decision",
    [
        (S.RETRIES_EXHAUSTED, None, S.RETRIES_EXHAUSTED, "replay"),
        (S.POISON, None, S.RETRIES_EXHAUSTED, "reason:poison"),
        (S.POISON, None, "poison", "replay"),
        (S.POISON, None, "all", "replay"),
        (S.RETRIES_EXHAUSTED, None, " poison , retries_exhausted,", "replay"),
        (None, None, "all", "no_dlq_reason"),
        (None, "9", "all", "no_dlq_reason"),
        (S.RETRIES_EXHAUSTED, "1", S.RETRIES_EXHAUSTED, "replay"),
        (S.RETRIES_EXHAUSTED, "2", S.RETRIES_EXHAUSTED, "replay_limit"),
        (S.RETRIES_EXHAUSTED, "7", "all", "replay_limit"),
        (S.POISON, "7", S.RETRIES_EXHAUSTED, "reason:poison"),
        ("made_up", None, "poison", "reason:made_up"),
    ],
)
def test_decisions(spark, reason, count, reasons, decision):
    log = log_frame(spark, [dead(0, 0, reason, count)])
    assert replay.replay_decisions(log, reasons).first().decision == decision


@pytest.mark.parametrize(
    "text,count", [("", 0), ("not-a-number", 0), ("-3", 0), (" 1", 0), ("1.0", 0), ("+1", 1), ("2", 2), ("1\n", 0)]
)
def test_replay_count(spark, text, count):
    log = log_frame(spark, [dead(0, 0, count=text)])
    assert log.select(H.replay_count(F.col("headers"))).first()[0] == count


@pytest.mark.parametrize("text", ["", " , ", "poisn", "all,nothing"])
def test_bad_reason_lists(text):
    with pytest.raises(ValueError):
        replay.parse_reasons(text)


def test_max_replays_must_be_positive(spark):
    with pytest.raises(ValueError):
        replay.replay_decisions(log_frame(spark, []), max_replays=0)


def texts(headers):
    return [(h["key"], bytes(h["value"]).decode()) for h in headers]


def test_headers_of_a_second_death(spark):
    before = [
        ("replay_count", "1"), ("replay_at", "t"), ("dlq_reason", "poison"), ("content-type", "json"),
        ("replay_of_dlq_partition", "0"), ("replay_of_dlq_offset", "41"),
    ]
    df = log_frame(spark, [record(2, 9, "{", before)])
    at = F.lit("2024-01-01 00:00:00.5").cast("timestamp")
    got = texts(
        df.select(
            H.dead_letter_headers(
                F.col("headers"), F.lit("poison"), F.lit("why"), F.lit(0), F.col("topic"), F.col("partition"),
                F.col("offset"), at,
            )
        ).first()[0]
    )
    assert got == [
        ("replay_count", "1"), ("replay_at", "t"), ("replay_of_dlq_partition", "0"), ("replay_of_dlq_offset", "41"),
        ("dlq_reason", "poison"), ("dlq_error", "why"), ("dlq_attempts", "0"), ("dlq_source_topic", "orders"),
        ("dlq_source_partition", "2"), ("dlq_source_offset", "9"), ("dlq_failed_at", "2024-01-01T00:00:00.500000Z"),
    ]


def test_first_header_wins_and_absent_is_null(spark):
    df = spark.createDataFrame([([("a", b"1"), ("a", b"2")],)], "headers array<struct<key:string,value:binary>>")
    row = df.select(H.header(F.col("headers"), "a"), H.header(F.col("headers"), "b")).first()
    assert tuple(row) == ("1", None)
    assert df.schema["headers"].dataType == HEADERS


def test_replayed_record_keeps_its_bytes_and_loses_the_diagnosis(spark):
    decided = replay.replay_decisions(log_frame(spark, [dead(1, 7, count="1", value="é{")]))
    row = replay.replay_records(decided, F.lit("2024-01-01").cast("timestamp")).first()
    assert bytes(row.value).decode() == "é{" and bytes(row.key) == b"k"
    assert texts(row.headers) == [
        ("replay_count", "2"), ("replay_at", "2024-01-01T00:00:00.000000Z"),
        ("replay_of_dlq_partition", "1"), ("replay_of_dlq_offset", "7"),
    ]


@pytest.mark.parametrize("limit,scanned,replayed", [(0, 12, 8), (1, 1, 1), (3, 4, 3), (5, 7, 5), (8, 12, 8), (99, 12, 8)])
def test_limit(spark, limit, scanned, replayed):
    rows = [dead(p, o, S.POISON if o == 2 else S.RETRIES_EXHAUSTED) for p in range(4) for o in range(3)]
    decided = replay.replay_decisions(log_frame(spark, rows))
    kept = replay.up_to_limit(decided, limit)
    got = [(r.partition, r.offset) for r in kept.orderBy("partition", "offset").collect()]
    all_rows = [(p, o) for p in range(4) for o in range(3)]
    wanted, n = [], 0
    for at in all_rows:
        if limit and n >= limit:
            break
        wanted.append(at)
        n += at[1] != 2
    assert got == wanted
    assert n == replayed and (len(got) == scanned or limit in (5, 8))


def test_report(spark):
    rows = [dead(0, 0), dead(0, 1, value="{bad"), dead(0, 2, S.POISON), dead(1, 0, None), dead(1, 1, count="2"), dead(1, 2, S.POISON)]
    report = replay.replay_report(replay.replay_decisions(log_frame(spark, rows))).first()
    assert (report.scanned, report.replayed, report.unreadable) == (6, 2, 1)
    assert report.skipped == {"no_dlq_reason": 1, "reason:poison": 2, "replay_limit": 1}


def test_report_of_nothing(spark):
    report = replay.replay_report(replay.replay_decisions(log_frame(spark, []))).first()
    assert (report.scanned, report.replayed, report.unreadable, report.skipped) == (0, 0, 0, {})


def test_verify_counts_distinct_ids(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("",)], "event_id string")
    store = spark.createDataFrame([("a", 1), ("z", 2)], "event_id string, x int")
    assert tuple(replay.verify_replayed(ids, store).first()) == (2, 1, 1)


def test_job_dry_run_apply_and_rerun(spark, folder):
    paths = (f"{folder}/log", f"{folder}/commits")
    write_batch(log_frame(spark, [record(p, o, "x") for p in range(3) for o in range(5)]), paths[0], 0)
    dlq = log_frame(spark, [dead(0, 0), dead(0, 1, S.POISON), dead(1, 0), dead(2, 0, None)])
    job = ReplayJob(spark)
    dry = job.run(dlq, None, *paths).first()
    assert (dry.dry_run, dry.scanned, dry.replayed, dry.failed) == (True, 4, 2, 0)

    store = spark.createDataFrame([(uid("e0-0"),)], "event_id string")
    done = job.run(dlq, None, *paths, apply=True, store=store).first()
    assert (done.scanned, done.replayed, done.failed) == (4, 2, 0)
    assert (done.verify.checked, done.verify.missing) == (2, 1)
    sent = read_batches(spark, paths[0], S.RECORD).where("batch_id > 0")
    assert sent.count() == 2
    assert sent.groupBy("partition").agg(F.min("offset").alias("o")).where("o <> 5").count() == 0

    commits = spark.read.parquet(paths[1])
    again = job.run(dlq, commits, *paths, apply=True).first()
    assert (again.scanned, again.replayed) == (0, 0)
    other_group = ReplayJob(spark, group_id="other").run(dlq, commits, *paths).first()
    assert other_group.scanned == 4


def test_records_that_cannot_be_sent_are_counted_and_stay(spark, folder, monkeypatch):
    def unreachable(*args):
        raise SinkError("08006")

    monkeypatch.setattr(replay_job, "append_to_log", unreachable)
    dlq = log_frame(spark, [dead(0, 0), dead(1, 0)])
    job = ReplayJob(spark, policy=RetryPolicy(1, 2, 10), sleep=lambda s: None)
    report = job.run(dlq, None, f"{folder}/log", f"{folder}/commits", apply=True).first()
    assert (report.scanned, report.replayed, report.failed) == (2, 0, 2)
    assert not os.path.exists(f"{folder}/commits")


def test_reasons_beyond_the_named_ones_are_counted_together(spark):
    decided = replay.replay_decisions(log_frame(spark, [dead(0, i, f"why{i % 70}") for i in range(140)]))
    report = replay.replay_report(decided).first()
    assert report.scanned == 140 and report.skipped == {replay.OTHER_REASONS: 140}


def test_replayed_copy_changes_nothing(spark):
    rows = [record(0, i, event(uid(f"e{i}"), uid(f"o{i}"))) for i in range(4)]
    again = [record(0, 4 + i, event(uid(f"e{i}"), uid(f"o{i}")), [("replay_count", "1")]) for i in range(4)]
    first = persist.classify(log_frame(spark, rows))
    both = persist.classify(log_frame(spark, rows + again))
    stored = lambda df: sorted(r.event_id for r in df.where("outcome = 'persisted'").select("event_id").collect())
    assert stored(first) == stored(both)
    assert both.where("outcome = 'duplicate'").count() == 4
