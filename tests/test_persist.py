import random

import pytest
from pyspark.sql import functions as F

from eventledger.operators import persist, progress
from helpers import event, log_frame, record, sequential, uid

IDS = "partition int, offset bigint, event_id string, order_id string"


def outcomes(df):
    return {(r.partition, r.offset): r for r in df.drop("value", "event", "headers").collect()}


def classify_ids(spark, rows, stored=(), **options):
    """classify on (partition, offset, event, order) with ids as small numbers."""
    log = log_frame(spark, [record(p, o, event(uid(f"e{e}"), uid(f"o{x}"))) for p, o, e, x in rows])
    before = spark.createDataFrame(
        [(uid(f"e{e}"), uid(f"o{x}")) for e, x in stored], "event_id string, order_id string"
    )
    got = outcomes(persist.classify(log, before if stored else None, **options))
    return {k: r.outcome for k, r in got.items()}


@pytest.mark.parametrize(
    "value,readable",
    [
        (event("a", "b"), True),
        ("{}", True),
        ("null", True),
        (event("a", "b", extra={"x": [1, "y"]}), True),
        (event("a", "b", items=...), True),
        (event("a", "b", items=None), True),
        (event("a", "b", items=[{"sku": "s", "note": 5}, None]), True),
        (event("a", "b", occurred_at="2024-01-01T00:00:00.123456789+02:00"), True),
        ("{not json", False),
        ("<xml/>", False),
        ("", False),
        (event("a", "b") + " x", False),
        (event("a", "b") * 2, False),
        ("{},{}", False),
        ("{}]", False),
        ("{}] x", False),
        ("[]", False),
        ("5", False),
        (event(5, "b"), False),
        (event("a", "b", customer_id={"a": 1}), False),
        (event("a", "b", total_cents="5"), False),
        (event("a", "b", total_cents=1.5), False),
        (event("a", "b", items=5), False),
        (event("a", "b", items=[5]), False),
        (event("a", "b", items=[{"quantity": 1.5}]), False),
        (event("a", "b", items=[{"quantity": 1, "x": 1}, {"sku": 7}]), False),
        (event("a", "b", occurred_at="2024-01-01"), False),
        (event("a", "b", occurred_at="2024-13-01T00:00:00Z"), False),
        (event("a", "b", occurred_at=5), False),
    ],
)
def test_what_can_be_read(spark, value, readable):
    row = persist.decode_records(log_frame(spark, [record(0, 0, value)])).select("readable").first()
    assert row["readable"] is readable


def test_missing_fields_become_zero_values(spark):
    row = persist.decode_records(log_frame(spark, [record(0, 0, '{"items":[{}]}')])).select(
        "event_id", "event.total_cents", F.col("event.event_id").alias("text"), "event.items",
        F.col("event.occurred_at").cast("string").alias("at"),
    ).first()
    assert (row.text, row.event_id, row.total_cents) == ("", None, 0)
    assert row["items"][0].asDict() == {"sku": "", "quantity": 0, "unit_price_cents": 0}
    assert row["at"] == "0001-01-01 00:00:00"


def test_time_is_cut_to_microseconds(spark):
    value = event("a", "b", occurred_at="2024-01-01T00:00:00.5618959Z")
    row = persist.decode_records(log_frame(spark, [record(0, 0, value)])).select(
        F.unix_micros("event.occurred_at") % 1_000_000
    ).first()
    assert row[0] == 561895


def test_poison_reasons_and_attempts(spark):
    good = [event(uid(f"e{i}"), uid(f"o{i}")) for i in range(6)]
    rows = [
        record(0, 0, "{not json"),
        record(0, 1, event(uid("x"), "NOT-A-UUID")),
        record(0, 2, "{}"),
        record(0, 3, good[3]),
        record(0, 4, event(uid("other"), uid("o3"))),
        record(0, 5, event(uid("other"), uid("o3"))),
        record(0, 6, good[3]),
        record(0, 7, good[4]),
        record(0, 8, good[5]),
    ]
    faults = spark.createDataFrame(
        [(0, 7, "08006", 6, False), (0, 8, "57P01", 3, True)],
        "partition int, offset bigint, sqlstate string, attempts int, recovered boolean",
    )
    got = outcomes(persist.classify(log_frame(spark, rows), faults=faults))
    seen = {o: (r.outcome, r.reason, r.cause, r.attempts) for (_, o), r in got.items()}
    assert seen == {
        0: ("dead_letter", "poison", "undecodable", 0),
        1: ("dead_letter", "poison", "malformed_id", 1),
        2: ("dead_letter", "poison", "malformed_id", 1),
        3: ("persisted", None, None, 1),
        4: ("dead_letter", "poison", "order_id_collision", 1),
        5: ("dead_letter", "poison", "order_id_collision", 1),
        6: ("duplicate", None, None, 1),
        7: ("dead_letter", "retries_exhausted", "sink_fault", 6),
        8: ("persisted", None, None, 3),
    }


def test_ids_compare_in_any_spelling(spark):
    e, o = uid("e"), uid("o")
    rows = [record(0, 0, event(e, o)), record(0, 1, event(e.upper(), "{" + o + "}"))]
    got = outcomes(persist.classify(log_frame(spark, rows)))
    assert [got[0, i].outcome for i in (0, 1)] == ["persisted", "duplicate"]


def test_redelivered_log(spark):
    rows = [(0, i, i % 3, i % 3) for i in range(6)]
    got = classify_ids(spark, rows)
    assert list(got.values()).count("persisted") == 3
    assert list(got.values()).count("duplicate") == 3


def test_stored_rows_come_first(spark):
    rows = [(0, 0, 1, 1), (0, 1, 2, 1), (0, 2, 3, 3), (1, 0, 1, 9)]
    stored = [(1, 1)]
    got = classify_ids(spark, rows, stored)
    assert got == sequential(rows, stored)
    assert got[1, 0] == "duplicate"  # stored under another order, still the same event


@pytest.mark.parametrize("seed", range(3))
def test_against_the_sequential_loop(spark, seed):
    """Each event on one order: closed form, with a frequent key answered by the broadcast."""
    rng = random.Random(seed)
    order_of = {e: rng.randrange(8) for e in range(20)}
    part_of = {o: rng.randrange(3) for o in range(8)}
    next_offset = [0, 0, 0]
    rows = []
    for _ in range(60):
        e = 0 if rng.random() < 0.4 else rng.randrange(20)
        p = part_of[order_of[e]]
        rows.append((p, next_offset[p], e, order_of[e]))
        next_offset[p] += 1
    stored, taken = [], set()
    for e in range(3):
        if order_of[e] not in taken:
            taken.add(order_of[e])
            stored.append((e, order_of[e]))
    assert classify_ids(spark, rows, stored, frequent_rows=5) == sequential(rows, stored)
    assert classify_ids(spark, rows, one_order_per_event=True) == sequential(rows)


@pytest.mark.parametrize("seed", range(2))
def test_events_on_several_orders(spark, seed):
    """A broken producer: events and orders mixed at random, settled in rounds."""
    rng = random.Random(100 + seed)
    rows = [(i % 3, i // 3, rng.randrange(9), rng.randrange(9)) for i in range(45)]
    stored = [(0, 8), (8, 0)]
    assert classify_ids(spark, rows, stored, frequent_rows=4) == sequential(rows, stored)


def test_aggregated_counts_and_rows_agree_with_the_verdicts(spark):
    rng = random.Random(5)
    order_of = {e: rng.randrange(10) for e in range(30)}
    values = []
    for i in range(120):
        e = rng.randrange(30)
        values.append("{bad" if i % 17 == 0 else event(uid(f"e{e}"), uid(f"o{order_of[e]}") if i % 13 else "x"))
    log = log_frame(spark, [record(0, i, v) for i, v in enumerate(values)])
    verdicts = persist.classify(log)
    count = lambda **how: {(r.status, r.reason): r.n for r in persist.outcome_counts(log, **how).collect()}
    expected = {
        (r.outcome, r.reason or ""): r.n
        for r in verdicts.groupBy("outcome", "reason").agg(F.count("*").alias("n")).collect()
    }
    assert count(one_order_per_event=True) == count() == expected
    now = F.lit("2024-01-01").cast("timestamp")
    a = persist.store_rows(verdicts, now).orderBy("order_id").collect()
    b = persist.insert_once(log, processed_at=now, one_order_per_event=True).orderBy("order_id").collect()
    assert a == b


def test_one_event_on_two_orders_is_stored_once(spark):
    values = [event(uid("e"), uid("o1")), event(uid("e"), uid("o2")), event(uid("f"), uid("o2"))]
    log = log_frame(spark, [record(0, i, v) for i, v in enumerate(values)])
    stored = {(r.event_id, r.order_id) for r in persist.insert_once(log).collect()}
    assert stored == {(uid("e"), uid("o1")), (uid("f"), uid("o2"))}
    counted = {(r.status, r.reason): r.n for r in persist.outcome_counts(log).collect()}
    assert counted == {("persisted", ""): 2, ("duplicate", ""): 1}


def test_frontier(spark):
    rows = [(0, o, True) for o in range(10, 15)] + [(1, o, o != 22) for o in range(20, 25)] + [(2, 5, False)]
    records = spark.createDataFrame(rows, "partition int, offset bigint, ok boolean")
    got = {r.partition: (r.last_offset, r.next_offset, r.blocked) for r in progress.commit_frontier(records).collect()}
    assert got == {0: (14, 15, False), 1: (21, 22, True), 2: (4, 5, True)}
    ahead = progress.before_frontier(records, 3).groupBy("partition").count().collect()
    assert {r.partition: r["count"] for r in ahead} == {0: 5, 1: 2}


@pytest.mark.parametrize("bad", [None, 12])
def test_chunks(spark, bad):
    rows = [(0, 100 + i) for i in range(25)]
    records = spark.createDataFrame(rows, "partition int, offset bigint")
    sizes = progress.offset_chunks(records, 10, width=4).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in sizes] == [10, 10, 5]


def test_dense_offsets_give_the_chunk(spark):
    records = spark.createDataFrame([(0, i) for i in range(25)], "partition int, offset bigint")
    same = progress.dense_chunks(records, 10).exceptAll(progress.offset_chunks(records, 10))
    assert same.isEmpty()


def test_lag_and_skew(spark):
    end = spark.createDataFrame([(0, 10), (1, 7)], "partition int, next_offset bigint")
    done = spark.createDataFrame([(0, 4)], "partition int, next_offset bigint")
    got = {r.partition: r.lag for r in progress.consumer_lag(end, done).collect()}
    assert got == {0: 6, 1: 7}
    log = spark.createDataFrame([(0,), (0,), (0,), (1,)], "partition int")
    assert {r.partition: r.share for r in progress.partition_skew(log).collect()} == {0: 0.75, 1: 0.25}
