import datetime as dt
import bisect
import math

import pytest
from pyspark.sql import functions as F

from eventledger import schemas as S
from eventledger.functions import failures
from eventledger.operators import measure, series
from eventledger.sources import sinks
from eventledger.sources.record_log import append_records, log_end
from eventledger.streaming.store import write_orders_table

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize(
    "kind,state,retry,caller",
    [
        ("server", "23505", False, False),
        ("server", "23502", False, False),
        ("server", "22P02", False, True),
        ("server", "42703", False, False),
        ("server", "08006", True, False),
        ("server", "53300", True, False),
        ("server", "57P01", True, False),
        ("server", "57P03", True, False),
        ("server", "58030", True, False),
        ("server", "40001", True, False),
        ("server", "40P01", True, False),
        ("server", "XX000", False, False),
        ("server", None, False, False),
        ("transport", None, True, False),
        ("timeout", None, True, False),
        ("cancelled", None, False, False),
        ("invalid_argument", None, False, True),
        (None, None, False, False),
    ],
)
def test_failure_classes(spark, kind, state, retry, caller):
    df = spark.createDataFrame([(kind, state)], "kind string, sqlstate string")
    k, s = F.col("kind"), F.col("sqlstate")
    row = df.select(failures.is_retryable(k, s), failures.is_caller_error(k, s)).first()
    assert tuple(row) == (retry, caller)


def test_backoff(spark):
    df = spark.range(0, 2000).select((F.col("id") % 100).alias("a"))
    row = df.select("a", failures.backoff_ceiling_ms(F.col("a")).alias("c"), failures.backoff_delay_ms(F.col("a")).alias("d"))
    got = {r.a: r.c for r in row.collect()}
    assert [got[a] for a in (0, 1, 2, 5, 6, 99)] == [100, 200, 400, 3200, 5000, 5000]
    assert row.where("d < 0 or d > c").count() == 0


def requests(spark, rows):
    full = [("r", at(i), at(i + late), at(i + late + took) if status else None, status, 1_000_000)
            for i, (late, took, status) in enumerate(rows)]
    return spark.createDataFrame(
        full, "run string, due timestamp, dispatched timestamp, done timestamp, status int, interval_us bigint"
    )


def test_run_report(spark):
    rows = [(0, 0.5, 202), (2, 1, 202), (1, 0.25, 503), (0, 0, None)]
    r = measure.run_report(requests(spark, rows)).first()
    assert (r.sent, r.accepted, r.failed, r.scheduler_behind) == (4, 2, 1, 1)
    assert r.status_codes == {"202": 2, "503": 1}
    assert (r.accept_count, r.accept_p50_seconds, r.accept_max_seconds) == (3, 1.25, 3.0)
    assert r.wall_clock_seconds == 4.0 and r.achieved_rate == 0.5


def test_report_and_table_files(spark, folder):
    report = measure.run_report(requests(spark, [(0, 0.5, 202)]))
    sinks.write_report(report, folder + "/report")
    assert spark.read.json(folder + "/report").first().status_codes["202"] == 1
    table = report.select("run", "sent", "achieved_rate")
    sinks.write_tsv(table, folder + "/t")
    back = sinks.read_tsv(spark, folder + "/t", "run string, sent bigint, achieved_rate double")
    assert back.collect() == table.collect()


def test_create_store_twice(spark, folder):
    rows = spark.createDataFrame([("o1", "e1", "c", [], 1, T0, T0)], S.STORE)
    write_orders_table(rows, folder + "/orders/batch_id=0")
    for _ in range(2):
        sinks.create_store(spark, "orders_test_table", folder + "/orders")
    sinks.refresh_store(spark, "orders_test_table", folder + "/orders")
    table = spark.table("orders_test_table")
    assert table.columns == [f.name for f in S.STORE.fields] + ["batch_id", "id_bucket"]
    assert [(r.order_id, r.batch_id) for r in table.collect()] == [("o1", 0)]
    spark.sql("DROP TABLE orders_test_table")


def test_throughput_of_one_row(spark):
    df = spark.createDataFrame([(T0,)], "processed_at timestamp")
    assert measure.throughput(df).first().throughput == 1000.0


def test_reconcile(spark):
    ids = lambda text: spark.createDataFrame([(c, c) for c in text], "event_id string, order_id string")
    r = measure.reconcile(ids("aabcde"), ids("abx"), ids("cb")).first()
    assert r.asDict() == {
        "accepted_events": 5, "stored_rows": 3, "stored_events": 3, "parked_events": 1, "missing": 2, "unexpected": 1
    }


def test_approximate_latency_is_close(spark):
    df = spark.range(1, 1001).select((F.col("id") * 1000).alias("us"))
    r = measure.approximate_latency(df, F.col("us")).first()
    assert (r["count"], r.max_seconds) == (1000, 1.0) and abs(r.p99_seconds - 0.99) < 0.01


def test_merged_slices_give_quantiles_within_the_error(spark):
    # half of all rows in one slice and group, values unlike from slice to slice
    n = 60_000
    slot = F.when(F.col("id") < n // 2, 0).otherwise(F.col("id") % 23)
    df = spark.range(n).select(
        (F.col("id") % 3 == 0).alias("odd"),
        F.timestamp_micros(slot.cast("bigint") * 3_600_000_000 - 7_200_000_000 + F.col("id")).alias("at"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_000) * (slot + 1)).alias("us"),
    ).unionByName(spark.createDataFrame([(True, T0, None), (False, None, 5)], "odd boolean, at timestamp, us bigint"))
    slices = measure.latency_slices(df, F.col("us"), "at", 3_600_000_000, ["odd"])
    assert slices.count() == 46 and slices.agg(F.min("slice_us")).first()[0] == -7_200_000_000
    assert slices.agg(F.max(F.length("sketch"))).first()[0] < 64_000
    some = slices.where(F.col("slice_us") < 5 * 3_600_000_000)
    for chosen, rows in ((slices, df), (some, df.where(F.unix_micros("at") < 5 * 3_600_000_000))):
        rows = rows.where("us IS NOT NULL AND at IS NOT NULL")
        for odd, got in {r.odd: r for r in measure.merged_latency(chosen, ["odd"]).collect()}.items():
            values = sorted(r.us for r in rows.where(F.col("odd") == odd).select("us").collect())
            assert got["count"] == len(values) and got.max_seconds == values[-1] / 1e6
            for name, q in measure.QUANTILES.items():
                value = round(got[f"{name}_seconds"] * 1e6)
                below, upto = bisect.bisect_left(values, value), bisect.bisect_right(values, value)
                assert below <= (q + measure.RANK_ERROR) * len(values) and upto >= (q - measure.RANK_ERROR) * len(values)
    assert measure.merged_latency(slices.limit(0)).count() == 0


def test_histogram(spark):
    df = spark.createDataFrame([(0.001,), (0.005,), (0.2,), (99.0,)], "s double")
    got = {r.le: r.bucket_count for r in measure.histogram(df, F.col("s"), [0.005, 0.25]).collect()}
    assert got == {0.005: 2, 0.25: 3, math.inf: 4}


def samples(spark, values, step=10, metric="m", label="l"):
    return spark.createDataFrame(
        [(at(i * step), metric, "i", label, float(v)) for i, v in enumerate(values) if v is not None],
        "ts timestamp, metric string, instance string, label string, value double",
    )


def by_time(df, column):
    return [r[column] for r in df.orderBy("ts").collect()]


def test_increase_and_reset(spark):
    grown = series.counter_increase(samples(spark, [0, 5, 7, 2, 4]), 30_000_000)
    # windows (t-30, t] hold three samples
    assert by_time(grown, "increase") == [None, 5.0, 7.0, 4.0, 4.0]
    rated = series.counter_rate(samples(spark, [0, 30]), 30_000_000)
    assert by_time(rated, "rate") == [None, 1.0]


def test_extrapolated_rate(spark):
    # full window of samples 10 s apart: 20 s covered, 10 s to the window's start
    grown = series.counter_increase(samples(spark, [100, 110, 120, 130]), 30_000_000, extrapolate=True)
    assert by_time(grown, "increase")[3] == pytest.approx(30.0)
    # the samples begin far from the window's start: half a gap is added
    grown = series.counter_increase(samples(spark, [100, 110]), 60_000_000, extrapolate=True)
    assert by_time(grown, "increase")[1] == pytest.approx(15.0)
    # a counter that began at 0 is not extended beyond it
    grown = series.counter_increase(samples(spark, [0, 10]), 60_000_000, extrapolate=True)
    assert by_time(grown, "increase")[1] == pytest.approx(10.0)


def test_slope(spark):
    sloped = series.slope(samples(spark, [0, 20, 40, 30, 20]), 30_000_000)
    assert by_time(sloped, "slope") == [None, pytest.approx(2), pytest.approx(2), pytest.approx(0.5), pytest.approx(-1)]


@pytest.mark.parametrize(
    "counts,q,want",
    [
        ([(1, 10), (2, 20), (math.inf, 20)], 0.5, 1.0),
        ([(1, 10), (2, 20), (math.inf, 20)], 0.75, 1.5),
        ([(1, 10), (2, 20), (math.inf, 20)], 0.25, 0.5),
        ([(1, 0), (2, 0), (math.inf, 10)], 0.5, 2.0),
        ([(1, 0), (2, 0), (math.inf, 0)], 0.5, None),
        ([(1, 5), (2, 5), (4, 10), (math.inf, 10)], 0.9, 3.6),
    ],
)
def test_histogram_quantile(spark, counts, q, want):
    rows = [("a", float(le), n / 2) for le, n in counts for _ in range(2)]  # two instances
    df = spark.createDataFrame(rows, "k string, le double, value double")
    got = series.histogram_quantile(df, q, ["k"]).first().quantile
    assert got == (None if want is None else pytest.approx(want))


def test_resample_and_staleness(spark):
    df = samples(spark, [1, None, 2], step=100)
    got = series.resample(df, F.lit(at(50)), F.lit(at(850)), 100_000_000)
    assert [(r.tick.timestamp() - T0.timestamp(), r.value) for r in got.orderBy("tick").collect()] == [
        (50.0, 1.0), (150.0, 1.0), (250.0, 2.0), (350.0, 2.0), (450.0, 2.0)
    ]
    assert series.latest(df, F.lit(at(499))).first().value == 2.0
    assert series.latest(df, F.lit(at(500))).count() == 0


def test_peak_stays_inside_the_run(spark):
    df = samples(spark, [9, 1, 5, 2, 8], step=1800).unionByName(samples(spark, [0, 1, 1, 0, 0], step=1800, label="x"))
    runs = spark.createDataFrame([("r", at(1800), at(5400))], "run string, run_start timestamp, run_end timestamp")
    assert series.peak_over_run(df, runs, ["run"]).first().peak_lag == 6.0


def test_windowed_rates(spark):
    df = spark.createDataFrame([(at(1),), (at(2),), (at(31),)], "t timestamp")
    tumbling = {r.window_start.timestamp() - T0.timestamp(): r.rows for r in measure.tumbling_rate(df, "t", "30 seconds").collect()}
    assert tumbling == {0: 2, 30: 1}
    sliding = {r.window_start.timestamp() - T0.timestamp(): r.rows for r in measure.sliding_rate(df, "t", "30 seconds", "10 seconds").collect()}
    assert sliding == {-20: 2, -10: 2, 0: 2, 10: 1, 20: 1, 30: 1}


def test_append_continues_each_partition(spark):
    rows = [(f"k{i % 7}".encode(), b"v", T0, i) for i in range(50)]
    new = spark.createDataFrame(rows, "key binary, value binary, timestamp timestamp, position bigint")
    first = append_records(new, "position", "orders", 4, keep=["position"], width=8)
    second = append_records(new, "position", "orders", 4, end=log_end(first), keep=["position"], width=8)
    both = first.unionByName(second).collect()
    for p in {r.partition for r in both}:
        assert sorted(r.offset for r in both if r.partition == p) == list(range(sum(r.partition == p for r in both)))
    assert len({(bytes(r.key), r.partition) for r in both}) == 7
    per = [(r.partition, r.offset, r.position) for r in first.collect()]
    assert all(a[2] < b[2] for a in per for b in per if a[0] == b[0] and a[1] < b[1])
