"""Rates and sums at ticks that are not sample times."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventledger.operators import series

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SECOND = 1_000_000


def samples(spark, rows):
    """rows: (second, instance, value)"""
    full = [(T0 + dt.timedelta(seconds=s), "m", i, "x", float(v)) for s, i, v in rows]
    return spark.createDataFrame(full, "ts timestamp, metric string, instance string, label string, value double")


def at(second):
    return F.lit(T0 + dt.timedelta(seconds=second))


def seconds(df, *columns):
    return sorted(((r.tick - T0.replace(tzinfo=None)).total_seconds(), *[r[c] for c in columns]) for r in df.collect())


def test_rate_between_samples_with_a_reset(spark):
    found = samples(spark, [(0, "a", 10), (10, "a", 20), (20, "a", 5), (31, "a", 6)])
    rated = series.rate_at_ticks(found, at(5), at(65), 10 * SECOND, 30 * SECOND)
    # windows (t - 30, t]: two samples at least, a fall counts from 0
    assert seconds(rated, "increase") == [(15.0, 10.0), (25.0, 15.0), (35.0, 6.0), (45.0, 1.0)]
    assert {r.rate for r in rated.where("increase = 15").collect()} == {0.5}


def test_rate_is_drawn_out_to_the_window(spark):
    found = samples(spark, [(s, "a", s) for s in range(100, 200, 10)])
    rated = series.rate_at_ticks(found, at(165), at(165), SECOND, 30 * SECOND, extrapolate=True)
    # samples at 140, 150, 160: 20 in 20 s; 5 s to either end, both nearer than a gap
    assert [round(r.increase, 9) for r in rated.collect()] == [30.0]
    # a counter was never below 0: from 150 back it would reach 0 after 2 s
    young = samples(spark, [(150, "a", 2), (160, "a", 12)])
    rated = series.rate_at_ticks(young, at(162), at(162), SECOND, 60 * SECOND, extrapolate=True)
    assert [round(r.increase, 9) for r in rated.collect()] == [14.0]


@pytest.mark.parametrize("slot", [1, 16])
def test_series_sampled_at_different_times_add_up(spark, slot):
    found = samples(spark, [(1, "a", 1), (11, "a", 2), (21, "a", 4), (4, "b", 10), (14, "b", 20), (14, "b", 30), (500, "a", 7)])
    summed = series.sum_at_ticks(found, 5 * SECOND, staleness_us=20 * SECOND)
    want = {5: 11, 10: 11, 15: 32, 20: 32, 25: 34, 30: 34, 35: 4, 40: 4, 500: 7, 505: 7, 510: 7, 515: 7}
    assert dict(seconds(summed, "value")) == want
    # a sample at a tick counts there; the next one takes over at its own time
    one = samples(spark, [(0, "a", 1), (10, "a", 2)])
    assert seconds(series.aligned(one, 10 * SECOND, staleness_us=10 * SECOND), "value") == [(0.0, 1.0), (10.0, 2.0)]
    assert series.aligned(one.limit(0), SECOND).count() == 0


def test_peak_of_a_sum(spark):
    found = samples(spark, [(0, "a", 5), (7, "b", 5), (12, "a", 0), (30, "b", 50)])
    runs = spark.createDataFrame(
        [("one", T0, T0 + dt.timedelta(seconds=20)), ("none", T0 - dt.timedelta(days=9), T0 - dt.timedelta(days=8))],
        "run string, run_start timestamp, run_end timestamp",
    )
    peak = series.peak_of_sum(found, runs, ["run"], 5 * SECOND)
    assert [tuple(r) for r in peak.collect()] == [("one", 10.0)]
    # by sample times alone the two never meet
    assert [r.peak_lag for r in series.peak_over_run(found, runs, ["run"]).collect()] == [5.0]
