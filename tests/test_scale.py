"""The skew-safe building blocks against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from eventledger.operators import measure, scale


def skewed(spark, n=400, seed=1):
    rng = random.Random(seed)
    keys = [None if rng.random() < 0.1 else ("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}") for _ in range(n)]
    return spark.createDataFrame(list(enumerate(keys)), "i bigint, key string")


@pytest.mark.parametrize("threshold", [1, 10, 10_000])
def test_lookup_equals_a_left_join(spark, threshold):
    left = skewed(spark)
    right = left.where("key is not null and key <> 'k3'").groupBy("key").agg(
        F.max("i").alias("last"), F.count("*").alias("n")
    )
    got = scale.lookup(left, right, "key", "n", ["i"], frequent_rows=threshold)
    want = left.join(right, "key", "left").select("i", "key", "last", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lookup_spreads_frequent_and_missing_keys(spark):
    """No task of the final join may hold the hot key or the rows without a key."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        left = spark.range(4000).select(
            F.col("id").alias("i"),
            F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 < 3, "hot").otherwise(
                F.concat(F.lit("k"), F.col("id").cast("string"))
            ).alias("key"),
        )
        right = left.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
        joined = scale.lookup(left, right, "key", "n", ["i"], frequent_rows=100)
        # the sum keeps the optimizer from dropping the join
        tasks = joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("rows"), F.sum("n"))
        sizes = [r["rows"] for r in tasks.collect()]
        assert len(sizes) == 8 and max(sizes) < 1.5 * 4000 / 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


@pytest.mark.parametrize("width", [1, 7, 1 << 15])
def test_number_rows(spark, width):
    rng = random.Random(2)
    positions = rng.sample(range(-50, 500), 200)
    df = spark.createDataFrame([(p, "a" if p % 3 else "b", p % 2) for p in positions], "p bigint, g string, o int")
    got = scale.number_rows(df, "p", group=["g"], order=["o"], into="rn", width=width)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "p")).cast("bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_number_rows_over_everything(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("p"))
    got = scale.number_rows(df, "p", into="rn", width=10)
    assert sorted(map(tuple, got.collect())) == [(3 * i, i + 1) for i in range(100)]


def test_number_in_order(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = scale.number_in_order(df.repartition(5), [F.desc("a"), F.asc("b")], "rn")
    want = [(a, b, i + 1) for i, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))]
    assert [tuple(r) for r in got.orderBy("rn").collect()] == want


@pytest.mark.parametrize("spread", [10, 10_000, 10**9])
@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_quantiles(spark, spread, n):
    rng = random.Random(n * spread)
    values = [rng.randrange(-spread, spread) for _ in range(n)]
    df = spark.createDataFrame([("x", v) for v in values] + [("y", None)], "g string, v bigint")
    q = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    cont = scale.exact_quantiles(df, "v", q, ["g"]).where("g = 'x'").first()
    disc = scale.exact_quantiles(df, "v", q, ["g"], scale.DISCRETE).where("g = 'x'").first()
    for name, share in q.items():
        assert cont[name] == pytest.approx(np.percentile(values, 100 * share, method="linear"))
        place = max(int(np.ceil(share * n)) - 1, 0)
        assert disc[name] == sorted(values)[place]
    assert (cont["n"], cont["max"]) == (n, max(values))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v bigint")
    row = measure.latency_stats(empty, F.col("v")).first()
    assert row.asDict() == {
        "count": 0, "p50_seconds": 0.0, "p95_seconds": 0.0, "p99_seconds": 0.0, "max_seconds": 0.0
    }


def test_quantiles_without_groups(spark):
    df = spark.range(1, 101).select((F.col("id") * 1_000_000).alias("v"))
    row = measure.latency_stats(df, F.col("v"), method=measure.DISCRETE).first()
    assert (row["count"], row.p50_seconds, row.p99_seconds, row.max_seconds) == (100, 50.0, 99.0, 100.0)


@pytest.mark.parametrize("lookback", [5, 13])
def test_lookback_slots(spark, lookback):
    rng = random.Random(4)
    rows = [(s, t, float(rng.randrange(100))) for s in "ab" for t in rng.sample(range(300), 120)]
    df = spark.createDataFrame(rows, "s string, t bigint, v double")
    cut, keys = scale.with_lookback(df, ["s"], "t", lookback, slots=3)
    frame = Window.partitionBy(*keys).orderBy("t").rangeBetween(-(lookback - 1), 0)
    got = cut.withColumn("x", F.sum("v").over(frame)).where(~F.col("_earlier")).select("s", "t", "x")
    plain = Window.partitionBy("s").orderBy("t").rangeBetween(-(lookback - 1), 0)
    want = df.withColumn("x", F.sum("v").over(plain)).select("s", "t", "x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert cut.where("_earlier").count() > 0
