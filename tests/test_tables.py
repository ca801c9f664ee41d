"""Orders of any size: totals and problems without gathering their lines."""

from pyspark.sql import functions as F

from eventledger.functions import ingress
from eventledger.operators import ingest
from eventledger.sources import tables

LINES = 25_000


def large_order(spark, folder):
    """Order 7 has 25,000 good lines but for three; order 8 has one, order 9 none."""
    n = F.col("id")
    lines = spark.range(LINES).select(
        F.lit(7).cast("bigint").alias("l_orderkey"), (n + 1).alias("l_partkey"), F.lit(1).cast("bigint").alias("l_suppkey"),
        F.when(n.isin(10, 11), 3).otherwise(n + 1).cast("int").alias("l_linenumber"),
        F.when(n == 20_000, 0.0).otherwise(2.0).alias("l_quantity"),
        F.when(n.isin(11, 24_999), -5.0).otherwise(100.0).alias("l_extendedprice"),
    )
    one = lines.limit(1).withColumn("l_orderkey", F.lit(8).cast("bigint"))
    lines.union(one).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(7, 10).select(
        F.col("id").alias("o_orderkey"), F.lit(1).cast("bigint").alias("o_custkey"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("o_orderdate"),
    ).write.parquet(f"{folder}/orders.parquet")


def test_totals_and_problems_of_a_large_order(spark, folder):
    large_order(spark, folder)
    message = ingress.validation_message(
        ingress.problems_of(F.col("customer_id"), F.col("n_items"), F.col("faulty"))
    )
    rows = {r.order_key: r for r in tables.order_requests(spark, folder).withColumn("message", message).collect()}
    assert rows[7].n_items == LINES
    assert rows[7].total_cents == 200 * (LINES - 3) - 2 * 2 * 5
    # lines 10 and 11 both have number 3, after line 2 and before line 3 by the other columns
    order = sorted(range(LINES), key=lambda i: (3 if i in (10, 11) else i + 1, i + 1))
    at = {i: order.index(i) for i in (11, 20_000, 24_999)}
    assert rows[7].message == (
        f"invalid order: items[{at[11]}].unit_price_cents must be >= 0; "
        f"items[{at[20_000]}].quantity must be > 0; items[{at[24_999]}].unit_price_cents must be >= 0"
    )
    assert (rows[8].total_cents, rows[8].message) == (200, None)
    assert (rows[9].total_cents, rows[9].message) == (0, "invalid order: at least one item is required")


def test_the_body_of_a_large_order_is_refused_by_its_size(spark, folder):
    large_order(spark, folder)
    bodies = tables.order_bodies(spark, folder)
    sizes = {r.order_key: r.size for r in bodies.select("order_key", F.octet_length("body").alias("size")).collect()}
    assert sizes[7] > 1 << 20
    reasons = {r.order_key: r.reject_reason for r in ingest.decode_requests(bodies).collect()}
    assert reasons == {7: ingest.MALFORMED_BODY, 8: None, 9: ingest.VALIDATION}


def test_a_total_beyond_64_bits_is_null(spark, folder):
    large_order(spark, folder)
    spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("l_extendedprice", F.lit(4e18)).write.parquet(
        f"{folder}/wide/lineitem.parquet"
    )
    spark.read.parquet(f"{folder}/orders.parquet").write.parquet(f"{folder}/wide/orders.parquet")
    rows = {r.order_key: r.total_cents for r in tables.order_requests(spark, f"{folder}/wide").collect()}
    assert rows == {7: None, 8: 8 * 10**18, 9: 0}
