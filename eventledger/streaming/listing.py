"""An index for listings: which orders come next, without a scan of the store.

A narrow copy of each folder of orders (time, id, customer) is kept twice, in the
order of time and by customer, cut into slices of bounded size. A small table knows
the first and the last row of each slice and how many it has. A page goes back from
its cursor only over as many slices as hold its rows for certain; for one customer,
whose share of a slice is not known, it goes back further until it has them.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..functions import paging
from .manifest import BATCH

SLICE_ROWS = 100_000
CUSTOMER_BUCKETS = 16
# Slices looked at first; four times as many whenever they are too few.
SLICES_FIRST = 64

BY_TIME, BY_CUSTOMER = "time", "customer"

LISTED = T.StructType([
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("cluster", T.StringType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("slice", T.IntegerType()),
])
PLACE = T.StructType([T.StructField("us", T.LongType()), T.StructField("id", T.StringType())])
SLICES = T.StructType([
    T.StructField("cluster", T.StringType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("slice", T.IntegerType()),
    T.StructField("low", PLACE),
    T.StructField("high", PLACE),
    T.StructField("rows", T.LongType()),
])


def customer_bucket(customer_id: Column) -> Column:
    return F.pmod(F.hash(customer_id), F.lit(CUSTOMER_BUCKETS)).cast("int")


def write_listing(orders: DataFrame, count: int, path: str) -> None:
    """Both copies of one folder of orders, one file per bucket and slice."""
    narrow = orders.select("processed_at", "order_id", "customer_id")
    twice = narrow.withColumn(
        "_copy",
        F.explode(
            F.array(
                F.struct(F.lit(BY_TIME).alias("cluster"), F.lit(0).alias("bucket")),
                F.struct(F.lit(BY_CUSTOMER).alias("cluster"), customer_bucket(F.coalesce("customer_id", F.lit(""))).alias("bucket")),
            )
        ),
    ).select(*narrow.columns, "_copy.cluster", "_copy.bucket")
    order = ["cluster", "bucket", "processed_at", "order_id"]
    cut = twice.repartitionByRange(max(1, -(-2 * count // SLICE_ROWS)), *order).sortWithinPartitions(*order)
    cut.withColumn("slice", F.spark_partition_id()).write.mode("overwrite").partitionBy("cluster", "bucket", "slice").parquet(path)


def slices_in(spark: SparkSession, path: str) -> DataFrame:
    """The slices that ``write_listing`` has left in a folder."""
    at = F.struct(F.unix_micros("processed_at").alias("us"), F.col("order_id").alias("id"))
    return (
        spark.read.schema(LISTED)
        .parquet(path)
        .groupBy("cluster", "bucket", "slice")
        .agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("rows"))
        .select(*SLICES.fieldNames())
    )


class Position(NamedTuple):
    us: int
    id: str

    def column(self) -> Column:
        return F.struct(F.lit(self.us).cast("bigint").alias("us"), F.lit(self.id).alias("id"))


def _chosen(slices: DataFrame, rows: int, behind: Position | None) -> tuple[list[Row], bool]:
    """The slices that hold at least the next ``rows`` rows behind a position, and whether there are more.

    Slices wholly behind it are counted from the newest on. Where they suffice, no
    row before the first place of the last of them is needed, so every slice that
    ends earlier is left out.
    """
    open_ = slices if behind is None else slices.where(F.col("low") < behind.column())
    newest, most = open_.orderBy(F.desc("low.us"), F.desc("low.id")), SLICES_FIRST
    while True:
        seen, total, floor = newest.limit(most).collect(), 0, None
        for row in seen:
            if behind is None or (row["high"]["us"], row["high"]["id"]) < behind:
                total += row["rows"]
            if total >= rows:
                floor = Position(*row["low"])
                break
        if floor is not None:
            return open_.where(F.col("high") >= floor.column()).collect(), True
        if len(seen) < most:
            return seen, False
        most *= 4


def next_keys(
    slices: DataFrame,
    read: Callable[[list[Row]], DataFrame],
    rows: int,
    page_token: str = "",
    customer_id: str = "",
) -> list[Row]:
    """(batch_id, order_id, token) of the next ``rows`` orders, newest first.

    ``read`` gives the rows of some slices, in the shape of LISTED with the folder's number.
    """
    behind = None
    if page_token:
        stamp, order_id = paging.decode_cursor(page_token)
        spark = slices.sparkSession
        us = spark.range(1).select(F.unix_micros(F.lit(stamp).cast("timestamp"))).first()[0]
        behind = Position(us, order_id)
    if customer_id:
        slices = slices.where((F.col("cluster") == BY_CUSTOMER) & (F.col("bucket") == customer_bucket(F.lit(customer_id))))
    else:
        slices = slices.where(F.col("cluster") == BY_TIME)
    wanted = rows
    while True:
        chosen, more = _chosen(slices, wanted, behind)
        if not chosen:
            return []
        found = read(chosen)
        if customer_id:
            found = found.where(F.col("customer_id") == customer_id)
        if behind is not None:
            us = F.unix_micros("processed_at")
            found = found.where((us <= behind.us) & ((us < behind.us) | (F.col("order_id") < behind.id)))
            found = found.where(F.col("processed_at") <= F.timestamp_micros(F.lit(behind.us)))
        keys = (
            found.orderBy(F.desc("processed_at"), F.desc("order_id"))
            .limit(rows)
            .select(BATCH, "order_id", paging.page_token(F.col("processed_at"), F.col("order_id")).alias("token"))
            .collect()
        )
        if len(keys) == rows or not more:
            return keys
        wanted *= 4
