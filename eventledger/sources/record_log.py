"""Reading and appending the keyed record log."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import partition_for
from ..operators.scale import broadcast_up_to, number_rows
from ..schemas import HEADERS, RECORD


def read_log(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """A record log kept as Parquet files, from its beginning."""
    if streaming:
        return spark.readStream.schema(RECORD).options(**options).parquet(path)
    return spark.read.schema(RECORD).options(**options).parquet(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, streaming: bool = True, **options) -> DataFrame:
    """The same rows from Kafka, where the connector is installed.

    ``maxOffsetsPerTrigger`` bounds a micro-batch, ``minPartitions`` splits a
    partition that holds much of the backlog over several tasks.
    """
    reader = spark.readStream if streaming else spark.read
    return (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("includeHeaders", "true")
        .options(**options)
        .load()
    )


def kafka_sink(records: DataFrame, servers: str, topic: str) -> None:
    """Append key, value and headers of a batch to a Kafka topic, acknowledged by all replicas."""
    (
        records.select("key", "value", "headers")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("topic", topic)
        .save()
    )


def log_end(log: DataFrame) -> DataFrame:
    """(partition, next_offset): where the next record of each partition goes."""
    return log.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))


def append_records(
    new: DataFrame,
    position: str,
    topic: str,
    partitions: int,
    end: DataFrame | None = None,
    partition: Column | None = None,
    keep: Sequence[str] = (),
    order: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Place key/value/timestamp rows on the log: partition by key, dense offsets.

    ``position`` is a whole number giving the order of arrival, after the columns
    of ``order`` and unique with them; it should be dense. ``end`` says where each partition continues; it has at most ``partitions`` rows.
    The result has the record schema, plus the columns of ``keep``. ``new`` is
    read twice; checkpoint it first if it is costly to compute.
    """
    placed = new.withColumn(
        "partition", partition_for(F.col("key"), partitions) if partition is None else partition
    )
    widths = {} if width is None else {"width": width}
    numbered = number_rows(
        placed, position, group=["partition"], order=order, into="_number", **widths
    )
    if end is not None:
        numbered = numbered.join(broadcast_up_to(end, partitions), "partition", "left")
        first = F.coalesce("next_offset", F.lit(0))
    else:
        first = F.lit(0)
    headers = F.col("headers") if "headers" in new.columns else F.array()
    return numbered.select(
        "key",
        "value",
        F.lit(topic).alias("topic"),
        "partition",
        (first + F.col("_number") - 1).cast("bigint").alias("offset"),
        F.col("timestamp"),
        F.lit(0).alias("timestampType"),
        headers.cast(HEADERS).alias("headers"),
        *keep,
    )
