"""How far each partition of the log has been dealt with."""

from pyspark.sql import DataFrame, Window, functions as F

from .scale import broadcast_up_to, bucket_of, number_rows


def commit_frontier(records: DataFrame) -> DataFrame:
    """Per partition: last offset with everything up to it accounted for.

    ``records`` has partition, offset and ``ok`` (stored or parked). One
    aggregation: the first record that is not ok holds the partition there.
    ``last_offset`` is the one before the commit position ``next_offset``;
    it equals next_offset - 1 because offsets are dense, and is one below the
    first offset where nothing could be committed.
    """
    return (
        records.groupBy("partition")
        .agg(
            F.min(F.when(~F.col("ok"), F.col("offset"))).alias("first_failure"),
            F.max("offset").alias("_max"),
        )
        .select(
            "partition",
            F.coalesce("first_failure", F.col("_max") + 1).alias("next_offset"),
            (F.coalesce("first_failure", F.col("_max") + 1) - 1).alias("last_offset"),
            F.col("first_failure").isNotNull().alias("blocked"),
        )
    )


def before_frontier(records: DataFrame, partitions: int) -> DataFrame:
    """Records that may be written: those ahead of nothing unaccounted for.

    The joined table has one row per log partition, ``partitions`` at most.
    """
    frontier = commit_frontier(records).select("partition", "next_offset")
    return (
        records.join(broadcast_up_to(frontier, partitions), "partition")
        .where(F.col("offset") < F.col("next_offset"))
        .drop("next_offset")
    )


def offset_chunks(records: DataFrame, size: int, width: int | None = None) -> DataFrame:
    """Adds ``chunk``: runs of ``size`` consecutive records of a partition, from 0."""
    widths = {} if width is None else {"width": width}
    numbered = number_rows(records, "offset", group=["partition"], into="_number", **widths)
    return numbered.withColumn("chunk", bucket_of(F.col("_number") - 1, size)).drop("_number")


def dense_chunks(records: DataFrame, size: int) -> DataFrame:
    """The same for a log whose offsets are dense and begin at 0: the offset gives the chunk."""
    return records.withColumn("chunk", bucket_of(F.col("offset"), size))


def consumer_lag(end: DataFrame, committed: DataFrame) -> DataFrame:
    """Records between the committed offset and the end of the log, per partition.

    Both tables have one row per partition. A partition without a commit lags
    by its whole length.
    """
    done = committed.select("partition", F.col("next_offset").alias("committed"))
    return (
        end.withColumnRenamed("next_offset", "log_end")
        .join(done, "partition", "left")
        .select(
            "partition",
            "log_end",
            F.coalesce("committed", F.lit(0).cast("bigint")).alias("committed"),
            (F.col("log_end") - F.coalesce("committed", F.lit(0))).alias("lag"),
        )
    )


def partition_skew(log: DataFrame) -> DataFrame:
    """Records per partition, and each partition's share of the log."""
    sizes = log.groupBy("partition").agg(F.count("*").alias("records"))
    # one row per partition
    total = F.sum("records").over(Window.partitionBy(F.lit(0)))
    return sizes.withColumn("share", F.col("records") / total)
