"""Contiguous shards of equal size from global prefix sums of byte sizes.

The rows are put in one order by a range partitioning. Each partition adds up
its own sizes; the totals, one row per partition, give every partition its
starting offset in the whole; a row's shard is the sixteenth (for 16 shards) of
all bytes in which its middle lies. No task holds more than its partition, and
no key has to meet in one place.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from eventledger.llm.common import text_or_empty

# A group of equal texts goes whole to one shard if it is no larger than this share of it.
GROUP_SHARE = 0.02


def _running(batches):
    """Adds to each row of a sorted partition the bytes and rows before it there."""
    bytes_before = rows_before = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        upto = np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(bytes_before + upto - size, pa.int64()),
                pa.array(np.arange(rows_before, rows_before + len(size)), pa.int64()),
            ],
            names=[*batch.schema.names, "bytes_before", "rows_before"],
        )
        if len(size):
            bytes_before += int(upto[-1])
            rows_before += len(size)


def assign_shards(docs: DataFrame, shards: int = 16, partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Rows are ordered by the hash of their text, then doc_id, so equal texts lie
    next to each other; a cut that would part a group of equal texts no larger
    than GROUP_SHARE of a shard is moved to the nearer end of the group. Sizes of
    shards differ by one row or one such group at most. ``slot`` counts the rows
    of a shard from 0 without gaps. A null text has size 1, like an empty one,
    and the checksum 0; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    raw = F.encode(text_or_empty(), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        (F.octet_length(text_or_empty()) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text_or_empty()).alias("text_hash"),
    )
    keys = ["text_hash", "text_crc32", "size", "doc_id"]
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        rows.repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(
            _running,
            "doc_id bigint, size bigint, text_crc32 bigint, text_hash bigint, "
            "bytes_before bigint, rows_before bigint",
        )
        .withColumn("part", F.spark_partition_id())
        .checkpoint()  # both uses below must see the same cut
    )
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    # one row per partition of the cut
    starts = totals.select(
        "part",
        F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("r").over(upto), F.lit(0)).alias("r0"),
    )
    at = placed.join(F.broadcast(starts), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "text_hash",
        (F.col("bytes_before") + F.col("b0")).alias("start"),
        (F.col("rows_before") + F.col("r0")).alias("number"),
    )
    whole = totals.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()["b"]
    target = whole / shards

    def shard_of(middle):
        """Which equal part of all bytes a place lies in; places are counted in half bytes."""
        part = F.floor(middle * F.lit(shards) / F.lit(max(2 * whole, 1)))
        return F.least(part, F.lit(shards - 1)).cast("int")

    own = shard_of((2 * F.col("start") + F.col("size")).cast("double"))
    # the groups that lie across a cut: at most one per cut
    cut = at.groupBy("text_hash", "text_crc32", "size").agg(
        F.min("start").alias("first"),
        F.sum("size").alias("group_bytes"),
        F.min(own).alias("low"),
        F.max(own).alias("high"),
    ).where((F.col("low") != F.col("high")) & (F.col("group_bytes") <= GROUP_SHARE * target))
    cut = cut.select(
        "text_hash",
        "text_crc32",
        "size",
        shard_of((2 * F.col("first") + F.col("group_bytes")).cast("double")).alias("together"),
    )
    assigned = at.join(F.broadcast(cut.limit(shards)), ["text_hash", "text_crc32", "size"], "left").select(
        "doc_id", "size", "text_crc32", "number", F.coalesce("together", own).alias("shard")
    )
    firsts = assigned.groupBy("shard").agg(F.min("number").alias("first"))
    return assigned.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("number") - F.col("first")).cast("bigint").alias("slot"),
    )
