"""Building blocks that keep every task's share of the work bounded.

A key may hold a large part of all rows. None of the steps here gathers such a
key in one task: they pre-aggregate before the shuffle, number rows by bounded
buckets, and answer the rows of a frequent key from a small broadcast.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# A key with this many rows is "frequent". At most FREQUENT_KEYS of them are
# broadcast; every further key still gets its answer through the shuffle.
FREQUENT_ROWS = 1_000_000
FREQUENT_KEYS = 10_000

# Rows of a side whose size the caller can prove, up to which it is broadcast.
BROADCAST_ROWS = 100_000

# Consecutive numbers per bucket when rows are numbered by an integer position.
POSITIONS_PER_BUCKET = 1 << 15


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    The optimizer copies a projected expression into every filter and
    projection that refers to it, which multiplies the cost of parsing a
    document. It does not move expressions across a generator.
    """
    for name, expression in columns.items():
        df = df.withColumn(name, F.explode(F.array(expression)))
    return df


def broadcast_up_to(df: DataFrame, rows_at_most: int) -> DataFrame:
    """Broadcast hint if the proven bound allows it; otherwise left to the planner."""
    return F.broadcast(df) if rows_at_most <= BROADCAST_ROWS else df


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row."""
    together = rows[0]
    for row in rows[1:]:
        together = together.unionByName(row, allowMissingColumns=True)
    return together.agg(*[F.any_value(c, ignoreNulls=True).alias(c) for c in together.columns])


def bucket_of(number: Column, width: int) -> Column:
    """Whole-number bucket; keeps all 64 bits, unlike a division of doubles."""
    return F.call_function("div", number.cast("bigint"), F.lit(width).cast("bigint"))


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    spread: Sequence[str],
    frequent_rows: int | None = None,
) -> DataFrame:
    """Left outer join to ``right``, which has one row per ``key``.

    ``right[weight]`` says how many rows of ``left`` share the key. Keys above
    the threshold are answered by a broadcast of bounded size, and their rows
    then pass the shuffle join under a salt that matches nothing, so they
    spread evenly instead of meeting in one task. Rows without a key travel the
    same way. ``spread`` names columns that differ between rows of one key.
    """
    threshold = FREQUENT_ROWS if frequent_rows is None else frequent_rows
    columns = [c for c in right.columns if c != key]
    answer = F.struct(*[F.col(c) for c in columns])

    # the join adds this filter to one use of ``right``; adding it to both keeps
    # the two alike, so that what computes ``right`` runs once
    right = right.where(F.col(key).isNotNull())
    frequent = (
        right.where(F.col(weight) >= threshold)
        .orderBy(F.desc(weight), F.asc(key))
        .limit(FREQUENT_KEYS)
        .select(F.col(key).alias("_fkey"), answer.alias("_frequent"))
    )
    salt = F.pmod(F.xxhash64(*spread), F.lit(1 << 30)) + 1
    marked = left.join(F.broadcast(frequent), F.col(key) == F.col("_fkey"), "left").withColumn(
        "_salt",
        F.when(F.col("_fkey").isNotNull() | F.col(key).isNull(), salt).otherwise(F.lit(0).cast("bigint")),
    )
    # a weight is never negative, so this is always 0, but not a foldable constant:
    # a literal would be moved out of the join keys and the salt with it
    answers = right.select(
        F.col(key).alias("_rkey"),
        F.least(F.col(weight), F.lit(0)).cast("bigint").alias("_rsalt"),
        answer.alias("_answer"),
    )
    joined = marked.join(
        answers, (F.col(key) == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt")), "left"
    )
    found = F.coalesce("_frequent", "_answer")
    return joined.select(
        *[F.col(c) for c in left.columns], *[found[c].alias(c) for c in columns]
    )


def number_rows(
    df: DataFrame,
    position: str,
    group: Sequence[str] = (),
    order: Sequence[str] = (),
    into: str = "row_number",
    width: int = POSITIONS_PER_BUCKET,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Dense row numbers from 1 within ``group``, by ``order`` then ``position``.

    ``position`` is an integer, unique within (group, order); a bucket of
    ``width`` consecutive positions therefore holds at most ``width`` rows.
    Where positions repeat, ``ties`` orders the rows of one.
    Rows are numbered inside their bucket, and a running count over the buckets
    supplies what came before, so no task ever sorts a whole group.
    """
    keys = [*group, *order, "_bucket"]
    bucketed = df.withColumn("_bucket", bucket_of(F.col(position), width))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order, "_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = bucketed.groupBy(*keys).agg(F.count("*").alias("_rows"))
    starts = sizes.select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(position, *ties)
    return (
        bucketed.withColumn("_inside", F.row_number().over(inside))
        .join(starts, keys, "left")
        .withColumn(into, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_bucket", "_inside", "_before")
        .select(*df.columns, into)
    )


def number_in_order(df: DataFrame, order: Sequence[Column], into: str = "row_number") -> DataFrame:
    """Dense row numbers from 1 in one order over the whole table.

    Range partitioning cuts the table into parts of even size, whatever the
    distribution; each part is sorted by itself and continues the count of the
    parts before it. The sorted table is checkpointed, so that sizes and
    positions come from the same cut even if executors are lost in between.
    ``order`` should end in a unique column.
    """
    place_bits = (1 << 33) - 1
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(place_bits)))
        .checkpoint()
    )
    # one row per partition of the cut
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    starts = broadcast_up_to(starts, placed.rdd.getNumPartitions())
    return placed.join(starts, "_part").select(
        *df.columns, (F.col("_before") + F.col("_place") + 1).cast("bigint").alias(into)
    )


# Low bits of a value inside its bucket when quantiles are found by counting.
VALUE_BITS = 16

CONTINUOUS = "cont"
DISCRETE = "disc"


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: dict[str, float],
    by: Sequence[str] = (),
    method: str = CONTINUOUS,
) -> DataFrame:
    """Exact quantiles of a whole-number column, one row per group.

    Equal values are counted before the shuffle. The counts are then ranked in
    two levels: inside buckets of 65,536 consecutive values, and over the
    buckets. So a group of any size needs neither a sort nor a map of its values.

    ``cont`` interpolates between the two neighbouring ranks, ``disc`` takes the
    nearest rank. Adds ``n`` and ``max`` of each group. Without ``by`` there is
    always one row, with n = 0 and NULL quantiles when there is no input.
    """
    # never NULL after the filter; saying so lets both uses of the counts share one shuffle
    number = F.coalesce(F.col(value).cast("bigint"), F.lit(0))
    counts = (
        df.where(F.col(value).isNotNull())
        .select(*by, number.alias("_v"))
        .groupBy(*by, F.shiftright("_v", VALUE_BITS).alias("_bucket"), "_v")
        .agg(F.count("*").alias("_c"))
    )
    everything = list(by) or [F.lit(0)]
    upto = (Window.unboundedPreceding, Window.currentRow)
    buckets = counts.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_bc"))
    buckets = buckets.select(
        *by,
        "_bucket",
        (F.sum("_bc").over(Window.partitionBy(*everything).orderBy("_bucket").rowsBetween(*upto)) - F.col("_bc")).alias("_before"),
        F.sum("_bc").over(Window.partitionBy(*everything)).alias("_n"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(*upto)
    ranked = (
        counts.withColumn("_inside", F.sum("_c").over(inside))
        .join(buckets, [*by, "_bucket"])
        .select(
            *by,
            "_v",
            "_n",
            (F.col("_before") + F.col("_inside") - F.col("_c")).alias("_first"),
            (F.col("_before") + F.col("_inside")).alias("_next"),
        )
    )

    def at_rank(rank: Column) -> Column:
        """The value at a rank counted from 0."""
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_next")), F.col("_v")))

    aggregates = [F.coalesce(F.max("_n"), F.lit(0)).alias("n"), F.max("_v").alias("max")]
    for name, q in quantiles.items():
        if method == DISCRETE:
            rank = F.greatest(F.ceil(F.lit(float(q)) * F.col("_n")) - 1, F.lit(0))
            aggregates.append(at_rank(rank).cast("double").alias(name))
        else:
            place = F.lit(float(q)) * (F.col("_n") - 1)
            low, high = at_rank(F.floor(place)), at_rank(F.ceil(place))
            share = F.max(place - F.floor(place))
            aggregates.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*by).agg(*aggregates)


def with_lookback(
    samples: DataFrame, series: Sequence[str], time_us: str, lookback_us: int, slots: int = 16
) -> tuple[DataFrame, list[str]]:
    """Cut series into time slots that each carry the end of the slot before.

    Returns the rows, with ``_earlier`` set on the copies that only serve as
    history, and the columns to partition a window by. Inside such a window
    every row that is not a copy sees all rows of its series up to
    ``lookback_us`` back, while no task holds more than one slot of a series.
    """
    slot_us = lookback_us * slots
    slot = bucket_of(F.col(time_us), slot_us)
    late = F.col(time_us) >= (slot + 1) * F.lit(slot_us) - F.lit(lookback_us)
    copies = F.when(late, F.array(slot, slot + 1)).otherwise(F.array(slot))
    cut = (
        samples.withColumn("_slot", F.explode(copies))
        .withColumn("_earlier", F.col("_slot") != slot)
    )
    return cut, [*series, "_slot"]
