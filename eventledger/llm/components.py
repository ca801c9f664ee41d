"""Connected components by alternating star contractions."""

from pyspark.sql import DataFrame, functions as F


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (or smaller) neighbours to its smallest one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.where("v < u")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("m", "u").alias("m")
    )
    linked = around.join(least, "u")
    if large:
        moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


# Edges per partition between rounds: few edges in many partitions make many small shuffle blocks.
PER_PARTITION = 100_000


def compacted(df: DataFrame, per_partition: int = PER_PARTITION) -> DataFrame:
    """A checkpoint of ``df``, read back in no more partitions than its rows need."""
    kept = df.checkpoint()
    return kept.coalesce(max(1, -(-kept.count() // per_partition)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v); a component is named by its smallest node.

    The number of rounds grows with the logarithm of the longest chain. Each
    round ends in a checkpoint; the driver sees a few numbers per round.
    """
    now = compacted(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    while True:
        now = compacted(_stars(_stars(now, True), False))
        state = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
