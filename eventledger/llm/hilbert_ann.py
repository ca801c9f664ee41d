"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few directions at a time and ordered along a Hilbert
curve, several times over with other directions and shifts. Near vectors tend to
have near places in some of the orders. Spark sorts each order by range
partitioning and cuts it into blocks; a query meets the blocks that its window of
places touches, and the nearest of all its windows are merged by the exact
distance.

How wide the window is, as a share of the order, is fitted on a bounded sample:
the narrowest width of a ladder at which the sample's recall reaches the target.
Clustered vectors get narrow windows, vectors without structure wide ones.
"""

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from eventledger.llm.common import share
from eventledger.operators.scale import number_in_order

CURVES, DIRECTIONS, BITS = 8, 8, 6
# Vectors that the directions, ranges and window are fitted on, and queries among them.
SAMPLE, SAMPLE_QUERIES = 10_000, 200
TARGET_RECALL = 0.97
# Vectors per block, and queries compared with a block at a time.
BLOCK, QUERIES = 2048, 512


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (0 to 2**bits - 1).

    Works from the coarsest bit to the finest: where a coordinate's bit is set the
    cell is mirrored, where it is not it is exchanged with the first coordinate.
    What remains is the Gray code of the place, bit by bit.
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, lower = 1 << level, (1 << level) - 1
        for axis in range(len(x)):
            mirrored = (x[axis] & bit) != 0
            swap = np.where(mirrored, 0, (x[0] ^ x[axis]) & lower)
            x[0] ^= np.where(mirrored, lower, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flips
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = key << 1 | x[axis] >> level & 1
    return key


class Curves:
    """The directions, ranges and shifts of all curves."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, directions: int = DIRECTIONS, bits: int = BITS, seed: int = 7):
        dim = sample.shape[1]
        self.directions, self.bits = min(directions, dim), bits
        draw = np.random.default_rng(seed)
        self.center = sample.mean(axis=0)
        bases, rotated = [], np.zeros((dim, 0))
        for _ in range(curves):
            if rotated.shape[1] < self.directions:  # all directions of one rotation are used once
                rotated = np.linalg.qr(draw.normal(size=(dim, dim)))[0]
            bases.append(rotated[:, : self.directions])
            rotated = rotated[:, self.directions :]
        self.bases = bases
        spread = [(sample - self.center) @ b for b in bases]
        self.low = [s.min(axis=0) for s in spread]
        # half as much room again, into which each curve is shifted at random
        self.room = [1.5 * np.maximum(np.ptp(s, axis=0), 1e-9) for s in spread]
        self.shift = [draw.random(self.directions) / 3 for _ in bases]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One row per curve."""
        out = []
        for base, low, room, shift in zip(self.bases, self.low, self.room, self.shift):
            place = ((vectors - self.center) @ base - low) / room + shift
            cells = np.clip(np.floor(place * (1 << self.bits)), 0, (1 << self.bits) - 1)
            out.append(hilbert_keys(cells, self.bits))
        return np.array(out)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def fitted_window(curves: Curves, sample: np.ndarray, k: int, target: float = TARGET_RECALL) -> float:
    """The narrowest half window, as a share of all places, that reaches the recall on the sample."""
    n = len(sample)
    if n <= 2 * k + 2:
        return 1.0
    chosen = np.linspace(0, n - 1, min(n, SAMPLE_QUERIES)).astype(int)
    ranks = np.empty((len(curves.bases), n), np.int64)
    for row, keys in zip(ranks, curves.keys(sample)):
        row[np.argsort(keys, kind="stable")] = np.arange(n)
    gaps = []
    for q in chosen:
        away = distances(sample, sample[q])
        away[q] = np.inf
        near = np.argpartition(away, k)[:k]
        gaps.append(np.abs(ranks[:, near] - ranks[:, [q]]).min(axis=0))
    gap = np.concatenate(gaps) / n
    width = 0.001
    while width < 1.0 and (gap <= width).mean() < target:
        width *= 1.25
    return min(width, 1.0)


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, vec) of the rows that can be compared: see ``nearest``."""
    kept = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("vec")
    ).where(
        F.col("vec_id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & F.exists("vec", lambda x: x != 0)
    )
    return kept.distinct()


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    id_column: str = "vec_id",
    column: str = "embedding",
    target: float = TARGET_RECALL,
) -> DataFrame:
    """The ``k`` nearest found for each query row, by Euclidean distance.

    Rows: query_id, rank from 1, vec_id, score; ties go to the smaller id. A row
    takes part if it has an id and its vector has components that are all finite and
    not all zero. Vectors are compared with those of as many components, one number
    of components after the other. Rows that repeat in full count once; a query is
    never its own neighbour. Equal vectors share one place on the curves, with
    their k + 1 smallest ids. An empty table gives no rows.
    """
    rows = usable(vectors, id_column, column).checkpoint()
    lengths = [r["dim"] for r in rows.select(F.size("vec").alias("dim")).distinct().orderBy("dim").collect()]
    found = [_nearest_of(rows.where(F.size("vec") == dim), is_query, k, target) for dim in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return functools.reduce(DataFrame.unionByName, found)


def _nearest_of(rows: DataFrame, is_query, k: int, target: float) -> DataFrame:
    """``nearest`` for rows (vec_id, vec) whose vectors have equally many components."""
    spark = rows.sparkSession
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    places = (
        few.groupBy("vec")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("place"), "vec", "ids")
        .checkpoint()
    )
    n = places.count()
    # SAMPLE places are expected below the threshold, however many partitions there are
    hashed = places.select(F.xxhash64("place").alias("hash"), "place", "vec")
    taken = hashed.where(F.pmod("hash", F.lit(1 << 40)) < int(min(1.0, SAMPLE / n) * (1 << 40)))
    drawn = taken.collect() or hashed.orderBy("hash").limit(1).collect()
    sample = np.array([r["vec"] for r in sorted(drawn, key=lambda r: (r["hash"], r["place"]))])
    curves = Curves(sample)
    reach = max(8 * k, math.ceil(fitted_window(curves, sample, k, target) * n))
    shared = share(spark, curves)

    def keyed(batches):
        curves = shared()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = curves.keys(_matrix(batch.column("vec")))
            ids = batch.column("place")
            for curve, key in enumerate(keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), curve, np.int32)), pa.array(key), ids],
                    names=["curve", "key", "place"],
                )

    ordered = number_in_order(
        places.select("place", "vec").mapInArrow(keyed, "curve int, key bigint, place bigint"),
        [F.col("curve"), F.col("key"), F.col("place")],
        "number",
    ).select("curve", "place", (F.col("number") - 1 - F.col("curve") * F.lit(n)).alias("at"))
    asked = rows.where(is_query).withColumnRenamed("vec_id", "query_id")
    asked = asked.join(places.select("vec", "place"), "vec").select("query_id", "place").checkpoint()
    heads = asked.select("place").distinct()
    # queries that meet a block, on average, decide into how many parts they are dealt
    per_block = heads.count() * min(1.0, (2 * reach + BLOCK) / n)
    parts = max(1, math.ceil(per_block / QUERIES))
    at_block = ordered.join(places.select("place", "vec"), "place")
    blocks = at_block.select(
        "curve",
        F.floor(F.col("at") / BLOCK).cast("bigint").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        "place",
        "vec",
    )
    first = F.floor(F.greatest(F.col("at") - reach, F.lit(0)) / BLOCK).cast("bigint")
    last = F.floor(F.least(F.col("at") + reach, F.lit(n - 1)) / BLOCK).cast("bigint")
    windows = at_block.join(heads, "place", "left_semi").select(
        "curve",
        F.explode(F.sequence(first, last)).alias("block"),
        F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int").alias("part"),
        "place",
        "vec",
    ).toDF("q_curve", "q_block", "q_part", "q_place", "q_vec")

    def meet(block: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if block.num_rows and queries.num_rows:
            ids, there = block.column("place").to_numpy(), _matrix(block.column("vec"))
            for query, vector in zip(queries.column("q_place").to_pylist(), _matrix(queries.column("q_vec"))):
                away = distances(there, vector)
                best = np.lexsort((ids, away))[: k + 1] if len(ids) <= k + 1 else None
                if best is None:
                    edge = np.partition(away, k)[k]
                    close = np.flatnonzero(away <= edge)
                    best = close[np.lexsort((ids[close], away[close]))][: k + 1]
                out[0] += [query] * len(best)
                out[1] += ids[best].tolist()
                out[2] += away[best].tolist()
        return pa.table(
            {"asked": pa.array(out[0], pa.int64()), "found": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())}
        )

    met = (
        blocks.groupBy("curve", "block", "part")
        .cogroup(windows.groupBy("q_curve", "q_block", "q_part"))
        .applyInArrow(meet, "asked bigint, found bigint, score double")
    )
    merged = met.distinct().withColumn(
        "at", F.row_number().over(Window.partitionBy("asked").orderBy("score", "found"))
    ).where(F.col("at") <= k + 1)
    listed = (
        asked.join(merged, F.col("place") == F.col("asked"))
        .join(places.select(F.col("place").alias("found"), "ids"), "found")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where(F.col("vec_id") != F.col("query_id"))
    )
    ranked = listed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
