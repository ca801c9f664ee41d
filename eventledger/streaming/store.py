"""The tables that the jobs write: record logs and the stored orders.

The tables of a job share one list of commits (see ``manifest``): a batch becomes
visible in all of them at once or not at all, and of two jobs that would append to
the same tables one is refused. A table is a set of folders ``batch_id=n``, n being
the number of the commit that added it.

Orders are laid out by a hash of the order id inside each folder. Their event ids
are kept in a table of their own, laid out by a hash of the event id. A third table
holds a Bloom filter per folder and bucket for either id: a micro-batch asks the
filters first and then reads only the buckets of those folders that may hold one of
its ids. Folders are merged by levels, so their number grows with the logarithm of
the number of batches.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.scale import BROADCAST_ROWS
from ..schemas import RECORD, STORE
from ..sources.record_log import log_end
from . import listing
from .manifest import BATCH, Manifest, manifest_of

BUCKET = "id_bucket"
BUCKETS = 64

ENDS = T.StructType([
    T.StructField("partition", T.IntegerType()),
    T.StructField("next_offset", T.LongType()),
])
EVENT_INDEX = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("order_id", T.StringType()),
])
# One row per id kind, bucket and segment of a folder.
FILTERS = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("segment", T.IntegerType()),
    T.StructField("words", T.ArrayType(T.LongType())),
])

# Bits of a filter per id, and how many of them an id sets: wrong once in some 20,000 times.
BITS_PER_ID, BITS_SET = 24, 8
# Words of 64 bits in a segment of a filter.
LEAST_WORDS, MOST_WORDS = 16, 1024
# Ids of a batch that ask one segment together.
ASKED_TOGETHER = 100_000

# So many folders of a level become one of the next; larger ones stay as they are.
MERGED_FOLDERS = 8
MERGED_ROWS = 64_000_000


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def batches_of(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the folders of a table."""
    known = manifest_of(spark, path)
    if known is not None:
        return set(known[0].folders(known[1]))
    folder, system = _folder(spark, path)
    if not system.exists(folder):
        return set()
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return {int(n.removeprefix(f"{BATCH}=")) for n in names if n.startswith(f"{BATCH}=")}


def read_batches(spark: SparkSession, path: str, schema: T.StructType, only: Column | None = None) -> DataFrame:
    """What the commits have added to a table, or all its folders where it has no commits.

    An empty table where nothing was written yet. ``only`` is a condition on the
    layout (see ``bucket_of_id``) that leaves whole folders unread.
    """
    laid_out = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())]) if only is not None else schema
    batches = read_folders(spark, path, laid_out, [f"{path}/{BATCH}={n}" for n in sorted(batches_of(spark, path))])
    if only is not None:
        batches = batches.where(only)
    return batches.select(*schema.fieldNames(), BATCH)


def read_folders(spark: SparkSession, path: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    full = _with_batch(schema)
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*folders)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A folder of a table without commits."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def add(df: DataFrame, manifest: Manifest, table: str) -> dict:
    """Writes what the next commit adds to a table."""
    path = manifest.attempt(table)
    df.write.mode("overwrite").parquet(path)
    return {"from": path}


# --- record logs


def log_tables(log: str, **others: str) -> dict[str, str]:
    return {"log": log, **others}


def commits_of_log(spark: SparkSession, log: str) -> Manifest:
    return Manifest(spark, f"{log.rstrip('/')}-commits")


def as_ends(spark: SparkSession, ends: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(ends.items()), ENDS)


def ends_in(records: DataFrame) -> dict[int, int]:
    """One number per partition of a log."""
    return {r["partition"]: r["next_offset"] for r in log_end(records).collect()}


def end_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(partition, next_offset) of a log; kept with its commits, else found by a scan."""
    known = manifest_of(spark, path)
    if known is None:
        return log_end(read_batches(spark, path, RECORD))
    manifest, table = known
    return as_ends(spark, ends_of(manifest, table))


def ends_of(manifest: Manifest, table: str) -> dict[int, int]:
    ends = manifest.end_of(table)
    # folders from before the log had commits carry no ends
    old = [n for n, info in manifest.folders(table).items() if "records" not in info]
    if old and not ends:
        path = manifest.state()["tables"][table]["path"]
        ends = ends_in(read_folders(manifest.spark, path, RECORD, [f"{path}/{BATCH}={n}" for n in old]))
    return ends


class Appended(NamedTuple):
    """What a commit adds to a log (nothing where there are no records) and its new ends."""

    adds: dict[str, dict]
    ends: dict[str, dict[int, int]]


def append_to_log(
    manifest: Manifest,
    table: str,
    place: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame, str], None] = lambda records, path: records.write.mode("overwrite").parquet(path),
) -> Appended:
    """Writes what ``place`` makes of the present end offsets; the next commit makes it part of the log."""
    before = ends_of(manifest, table)
    path = manifest.attempt(table)
    write(place(as_ends(manifest.spark, before)), path)
    written = ends_in(manifest.spark.read.schema(RECORD).parquet(path))
    if not written:
        return Appended({}, {table: before} if before else {})
    records = sum(end - before.get(p, 0) for p, end in written.items())
    return Appended({table: {"from": path, "records": records}}, {table: before | written})


# --- the orders

ORDERS, EVENTS, MEMBERS, LISTING, SLICES = "orders", "events", "members", "listing", "slices"
OF_STORE = (ORDERS, EVENTS, MEMBERS, LISTING, SLICES)
_IDS = (("order", ORDERS, "order_id"), ("event", EVENTS, "event_id"))


def store_tables(store: str) -> dict[str, str]:
    """The tables of a store: orders, the index of event ids, the filters of both, the listing and its slices."""
    return {ORDERS: store} | {name: f"{store}-{name}" for name in OF_STORE[1:]}


def commits_of_store(spark: SparkSession, store: str) -> Manifest:
    return Manifest(spark, f"{store.rstrip('/')}-commits")


def bucket_of_id(an_id: Column) -> Column:
    return F.pmod(F.hash(an_id), F.lit(BUCKETS)).cast("int")


def in_bucket_of(an_id: str) -> Column:
    """The bucket that a known id must be in; a constant when the query is planned."""
    return F.col(BUCKET) == bucket_of_id(F.lit(an_id))


def _write_bucketed(df: DataFrame, path: str, an_id: str, blooms: list[str], order: list[str]) -> None:
    bucketed = df.withColumn(BUCKET, bucket_of_id(F.col(an_id)))
    writer = bucketed.repartition(BUCKET).sortWithinPartitions(BUCKET, *order).write.mode("overwrite")
    for column in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy(BUCKET).parquet(path)


def write_orders_table(rows: DataFrame, path: str) -> None:
    """One folder of orders, by bucket of the order id and newest last within a bucket."""
    _write_bucketed(rows, path, "order_id", ["order_id", "event_id", "customer_id"], ["processed_at", "order_id"])


def write_event_index(rows: DataFrame, path: str) -> None:
    _write_bucketed(rows.select("event_id", "order_id"), path, "event_id", ["event_id"], ["event_id"])


class FilterSize(NamedTuple):
    segments: int
    words: int

    @staticmethod
    def of(rows: int) -> "FilterSize":
        """Whole powers of two for the ids that a bucket of ``rows`` rows in all holds."""
        needed = rows / BUCKETS * BITS_PER_ID / 64
        words = LEAST_WORDS
        while words < min(needed, MOST_WORDS):
            words *= 2
        segments = 1
        while segments * words < needed:
            segments *= 2
        return FilterSize(segments, words)


def _segment(hashed: Column, segments: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 40), segments).cast("int")


def _bits(hashed: Column, words: Column) -> Column:
    """The bits that an id sets in its segment."""
    first, step = hashed.bitwiseAND(F.lit(0xFFFFF)), F.shiftrightunsigned(hashed, 20).bitwiseAND(F.lit(0xFFFFF)).bitwiseOR(F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(BITS_SET - 1)), lambda i: F.pmod(first + i * step, words * 64).cast("int")
    )


def _hash_of(an_id: str) -> Column:
    return F.xxhash64(F.col(an_id), F.lit("member"))


def filters_of(ids: DataFrame, size: FilterSize) -> DataFrame:
    """Filters of the order and event ids of one folder, in the shape of FILTERS."""
    hashed = [
        ids.where(F.col(an_id).isNotNull()).select(
            F.lit(kind).alias("kind"), bucket_of_id(F.col(an_id)).alias("bucket"), _hash_of(an_id).alias("hash")
        )
        for kind, _, an_id in _IDS
    ]
    places = hashed[0].unionByName(hashed[1]).select(
        "kind",
        "bucket",
        _segment(F.col("hash"), F.lit(size.segments)).alias("segment"),
        F.explode(_bits(F.col("hash"), F.lit(size.words))).alias("bit"),
    )
    key = ["kind", "bucket", "segment"]
    mask = F.expr("bit_or(shiftleft(1L, bit & 63))")
    set_words = places.groupBy(*key, F.shiftright("bit", 6).alias("word")).agg(mask.alias("mask"))
    # words without a bit are written too, so that a word's place is its number
    blank = set_words.select(*key).distinct().select(
        *key, F.explode(F.sequence(F.lit(0), F.lit(size.words - 1))).alias("word"), F.lit(0).cast("bigint").alias("mask")
    )
    dense = set_words.unionByName(blank).groupBy(*key, "word").agg(F.max(F.struct(F.col("mask") != 0, "mask")).alias("one"))
    listed = F.sort_array(F.collect_list(F.struct("word", F.col("one.mask").alias("mask"))))
    return dense.groupBy(*key).agg(F.transform(listed, lambda x: x["mask"]).alias("words"))


def add_orders(rows: DataFrame, count: int, manifest: Manifest, level: int = 0) -> dict[str, dict]:
    """Writes what goes with orders that lie in the attempt of this commit: index, filters and listing."""
    if count == 0:
        return {}
    spark, size = manifest.spark, FilterSize.of(count)
    orders = manifest.attempt(ORDERS)
    ids = spark.read.schema(STORE).parquet(orders).select("order_id", "event_id")
    write_event_index(ids, manifest.attempt(EVENTS))
    members = add(filters_of(ids, size), manifest, MEMBERS)
    listed = manifest.attempt(LISTING)
    listing.write_listing(spark.read.schema(STORE).parquet(orders), count, listed)
    slices = add(listing.slices_in(spark, listed).coalesce(1), manifest, SLICES)
    known = {"rows": count, "level": level}
    return {
        ORDERS: {"from": orders, **known, **size._asdict()},
        EVENTS: {"from": manifest.attempt(EVENTS), **known},
        MEMBERS: {**members, **known},
        LISTING: {"from": listed, **known},
        SLICES: {**slices, **known},
    }


def _admitted(spark: SparkSession, manifest: Manifest, wanted: DataFrame, count: int) -> dict[str, list[tuple[int, int]]]:
    """(folder, bucket) per kind of id that may hold one of ``wanted`` (kind, id).

    At most the number of folders times BUCKETS, which merging keeps small.
    """
    folders = manifest.folders(ORDERS)
    sized = [(n, info["segments"], info["words"]) for n, info in folders.items() if "segments" in info]
    buckets = {kind: set() for kind, _, _ in _IDS}
    keyed = wanted.select("kind", bucket_of_id(F.col("id")).alias("bucket"), _hash_of("id").alias("hash"))
    found = {kind: [] for kind in buckets}
    if len(sized) < len(folders):  # folders from before there were filters: the buckets that are asked for
        old = [n for n, info in folders.items() if "segments" not in info]
        for row in keyed.select("kind", "bucket").distinct().collect():
            found[row["kind"]] += [(n, row["bucket"]) for n in old if _has_bucket(manifest, row["kind"], n, row["bucket"])]
    if not sized:
        return found
    every = F.array(*[F.struct(F.lit(n).cast("bigint").alias(BATCH), F.lit(s).alias("segments"), F.lit(w).alias("size")) for n, s, w in sized])
    chunks = -(-count // (BUCKETS * ASKED_TOGETHER))
    key = ["kind", "bucket", BATCH, "segment"]
    asked = (
        keyed.withColumn("one", F.explode(every))
        .select(
            "kind", "bucket", f"one.{BATCH}", _segment(F.col("hash"), F.col("one.segments")).alias("segment"),
            F.col("one.size").alias("size"), F.pmod("hash", F.lit(chunks)).alias("chunk"), "hash",
        )
        .groupBy(*key, "size", "chunk")
        .agg(F.collect_list("hash").alias("hashes"))
    )
    filters = read_batches(spark, manifest.state()["tables"][MEMBERS]["path"], FILTERS)

    def is_set(bit: Column) -> Column:
        word = F.get("words", F.shiftright(bit, 6))
        return F.call_function("shiftright", word, bit.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1

    may = F.exists("hashes", lambda h: F.forall(_bits(h, F.col("size")), is_set))
    for row in asked.join(filters, key).where(may).select("kind", BATCH, "bucket").distinct().collect():
        found[row["kind"]].append((row[BATCH], row["bucket"]))
    return found


def _has_bucket(manifest: Manifest, kind: str, folder: int, bucket: int) -> bool:
    table = next(t for k, t, _ in _IDS if k == kind)
    path = manifest.state()["tables"][table]["path"]
    return manifest.files.exists(f"{path}/{BATCH}={folder}/{BUCKET}={bucket}")


def stored_with(spark: SparkSession, path: str, ids: DataFrame, manifest: Manifest | None = None) -> DataFrame:
    """(order_id, event_id) of stored rows that share an order or an event with ``ids``.

    Only those buckets of those folders are read whose filters admit one of ``ids``.
    The ids are broadcast as far as their number allows; the store is not shuffled then.
    """
    manifest = manifest or commits_of_store(spark, path)
    tables = store_tables(path)
    kinds = [
        ids.where(F.col(an_id).isNotNull()).select(F.lit(kind).alias("kind"), F.col(an_id).alias("id"))
        for kind, _, an_id in _IDS
    ]
    wanted = kinds[0].unionByName(kinds[1]).distinct()
    count = wanted.count()
    found = []
    admitted = _admitted(spark, manifest, wanted, count) if count and manifest.folders(ORDERS) else {}
    for kind, table, an_id in _IDS:
        places = [f"{tables[table]}/{BATCH}={n}/{BUCKET}={b}" for n, b in sorted(admitted.get(kind, []))]
        schema = STORE if table == ORDERS else EVENT_INDEX
        rows = read_folders(spark, tables[table], schema, places).select("order_id", "event_id")
        own = wanted.where(F.col("kind") == kind).select(F.col("id").alias(an_id))
        own = F.broadcast(own) if count <= BROADCAST_ROWS else own
        found.append(rows.join(own, an_id, "left_semi").select("order_id", "event_id"))
    return found[0].unionByName(found[1]).distinct()


def newest_orders(spark: SparkSession, store: str, rows: int, page_token: str = "", customer_id: str = "") -> DataFrame:
    """The next orders of a listing, newest first, by way of the listing.

    Reads the slices that hold them, then the buckets of the folders in which they
    lie; at most 501 keys reach the driver. All of it is seen as of one commit.
    """
    manifest = commits_of_store(spark, store)
    folders = manifest.folders(SLICES)
    tables = store_tables(store)
    known = read_folders(spark, tables[SLICES], listing.SLICES, [f"{tables[SLICES]}/{BATCH}={n}" for n in sorted(folders)])

    def read(slices) -> DataFrame:
        places = [f"{tables[LISTING]}/{BATCH}={s[BATCH]}/cluster={s['cluster']}/bucket={s['bucket']}/slice={s['slice']}" for s in slices]
        return read_folders(spark, tables[LISTING], listing.LISTED, sorted(places))

    keys = listing.next_keys(known, read, rows, page_token, customer_id)
    ids = spark.createDataFrame([(k[BATCH], k["order_id"]) for k in keys], f"{BATCH} bigint, order_id string")
    at = ids.select(BATCH, bucket_of_id(F.col("order_id")).alias(BUCKET)).distinct().collect()
    places = [f"{store}/{BATCH}={r[BATCH]}/{BUCKET}={r[BUCKET]}" for r in at]
    found = read_folders(spark, store, STORE, sorted(places)).select(*STORE.fieldNames())
    wanted = found.where(F.col("order_id").isin([k["order_id"] for k in keys]))
    return wanted.orderBy(F.desc("processed_at"), F.desc("order_id"))


def merge_due(manifest: Manifest) -> bool:
    """Merges the oldest MERGED_FOLDERS folders of a level into one of the next, in one commit.

    Levels that became full by it are merged too, so a store of n batches has at
    most MERGED_FOLDERS - 1 folders a level and log n levels, besides folders of more
    than MERGED_ROWS rows. Rows and readers see no difference: the old folders stay
    until ``Manifest.vacuum`` deletes them.
    """
    spark, merged = manifest.spark, False
    while True:
        levels: dict[int, list[int]] = {}
        folders = manifest.folders(ORDERS)
        for n, info in sorted(folders.items()):
            if info.get("rows", MERGED_ROWS) * MERGED_FOLDERS <= MERGED_ROWS:
                levels.setdefault(info["level"], []).append(n)
        full = [level for level, numbers in sorted(levels.items()) if len(numbers) >= MERGED_FOLDERS]
        if not full:
            return merged
        chosen = levels[full[0]][:MERGED_FOLDERS]
        path = manifest.state()["tables"][ORDERS]["path"]
        rows = read_folders(spark, path, STORE, [f"{path}/{BATCH}={n}" for n in chosen]).drop(BATCH)
        write_orders_table(rows, manifest.attempt(ORDERS))
        adds = add_orders(rows, sum(folders[n]["rows"] for n in chosen), manifest, full[0] + 1)
        manifest.commit(adds, removes={table: chosen for table in OF_STORE})
        merged = True
