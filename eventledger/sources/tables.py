"""The pipeline's inputs, derived from the test tables (orders, lineitem, events).

Every view covers its whole table. Faults are planted by rules on the key, so an
independent query can say what must come out.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions import ingress
from ..functions.events import event_json
from ..functions.ids import uuid_from_md5
from ..operators import persist, replay
from ..operators.scale import lookup, number_rows
from ..session import folder_of, prepare, table_of
from ..streaming import listing
from ..streaming.manifest import BATCH
from ..streaming.store import read_folders, write_orders_table
from .record_log import append_records

PARTITIONS = 3
DLQ_PARTITIONS = 3

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- ingest ---------------------------------------------------------------


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), *LINE_ORDER)


def _item(line: Column) -> Column:
    return F.struct(
        F.concat(F.lit("SKU-"), line["l_partkey"].cast("string")).alias("sku"),
        line["l_quantity"].cast("bigint").alias("quantity"),
        F.floor(line["l_extendedprice"]).cast("bigint").alias("unit_price_cents"),
    )


def _first_item(item: Column) -> Column:
    """The first item of an order with the faults planted in it."""
    key = F.col("order_key")
    return F.struct(
        F.when(key % 107 == 0, "").otherwise(item["sku"]).alias("sku"),
        F.when(key % 103 == 0, 0).otherwise(item["quantity"]).cast("bigint").alias("quantity"),
        F.when(key % 109 == 0, -1).otherwise(item["unit_price_cents"]).cast("bigint").alias("unit_price_cents"),
    )


def _price(item: Column) -> Column:
    wide = "decimal(19,0)"
    return (item["unit_price_cents"].cast(wide) * item["quantity"].cast(wide)).cast("decimal(38,0)")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_key, customer_id, idempotency_key, occurred_at; faults planted."""
    key = F.col("order_key")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), "o_custkey", F.col("o_orderdate").cast("timestamp").alias("occurred_at")
    )
    return orders.select(
        key,
        F.when(key % 101 == 0, "   ").otherwise(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))).alias("customer_id"),
        F.when(key % 10 <= 1, F.concat(F.lit("checkout-"), (key - key % 2).cast("string"))).otherwise("").alias("idempotency_key"),
        "occurred_at",
    )


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a request whose items are not gathered.

    order_key, customer_id, idempotency_key, occurred_at, n_items, total_cents
    (NULL beyond 64 bits), faulty (the items with a problem: at, sku, quantity,
    unit_price_cents). An order may have any number of lines: totals are sums,
    and only faulty lines are numbered and collected.
    """
    line = F.struct(*LINE_ORDER)
    lines = _lines(spark, sf_dir)
    bad = F.coalesce(ingress.item_is_faulty(_item(F.col("line"))), F.lit(False))
    marked = lines.select("order_key", line.alias("line")).withColumn("bad", bad)
    per_order = marked.groupBy("order_key").agg(
        F.count("*").alias("n_items"),
        _item(F.min("line")).alias("first"),
        F.sum(_price(_item(F.col("line")))).alias("listed"),
        F.count_if("bad").alias("n_bad"),
    )
    # where lines after the first are faulty, their places are needed
    some_bad = per_order.where(F.col("n_bad") > 0).select("order_key")
    placed = number_rows(
        lines.join(some_bad, "order_key", "left_semi"), "l_linenumber", group=["order_key"], into="_number",
        ties=LINE_ORDER[1:], width=1,
    )
    item = _item(F.struct(*LINE_ORDER))
    later = (
        placed.where((F.col("_number") > 1) & F.coalesce(ingress.item_is_faulty(item), F.lit(False)))
        .groupBy("order_key")
        .agg(F.sort_array(F.collect_list(_at(F.col("_number") - 1, item))).alias("later"))
    )
    planted = _first_item(F.col("first"))
    none = F.array().cast(ingress.FAULTY)
    first_faulty = F.when(
        F.col("n_items").isNotNull() & F.coalesce(ingress.item_is_faulty(planted), F.lit(False)),
        F.array(_at(F.lit(0).cast("bigint"), planted)),
    )
    total = F.col("listed") - _price(F.col("first")) + _price(planted)
    return (
        _orders(spark, sf_dir)
        .join(per_order, "order_key", "left")
        .join(later, "order_key", "left")
        .select(
            "order_key",
            "customer_id",
            "idempotency_key",
            "occurred_at",
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.when(F.col("n_items").isNull(), 0).otherwise(total.try_cast("bigint")).alias("total_cents"),
            F.concat(F.coalesce(first_faulty, none), F.coalesce("later", none)).alias("faulty"),
        )
    )


def _at(place: Column, item: Column) -> Column:
    return F.struct(
        place.cast("bigint").alias("at"),
        item["sku"].alias("sku"),
        item["quantity"].alias("quantity"),
        item["unit_price_cents"].alias("unit_price_cents"),
    )


def order_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_key, body (JSON text), idempotency_key, occurred_at.

    A body is one value, so the lines of an order meet in one row here; the
    decoder then judges its size.
    """
    key = F.col("order_key")
    in_order = F.sort_array(F.collect_list(F.struct(*LINE_ORDER)))
    listed = _lines(spark, sf_dir).groupBy("order_key").agg(F.transform(in_order, _item).alias("items"))
    joined = _orders(spark, sf_dir).join(listed, "order_key", "left")
    no_items = F.array().cast(S.REQUEST["items"].dataType)
    items = F.coalesce(
        F.transform("items", lambda x, i: F.when(i == 0, _first_item(x)).otherwise(x)), no_items
    )
    plain = F.to_json(F.struct("customer_id", items.alias("items")))
    body = (
        F.when(key % 113 == 0, "{")
        .when(key % 127 == 0, F.concat(F.expr("left(body, length(body) - 1)"), F.lit(',"discount":5}')))
        .when(key % 131 == 0, F.regexp_replace("body", '"quantity":[0-9]+', '"quantity":1.5'))
        .when(key % 137 == 0, F.regexp_replace("body", '"customer_id":"[^"]*"', '"customer_id":7'))
        .otherwise(F.col("body"))
    )
    return joined.withColumn("body", plain).select(key, body.alias("body"), "idempotency_key", "occurred_at")


PRODUCE_FAILS_EVERY = 139


def produce_failed() -> Column:
    """Requests whose event the log did not take."""
    return F.col("order_key") % PRODUCE_FAILS_EVERY == 0


def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key per order, good and bad by turns."""
    n = F.col("order_key")
    text = n.cast("string")
    kind = n % 7
    key = (
        F.when(kind == 0, F.concat(F.lit("order:"), text))
        .when(kind == 1, F.concat(F.lit("order "), text))
        .when(kind == 2, F.lpad(text, 255, "k"))
        .when(kind == 3, F.lpad(text, 256, "k"))
        .when(kind == 4, F.concat(text, F.lit("\t")))
        .when(kind == 5, F.concat(text, F.lit("é")))
        .otherwise("")
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key")).withColumn("idempotency_key", key)


# --- the record log ---------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"
    )


def _order_number() -> Column:
    n = F.col("n")
    return F.when(n % 250 == 8, n - 1).otherwise(n)


def _named_id(kind: str, number: Column) -> Column:
    return uuid_from_md5(F.concat(F.lit(f"{kind}:"), number.cast("string")))


def _partition_of(order_id: Column) -> Column:
    return (F.ascii(F.substring(order_id, 1, 1)) % PARTITIONS).cast("int")


def _one_item() -> Column:
    n = F.col("n")
    return F.array(
        F.struct(
            F.concat(F.lit("SKU-"), (n % 1000).cast("string")).alias("sku"),
            F.lit(1).cast("bigint").alias("quantity"),
            F.floor(F.col("value") * 100).cast("bigint").alias("unit_price_cents"),
        )
    )


def arriving_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries in order of ``arrival``; every sixteenth event is delivered twice."""
    n = F.col("n")
    order_id = _named_id("order", _order_number())
    items = _one_item()
    fields = {
        "event_id": _named_id("event", n),
        "event_type": F.lit(S.EVENT_TYPE_CREATED),
        "order_id": F.when(n % 89 == 0, "NOT-A-UUID").otherwise(order_id),
        "occurred_at": F.col("ts"),
        "customer_id": F.concat("event_type", F.lit("-"), n.cast("string")),
        "items": items,
        "total_cents": items[0]["unit_price_cents"],
    }
    value = F.when(n % 97 == 0, "{not json").otherwise(event_json(fields))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value"))
    count = F.when(n % 15 == 0, "rubbish").otherwise((n % 4).cast("string"))
    headers = F.filter(
        F.array(
            F.when(n % 6 == 0, entry("content-type", F.lit("application/json"))),
            F.when(n % 3 == 0, entry(S.REPLAY_COUNT, count)),
        ),
        lambda h: h.isNotNull(),
    )
    arrivals = F.when(n % 16 == 0, F.array(2 * n, 2 * n + 101)).otherwise(F.array(2 * n))
    return _events(spark, sf_dir).withColumn("arrival", F.explode(arrivals)).select(
        "n",
        "arrival",
        F.encode(order_id, "UTF-8").alias("key"),
        F.encode(value, "UTF-8").alias("value"),
        F.col("ts").alias("timestamp"),
        headers.alias("headers"),
        _partition_of(order_id).alias("partition"),
    )


def place_on_log(arriving: DataFrame) -> DataFrame:
    return append_records(
        arriving, "arrival", S.SOURCE_TOPIC, PARTITIONS, partition=F.col("partition"), keep=["n"]
    )


def record_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source log (record schema plus the event number ``n``), stored once per application."""
    prepare(spark)
    return table_of(spark, "record_log", sf_dir, ["events"], lambda: place_on_log(arriving_records(spark, sf_dir)))


def sink_faults(log: DataFrame) -> DataFrame:
    """Failed writes, one row per faulty record."""
    kind = F.col("n") % 500
    return log.where(kind.isin(3, 4, 5)).select(
        "partition",
        "offset",
        F.when(kind == 3, "08006").when(kind == 4, "57P01").otherwise("23514").alias("sqlstate"),
        F.when(kind == 3, 6).when(kind == 4, 3).otherwise(1).alias("attempts"),
        (kind == 4).alias("recovered"),
    )


def accounted_for(log: DataFrame) -> DataFrame:
    """partition, offset, n, ok: records that could neither be stored nor parked are not ok."""
    return log.select("partition", "offset", "n", (F.col("n") % 1000 != 503).alias("ok"))


def classified_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = record_log(spark, sf_dir)
    return persist.classify(log, faults=sink_faults(log))


# --- dead letters -----------------------------------------------------------


def place_dead_letters(classified: DataFrame) -> DataFrame:
    """Dead letters on their own log; every 35th lost its reason on the way."""
    written = replay.dead_letters(classified, F.col("timestamp"), keep=["n"])
    without = F.filter("headers", lambda h: h["key"] != S.DLQ_REASON)
    tampered = written.withColumn(
        "headers", F.when(F.col("n") % 35 == 0, without).otherwise(F.col("headers"))
    )
    # numbering reads its input twice: classify only once
    return append_records(
        tampered.checkpoint(), "source_offset", S.DEAD_LETTER_TOPIC, DLQ_PARTITIONS,
        partition=F.col("source_partition"), keep=["n"],
    )


def dead_letter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead-letter log, stored once per application."""
    prepare(spark)
    return table_of(
        spark, "dead_letter_log", sf_dir, ["events"], lambda: place_dead_letters(classified_log(spark, sf_dir))
    )


# --- what the pipeline leaves behind ------------------------------------------


def orders_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored orders (with ``tag`` and ``n``), laid out as the persist job does; stored once per application.

    One order per event, written floor(value * 1000) microseconds after it occurred.
    """
    return table_of(
        spark, "orders_store", sf_dir, ["events"], lambda: _stored_orders(spark, sf_dir), write_orders_table
    )


def next_orders(
    spark: SparkSession, sf_dir: str, rows: int, page_token: str = "", tag: str = ""
) -> list:
    """Keys of the next orders by the listing that goes with the store, kept per application; its customer is the tag."""

    def write(orders: DataFrame, path: str) -> None:
        listing.write_listing(orders, orders.count(), f"{path}/listing/{BATCH}=0")
        listing.slices_in(spark, f"{path}/listing/{BATCH}=0").coalesce(1).write.parquet(f"{path}/slices/{BATCH}=0")

    by_tag = lambda: orders_store(spark, sf_dir).withColumn("customer_id", F.col("tag"))
    path = folder_of(spark, "orders_listing", sf_dir, ["events"], by_tag, write)

    def read(slices) -> DataFrame:
        places = [f"{path}/listing/{BATCH}=0/cluster={s['cluster']}/bucket={s['bucket']}/slice={s['slice']}" for s in slices]
        return read_folders(spark, f"{path}/listing", listing.LISTED, sorted(places))

    slices = read_folders(spark, f"{path}/slices", listing.SLICES, [f"{path}/slices/{BATCH}=0"])
    return listing.next_keys(slices, read, rows, page_token, tag)


def _stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = F.floor(F.col("value") * 1000).cast("bigint")
    items = _one_item()
    return _events(spark, sf_dir).select(
        _named_id("order", F.col("n")).alias("order_id"),
        _named_id("event", F.col("n")).alias("event_id"),
        F.concat("event_type", F.lit("-"), F.col("n").cast("string")).alias("customer_id"),
        items.alias("items"),
        items[0]["unit_price_cents"].alias("total_cents"),
        F.col("ts").alias("occurred_at"),
        F.timestamp_micros(F.unix_micros("ts") + delay).alias("processed_at"),
        F.col("event_type").alias("tag"),
        "n",
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client side: one request per event, one per second and run."""
    n = F.col("n")
    interval = 1_000_000
    events = _events(spark, sf_dir).withColumnRenamed("event_type", "run")
    starts = events.groupBy("run").agg(F.min("ts").alias("run_start"), F.count("*").alias("run_rows"))
    placed = lookup(
        number_rows(events, "n", group=["run"], into="_number"), starts, "run", "run_rows", ["n"]
    )
    due = F.unix_micros("run_start") + (F.col("_number") - 1) * interval
    sent = due + F.call_function("div", (n % 7) * interval, F.lit(3))
    done = sent + F.floor(F.col("value") * 1000).cast("bigint")
    status = F.when(n % 41 == 0, 503).when(n % 43 == 0, F.lit(None)).otherwise(202).cast("int")
    return placed.select(
        "n",
        "run",
        (F.col("_number") - 1).alias("seq"),
        F.timestamp_micros(due).alias("due"),
        F.timestamp_micros(sent).alias("dispatched"),
        F.when(status.isNotNull(), F.timestamp_micros(done)).alias("done"),
        status.alias("status"),
        F.lit(interval).cast("bigint").alias("interval_us"),
    )


RESTART = "2024-01-11 00:00:00"
DRAIN_PER_HOUR = 4


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly samples: a counter per event type, latency buckets, a backlog gauge.

    The store is first counted per hour; running totals are taken over the hours
    of a series. Counters restart at 2024-01-11.
    """
    from pyspark.sql import Window

    store = orders_store(spark, sf_dir).select(
        F.date_trunc("hour", "processed_at").alias("ts"),
        F.concat(F.lit("worker-"), (F.col("n") % 2).cast("string")).alias("instance"),
        F.col("tag"),
        ((F.unix_micros("processed_at") - F.unix_micros("occurred_at")) / 1e6).alias("seconds"),
        _partition_of(F.col("order_id")).alias("partition"),
    )
    after_restart = F.col("ts") >= F.lit(RESTART).cast("timestamp")
    per_hour = store.groupBy("ts", "instance", "tag").agg(F.count("*").alias("rows"))
    upto_now = lambda *keys: Window.partitionBy(*keys).orderBy("ts").rowsBetween(
        Window.unboundedPreceding, 0
    )

    counter = per_hour.select(
        "ts",
        F.lit("orders_processed_total").alias("metric"),
        "instance",
        F.col("tag").alias("label"),
        F.sum("rows").over(upto_now("instance", "tag", after_restart)).cast("double").alias("value"),
    )

    from ..operators.measure import histogram

    buckets = histogram(store, F.col("seconds"), S.END_TO_END_BUCKETS, ["ts", "instance"]).select(
        "ts",
        F.lit("order_end_to_end_latency_seconds_bucket").alias("metric"),
        "instance",
        F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")).alias("label"),
        F.sum("bucket_count").over(upto_now("instance", "le", after_restart)).cast("double").alias("value"),
    )

    hour_number = (F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3_600_000_000
    arrived = F.sum("rows").over(upto_now("partition"))
    gauge = (
        store.groupBy("ts", "partition")
        .agg(F.count("*").alias("rows"))
        .select(
            "ts",
            F.lit("consumer_lag").alias("metric"),
            F.lit("broker").alias("instance"),
            F.col("partition").cast("string").alias("label"),
            F.greatest(F.lit(0.0), arrived - F.lit(DRAIN_PER_HOUR) * (hour_number + 1)).alias("value"),
        )
    )
    return counter.unionByName(buckets).unionByName(gauge)
