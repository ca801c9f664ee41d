"""Point lookup, newest-first listing with page tokens, counts."""

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions import paging
from ..functions.events import rfc3339
from ..functions.ids import canonical_uuid_text
from ..schemas import ITEM, STORE
from ..streaming.store import BUCKET, bucket_of_id, in_bucket_of, newest_orders
from .scale import bucket_of, number_in_order

COLUMNS = [f.name for f in STORE.fields]


def get_order(store: DataFrame, order_id: str) -> DataFrame:
    """The order, or no row: absence is a normal answer, malformed text is not."""
    if order_id == "":
        raise paging.InvalidArgument("order_id is required")
    wanted = canonical_uuid_text(order_id)
    if wanted is None:
        raise paging.InvalidArgument(f"invalid order_id: {order_id}")
    if BUCKET in store.columns:  # a table laid out by id: one bucket is read
        store = store.where(in_bucket_of(wanted))
    return store.where(F.col("order_id") == wanted).select(*COLUMNS)


def orders_with(store: DataFrame, ids: list[str]) -> DataFrame:
    """The orders of a page, newest first; of a table laid out by id only their buckets are read."""
    if BUCKET in store.columns:
        keys = store.sparkSession.createDataFrame([(i,) for i in ids], "order_id string")
        buckets = sorted({r[0] for r in keys.select(bucket_of_id(F.col("order_id"))).collect()})
        store = store.where(F.col(BUCKET).isin(buckets))
    found = store.where(F.col("order_id").isin(ids)).select(*COLUMNS)
    return found.orderBy(F.desc("processed_at"), F.desc("order_id"))


def after_cursor(store: DataFrame, stamp: str, order_id: str) -> DataFrame:
    """Rows behind a position in newest-first order.

    Written so that the comparison of the time reaches the scan; comparing the
    pair as a whole would not.
    """
    at = F.lit(stamp).cast("timestamp")
    return store.where(
        (F.col("processed_at") <= at)
        & ((F.col("processed_at") < at) | (F.col("order_id") < order_id))
    )


def newest_first(
    store: DataFrame, rows: int, page_token: str = "", customer_id: str = ""
) -> DataFrame:
    found = store
    if customer_id:
        found = found.where(F.col("customer_id") == customer_id)
    if page_token:
        found = after_cursor(found, *paging.decode_cursor(page_token))
    return found.select(*COLUMNS).orderBy(F.desc("processed_at"), F.desc("order_id")).limit(rows)


def list_orders(
    store: DataFrame, page_size: int = 0, page_token: str = "", customer_id: str = ""
) -> tuple[list[Row], str]:
    """One page and the token of the next one ('' at the end).

    One row more than the page is read to learn whether there is a next page;
    at most 501 rows reach the driver.
    """
    size = paging.page_size_or_default(page_size)
    rows = (
        newest_first(store, size + 1, page_token, customer_id)
        .withColumn("_token", paging.page_token(F.col("processed_at"), F.col("order_id")))
        .collect()
    )
    token = rows[size - 1]["_token"] if len(rows) > size else ""
    return rows[:size], token


def list_stored(
    spark: SparkSession, path: str, page_size: int = 0, page_token: str = "", customer_id: str = ""
) -> tuple[list[Row], str]:
    """``list_orders`` of a store that a job keeps at ``path``: read by its listing, not by a scan."""
    size = paging.page_size_or_default(page_size)
    rows = (
        newest_orders(spark, path, size + 1, page_token, customer_id)
        .withColumn("_token", paging.page_token(F.col("processed_at"), F.col("order_id")))
        .collect()
    )
    return rows[:size], rows[size - 1]["_token"] if len(rows) > size else ""


def keyset_pages(store: DataFrame, page_size: int) -> DataFrame:
    """order_id, processed_at and page number of every order, for an export of all pages.

    Only the keys of the listing are sorted; join them to the store for the rest.
    """
    newest = [F.desc("processed_at"), F.desc("order_id")]
    numbered = number_in_order(store.select("processed_at", "order_id"), newest, into="_number")
    return numbered.withColumn("page", bucket_of(F.col("_number") - 1, page_size)).drop("_number")


def order_json(store: DataFrame) -> DataFrame:
    """``body``: each order as response JSON; items are never null."""
    body = F.to_json(
        F.struct(
            "order_id",
            "event_id",
            "customer_id",
            F.coalesce("items", F.array().cast(f"array<{ITEM.simpleString()}>")).alias("items"),
            "total_cents",
            rfc3339(F.col("occurred_at")).alias("occurred_at"),
            rfc3339(F.col("processed_at")).alias("processed_at"),
        )
    )
    return store.select("order_id", body.alias("body"))


def count_orders(store: DataFrame, tag: str | None = None) -> DataFrame:
    found = store if tag is None else store.where(F.col("customer_id").startswith(f"{tag}-"))
    return found.agg(F.count("*").alias("orders"))
