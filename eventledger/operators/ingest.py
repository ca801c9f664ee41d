"""From request bodies to events on the log."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids, ingress
from ..functions.events import event_json
from ..schemas import EVENT_TYPE_CREATED
from .scale import once

MALFORMED_BODY = "malformed_body"
VALIDATION = "validation"
PRODUCE_FAILED = "produce_failed"


def decode_requests(bodies: DataFrame) -> DataFrame:
    """Strictly decode ``body``; keeps the other columns.

    Adds customer_id, items, problems, total_cents (NULL beyond 64 bits) and
    reject_reason (NULL when accepted).
    ``idempotency_key`` is checked first if the column is there, then the shape
    of the body, then its content. A body over the size limit is refused unread.
    """
    read = once(bodies, _document=ingress.request_document(F.col("body")))
    fitted = once(read, well_formed=ingress.request_fits(F.col("_document")))
    request = F.when(F.col("well_formed"), ingress.request_fields(F.col("body")))
    typed = once(fitted, _request=request)
    filled = once(
        typed,
        customer_id=F.coalesce(F.col("_request.customer_id"), F.lit("")),
        items=ingress.zero_filled_items(F.col("_request.items")),
    )
    decoded = once(
        filled,
        problems=F.when(
            F.col("well_formed"), ingress.validation_problems(F.col("customer_id"), F.col("items"))
        ).otherwise(F.array().cast("array<string>")),
        total_cents=ingress.total_cents(F.col("items")),
    )
    reason = F.when(~F.col("well_formed"), MALFORMED_BODY).when(
        (F.size("problems") > 0) | F.col("total_cents").isNull(), VALIDATION
    )
    if "idempotency_key" in bodies.columns:
        reason = F.when(~ingress.idempotency_key_ok(F.col("idempotency_key")), VALIDATION).otherwise(reason)
    return decoded.withColumn("reject_reason", reason).drop("_document", "_request", "well_formed")


def with_produce_failures(decoded: DataFrame, failed: Column) -> DataFrame:
    """Marks accepted requests whose event could not be put on the log."""
    reason = F.when(F.col("reject_reason").isNull() & failed, PRODUCE_FAILED).otherwise(F.col("reject_reason"))
    return decoded.withColumn("reject_reason", reason)


def new_events(requests: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Events of accepted requests (customer_id, items, idempotency_key, occurred_at).

    Where the items are not at hand, their total may come as ``total_cents``.

    With a key both ids follow from it, so a client's retry meets the same ids.
    Without one they are random; write the result before using it twice.
    """
    key = F.col("idempotency_key")

    def an_id(prefix: str):
        derived = ids.uuid5(F.concat(F.lit(prefix), key))
        return F.when(key != "", derived).otherwise(F.uuid())

    return requests.select(
        an_id("event:").alias("event_id"),
        F.lit(EVENT_TYPE_CREATED).alias("event_type"),
        an_id("order:").alias("order_id"),
        F.col("occurred_at"),
        F.col("customer_id"),
        *([F.col("items")] if "items" in requests.columns else []),
        F.col("total_cents") if "items" not in requests.columns else ingress.total_cents(F.col("items")).alias("total_cents"),
        *keep,
    )


def event_records(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Key and value of each event for the log; the order id is the key."""
    value = event_json({c: F.col(c) for c in events.columns})
    return events.select(
        F.encode("order_id", "UTF-8").alias("key"),
        F.encode(value, "UTF-8").alias("value"),
        F.col("occurred_at").alias("timestamp"),
        *keep,
    )
