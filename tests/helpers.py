"""Small record logs and a sequential model of the worker."""

import datetime as dt
import json
import uuid

from eventledger.schemas import RECORD

NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def uid(name) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, str(name)))


def event(event_id, order_id, **changes) -> str:
    body = {
        "event_id": event_id,
        "event_type": "order.created",
        "order_id": order_id,
        "occurred_at": "2024-01-01T00:00:00Z",
        "customer_id": "cust-1",
        "items": [{"sku": "A", "quantity": 2, "unit_price_cents": 1999}],
        "total_cents": 3998,
    }
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v is not ...})


def record(partition, offset, value, headers=(), key="k"):
    return (
        key.encode(), value.encode(), "orders", partition, offset, NOW, 0,
        [(k, v.encode()) for k, v in headers],
    )


def log_frame(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def sequential(rows, stored=()):
    """Outcome per (partition, offset) by the plain loop: rows are (partition, offset, event, order)."""
    events = {e for e, _ in stored}
    orders = {o for _, o in stored}
    out = {}
    for partition, offset, e, o in sorted(rows, key=lambda r: (r[0], r[1])):
        if e in events:
            out[partition, offset] = "duplicate"
        elif o in orders:
            out[partition, offset] = "dead_letter"
        else:
            events.add(e)
            orders.add(o)
            out[partition, offset] = "persisted"
    return out
