import uuid

import pytest
from pyspark.sql import functions as F

from eventledger.functions import ids, ingress
from eventledger.operators import ingest
from eventledger.schemas import ID_NAMESPACE, REQUEST

GOOD = '{"customer_id":"cust-1","items":[{"sku":"WIDGET-1","quantity":2,"unit_price_cents":1999}]}'


def decode(spark, bodies, keys=None):
    rows = [(i, b, (keys or [""] * len(bodies))[i]) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "i int, body string, idempotency_key string")
    return [r.asDict(recursive=True) for r in ingest.decode_requests(df).orderBy("i").collect()]


@pytest.mark.parametrize(
    "body",
    [
        "", "{", "[]", "5", '"text"',
        '{"customer_id":5,"items":[]}',
        '{"customer_id":"c","discount":5}',
        '{"items":[{"sku":"a","quantity":1.5}]}',
        '{"items":[{"sku":"a","quantity":1.0}]}',
        '{"items":[{"sku":"a","quantity":"2"}]}',
        '{"items":[{"sku":"a","quantity":1,"colour":"red"}]}',
        '{"items":[{"quantity":1},5]}',
        '{"items":{"sku":"a"}}',
        '{"items":[{"quantity":99999999999999999999}]}',
    ],
)
def test_malformed(spark, body):
    assert decode(spark, [body])[0]["reject_reason"] == "malformed_body"


def test_accepted_and_rejected_by_content(spark):
    got = decode(
        spark,
        [GOOD, "{}", "null", '{"customer_id":null,"items":null}', '{"customer_id":"c","items":[null]}',
         GOOD + " trailing", '{"customer_id":"a","customer_id":"b","items":[{"sku":"s","quantity":1}]}'],
    )
    assert [g["reject_reason"] for g in got] == [None, "validation", "validation", "validation", "validation", None, None]
    assert got[1]["problems"] == ["customer_id is required", "at least one item is required"]
    assert got[4]["problems"] == ["items[0].sku is required", "items[0].quantity must be > 0"]
    assert got[6]["customer_id"] == "b"
    assert got[6]["items"][0]["unit_price_cents"] == 0


def test_body_size_limit(spark):
    exact = '{"customer_id":"' + "x" * ((1 << 20) - 31) + '","items":[]}'
    assert len(exact) <= 1 << 20
    got = decode(spark, [exact, exact + " " * ((1 << 20) - len(exact) + 1)])
    assert [g["reject_reason"] for g in got] == ["validation", "malformed_body"]


def test_unreadable_body_given_as_null_is_refused(spark):
    assert decode(spark, [None])[0]["reject_reason"] == "malformed_body"


def test_bad_key_is_reported_before_the_body(spark):
    got = decode(spark, ["{", GOOD], ["has space", "ok"])
    assert [g["reject_reason"] for g in got] == ["validation", None]


@pytest.mark.parametrize(
    "customer,items,problems",
    [
        ("cust-1", [("WIDGET-1", 2, 1999)], []),
        ("cust-1", [("FREE", 1, 0)], []),
        ("", [("A", 1, 1)], ["customer_id is required"]),
        (" \t ", [("A", 1, 1)], ["customer_id is required"]),
        ("c", [], ["at least one item is required"]),
        ("c", [(" ", 1, 1)], ["items[0].sku is required"]),
        ("c", [("A", 0, 1)], ["items[0].quantity must be > 0"]),
        ("c", [("A", 1, -1)], ["items[0].unit_price_cents must be >= 0"]),
        ("c", [("A", 1, 1), ("", -1, -5)],
         ["items[1].sku is required", "items[1].quantity must be > 0", "items[1].unit_price_cents must be >= 0"]),
    ],
)
def test_validation(spark, customer, items, problems):
    df = spark.createDataFrame([(customer, items)], REQUEST)
    found = ingress.validation_problems(F.col("customer_id"), F.col("items"))
    row = df.select(found.alias("p"), ingress.validation_message(found).alias("m")).first()
    assert row["p"] == problems
    assert row["m"] == ("invalid order: " + "; ".join(problems) if problems else None)


def test_totals(spark):
    df = spark.createDataFrame(
        [("c", [("A", 2, 1999), ("B", 3, 500)]), ("c", [("A", 2**62, 4)]), ("c", [])], REQUEST
    )
    assert [r[0] for r in df.select(ingress.total_cents(F.col("items"))).collect()] == [5498, None, 0]


def test_total_out_of_range_is_a_validation_failure(spark):
    body = '{"customer_id":"c","items":[{"sku":"s","quantity":4611686018427387904,"unit_price_cents":4}]}'
    assert decode(spark, [body])[0]["reject_reason"] == "validation"


def test_idempotency_keys(spark):
    good = ["", "abc-123", "order:42", "k" * 255, "~!"]
    bad = ["k" * 256, "has space", "tab\there", "nul\x00", "emoji🙂", "newline\n"]
    df = spark.createDataFrame([(k,) for k in good + bad], "k string")
    got = [r[0] for r in df.select(ingress.idempotency_key_ok(F.col("k"))).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_derived_ids_are_stable_uuid5(spark):
    rows = [("c", [("A", 1, 1)], k, None) for k in ("checkout-1", "checkout-1", "checkout-2", "")]
    df = spark.createDataFrame(
        rows, "customer_id string, items array<struct<sku string, quantity bigint, unit_price_cents bigint>>, "
        "idempotency_key string, occurred_at timestamp",
    )
    a, b, c, none = ingest.new_events(df).collect()
    space = uuid.UUID(ID_NAMESPACE)
    assert a.order_id == b.order_id == str(uuid.uuid5(space, "order:checkout-1"))
    assert a.event_id == b.event_id == str(uuid.uuid5(space, "event:checkout-1"))
    assert len({a.order_id, a.event_id, c.order_id, c.event_id, none.order_id, none.event_id}) == 6
    assert uuid.UUID(none.order_id).version == 4


def test_uuid5_many(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("s"), ids.uuid5(F.col("id").cast("string")).alias("u"))
    space = uuid.UUID(ID_NAMESPACE)
    assert all(r.u == str(uuid.uuid5(space, r.s)) for r in df.collect())


def test_canonical_uuid(spark):
    u = "123e4567-e89b-12d3-a456-426614174000"
    spellings = [u, u.upper(), u.replace("-", ""), "{" + u + "}", "123e-4567-e89b-12d3-a456-4266-1417-4000"]
    bad = ["", "NOT-A-UUID", u[:-1], u + "0", "{" + u, u.replace("e", "g"), "1" + u[1:8] + "--" + u[9:]]
    df = spark.createDataFrame([(x,) for x in spellings + bad], "x string")
    got = [r[0] for r in df.select(ids.canonical_uuid(F.col("x"))).collect()]
    assert got == [u] * len(spellings) + [None] * len(bad)
