import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventledger.functions import paging
from eventledger.plans import catalog
from eventledger.streaming.store import BUCKET
from eventledger.operators import reads
from eventledger.schemas import STORE
from helpers import uid

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def store_of(spark, n, same_time=1, first=0):
    rows = [
        (uid(i), uid(f"e{i}"), f"cust-{i % 3}", [("A", 1, i)], i, T0, T0 + dt.timedelta(microseconds=(i // same_time) * 7))
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(rows, STORE)


def newest(store):
    return [r.order_id for r in store.orderBy(F.desc("processed_at"), F.desc("order_id")).collect()]


def walk(store, size, grow=None):
    seen, token, pages = [], "", 0
    while True:
        rows, token = reads.list_orders(store, size, token)
        seen += [r.order_id for r in rows]
        pages += 1
        if grow is not None and pages == 1:
            store = store.unionByName(grow)
        if not token:
            return seen, pages


@pytest.mark.parametrize("size,pages", [(10, 3), (25, 1), (24, 2), (26, 1)])
def test_pages_cover_everything_once(spark, size, pages):
    store = store_of(spark, 25, same_time=4)
    seen, count = walk(store, size)
    assert seen == newest(store) and count == pages


def test_insert_between_pages_moves_nothing(spark):
    store = store_of(spark, 25)
    seen, _ = walk(store, 10, grow=store_of(spark, 5, first=1000))
    assert seen == newest(store)


def test_customer_filter_and_empty(spark):
    store = store_of(spark, 9)
    rows, token = reads.list_orders(store, 0, "", "cust-1")
    assert len(rows) == 3 and token == "" and {r.customer_id for r in rows} == {"cust-1"}
    assert reads.list_orders(store, 5, "", "nobody") == ([], "")


def test_page_sizes():
    assert [paging.page_size_or_default(n) for n in (-1, 0, 1, 500, 501)] == [50, 50, 1, 500, 500]
    assert [paging.page_size_from_text(t) for t in ("", "7", "99999999999")] == [0, 7, 500]
    for bad in ("abc", "-1", "1.5", " 1"):
        with pytest.raises(paging.InvalidArgument):
            paging.page_size_from_text(bad)


@pytest.mark.parametrize(
    "token", ["not-base64!!", "aGVsbG8", "", "e30", "eyJvIjoiYWJjIn0", "W10", "eyJwIjo1LCJvIjoiYSJ9"]
)
def test_bad_cursors(token):
    with pytest.raises(paging.InvalidArgument):
        paging.decode_cursor(token)


def test_cursor_round_trip(spark):
    at = T0 + dt.timedelta(microseconds=561895)
    token = paging.encode_cursor(at, "abc")
    assert paging.decode_cursor(token) == ("2024-01-01T00:00:00.561895Z", "abc")
    assert "=" not in token
    column = spark.createDataFrame([(at, "abc")], "p timestamp, o string").select(
        paging.page_token(F.col("p"), F.col("o"))
    )
    assert column.first()[0] == token


def test_cursor_reaches_the_scan(spark, folder):
    store_of(spark, 20).write.parquet(folder + "/s")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    page = reads.newest_first(spark.read.parquet(folder + "/s"), 5, paging.encode_cursor(T0, uid(3)), "cust-1")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(processed_at" in plan and "EqualTo(customer_id,cust-1)" in plan
    assert "TakeOrderedAndProject" in plan


def test_get_order(spark):
    store = store_of(spark, 3)
    assert reads.get_order(store, uid(1).upper()).first().total_cents == 1
    assert reads.get_order(store, uid("absent")).count() == 0
    for bad in ("", "nonsense"):
        with pytest.raises(paging.InvalidArgument):
            reads.get_order(store, bad)


def test_counts(spark):
    store = store_of(spark, 9)
    assert reads.count_orders(store).first().orders == 9
    assert reads.count_orders(store, "cust").first().orders == 9
    assert reads.count_orders(store, "cus").first().orders == 0


def test_json_has_six_digits_and_a_list(spark):
    rows = [(uid(1), uid(2), "c", None, 5, T0, T0 + dt.timedelta(microseconds=10))]
    body = json.loads(reads.order_json(spark.createDataFrame(rows, STORE)).first().body)
    assert body["items"] == []
    assert body["processed_at"] == "2024-01-01T00:00:00.000010Z"
    assert list(body) == ["order_id", "event_id", "customer_id", "items", "total_cents", "occurred_at", "processed_at"]


def test_exported_pages_equal_walked_pages(spark):
    store = store_of(spark, 25, same_time=4)
    exported = reads.keyset_pages(store.repartition(4), 10)
    by_page = {r.order_id: r.page for r in exported.collect()}
    assert [by_page[o] for o in newest(store)] == [i // 10 for i in range(25)]


def test_the_registered_lookup_reads_one_bucket(spark):
    found = catalog.all_queries()["get_order"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert BUCKET in plan.split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(order_id" in plan.split("PushedFilters")[1]
    assert found.count() == 1


@pytest.mark.parametrize("name", ["list_orders", "list_orders_by_customer", "list_orders_page2"])
def test_registered_listings_do_not_scan_the_store(spark, name):
    found = catalog.all_queries()[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert BUCKET in plan.split("PartitionFilters")[1].split("]")[0]
    assert "order_id" in plan.split("PushedFilters")[1]
    assert found.count() == catalog.PAGE
