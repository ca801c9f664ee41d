"""Commits over several tables, filters of stored ids, merging of folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventledger import schemas as S
from eventledger.operators import reads, series
from eventledger.streaming import listing, manifest as M, persist_job as P, store as St
from eventledger.streaming.ingest_job import IngestJob
from eventledger.streaming.retry import RetryPolicy, SinkError
from helpers import event, log_frame, record, uid

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(St, "BUCKETS", 4)


def orders(spark, numbers):
    rows = [(uid(f"o{i}"), uid(f"e{i}"), "c", [], i, T0, T0) for i in numbers]
    return spark.createDataFrame(rows, S.STORE)


def opened(spark, folder):
    return St.commits_of_store(spark, folder + "/s").open(St.store_tables(folder + "/s"))


def put(commits, numbers):
    rows = orders(commits.spark, numbers)
    St.write_orders_table(rows, commits.attempt(St.ORDERS))
    return commits.commit(St.add_orders(rows, len(numbers), commits))


def stored(spark, folder):
    return sorted(r.total_cents for r in St.read_batches(spark, folder + "/s", S.STORE).collect())


def files_of(df):
    return {tuple(f.split("/")[-3:-1]) for f in df.inputFiles()}


def test_a_batch_reads_only_what_the_filters_admit(spark, folder):
    commits = opened(spark, folder)
    numbers = [put(commits, range(100 * k, 100 * k + 100)) for k in range(5)]
    asked = spark.createDataFrame([(uid(f"o{i}"), uid(f"e{i}")) for i in (210, 211)], "order_id string, event_id string")
    met = St.stored_with(spark, folder + "/s", asked)
    folders = {f"batch_id={numbers[2]}"}
    read = files_of(met)
    assert {batch for batch, _ in read} == folders and len(read) <= 4
    assert sorted(r.event_id for r in met.collect()) == sorted(uid(f"e{i}") for i in (210, 211))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # an order met by one id and an event by the other; ids that nobody has
    other = [(uid("o7"), uid("new")), (uid("none"), uid("e420")), (None, uid("absent"))]
    met = St.stored_with(spark, folder + "/s", spark.createDataFrame(other, "order_id string, event_id string"))
    assert sorted(r.order_id for r in met.collect()) == sorted(uid(f"o{i}") for i in (7, 420))
    fresh = [(uid(f"o{i}"), uid(f"e{i}")) for i in range(1000, 1050)]
    met = St.stored_with(spark, folder + "/s", spark.createDataFrame(fresh, "order_id string, event_id string"))
    assert files_of(met) == set() and met.count() == 0


@pytest.mark.parametrize("rows,size", [(1, (1, 16)), (4_000, (1, 512)), (100_000, (16, 1024))])
def test_filters_hold_every_id_and_few_others(spark, rows, size):
    assert St.FilterSize.of(rows) == size
    if rows > 5_000:
        return
    ids = spark.range(rows).select(F.md5(F.col("id").cast("string")).alias("order_id"), F.lit(None).cast("string").alias("event_id"))
    filters = St.filters_of(ids, St.FilterSize.of(rows)).collect()
    assert all(len(r.words) == size[1] for r in filters)
    words = {(r.bucket, r.segment): r.words for r in filters}

    def share(df):
        probe = df.select(
            St.bucket_of_id(F.col("order_id")).alias("bucket"),
            St._segment(St._hash_of("order_id"), F.lit(size[0])).alias("segment"),
            St._bits(St._hash_of("order_id"), F.lit(size[1])).alias("bits"),
        ).collect()
        held = [all(words[r.bucket, r.segment][b >> 6] >> (b & 63) & 1 for b in r.bits) for r in probe if (r.bucket, r.segment) in words]
        return sum(held) / len(probe)

    assert share(ids) == 1.0
    others = spark.range(20_000).select(F.sha1(F.col("id").cast("string")).alias("order_id"))
    assert share(others) < 0.002


def test_merging_keeps_few_folders_and_all_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(St, "MERGED_FOLDERS", 2)
    commits = opened(spark, folder)
    put(commits, [0])
    reader = St.read_batches(spark, folder + "/s", S.STORE)
    for i in range(1, 8):
        put(commits, [i])
        St.merge_due(commits)
        folders = commits.folders(St.ORDERS)
        levels = [info["level"] for info in folders.values()]
        assert len(set(levels)) == len(levels) <= i.bit_length() + 1
        assert set(folders) == set(commits.folders(St.EVENTS)) == set(commits.folders(St.MEMBERS))
    assert stored(spark, folder) == list(range(8))
    # who had opened the first folder still reads it; afterwards it may go
    assert [r.total_cents for r in reader.collect()] == [0]
    asked = spark.createDataFrame([(uid("o3"), uid("e5"))], "order_id string, event_id string")
    assert sorted(r.order_id for r in St.stored_with(spark, folder + "/s", asked).collect()) == sorted([uid("o3"), uid("o5")])
    assert commits.vacuum(keep=0) > 0 and commits.vacuum(keep=0) == 0
    assert stored(spark, folder) == list(range(8))
    assert len(commits.files.names(folder + "/s")) == len(commits.folders(St.ORDERS))


def test_large_folders_are_not_merged(spark, folder, monkeypatch):
    monkeypatch.setattr(St, "MERGED_FOLDERS", 2)
    monkeypatch.setattr(St, "MERGED_ROWS", 6)
    commits = opened(spark, folder)
    for i in range(4):
        put(commits, range(4 * i, 4 * i + 4))
        assert not St.merge_due(commits)
    assert len(commits.folders(St.ORDERS)) == 4


def test_states_are_read_from_the_newest_whole_one(spark, folder, monkeypatch):
    monkeypatch.setattr(M, "STATE_EVERY", 3)
    commits = M.Manifest(spark, folder + "/c").open({"t": folder + "/t"})
    for i in range(8):
        commits.commit({"t": St.add(spark.range(1), commits, "t")}, ends={"t": {0: i}})
    read = []
    fresh = M.Manifest(spark, folder + "/c")
    text = fresh.files.text
    fresh.files.text = lambda path: read.append(path) or text(path)
    assert fresh.state() == commits.state() and fresh.end_of("t") == {0: 7}
    assert len(read) == 1


# --- listing


def many(spark, first, n):
    """Orders of three customers, one of which has nearly all; three of them at a time."""
    rows = [
        (uid(f"o{i}"), uid(f"e{i}"), "rare" if i % 20 == 7 else "other" if i % 20 == 9 else "hot", [], i, T0, T0 + dt.timedelta(seconds=i // 3))
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(rows, S.STORE)


def walked(spark, store, size, customer=""):
    token, pages = "", []
    while True:
        rows, token = reads.list_stored(spark, store, size, token, customer)
        pages.append([r.order_id for r in rows])
        if not token:
            return pages


def test_pages_read_few_slices(spark, folder, monkeypatch):
    monkeypatch.setattr(listing, "SLICE_ROWS", 20)
    monkeypatch.setattr(listing, "SLICES_FIRST", 2)
    commits = opened(spark, folder)
    store, everything = folder + "/s", []
    for k in range(3):
        rows = many(spark, 60 * k, 60)
        St.write_orders_table(rows, commits.attempt(St.ORDERS))
        commits.commit(St.add_orders(rows, 60, commits))
        everything += rows.collect()
    newest = [r.order_id for r in sorted(everything, key=lambda r: (r.processed_at, r.order_id), reverse=True)]
    sizes = []
    real = listing._chosen

    def counted(*args):
        found = real(*args)
        sizes.append(len(found[0]))
        return found

    monkeypatch.setattr(listing, "_chosen", counted)
    pages = walked(spark, store, 25)
    assert sum(pages, []) == newest and [len(p) for p in pages] == [25] * 7 + [5]
    # of some nine slices in three folders a page needs those that hold 26 rows, and the one it begins in
    total = St.read_batches(spark, folder + "/s-slices", listing.SLICES).where("cluster = 'time'").count()
    assert total >= 9 and max(sizes) <= 5
    for customer in ("hot", "rare", "nobody"):
        own = [o for o in newest if next(r for r in everything if r.order_id == o).customer_id == customer]
        assert sum(walked(spark, store, 7, customer), []) == own
    page = St.newest_orders(spark, store, 6)
    assert {batch for batch, _ in files_of(page)} == {f"batch_id={max(commits.folders(St.ORDERS))}"}
    monkeypatch.setattr(St, "MERGED_FOLDERS", 3)
    assert St.merge_due(commits)
    assert sum(walked(spark, store, 100), []) == newest


def test_pages_of_an_empty_store(spark, folder):
    opened(spark, folder)
    assert walked(spark, folder + "/s", 5) == [[]]


# --- all or nothing

STEPS = ["write_orders_table", "add_orders", "_park", "add", "commit"]


@pytest.mark.parametrize("step", STEPS)
def test_no_reader_sees_half_a_batch(spark, folder, monkeypatch, step):
    """The job dies right after a step; the batch then comes again."""
    rows = [record(0, 0, event(uid("e0"), uid("o0"))), record(0, 1, "{not json"), record(0, 2, event(uid("e1"), uid("o1")))]
    paths = [folder + "/s", folder + "/d", folder + "/o"]
    schemas = [S.STORE, S.RECORD, P.OUTCOMES]
    job = P.PersistJob(spark, *paths)
    counts = lambda: [St.read_batches(spark, p, s).count() for p, s in zip(paths, schemas)]

    def then_die(real):
        def run(*args, **kwargs):
            real(*args, **kwargs)
            raise RuntimeError("killed")
        return run

    with monkeypatch.context() as m:
        if step == "_park":
            job._park = then_die(job._park)
        elif step == "commit":
            # dies after the commit, with nothing in its place yet
            m.setattr(M.Files, "move", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        else:
            m.setattr(P, step, then_die(getattr(P, step)))
        with pytest.raises(Exception, match="killed"):
            job.write(log_frame(spark, rows), 0)
    assert counts() == ([2, 1, 2] if step == "commit" else [0, 0, 0])
    again = P.PersistJob(spark, *paths)
    again.write(log_frame(spark, rows), 0)
    again.write(log_frame(spark, rows), 0)
    assert counts() == [2, 1, 2]


def test_two_ingest_jobs_cannot_take_the_same_offsets(spark, folder):
    body = '{"customer_id":"c","items":[{"sku":"s","quantity":1,"unit_price_cents":1}]}'
    bodies = spark.createDataFrame([(i, body, f"k{i}") for i in range(3)], "position bigint, body string, idempotency_key string")
    bodies = bodies.withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp"))
    one, two = (IngestJob(spark, folder + "/log", folder + "/r", partitions=1) for _ in range(2))
    one.write(bodies, 0)
    two.write(bodies, 1)
    with pytest.raises(M.Fenced):
        one.write(bodies, 2)
    # also where the other comes between the append and the commit
    real, late = two.commits().commit, IngestJob(spark, folder + "/log", folder + "/r", partitions=1)
    two.commits().commit = lambda *a, **k: late.commits() and real(*a, **k)
    with pytest.raises(M.Fenced):
        two.write(bodies, 3)
    late.write(bodies, 4)
    offsets = sorted(r.offset for r in St.read_batches(spark, folder + "/log", S.RECORD).collect())
    assert offsets == list(range(9))


def test_a_number_is_given_once(spark, folder):
    files = M.Files(spark)
    assert files.put_if_absent(folder + "/x", "one") and not files.put_if_absent(folder + "/x", "two")
    assert files.text(folder + "/x") == "one" and len(files.names(folder)) == 1


def test_a_table_has_one_list_of_commits(spark, folder):
    M.Manifest(spark, folder + "/a").open({"t": folder + "/t"})
    with pytest.raises(ValueError):
        M.Manifest(spark, folder + "/b").open({"t": folder + "/t"})


def test_a_half_that_the_environment_fails_is_not_split(spark, folder):
    """A bad record has the batch halved; then the store goes away for one half of it."""
    rows = [record(0, i, event(uid(f"e{i}"), uid(f"o{i}"))) for i in range(8)]
    tries = []

    def picky(rows, batch_id):
        ids = {r.event_id for r in rows.select("event_id").collect()}
        tries.append(len(ids))
        if len(ids) == 8:
            raise SinkError("23514")
        if uid("e7") in ids:
            raise SinkError("08006")

    job = P.PersistJob(
        spark, folder + "/s", folder + "/d", folder + "/o", before_store_write=picky,
        policy=RetryPolicy(base_ms=1, max_ms=2, budget_ms=1), sleep=lambda s: None,
    )
    job.write(log_frame(spark, rows), 0)
    assert [n for n in tries if n < 4] == []
    found = {(r.outcome, r.reason): r.n for r in St.read_batches(spark, folder + "/o", P.OUTCOMES).collect()}
    assert found == {("persisted", None): 4, ("dead_letter", "retries_exhausted"): 4}


def test_a_job_leaves_samples_of_its_own(spark, folder):
    """Counters go on after a restart; the dashboard's processing time and the lag come from them."""
    rows = [record(p, o, event(uid(f"e{p}-{o}"), uid(f"o{p}-{o}")) if o else "{not json") for p in (0, 1) for o in range(4)]
    St.write_batch(log_frame(spark, rows), folder + "/log", 0)
    paths = [folder + "/s", folder + "/d", folder + "/o"]
    P.PersistJob(spark, *paths, log=folder + "/log").write(log_frame(spark, [r for r in rows if r[3] == 0]), 0)
    P.PersistJob(spark, *paths, log=folder + "/log").write(log_frame(spark, [r for r in rows if r[3] == 1][:3]), 1)
    samples = St.read_batches(spark, folder + "/o-samples", P.SAMPLES).drop("batch_id")
    now = F.current_timestamp()
    grown = series.increase_at(samples.where("metric <> 'consumer_lag'"), now, 3_600_000_000)
    found = {(r.metric, r.label): r.increase for r in grown.collect()}
    assert found["orders_processed_total", "persisted"] == 5 and found["orders_processed_total", "dead_letter"] == 2
    assert found["dlq_messages_total", "poison"] == 2 and found[P.TOOK, "+Inf"] == 5
    le = F.when(F.col("label") == "+Inf", float("inf")).otherwise(F.col("label").try_cast("double"))
    buckets = grown.where(F.col("metric") == P.TOOK).withColumn("le", le)
    assert series.histogram_quantile(buckets, 0.99, ["metric"], "increase").first()["quantile"] > 0
    lag = series.latest(samples.where("metric = 'consumer_lag'"), now)
    assert {r.label: r.value for r in lag.collect()} == {"0": 0.0, "1": 1.0}
