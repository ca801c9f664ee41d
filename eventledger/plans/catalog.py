"""The named queries: each takes (spark, sf_dir) and returns a DataFrame.

Times leave as epoch microseconds and NULL texts as '', so that results compare
across engines. Doubles are rounded.
"""

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions import failures, headers as H, ids, ingress, paging
from ..operators import ingest, measure, persist, progress, reads, replay, series
from ..operators.scale import side_by_side
from ..session import prepare
from ..sources import record_log as log_io, tables as T

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}

HOUR_US = 3_600_000_000
STICKY_PARTITIONS = 12
PAGE = 50
CHUNK = 10
REPLAY_LIMIT = 20
REPLAYED_AT = "2024-02-01 00:00:00"


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(prepare(spark), sf_dir)

    prepared.__doc__ = run.__doc__
    _queries[run.__name__] = prepared
    return prepared


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).alias(c)


def _us(c: str, name: str) -> Column:
    return F.unix_micros(F.col(c)).alias(name)


def _rounded(c: Column, digits: int, name: str) -> Column:
    return F.round(c.cast("double"), digits).alias(name)


def _joined_headers(headers: str = "headers") -> Column:
    return F.array_join(
        F.transform(headers, lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ";"
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source log classified; its ids come from the ingest step, one order per event."""
    log = T.record_log(spark, sf_dir)
    return persist.classify(log, faults=T.sink_faults(log), one_order_per_event=True)


# --- sources and sinks --------------------------------------------------------


@query
def record_log_scan(spark, sf_dir):
    value = F.col("value").cast("string")
    return T.record_log(spark, sf_dir).groupBy("partition").agg(
        F.count("*").alias("records"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.sum(F.octet_length("value")).alias("value_bytes"),
        F.min(F.md5(value)).alias("least_md5"),
        F.max(F.md5(value)).alias("greatest_md5"),
        F.sum(F.size("headers")).alias("headers"),
    )


@query
def log_append_offsets(spark, sf_dir):
    """A second run of the same deliveries, appended behind the first."""
    end = log_io.log_end(T.record_log(spark, sf_dir))
    arriving = T.arriving_records(spark, sf_dir).drop("value", "headers").withColumn(
        "value", F.lit(None).cast("binary")
    )
    return log_io.append_records(
        arriving, "arrival", S.SOURCE_TOPIC, T.PARTITIONS, end=end,
        partition=F.col("partition"), keep=["arrival"],
    ).select("arrival", "partition", "offset", F.col("key").cast("string").alias("key"))


@query
def key_stickiness(spark, sf_dir):
    placed = log_io.append_records(
        T.arriving_records(spark, sf_dir).drop("partition"), "arrival", S.SOURCE_TOPIC, STICKY_PARTITIONS
    )
    per_key = placed.groupBy("key").agg(
        F.count("*").alias("n"), (F.min("partition") != F.max("partition")).alias("split")
    )
    return per_key.agg(
        F.sum("n").alias("records"), F.count("*").alias("keys"), F.count_if("split").alias("split_keys")
    )


@query
def dead_letter_write(spark, sf_dir):
    return T.dead_letter_log(spark, sf_dir).select(
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        F.md5("value").alias("value_md5"),
        _joined_headers().alias("headers"),
    )


@query
def dlq_scan(spark, sf_dir):
    reason = F.coalesce(H.header(F.col("headers"), S.DLQ_REASON), F.lit(""))
    return T.dead_letter_log(spark, sf_dir).groupBy("partition", reason.alias("reason")).agg(
        F.count("*").alias("records"), F.max("offset").alias("last_offset")
    )


# --- ingest -------------------------------------------------------------------


@query
def strict_decode(spark, sf_dir):
    decoded = ingest.decode_requests(T.order_bodies(spark, sf_dir).drop("idempotency_key"))
    return decoded.select(
        "order_key",
        F.coalesce(F.col("reject_reason") == ingest.MALFORMED_BODY, F.lit(False)).alias("malformed"),
        "customer_id",
        F.size("items").cast("bigint").alias("items"),
        F.coalesce("total_cents", F.lit(-1)).alias("total_cents"),
        F.md5("body").alias("body_md5"),
    )


@query
def lenient_decode(spark, sf_dir):
    """Values damaged by rule: what the worker still reads and what it refuses."""
    value = F.col("value").cast("string")
    kind = F.col("n") % 11
    damaged = (
        F.when(kind == 1, F.concat(value, F.lit(" x")))
        .when(kind == 2, F.regexp_replace(value, r"\}$", ',"extra":{"a":[1,"b"]}}'))
        .when(kind == 3, F.regexp_replace(value, r'"items":\[.*\],', ""))
        .when(kind == 4, F.regexp_replace(value, r'"total_cents":([0-9]+)', '"total_cents":"$1"'))
        .when(kind == 5, F.regexp_replace(value, r"T[0-9:.]+Z", ""))
        .when(kind == 6, F.regexp_replace(value, r'"event_id":"[^"]*",', ""))
        .when(kind == 7, F.regexp_replace(value, r'"quantity":1', '"quantity":1.5'))
        .when(kind == 8, F.regexp_replace(value, r'"customer_id":"[^"]*"', '"customer_id":5'))
        .when(kind == 9, F.concat(value, value))
        .otherwise(value)
    )
    log = T.record_log(spark, sf_dir).withColumn("value", F.encode(damaged, "UTF-8"))
    event = persist.decode_records(log)
    shown = lambda c, other: F.when(F.col("readable"), c).otherwise(other)
    return event.select(
        "partition",
        "offset",
        "readable",
        shown(F.col("event.event_id"), "").alias("event_id"),
        shown(F.col("event.customer_id"), "").alias("customer_id"),
        shown(F.size("event.items"), -1).cast("bigint").alias("items"),
        shown(F.col("event.total_cents"), -1).cast("bigint").alias("total_cents"),
        shown(F.unix_micros("event.occurred_at"), 0).cast("bigint").alias("occurred_us"),
    )


@query
def validate_requests(spark, sf_dir):
    requests = T.order_requests(spark, sf_dir)
    problems = ingress.problems_of(F.col("customer_id"), F.col("n_items"), F.col("faulty"))
    return requests.select(
        "order_key",
        F.coalesce(ingress.validation_message(problems), F.lit("")).alias("message"),
    )


@query
def validate_idempotency_key(spark, sf_dir):
    keys = T.idempotency_keys(spark, sf_dir)
    return keys.select("order_key", ingress.idempotency_key_ok(F.col("idempotency_key")).alias("ok"))


@query
def order_totals(spark, sf_dir):
    return T.order_requests(spark, sf_dir).select("order_key", "total_cents")


@query
def derive_ids(spark, sf_dir):
    """Ids of every request: those that follow from a key are shown, the random ones judged by their form."""
    events = ingest.new_events(T.order_requests(spark, sf_dir), keep=["order_key", "idempotency_key"])
    keyed = F.col("idempotency_key") != ""
    form = lambda version: rf"^[0-9a-f]{{8}}-[0-9a-f]{{4}}-{version}[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$"
    well_formed = lambda c: F.when(keyed, F.col(c).rlike(form(5))).otherwise(F.col(c).rlike(form(4)))
    return events.select(
        "order_key",
        F.when(keyed, F.col("event_id")).otherwise("").alias("event_id"),
        F.when(keyed, F.col("order_id")).otherwise("").alias("order_id"),
        (well_formed("event_id") & well_formed("order_id") & (F.col("event_id") != F.col("order_id"))).alias("well_formed"),
        "customer_id",
        "total_cents",
        _us("occurred_at", "occurred_us"),
    )


@query
def rejections_by_reason(spark, sf_dir):
    decoded = ingest.decode_requests(T.order_bodies(spark, sf_dir))
    return measure.counts_by(decoded, F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))


@query
def order_json(spark, sf_dir):
    return reads.order_json(T.orders_store(spark, sf_dir))


FAILURE_CASES = [
    (failures.SERVER, "23505"),
    (failures.SERVER, "23502"),
    (failures.SERVER, "22P02"),
    (failures.SERVER, "42703"),
    (failures.SERVER, "08006"),
    (failures.SERVER, "53300"),
    (failures.SERVER, "57P01"),
    (failures.SERVER, "57P03"),
    (failures.SERVER, "58030"),
    (failures.SERVER, "40001"),
    (failures.SERVER, "40P01"),
    (failures.SERVER, "XX000"),
    (failures.TRANSPORT, ""),
    (failures.CANCELLED, ""),
    (failures.TIMEOUT, ""),
    (failures.INVALID_ARGUMENT, ""),
]


@query
def classify_failures(spark, sf_dir):
    """Every event meets one kind of failure; how many may be retried?"""
    cases = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("sqlstate")) for k, s in FAILURE_CASES])
    events = T.table(spark, sf_dir, "events")
    case = F.get(cases, (F.col("event_id") % len(FAILURE_CASES)).cast("int"))
    failed = events.select(case.alias("case")).select("case.*")
    return failed.groupBy("kind", "sqlstate").agg(
        F.count("*").alias("n"),
        F.count_if(failures.is_retryable(F.col("kind"), F.col("sqlstate"))).alias("retryable"),
        F.count_if(failures.is_caller_error(F.col("kind"), F.col("sqlstate"))).alias("caller_errors"),
    )


@query
def backoff_schedule(spark, sf_dir):
    """The longest wait before each retry of each faulty record."""
    faults = T.sink_faults(T.record_log(spark, sf_dir)).where(F.col("attempts") > 1)
    retries = faults.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.col("attempts") - 2)))
    return retries.select(
        "partition", "offset", "attempt", failures.backoff_ceiling_ms(F.col("attempt")).alias("ceiling_ms")
    )


@query
def generate_orders(spark, sf_dir):
    requests = T.request_log(spark, sf_dir)
    return requests.select(
        F.concat("run", F.lit("-"), F.col("seq").cast("string")).alias("customer_id"),
        F.concat(F.lit("SKU-"), (F.col("seq") % 1000).cast("string")).alias("sku"),
        F.lit(1).cast("bigint").alias("quantity"),
        F.lit(1999).cast("bigint").alias("unit_price_cents"),
    )


@query
def due_latency(spark, sf_dir):
    timed = measure.due_latency(T.request_log(spark, sf_dir))
    return timed.select("n", F.coalesce("latency_us", F.lit(-1)).alias("latency_us"), "behind")


# --- persistence ----------------------------------------------------------------


@query
def idempotent_insert(spark, sf_dir):
    log = T.record_log(spark, sf_dir)
    # whether an event lies on several orders is looked up, not promised
    stored = persist.insert_once(log, T.sink_faults(log), F.col("r.timestamp"))
    item = F.col("items")[0]
    return stored.select(
        "order_id", "event_id", "customer_id", item["sku"].alias("sku"),
        item["unit_price_cents"].alias("unit_price_cents"), "total_cents", _us("occurred_at", "occurred_us"),
    )


@query
def record_outcomes(spark, sf_dir):
    log = T.record_log(spark, sf_dir)
    return persist.classify(log, faults=T.sink_faults(log)).select(
        "partition", "offset", _text("event_id"), _text("order_id"), "outcome", _text("reason"),
        _text("cause"), "attempts",
    )


@query
def order_id_collisions(spark, sf_dir):
    return (
        _outcomes(spark, sf_dir)
        .where(F.col("cause") == persist.COLLISION)
        .select("partition", "offset", "event_id", "order_id", "sqlstate", "reason")
    )


@query
def poison_isolation(spark, sf_dir):
    """Per chunk of records: how many the bad ones among them did not take down."""
    log = T.record_log(spark, sf_dir)
    outcomes = persist.classify(log, faults=T.sink_faults(log), one_order_per_event=True)
    return progress.dense_chunks(outcomes, CHUNK).groupBy("partition", "chunk").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("outcome") == S.DEAD_LETTER).alias("parked"),
        F.count_if(F.col("outcome") != S.DEAD_LETTER).alias("applied"),
    )


@query
def outcome_counters(spark, sf_dir):
    log = T.record_log(spark, sf_dir)
    return persist.outcome_counts(log, T.sink_faults(log), one_order_per_event=True)


@query
def attempt_counters(spark, sf_dir):
    """Counters of the worker: records by outcome, retries, and all attempts at writing."""
    counted = measure.outcome_counters(_outcomes(spark, sf_dir))
    return counted.withColumn("attempts", F.col("persisted") + F.col("duplicate") + F.col("dead_letter") + F.col("retries"))


@query
def rejection_counters(spark, sf_dir):
    """Refusals of the front door by reason, with the requests whose event could not be produced."""
    decoded = ingest.decode_requests(T.order_bodies(spark, sf_dir))
    return measure.counts_by(
        ingest.with_produce_failures(decoded, T.produce_failed()), F.coalesce("reject_reason", F.lit("accepted")).alias("reason")
    )


@query
def reconcile(spark, sf_dir):
    """Every delivery was accepted once: stored, parked, or missing?

    Ids come from the values themselves; a value that cannot be read is known by
    its place. Dead letters are matched by the source place in their headers.
    """
    log = T.record_log(spark, sf_dir)
    place = F.concat_ws(":", F.col("partition").cast("string"), F.col("offset").cast("string"))
    read = persist.decode_records(log).select(
        "partition",
        "offset",
        F.when(F.col("readable"), F.coalesce("event_id", place)).otherwise(place).alias("event_id"),
        F.col("key").cast("string").alias("order_id"),
    )
    stored = persist.insert_once(log, T.sink_faults(log), one_order_per_event=True)
    source = lambda name: H.header(F.col("headers"), name)
    parked = T.dead_letter_log(spark, sf_dir).select(
        source(S.DLQ_SOURCE_PARTITION).cast("int").alias("partition"),
        source(S.DLQ_SOURCE_OFFSET).cast("bigint").alias("offset"),
    )
    return measure.reconcile(read, stored, read.join(parked, ["partition", "offset"], "left_semi"))


@query
def replay_is_noop(spark, sf_dir):
    """The store after the log, and after the log with every stored record sent again."""
    log = T.record_log(spark, sf_dir)
    faults = T.sink_faults(log)
    stored = _outcomes(spark, sf_dir).where(F.col("outcome") == S.PERSISTED).select(*log.columns)
    again = log_io.append_records(
        stored.withColumn("position", F.col("offset") * T.PARTITIONS + F.col("partition")),
        "position", S.SOURCE_TOPIC, T.PARTITIONS, end=log_io.log_end(log), partition=F.col("partition"),
    )
    fingerprint = F.sum(F.conv(F.substring(F.md5("order_id"), 1, 8), 16, 10).cast("bigint"))

    def state(records: DataFrame, name: str) -> DataFrame:
        return persist.insert_once(records, faults, one_order_per_event=True).agg(
            F.count("*").alias(f"rows_{name}"), fingerprint.alias(f"print_{name}")
        )

    resent = again.agg(F.count("*").alias("resent"))
    return side_by_side(state(log, "once"), state(log.drop("n").unionByName(again), "twice"), resent)


# --- progress -------------------------------------------------------------------


@query
def commit_frontier(spark, sf_dir):
    return progress.commit_frontier(T.accounted_for(T.record_log(spark, sf_dir)))


@query
def frontier_write_set(spark, sf_dir):
    return progress.before_frontier(
        T.accounted_for(T.record_log(spark, sf_dir)), T.PARTITIONS
    ).select("partition", "offset", "ok")


@query
def consumer_lag(spark, sf_dir):
    log = T.record_log(spark, sf_dir)
    committed = progress.commit_frontier(T.accounted_for(log))
    return progress.consumer_lag(log_io.log_end(log), committed)


@query
def offset_chunks(spark, sf_dir):
    log = T.record_log(spark, sf_dir).select("partition", "offset")
    return progress.offset_chunks(log, CHUNK)


@query
def partition_skew(spark, sf_dir):
    skew = progress.partition_skew(T.record_log(spark, sf_dir))
    return skew.select("partition", "records", _rounded(F.col("share"), 9, "share"))


# --- dead letters and replay ------------------------------------------------------


@query
def dead_letters(spark, sf_dir):
    return (
        _outcomes(spark, sf_dir)
        .where(F.col("outcome") == S.DEAD_LETTER)
        .select("partition", "offset", "reason", "attempts", persist.dead_letter_error().alias("error"))
    )


@query
def dead_letter_headers(spark, sf_dir):
    """Which headers a dead letter carries, and the replay count it kept."""
    parked = T.dead_letter_log(spark, sf_dir)
    return parked.select(
        "partition",
        "offset",
        F.array_join(F.transform("headers", lambda h: h["key"]), ",").alias("names"),
        F.coalesce(H.header(F.col("headers"), S.REPLAY_COUNT), F.lit("")).alias("kept_count"),
        H.header(F.col("headers"), S.DLQ_SOURCE_OFFSET).alias("source_offset"),
    )


def _decided(spark, sf_dir, reasons=replay.ALL_REASONS) -> DataFrame:
    return replay.replay_decisions(T.dead_letter_log(spark, sf_dir), reasons)


@query
def replay_decision(spark, sf_dir):
    default = replay.replay_decisions(T.dead_letter_log(spark, sf_dir))
    everything = replay.replay_decisions(
        default.withColumnsRenamed({"decision": "by_default", "replay_count": "count"}), replay.ALL_REASONS
    )
    return everything.select(
        "partition", "offset", F.col("count").alias("replay_count"), "by_default",
        F.col("decision").alias("with_all"),
    )


@query
def replay_records(spark, sf_dir):
    now = F.lit(REPLAYED_AT).cast("timestamp")
    back = replay.replay_records(_decided(spark, sf_dir), now)
    return back.select(
        F.col("dlq_partition"), "dlq_offset", F.col("key").cast("string").alias("key"),
        F.md5("value").alias("value_md5"), _joined_headers().alias("headers"),
    )


@query
def replay_limit(spark, sf_dir):
    scanned = replay.up_to_limit(_decided(spark, sf_dir), REPLAY_LIMIT)
    return scanned.groupBy("partition", "decision").agg(
        F.count("*").alias("records"), F.max("offset").alias("last_offset")
    )


@query
def replay_report(spark, sf_dir):
    report = replay.replay_report(_decided(spark, sf_dir, S.RETRIES_EXHAUSTED))
    skipped = lambda why: F.coalesce(F.col("skipped")[why], F.lit(0)).cast("bigint")
    return report.select(
        "scanned", "replayed", "failed", "unreadable",
        skipped("no_dlq_reason").alias("skipped_no_reason"),
        skipped("reason:poison").alias("skipped_poison"),
        skipped("replay_limit").alias("skipped_limit"),
    )


@query
def replay_rerun_empty(spark, sf_dir):
    """What a first run scans, and what a second one does after the first committed."""
    dlq = T.dead_letter_log(spark, sf_dir)
    first = replay.not_yet_scanned(dlq, None, T.DLQ_PARTITIONS)
    committed = replay.offsets_after(first, "order-dlq-replay", S.DEAD_LETTER_TOPIC)
    second = replay.not_yet_scanned(dlq, committed, T.DLQ_PARTITIONS)
    runs = first.select(F.lit(1).alias("run")).unionByName(second.select(F.lit(2).alias("run")))
    return runs.agg(
        F.count_if(F.col("run") == 1).alias("first_scanned"),
        F.count_if(F.col("run") == 2).alias("second_scanned"),
    )


@query
def replay_loop_guard(spark, sf_dir):
    """Dead letters that are sent back and die again, until the guard stops them."""
    now = F.lit(REPLAYED_AT).cast("timestamp")
    dead = T.dead_letter_log(spark, sf_dir)
    rounds = []
    for number in (1, 2, 3):
        decided = replay.replay_decisions(dead, replay.ALL_REASONS)
        rounds.append(decided.select(F.lit(number).alias("round"), "decision"))
        back = decided.where(F.col("decision") == replay.REPLAY)
        sent = H.replay_headers(F.col("replay_count") + 1, now, F.col("partition"), F.col("offset"))
        # the same failure again: a fresh diagnosis, replay headers carried forward
        dead = back.withColumn(
            "headers",
            H.dead_letter_headers(
                sent, F.lit(S.POISON), F.lit("still broken"), F.lit(1), F.lit(S.SOURCE_TOPIC),
                F.col("partition"), F.col("offset"), now,
            ),
        ).select(*dead.columns)
    seen = rounds[0]
    for later in rounds[1:]:
        seen = seen.unionByName(later)
    return seen.groupBy("round", "decision").agg(F.count("*").alias("records"))


@query
def replay_verify(spark, sf_dir):
    """Are the replayed events in the store? (The store here is the one before the replay.)"""
    log = T.record_log(spark, sf_dir)
    back = _decided(spark, sf_dir).where(F.col("decision") == replay.REPLAY)
    stored = persist.insert_once(log, T.sink_faults(log), one_order_per_event=True)
    return replay.verify_replayed(replay.with_event_id(back).select("event_id"), stored)


# --- reads ------------------------------------------------------------------------


def _shown(orders: DataFrame) -> DataFrame:
    item = F.col("items")[0]
    return orders.select(
        "order_id", "event_id", "customer_id", item["sku"].alias("sku"), "total_cents",
        _us("occurred_at", "occurred_us"), _us("processed_at", "processed_us"),
    )


def _order_id_of(number: int) -> str:
    d = hashlib.md5(f"order:{number}".encode()).hexdigest()
    return "-".join([d[:8], d[8:12], d[12:16], d[16:20], d[20:]])


@query
def get_order(spark, sf_dir):
    return _shown(reads.get_order(T.orders_store(spark, sf_dir), _order_id_of(42).upper()))


def _page(spark, sf_dir, token: str = "", tag: str = "") -> DataFrame:
    """One page by way of the listing: the slices that hold it, then the buckets of its orders."""
    keys = T.next_orders(spark, sf_dir, PAGE, token, tag)
    store = T.orders_store(spark, sf_dir)
    if tag:
        store = store.withColumn("customer_id", F.col("tag"))
    return _shown(reads.orders_with(store, [k["order_id"] for k in keys]))


@query
def list_orders(spark, sf_dir):
    return _page(spark, sf_dir)


@query
def list_orders_by_customer(spark, sf_dir):
    return _page(spark, sf_dir, tag="click")


@query
def list_orders_page2(spark, sf_dir):
    return _page(spark, sf_dir, token=T.next_orders(spark, sf_dir, PAGE)[-1]["token"])


@query
def page_cursors(spark, sf_dir):
    return T.orders_store(spark, sf_dir).select(
        "order_id", paging.page_token(F.col("processed_at"), F.col("order_id")).alias("token")
    )


@query
def keyset_pages(spark, sf_dir):
    return reads.keyset_pages(T.orders_store(spark, sf_dir), PAGE).select("order_id", "page")


@query
def count_orders(spark, sf_dir):
    return reads.count_orders(T.orders_store(spark, sf_dir))


@query
def count_by_tag(spark, sf_dir):
    return reads.count_orders(T.orders_store(spark, sf_dir), "click")


# --- measurement --------------------------------------------------------------------


def _latency_columns(stats: DataFrame, *keys: str) -> DataFrame:
    return stats.select(
        *keys, "count", *[_rounded(F.col(f"{c}_seconds"), 9, f"{c}_seconds") for c in ("p50", "p95", "p99", "max")]
    )


def _e2e() -> Column:
    return measure.elapsed_us("processed_at", "occurred_at")


@query
def e2e_latency(spark, sf_dir):
    return _latency_columns(measure.latency_stats(T.orders_store(spark, sf_dir), _e2e(), ["tag"]), "tag")


@query
def latency_of_slices(spark, sf_dir):
    """Hourly sketches merged per tag, and whether each quantile has the rank it should."""
    store = T.orders_store(spark, sf_dir).select("tag", "processed_at", _e2e().alias("us"))
    slices = measure.latency_slices(store, F.col("us"), "processed_at", HOUR_US, ["tag"])
    merged = measure.merged_latency(slices, ["tag"])
    # a row per tag, and there are few tags
    ranked = store.join(F.broadcast(merged), "tag").groupBy("tag", "slices", "count", "max_seconds").agg(
        *[
            (
                (F.count_if(F.col("us") / 1e6 < F.col(f"{c}_seconds")) <= (q + measure.RANK_ERROR) * F.count("*"))
                & (F.count_if(F.col("us") / 1e6 <= F.col(f"{c}_seconds")) >= (q - measure.RANK_ERROR) * F.count("*"))
            ).alias(f"{c}_in_rank")
            for c, q in measure.QUANTILES.items()
        ]
    )
    return ranked.withColumn("max_seconds", _rounded(F.col("max_seconds"), 9, "max_seconds"))


@query
def accept_latency(spark, sf_dir):
    timed = measure.due_latency(T.request_log(spark, sf_dir))
    return _latency_columns(
        measure.latency_stats(timed, F.col("latency_us"), ["run"], measure.DISCRETE), "run"
    )


@query
def throughput(spark, sf_dir):
    rates = measure.throughput(T.orders_store(spark, sf_dir), ["tag"])
    return rates.select("tag", "persisted", _rounded(F.col("throughput"), 6, "throughput"))


@query
def run_report(spark, sf_dir):
    report = measure.run_report(T.request_log(spark, sf_dir))
    code = lambda c: F.coalesce(F.col("status_codes")[c], F.lit(0)).cast("bigint")
    return report.select(
        "run", "sent", "accepted", "failed", "scheduler_behind",
        _rounded(F.col("wall_clock_seconds"), 6, "wall_clock_seconds"),
        _rounded(F.col("achieved_rate"), 6, "achieved_rate"),
        code("202").alias("status_202"), code("503").alias("status_503"),
        _rounded(F.col("accept_p99_seconds"), 6, "accept_p99_seconds"),
        F.col("accept_count").alias("answered"),
    )


WORKERS = {"signup": 1, "view": 2, "purchase": 4, "click": 8, "error": 16}
BATCH_SIZES = {"signup": 1, "view": 10, "purchase": 50, "click": 200, "error": 1000}


def _setting(tags: dict[str, int], tag: str = "tag") -> Column:
    setting = F.lit(0)
    for name, n in tags.items():
        setting = F.when(F.col(tag) == name, n).otherwise(setting)
    return setting.cast("int")


def _gauge(spark, sf_dir) -> DataFrame:
    return T.metric_samples(spark, sf_dir).where(F.col("metric") == "consumer_lag")


@query
def scaling_matrix(spark, sf_dir):
    store = T.orders_store(spark, sf_dir).withColumn("workers", _setting(WORKERS))
    runs = store.groupBy("workers").agg(
        F.min("processed_at").alias("run_start"), F.max("processed_at").alias("run_end")
    )
    peak = series.peak_over_run(_gauge(spark, sf_dir), runs, ["workers"], HOUR_US)
    matrix = measure.scaling_matrix(store, peak, ["workers"])
    return matrix.select(
        "workers", "persisted", _rounded(F.col("throughput"), 6, "throughput"),
        *[_rounded(F.col(f"{c}_ms"), 6, f"{c}_ms") for c in ("p50", "p95", "p99", "max")],
        _rounded(F.coalesce("peak_lag", F.lit(0.0)), 6, "peak_lag"),
    )


@query
def ramp_table(spark, sf_dir):
    store = T.orders_store(spark, sf_dir).withColumnRenamed("tag", "run")
    ramp = measure.ramp_table(T.request_log(spark, sf_dir), store)
    return ramp.select(
        "run", _rounded(F.col("achieved"), 6, "achieved"), "accepted", "rejected_503", "failed",
        "sched_behind", _rounded(F.col("accept_p99_ms"), 3, "accept_p99_ms"),
        _rounded(F.col("e2e_p99_ms"), 6, "e2e_p99_ms"), "persisted", "missing",
    )


@query
def batch_speedup(spark, sf_dir):
    store = T.orders_store(spark, sf_dir).withColumn("batch_size", _setting(BATCH_SIZES))
    sizes = measure.batch_speedup(store, "batch_size")
    return sizes.select(
        "batch_size", "persisted", _rounded(F.col("throughput"), 6, "throughput"),
        _rounded(F.col("speedup"), 6, "speedup"),
    )


@query
def latency_histogram(spark, sf_dir):
    return measure.histogram(
        T.orders_store(spark, sf_dir), _e2e() / 1e6, S.END_TO_END_BUCKETS, ["tag"]
    ).select("tag", F.coalesce(F.nullif(F.col("le"), F.lit(float("inf"))), F.lit(-1.0)).alias("le"), "bucket_count")


# --- metric samples ---------------------------------------------------------------------

WINDOW_US = 6 * HOUR_US


def _counter(spark, sf_dir) -> DataFrame:
    return T.metric_samples(spark, sf_dir).where(F.col("metric") == "orders_processed_total")


def _buckets(spark, sf_dir) -> DataFrame:
    samples = T.metric_samples(spark, sf_dir).where(
        F.col("metric") == "order_end_to_end_latency_seconds_bucket"
    )
    le = F.when(F.col("label") == "+Inf", float("inf")).otherwise(F.col("label").try_cast("double"))
    return samples.withColumn("le", le)


@query
def instance_sums(spark, sf_dir):
    """Counters summed over instances, as ``sum by`` does at each time."""
    total = series.sum_by(_counter(spark, sf_dir), "value", ["ts", "label"])
    return total.select(_us("ts", "ts_us"), "label", "value")


@query
def counter_increase(spark, sf_dir):
    grown = series.counter_increase(_counter(spark, sf_dir), WINDOW_US).where(F.col("increase").isNotNull())
    return grown.select(_us("ts", "ts_us"), "instance", "label", "increase")


@query
def counter_rate(spark, sf_dir):
    rated = series.counter_rate(_counter(spark, sf_dir), WINDOW_US).where(F.col("rate").isNotNull())
    summed = series.sum_by(rated, "rate", ["ts", "label"])
    return summed.select(_us("ts", "ts_us"), "label", _rounded(F.col("rate"), 9, "rate"))


@query
def counter_rate_extrapolated(spark, sf_dir):
    rated = series.counter_rate(_counter(spark, sf_dir), WINDOW_US, extrapolate=True)
    return rated.where(F.col("rate").isNotNull()).select(
        _us("ts", "ts_us"), "instance", "label", _rounded(F.col("rate"), 9, "rate")
    )


@query
def histogram_quantile(spark, sf_dir):
    # a quantile is the same for increases and for rates; increases are exact
    grown = series.counter_increase(_buckets(spark, sf_dir), WINDOW_US, [*series.SERIES, "le"])
    result = series.histogram_quantile(grown.where(F.col("increase").isNotNull()), 0.99, ["ts"], "increase")
    return result.where(F.col("quantile").isNotNull()).select(
        _us("ts", "ts_us"), _rounded(F.col("quantile"), 9, "p99")
    )


@query
def lag_slope(spark, sf_dir):
    sloped = series.slope(_gauge(spark, sf_dir), WINDOW_US).where(F.col("slope").isNotNull())
    return sloped.select(_us("ts", "ts_us"), "label", _rounded(F.col("slope"), 6, "slope"))


@query
def peak_lag(spark, sf_dir):
    runs = T.orders_store(spark, sf_dir).groupBy("tag").agg(
        F.min("processed_at").alias("run_start"), F.max("processed_at").alias("run_end")
    )
    peak = series.peak_over_run(_gauge(spark, sf_dir), runs, ["tag"], HOUR_US)
    return peak.select("tag", _rounded(F.col("peak_lag"), 6, "peak_lag"))


RANGE_START = "2024-01-01 00:00:00"
RANGE_END = "2024-01-31 00:00:00"
RANGE_STEP_US = 100_000_000


@query
def range_resample(spark, sf_dir):
    ticks = series.resample(
        _gauge(spark, sf_dir), F.lit(RANGE_START).cast("timestamp"), F.lit(RANGE_END).cast("timestamp"),
        RANGE_STEP_US,
    )
    return ticks.select(_us("tick", "tick_us"), "label", _rounded(F.col("value"), 6, "value"))


TICKS_START = "2024-01-01 00:07:00"
TICK_US = 1_200_000_000


@query
def rate_at_ticks(spark, sf_dir):
    """``sum by (label) (rate(x[6h]))`` drawn every twenty minutes, seven past the full hour and on."""
    rated = series.rate_at_ticks(
        _counter(spark, sf_dir), F.lit(TICKS_START).cast("timestamp"), F.lit(RANGE_END).cast("timestamp"), TICK_US, WINDOW_US
    )
    summed = series.sum_by(rated, "rate", ["tick", "label"])
    return summed.select(_us("tick", "tick_us"), "label", _rounded(F.col("rate"), 9, "rate"))


SHIFT_US = 17_000_000
SUM_TICK_US = 60_000_000
PEAK_TICK_US = 5_000_000


def _shifted(samples: DataFrame, number: Column) -> DataFrame:
    """Each series at times of its own."""
    return samples.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + number * SHIFT_US))


@query
def shifted_sums(spark, sf_dir):
    """Counters of instances that are scraped at different times, summed at common ticks."""
    counter = _shifted(_counter(spark, sf_dir), F.substring_index("instance", "-", -1).try_cast("bigint"))
    total = series.sum_at_ticks(counter, SUM_TICK_US, ["label"])
    return total.select(_us("tick", "tick_us"), "label", "value")


@query
def peak_lag_at_ticks(spark, sf_dir):
    """``max_over_time(sum(lag)[run:5s])`` of partitions that are sampled at different times."""
    runs = T.orders_store(spark, sf_dir).groupBy("tag").agg(
        F.min("processed_at").alias("run_start"), F.max("processed_at").alias("run_end")
    )
    lag = _shifted(_gauge(spark, sf_dir), F.col("label").try_cast("bigint"))
    peak = series.peak_of_sum(lag, runs, ["tag"], PEAK_TICK_US)
    return peak.select("tag", _rounded(F.col("peak_lag"), 6, "peak_lag"))


TILES_AT = "2024-01-20 12:04:00"


@query
def dashboard_tiles(spark, sf_dir):
    """One row of instant values; -1 where there is no sample."""
    from ..operators.dashboard import tiles

    log = T.record_log(spark, sf_dir)
    rejected = ingest.decode_requests(T.order_bodies(spark, sf_dir)).where(F.col("reject_reason").isNotNull())
    row = tiles(
        at=F.lit(TILES_AT).cast("timestamp"),
        window_us=WINDOW_US,
        samples=T.metric_samples(spark, sf_dir),
        requests=T.request_log(spark, sf_dir),
        outcomes=persist.outcome_counts(log, T.sink_faults(log), one_order_per_event=True),
        rejected=rejected,
        dead=T.dead_letter_log(spark, sf_dir),
        faults=T.sink_faults(log),
        frontier=progress.commit_frontier(T.accounted_for(log)),
    )
    return row.select(
        *[_rounded(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)), 9, c) for c in row.columns]
    )


@query
def tumbling_rate(spark, sf_dir):
    rates = measure.tumbling_rate(T.orders_store(spark, sf_dir), "processed_at", "30 seconds", ["tag"])
    return rates.select(_us("window_start", "window_us"), "tag", "rows", _rounded(F.col("rate"), 9, "rate"))


@query
def sliding_rate(spark, sf_dir):
    rates = measure.sliding_rate(T.orders_store(spark, sf_dir), "processed_at", "30 seconds", "10 seconds")
    return rates.select(_us("window_start", "window_us"), "rows", _rounded(F.col("rate"), 9, "rate"))
