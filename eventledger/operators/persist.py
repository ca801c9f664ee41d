"""What happens to each record of the log: persisted, duplicate or dead letter.

The rule is sequential in meaning: a record whose event_id is already stored is
a duplicate; otherwise one whose order_id is stored collides and is poison;
otherwise it is stored. It is computed without a sequential pass. Where every
event belongs to one order (any log written by the ingest step) the verdicts
follow from the first record of each order. Events that a broken producer put
on several orders are settled in rounds, see ``_settle_tangled``.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import failures
from ..functions.events import (
    event_fits,
    event_of,
    event_time,
    sealed,
    sealed_document,
    zero_filled_event,
)
from ..functions.ids import canonical_uuid
from ..schemas import DEAD_LETTER, DUPLICATE, PERSISTED, POISON
from .scale import lookup, once

UNDECODABLE = "undecodable"
SINK_FAULT = "sink_fault"
MALFORMED_ID = "malformed_id"
COLLISION = "order_id_collision"

# SQLSTATEs of the failures the data itself causes.
INVALID_TEXT = "22P02"
UNIQUE_VIOLATION = "23505"


def decode_records(records: DataFrame) -> DataFrame:
    """Adds ``readable``, the ``event`` and its canonical ids.

    ``event_id`` and ``order_id`` are NULL when the text in the event is not a
    UUID; a missing field is an empty string, hence also not one. ``event`` is
    left unevaluated until something selects it.
    """
    value = F.col("value").cast("string")
    listed = once(records, _listed=sealed(value))
    found = once(listed, _document=sealed_document(F.col("_listed"), value))
    typed = once(found, _typed=F.when(event_fits(F.col("_document")), event_of(value)))
    ids = once(
        typed,
        _occurred_at=event_time(F.col("_typed")),
        event_id=canonical_uuid(F.col("_typed.event_id")),
        order_id=canonical_uuid(F.col("_typed.order_id")),
    )
    return (
        ids.withColumn("readable", F.col("_occurred_at").isNotNull())
        .withColumn("event", zero_filled_event(F.col("_typed"), F.col("_occurred_at")))
        .drop("_listed", "_document", "_typed", "_occurred_at")
    )


def with_faults(decoded: DataFrame, faults: DataFrame | None) -> DataFrame:
    """Adds ``cause`` of records that cannot be stored whatever the store holds.

    ``faults`` lists records whose write failed: (partition, offset, sqlstate,
    attempts, recovered). An unrecovered failure hides every verdict the insert
    could have given, so it ranks before a malformed id.
    """
    if faults is None:
        marked = decoded.withColumn("fault", F.lit(None).cast(
            "struct<sqlstate:string,attempts:int,recovered:boolean>"))
    else:
        marked = decoded.join(
            faults.select(
                "partition", "offset", F.struct("sqlstate", "attempts", "recovered").alias("fault")
            ),
            ["partition", "offset"],
            "left",
        )
    cause = (
        F.when(~F.col("readable"), UNDECODABLE)
        .when(~F.col("fault.recovered"), SINK_FAULT)
        .when(F.col("event_id").isNull() | F.col("order_id").isNull(), MALFORMED_ID)
    )
    return marked.withColumn("cause", cause)


def first_of_each_order(eligible: DataFrame) -> DataFrame:
    """(order_id, first, rows): the record that takes each order, found by aggregation."""
    return eligible.groupBy("order_id").agg(
        F.min(F.struct("partition", "offset", "event_id")).alias("first"),
        F.count("*").alias("rows"),
    )


def _position(row: str = "") -> Column:
    at = f"{row}." if row else ""
    return F.struct(
        F.col(f"{at}partition").alias("partition"), F.col(f"{at}offset").alias("offset")
    )


def _shared_events(claims: DataFrame) -> DataFrame:
    """Events that several orders claim."""
    orders = claims.groupBy("event_id").agg(
        F.min("order_id").alias("_low"), F.max("order_id").alias("_high")
    )
    return orders.where(F.col("_low") != F.col("_high")).select("event_id")


def _claims_of_tangled_orders(claims: DataFrame, shared: DataFrame) -> DataFrame:
    """Every claim of an order that has a shared event."""
    pairs = claims.select("order_id", "event_id").distinct()
    orders = pairs.join(shared, "event_id", "left_semi").select("order_id").distinct()
    return claims.join(orders, "order_id", "left_semi")


def _settle_tangled(claims: DataFrame) -> DataFrame:
    """Exact verdicts where events are shared between orders, in rounds.

    A record is stored once it is the first open record of its order and the
    first open one of its event among orders not yet taken. Each round settles
    at least the earliest open record, and normally whole chains at once.
    Returns (partition, offset, verdict).
    """
    open_ = (
        claims.select("partition", "offset", "event_id", "order_id")
        .withColumn("taken", F.lit(False))
        .checkpoint()
    )
    spread = ["partition", "offset"]
    settled = None
    while not open_.isEmpty():
        by_order = open_.groupBy("order_id").agg(
            F.min(_position()).alias("order_first"), F.count("*").alias("order_rows")
        )
        by_event = open_.groupBy("event_id").agg(
            F.min(F.when(~F.col("taken"), _position())).alias("event_first"),
            F.count("*").alias("event_rows"),
        )
        judged = lookup(
            lookup(open_, by_order, "order_id", "order_rows", spread),
            by_event, "event_id", "event_rows", spread,
        )
        free = ~F.col("taken")
        judged = judged.withColumn(
            "verdict",
            F.when(
                F.col("taken")
                & (F.col("event_first").isNull() | (_position() < F.col("event_first"))),
                COLLISION,
            ).when(
                free
                & (_position() == F.col("order_first"))
                & (_position() == F.col("event_first")),
                PERSISTED,
            ),
        ).checkpoint()
        won = judged.where(F.col("verdict") == PERSISTED)
        after = lookup(
            judged.drop("order_first", "event_first", "order_rows", "event_rows"),
            won.select("event_id", "event_rows", F.lit(True).alias("event_won")),
            "event_id", "event_rows", spread,
        )
        after = lookup(
            after.drop("event_rows"),
            won.select("order_id", "order_rows", F.lit(True).alias("order_won")),
            "order_id", "order_rows", spread,
        )
        after = (
            after.withColumn(
                "verdict", F.coalesce("verdict", F.when(F.col("event_won"), F.lit(DUPLICATE)))
            )
            .withColumn("taken", F.col("taken") | F.coalesce("order_won", F.lit(False)))
            .select("partition", "offset", "event_id", "order_id", "taken", "verdict")
            .checkpoint()
        )
        done = after.where(F.col("verdict").isNotNull()).select("partition", "offset", "verdict")
        settled = done if settled is None else settled.unionByName(done)
        open_ = after.where(F.col("verdict").isNull()).drop("verdict")
    return settled


def classify(
    records: DataFrame,
    stored: DataFrame | None = None,
    faults: DataFrame | None = None,
    one_order_per_event: bool = False,
    frequent_rows: int | None = None,
) -> DataFrame:
    """Adds outcome, reason, cause, sqlstate and attempts to every record.

    ``stored`` holds (order_id, event_id) of rows already in the store that may
    meet these records. Pass ``one_order_per_event=True`` if the producer
    guarantees it; otherwise one extra aggregation looks for events on several
    orders and settles those exactly.
    """
    return classify_decoded(
        decode_records(records), stored, faults, one_order_per_event, frequent_rows
    )


def classify_decoded(
    decoded: DataFrame,
    stored: DataFrame | None = None,
    faults: DataFrame | None = None,
    one_order_per_event: bool = False,
    frequent_rows: int | None = None,
) -> DataFrame:
    """``classify`` for records that went through ``decode_records``."""
    judged = with_faults(decoded, faults)
    eligible = judged.where(F.col("cause").isNull()).select(
        "partition", "offset", "event_id", "order_id"
    )
    claims = eligible
    if stored is not None:
        # a stored row acts like a record before all others
        before = stored.select(
            F.lit(-1).alias("partition"), F.lit(-1).cast("bigint").alias("offset"), "event_id", "order_id"
        )
        claims = eligible.unionByName(before)

    firsts = first_of_each_order(claims)
    joined = lookup(
        judged, firsts, "order_id", "rows", ["partition", "offset"], frequent_rows=frequent_rows
    )
    verdict = (
        F.when(_position() == _position("first"), PERSISTED)
        .when(F.col("event_id") == F.col("first.event_id"), DUPLICATE)
        .otherwise(COLLISION)
    )
    joined = joined.withColumn("verdict", F.when(F.col("cause").isNull(), verdict)).drop("first", "rows")

    if not one_order_per_event:
        shared = _shared_events(claims)
        if shared.agg(F.count("*")).first()[0] > 0:
            exact = _settle_tangled(_claims_of_tangled_orders(claims, shared))
            joined = (
                joined.join(
                    exact.where(F.col("partition") >= 0).withColumnRenamed("verdict", "_exact"),
                    ["partition", "offset"],
                    "left",
                )
                .withColumn("verdict", F.coalesce("_exact", "verdict"))
                .drop("_exact")
            )
    return _outcome_columns(joined)


def _outcome_columns(judged: DataFrame) -> DataFrame:
    cause = F.coalesce("cause", F.when(F.col("verdict") == COLLISION, F.lit(COLLISION)))
    sqlstate = (
        F.when(cause == SINK_FAULT, F.col("fault.sqlstate"))
        .when(cause == MALFORMED_ID, INVALID_TEXT)
        .when(cause == COLLISION, UNIQUE_VIOLATION)
    )
    return (
        judged.withColumn("cause", cause)
        .withColumn("sqlstate", sqlstate)
        .withColumn(
            "outcome", F.when(F.col("cause").isNotNull(), DEAD_LETTER).otherwise(F.col("verdict"))
        )
        .withColumn(
            "reason",
            F.when(F.col("cause") == UNDECODABLE, POISON).when(
                F.col("cause").isNotNull(), failures.dead_letter_reason(F.col("sqlstate"))
            ),
        )
        .withColumn(
            "attempts",
            F.when(F.col("cause") == UNDECODABLE, 0).otherwise(
                F.coalesce(F.col("fault.attempts"), F.lit(1))
            ),
        )
        .drop("verdict", "fault")
    )


def events_keep_apart(records: DataFrame, faults: DataFrame | None = None) -> bool:
    """Whether no event of the records that can be stored lies on two orders."""
    eligible = with_faults(decode_records(records), faults).where(F.col("cause").isNull())
    return _shared_events(eligible).isEmpty()


def outcome_counts(
    records: DataFrame, faults: DataFrame | None = None, one_order_per_event: bool = False
) -> DataFrame:
    """(status, reason, n) of a log on an empty store.

    Where the producer guarantees one order per event, aggregation alone gives
    them: verdicts are never joined back to the records, each (order, event) pair
    is counted, and the pair that comes first in its order supplies one stored
    row and otherwise duplicates. Without that promise the records are classified.
    """
    if not one_order_per_event:
        classified = classify(records, faults=faults)
        return classified.groupBy(
            F.col("outcome").alias("status"), F.coalesce("reason", F.lit("")).alias("reason")
        ).agg(F.count("*").alias("n"))
    judged = with_faults(decode_records(records), faults)
    reason = F.when(F.col("cause") == UNDECODABLE, POISON).when(
        F.col("cause") == SINK_FAULT, failures.dead_letter_reason(F.col("fault.sqlstate"))
    ).otherwise(F.when(F.col("cause").isNotNull(), POISON))
    pairs = (
        judged.groupBy("order_id", "event_id", reason.alias("reason"))
        .agg(F.min(F.struct("partition", "offset")).alias("at"), F.count("*").alias("n"))
    )
    dead = pairs.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.sum("n").alias("n"))
    orders = (
        pairs.where(F.col("reason").isNull())
        .groupBy("order_id")
        .agg(F.min(F.struct("at", "n")).alias("first"), F.sum("n").alias("all"))
        .agg(
            F.count("*").alias("persisted"),
            F.sum(F.col("first.n") - 1).alias("duplicate"),
            F.sum(F.col("all") - F.col("first.n")).alias("collision"),
        )
    )
    kept = orders.select(
        F.explode(
            F.array(
                F.struct(F.lit(PERSISTED).alias("status"), F.lit("").alias("reason"), F.col("persisted").alias("n")),
                F.struct(F.lit(DUPLICATE).alias("status"), F.lit("").alias("reason"), F.coalesce("duplicate", F.lit(0)).alias("n")),
                F.struct(F.lit(DEAD_LETTER).alias("status"), F.lit(POISON).alias("reason"), F.coalesce("collision", F.lit(0)).alias("n")),
            )
        ).alias("row")
    ).select("row.*")
    return (
        kept.unionByName(dead.select(F.lit(DEAD_LETTER).alias("status"), "reason", "n"))
        .groupBy("status", "reason")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > 0)
    )


def store_rows(classified: DataFrame, processed_at: Column) -> DataFrame:
    """Rows to insert: the persisted records in the shape of the store."""
    return classified.where(F.col("outcome") == PERSISTED).select(
        "order_id",
        "event_id",
        F.col("event.customer_id").alias("customer_id"),
        F.col("event.items").alias("items"),
        F.col("event.total_cents").alias("total_cents"),
        F.col("event.occurred_at").alias("occurred_at"),
        processed_at.alias("processed_at"),
    )


def insert_once(
    records: DataFrame,
    faults: DataFrame | None = None,
    processed_at: Column | None = None,
    one_order_per_event: bool = False,
) -> DataFrame:
    """The store after writing a log to an empty one: each order once, each event once.

    With one order per event, a single aggregation gives it: the first eligible
    record of each order is its row, so no verdict has to be joined back and copies
    are dropped map-side. Where the producer does not guarantee it, one aggregation
    looks, and the records are classified if it finds an event on several orders. ``processed_at`` may refer to ``r.timestamp``,
    the time of the record.
    """
    if not one_order_per_event and not events_keep_apart(records, faults):
        classified = classify(records, faults=faults).withColumn("r", F.struct("timestamp"))
        return store_rows(classified, F.current_timestamp() if processed_at is None else processed_at)
    judged = with_faults(decode_records(records), faults).where(F.col("cause").isNull())
    row = F.struct("partition", "offset", "event_id", "event", "timestamp")
    return (
        judged.groupBy("order_id")
        .agg(F.min_by(row, F.struct("partition", "offset")).alias("r"))
        .select(
            "order_id",
            "r.event_id",
            "r.event.customer_id",
            "r.event.items",
            "r.event.total_cents",
            "r.event.occurred_at",
            (F.current_timestamp() if processed_at is None else processed_at).alias("processed_at"),
        )
    )


def dead_letter_error() -> Column:
    """Text for the dlq_error header of a classified record."""
    return (
        F.when(F.col("cause") == UNDECODABLE, F.lit("value is not a readable event"))
        .when(F.col("cause") == MALFORMED_ID, F.lit("invalid input syntax for type uuid (SQLSTATE 22P02)"))
        .when(F.col("cause") == COLLISION, F.lit("duplicate key value violates unique constraint on order_id (SQLSTATE 23505)"))
        .otherwise(F.concat(F.lit("write failed (SQLSTATE "), F.col("sqlstate"), F.lit(")")))
    )
