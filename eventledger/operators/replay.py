"""Dead letters: writing them, and sending them back under guard."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions import headers as H
from .persist import dead_letter_error, decode_records
from .scale import broadcast_up_to, side_by_side

ALL_REASONS = "all"
REPLAY = "replay"


def dead_letters(classified: DataFrame, failed_at: Column, keep: Iterable[str] = ()) -> DataFrame:
    """Key and value untouched, the diagnosis in the headers."""
    return classified.where(F.col("outcome") == S.DEAD_LETTER).select(
        "key",
        "value",
        failed_at.alias("timestamp"),
        H.dead_letter_headers(
            F.col("headers"),
            F.col("reason"),
            dead_letter_error(),
            F.col("attempts"),
            F.col("topic"),
            F.col("partition"),
            F.col("offset"),
            failed_at,
        ).alias("headers"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        *keep,
    )


def parse_reasons(text: str) -> frozenset[str]:
    """The reasons to replay: a comma-separated list of known names, or ``all``."""
    known = {ALL_REASONS, S.POISON, S.RETRIES_EXHAUSTED}
    names = frozenset(part.strip() for part in text.split(",") if part.strip())
    for name in sorted(names - known):
        raise ValueError(f"unknown reason {name!r}: use one of {sorted(known)}")
    if not names:
        raise ValueError("at least one reason must be named")
    return names


def replay_decisions(
    dlq: DataFrame, reasons: str = S.RETRIES_EXHAUSTED, max_replays: int = S.DEFAULT_MAX_REPLAYS
) -> DataFrame:
    """Adds ``replay_count`` and ``decision``: 'replay', or why the record stays.

    Not written by the dead-letter path, then not wanted, then sent back often
    enough already; the first that applies is the answer.
    """
    if max_replays < 1:
        raise ValueError("max_replays must be at least 1")
    wanted = parse_reasons(reasons)
    reason = H.header(F.col("headers"), S.DLQ_REASON)
    unwanted = F.lit(False) if ALL_REASONS in wanted else ~reason.isin(*sorted(wanted))
    count = H.replay_count(F.col("headers"))
    return dlq.withColumn("replay_count", count).withColumn(
        "decision",
        F.when(reason.isNull(), "no_dlq_reason")
        .when(unwanted, F.concat(F.lit("reason:"), reason))
        .when(count >= max_replays, "replay_limit")
        .otherwise(REPLAY),
    )


def up_to_limit(decided: DataFrame, limit: int) -> DataFrame:
    """Records scanned until ``limit`` of them were replayed, in (partition, offset) order.

    The first ``limit`` replayable positions are a bounded top-n; the last of them
    ends the scan. A limit of 0 means none.
    """
    if limit <= 0:
        return decided
    last = (
        decided.where(F.col("decision") == REPLAY)
        .select("partition", "offset")
        .orderBy("partition", "offset")
        .limit(limit)
        .agg(F.count("*").alias("n"), F.max(F.struct("partition", "offset")).alias("end"))
    )
    # a single value, NULL where the limit is not reached
    end = last.select(F.when(F.col("n") == limit, F.col("end"))).scalar()
    return decided.where(end.isNull() | (F.struct("partition", "offset") <= end))


def replay_records(decided: DataFrame, now: Column) -> DataFrame:
    """The records going back: same key and value, headers saying where they were."""
    return decided.where(F.col("decision") == REPLAY).select(
        "key",
        "value",
        now.alias("timestamp"),
        H.replay_headers(
            F.col("replay_count") + 1, now, F.col("partition"), F.col("offset")
        ).alias("headers"),
        F.col("partition").alias("dlq_partition"),
        F.col("offset").alias("dlq_offset"),
    )


def with_event_id(records: DataFrame) -> DataFrame:
    """Adds ``event_id``: the text in the value, '' if the value cannot be read."""
    decoded = decode_records(records)
    text = F.when(F.col("readable"), F.col("event.event_id")).otherwise("")
    return decoded.withColumn("event_id", text).drop("readable", "order_id", "event")


def not_yet_scanned(dlq: DataFrame, committed: DataFrame | None, partitions: int) -> DataFrame:
    """Dead letters at or after the committed offset of their partition."""
    if committed is None:
        return dlq
    done = committed.select("partition", F.col("next_offset").alias("_next"))
    return (
        dlq.join(broadcast_up_to(done, partitions), "partition", "left")
        .where(F.col("_next").isNull() | (F.col("offset") >= F.col("_next")))
        .drop("_next")
    )


def offsets_after(scanned: DataFrame, group_id: str, topic: str) -> DataFrame:
    """Commit table once everything in ``scanned`` was produced or deliberately left."""
    return scanned.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset")).select(
        F.lit(group_id).alias("group_id"), F.lit(topic).alias("topic"), "partition", "next_offset"
    )


def verify_replayed(ids: DataFrame, store: DataFrame) -> DataFrame:
    """One row: distinct ids checked, found in the store, missing.

    The store is scanned for one column; how the two meet is left to the planner.
    """
    wanted = ids.where(F.col("event_id") != "").select("event_id").distinct()
    found = store.select("event_id").join(wanted, "event_id", "left_semi")
    counted = side_by_side(
        wanted.agg(F.count("*").alias("checked")), found.agg(F.count("*").alias("persisted"))
    )
    return counted.withColumn("missing", F.col("checked") - F.col("persisted"))


def replay_report(scanned: DataFrame) -> DataFrame:
    """One row: scanned, replayed, failed, unreadable, and the skipped ones by reason, sorted."""
    return report_of(with_event_id(scanned))


OTHER_REASONS = "other"
# Why a dead letter can be left where it is; every other reason is counted as one.
LEFT = sorted(["no_dlq_reason", "replay_limit", f"reason:{S.POISON}", f"reason:{S.RETRIES_EXHAUSTED}"])


def report_of(read: DataFrame) -> DataFrame:
    """The report of records that went through ``with_event_id``, by one aggregation.

    ``failed`` is 0 here; a job that could not send records counts them there. A
    reason is a text of the record's headers and not bounded: the known ones are
    named, all others counted as one.
    """
    sent = F.col("decision") == REPLAY
    counts = {name: F.col("decision") == name for name in LEFT}
    counts[OTHER_REASONS] = ~F.col("decision").isin(REPLAY, *LEFT)
    counted = read.agg(
        F.count("*").alias("scanned"),
        F.count_if(sent).alias("replayed"),
        F.count_if(sent & (F.col("event_id") == "")).alias("unreadable"),
        *[F.count_if(kind).alias(f"_{name}") for name, kind in counts.items()],
    )
    entries = [F.struct(F.lit(name).alias("decision"), F.col(f"`_{name}`").alias("n")) for name in sorted(counts)]
    return counted.select(
        "scanned",
        "replayed",
        F.lit(0).cast("bigint").alias("failed"),
        "unreadable",
        F.map_from_entries(F.filter(F.array(*entries), lambda e: e["n"] > 0)).alias("skipped"),
    )
