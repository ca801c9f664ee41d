"""Record headers: lookup, dead-letter diagnosis, replay provenance."""

from pyspark.sql import Column, functions as F

from .. import schemas as S
from ..schemas import HEADERS
from .events import rfc3339


def _entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.encode(value.cast("string"), "UTF-8").alias("value"))


def _header_list(*entries: Column) -> Column:
    return F.array(*entries).cast(HEADERS)


def header(headers: Column, key: str) -> Column:
    """Text of the first header with this key, NULL if there is none."""
    found = F.filter(headers, lambda h: h["key"] == key)
    return F.get(found, F.lit(0))["value"].cast("string")


def replay_count(headers: Column) -> Column:
    """How often a record was sent back; anything unreadable or negative reads as 0."""
    text = header(headers, S.REPLAY_COUNT)
    number = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))
    return F.greatest(F.coalesce(number, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def dead_letter_headers(
    headers: Column,
    reason: Column,
    error: Column,
    attempts: Column,
    topic: Column,
    partition: Column,
    offset: Column,
    failed_at: Column,
) -> Column:
    """Replay headers carried forward, everything else replaced by a fresh diagnosis."""
    kept = F.filter(headers, lambda h: h["key"].isin(S.REPLAY_HEADERS))
    fresh = _header_list(
        _entry(S.DLQ_REASON, reason),
        _entry(S.DLQ_ERROR, error),
        _entry(S.DLQ_ATTEMPTS, attempts),
        _entry(S.DLQ_SOURCE_TOPIC, topic),
        _entry(S.DLQ_SOURCE_PARTITION, partition),
        _entry(S.DLQ_SOURCE_OFFSET, offset),
        _entry(S.DLQ_FAILED_AT, rfc3339(failed_at)),
    )
    return F.concat(F.coalesce(kept, F.array().cast(HEADERS)), fresh)


def replay_headers(count: Column, at: Column, dlq_partition: Column, dlq_offset: Column) -> Column:
    """Provenance of a record going back to the source log; the diagnosis stays behind."""
    return _header_list(
        _entry(S.REPLAY_COUNT, count),
        _entry(S.REPLAY_AT, rfc3339(at)),
        _entry(S.REPLAY_OF_PARTITION, dlq_partition),
        _entry(S.REPLAY_OF_OFFSET, dlq_offset),
    )
