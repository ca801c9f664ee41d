"""Failure classes and retry delays."""

from pyspark.sql import Column, functions as F

from ..schemas import BACKOFF_BASE_MS, BACKOFF_MAX_MS, POISON, RETRIES_EXHAUSTED

# SQLSTATE classes by what a retry can change.
RETRYABLE_CLASSES = ["08", "53", "57", "58", "40"]
CALLER_CLASS = "22"

# Kinds of failure that carry no SQLSTATE.
SERVER = "server"
CANCELLED = "cancelled"
INVALID_ARGUMENT = "invalid_argument"
TIMEOUT = "timeout"
TRANSPORT = "transport"


def is_retryable(kind: Column, sqlstate: Column) -> Column:
    """Retry what the environment caused, never what the data caused."""
    by_class = F.substring(sqlstate, 1, 2).isin(RETRYABLE_CLASSES)
    return (
        F.when(kind.isin(CANCELLED, INVALID_ARGUMENT), False)
        .when(kind == SERVER, F.coalesce(by_class, F.lit(False)))
        .otherwise(kind.isNotNull())
    )


def is_caller_error(kind: Column, sqlstate: Column) -> Column:
    by_class = (kind == SERVER) & (F.substring(sqlstate, 1, 2) == CALLER_CLASS)
    return F.coalesce((kind == INVALID_ARGUMENT) | by_class, F.lit(False))


def dead_letter_reason(sqlstate: Column) -> Column:
    return F.when(is_retryable(F.lit(SERVER), sqlstate), RETRIES_EXHAUSTED).otherwise(POISON)


def backoff_ceiling_ms(
    attempt: Column, base_ms: int = BACKOFF_BASE_MS, max_ms: int = BACKOFF_MAX_MS
) -> Column:
    """Longest wait before retry ``attempt`` (counted from 0)."""
    return F.least(F.lit(float(max_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt))


def backoff_delay_ms(attempt: Column, **bounds: int) -> Column:
    """A uniformly random wait up to the ceiling."""
    return F.rand() * backoff_ceiling_ms(attempt, **bounds)
