"""Bounded retry of a sink call on the driver."""

import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException

from ..functions.failures import RETRYABLE_CLASSES
from ..schemas import BACKOFF_BASE_MS, BACKOFF_BUDGET_MS, BACKOFF_MAX_MS


class SinkError(Exception):
    """A store refused a write; ``sqlstate`` says why ('' where it could not be reached)."""

    def __init__(self, sqlstate: str, message: str = ""):
        super().__init__(message or f"write failed (SQLSTATE {sqlstate})")
        self.sqlstate = sqlstate

    @property
    def retryable(self) -> bool:
        return self.sqlstate == "" or self.sqlstate[:2] in RETRYABLE_CLASSES


# SQLSTATE classes of refusals that the data causes.
DATA_CLASSES = ["22", "23"]


def sink_error(error: BaseException) -> SinkError | None:
    """What a failed write means, or None if it is a fault of the program.

    An error that names a SQLSTATE of the environment or of the data is taken by
    it. An input or output error or a time-out below it is one of the environment.
    """
    if isinstance(error, SinkError):
        return error
    if isinstance(error, (OSError, TimeoutError)):
        return SinkError("", str(error))
    state = error.getSqlState() if isinstance(error, PySparkException) else None
    if state and state[:2] in [*RETRYABLE_CLASSES, *DATA_CLASSES]:
        return SinkError(state, str(error))
    names = re.findall(r"\b((?:[a-z]\w*\.)+[A-Z]\w*(?:Exception|Error))\b", str(error))
    cause = getattr(error, "java_exception", None)
    while cause is not None:
        names.append(cause.getClass().getName())
        cause = cause.getCause()
    if any(re.fullmatch(r"java\.(io|net|nio)\..*|java\.util\.concurrent\.TimeoutException|org\.apache\.hadoop\.(fs|ipc|net)\..*", n) for n in names):
        return SinkError("", str(error))
    return None


@dataclass(frozen=True)
class RetryPolicy:
    base_ms: int = BACKOFF_BASE_MS
    max_ms: int = BACKOFF_MAX_MS
    budget_ms: int = BACKOFF_BUDGET_MS

    def ceiling_ms(self, attempt: int) -> float:
        return min(float(self.max_ms), self.base_ms * 2.0 ** min(attempt, 62))


def with_retry(
    call: Callable[[], None],
    policy: RetryPolicy = RetryPolicy(),
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic,
) -> tuple[int, SinkError | None]:
    """(attempts, error): tries until it works, cannot work, or the budget is spent.

    Errors that say nothing about the sink are raised.
    """
    deadline = clock() + policy.budget_ms / 1000
    attempts = 0
    while True:
        try:
            attempts += 1
            call()
            return attempts, None
        except Exception as raised:
            error = sink_error(raised)
            if error is None:
                raise
            delay = random.uniform(0, policy.ceiling_ms(attempts - 1)) / 1000
            if not error.retryable or clock() + delay > deadline:
                return attempts, error
            sleep(delay)
