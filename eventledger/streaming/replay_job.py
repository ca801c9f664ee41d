"""Send dead letters back: a bounded job over what the dead-letter log holds now."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..operators import replay
from ..operators.scale import number_rows, side_by_side
from ..sources.record_log import append_records
from .retry import RetryPolicy, with_retry
from .store import append_to_log, commits_of_log, log_tables


@dataclass
class ReplayJob:
    """Works on a dead-letter log and appends to the log that ingest writes, which it takes over from that job.

    ``commits`` is the commit table, to which a run appends.
    """

    spark: SparkSession
    # fixed value: the group that replay commits its offsets under
    group_id: str = "order-dlq-replay"
    reasons: str = S.RETRIES_EXHAUSTED
    max_replays: int = S.DEFAULT_MAX_REPLAYS
    limit: int = 0
    dlq_partitions: int = 3
    partitions: int = 3
    policy: RetryPolicy = field(default_factory=RetryPolicy)
    sleep: Callable[[float], None] | None = None

    def __post_init__(self) -> None:
        replay.parse_reasons(self.reasons)
        if self.max_replays < 1:
            raise ValueError("max_replays must be at least 1")

    def scanned(self, dlq: DataFrame, commits: DataFrame | None) -> DataFrame:
        """Dead letters of this run with a decision each."""
        committed = None
        if commits is not None:
            committed = (
                commits.where((F.col("group_id") == self.group_id) & (F.col("topic") == S.DEAD_LETTER_TOPIC))
                .groupBy("partition")
                .agg(F.max("next_offset").alias("next_offset"))
            )
        fresh = replay.not_yet_scanned(dlq, committed, self.dlq_partitions)
        return replay.up_to_limit(
            replay.replay_decisions(fresh, self.reasons, self.max_replays), self.limit
        )

    def run(
        self,
        dlq: DataFrame,
        commits: DataFrame | None,
        log_path: str,
        commits_path: str,
        apply: bool = False,
        store: DataFrame | None = None,
    ) -> DataFrame:
        """One-row report. Without ``apply`` nothing is sent and nothing is committed.

        The commit table is written after the records are on the log. If the run
        dies in between, the next one sends them again and the persist job
        recognises them.
        """
        # decided once: the report, what is sent, the commit and the check must agree
        scanned = replay.with_event_id(self.scanned(dlq, commits))
        if apply:
            scanned = scanned.checkpoint()
        back = replay.replay_records(scanned, F.current_timestamp())
        failed: Column = F.lit(0).cast("bigint")
        if apply:
            failed = F.lit(self._send(back, log_path)).cast("bigint")
        report = replay.report_of(scanned).select(
            F.lit(S.DEAD_LETTER_TOPIC).alias("dlq_topic"),
            F.lit(S.SOURCE_TOPIC).alias("source_topic"),
            F.lit(self.reasons).alias("reasons"),
            F.lit(not apply).alias("dry_run"),
            F.lit(self.max_replays).alias("max_replays"),
            "scanned",
            (F.col("replayed") - failed).alias("replayed"),
            failed.alias("failed"),
            "unreadable",
            "skipped",
        )
        if not apply:
            return report
        report = report.checkpoint()
        if report.first()["failed"]:
            return report  # nothing is committed, so the next run sends them again
        replay.offsets_after(scanned, self.group_id, S.DEAD_LETTER_TOPIC).write.mode("append").parquet(
            commits_path
        )
        if store is None:
            return report
        ids = scanned.where(F.col("decision") == replay.REPLAY).select("event_id")
        verified = replay.verify_replayed(ids, store).select(F.struct("*").alias("verify"))
        return side_by_side(report, verified)

    def _send(self, back: DataFrame, log_path: str) -> int:
        """Append the records to the log; the number of those that could not be sent (all or none)."""
        ordered = number_rows(back, "dlq_offset", order=["dlq_partition"], into="position").checkpoint()
        place = lambda end: append_records(ordered, "position", S.SOURCE_TOPIC, self.partitions, end=end)
        pauses = {"sleep": self.sleep} if self.sleep else {}

        def append() -> None:
            commits = commits_of_log(self.spark, log_path).open(log_tables(log_path))
            appended = append_to_log(commits, "log", place)
            commits.commit(appended.adds, ends=appended.ends)

        _, error = with_retry(append, self.policy, **pauses)
        return ordered.count() if error is not None else 0
