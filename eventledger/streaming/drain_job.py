"""A bounded run over the log that never passes a record it could not deal with.

Per partition it takes the records behind the committed offset, stores and parks
what it can, and commits up to the first record that was neither stored nor
parked. A partition is held when its dead letters cannot be appended although they
were tried again within the budget; the others move on. A held partition keeps its
offset, so the next run takes it up where it stopped.
"""

from dataclasses import dataclass, field
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..operators import persist, progress, replay
from ..operators.scale import broadcast_up_to
from ..sources.record_log import append_records
from .manifest import Manifest
from .retry import RetryPolicy, SinkError, with_retry
from .store import (
    ORDERS, Appended, as_ends, ends_in, ends_of, add_orders, append_to_log, merge_due, store_tables, stored_with,
    write_orders_table,
)

DEAD = "dead_letters"
DRAINED = "drained"


@dataclass
class DrainJob:
    """``commits`` is the folder of the commits of all tables of the job; they carry the offsets too."""

    spark: SparkSession
    store: str
    dead_letters: str
    commits: str
    partitions: int = 3
    # records a run takes per partition
    most_records: int = 100_000
    policy: RetryPolicy = field(default_factory=RetryPolicy)
    sleep: Callable[[float], None] | None = None

    def committed(self) -> DataFrame:
        """(partition, next_offset) after all runs so far."""
        return as_ends(self.spark, Manifest(self.spark, self.commits).end_of(DRAINED))

    def run(self, log: DataFrame) -> DataFrame:
        """One run over what ``log`` holds now; the frontier of each partition that had records.

        Orders, dead letters and offsets become visible in one commit. A run that
        dies before it has left nothing that a reader sees.
        """
        commits = Manifest(self.spark, self.commits).open(store_tables(self.store) | {DEAD: self.dead_letters})
        done = as_ends(self.spark, commits.end_of(DRAINED)).withColumnRenamed("next_offset", "_next")
        fresh = (
            log.join(broadcast_up_to(done, self.partitions), "partition", "left")
            .withColumn("_next", F.coalesce("_next", F.lit(0)))
            .where((F.col("offset") >= F.col("_next")) & (F.col("offset") < F.col("_next") + self.most_records))
            .drop("_next")
        )
        decoded = persist.decode_records(fresh).persist()
        try:
            stored = stored_with(self.spark, self.store, decoded.select("order_id", "event_id"), commits)
            classified = persist.classify_decoded(decoded, stored).checkpoint()
        finally:
            decoded.unpersist()
        parked, held = self._park(classified, commits)
        stuck = F.col("partition").isin(*sorted(held)) if held else F.lit(False)
        marked = classified.withColumn("ok", ~(stuck & (F.col("outcome") == S.DEAD_LETTER)))
        ahead = progress.before_frontier(marked, self.partitions).checkpoint()
        rows = persist.store_rows(ahead, F.current_timestamp())
        _, error = self._tried(lambda: write_orders_table(rows, commits.attempt(ORDERS)))
        if error is not None:
            raise error
        frontier = progress.commit_frontier(marked).checkpoint()
        # one row per partition
        ends = {r["partition"]: r["next_offset"] for r in frontier.collect()}
        adds = add_orders(rows, ahead.where(F.col("outcome") == S.PERSISTED).count(), commits) | parked.adds
        commits.commit(adds, ends=parked.ends | {DRAINED: ends})
        merge_due(commits)
        return frontier

    def _tried(self, call: Callable[[], None]) -> tuple[int, SinkError | None]:
        return with_retry(call, self.policy, **({"sleep": self.sleep} if self.sleep else {}))

    def _placed(self, classified: DataFrame, end: DataFrame) -> DataFrame:
        return append_records(
            replay.dead_letters(classified, F.current_timestamp()), "source_offset", S.DEAD_LETTER_TOPIC,
            self.partitions, end=end, order=["source_partition"],
        )

    def append(self, letters: DataFrame, path: str) -> None:
        """Writes dead letters; raises where the log does not take them."""
        letters.write.mode("overwrite").parquet(path)

    def _park(self, classified: DataFrame, commits: Manifest) -> tuple[Appended, set[int]]:
        """Appends the dead letters; the partitions whose own could not be.

        All go at once as long as the log takes them. If it refuses, each source
        partition is tried by itself, behind those that went before.
        """
        all_of_them: list[Appended] = []
        _, error = self._tried(
            lambda: all_of_them.append(append_to_log(commits, DEAD, lambda end: self._placed(classified, end), self.append))
        )
        if error is None:
            return all_of_them[-1], set()
        dead = classified.where(F.col("outcome") == S.DEAD_LETTER)
        ends, held = ends_of(commits, DEAD), set()
        before = sum(ends.values())
        commits.files.delete(commits.attempt(DEAD))
        for row in dead.select("partition").distinct().orderBy("partition").collect():
            path = commits.attempt(DEAD, f"/source={row['partition']}")
            own = self._placed(classified.where(F.col("partition") == row["partition"]), as_ends(self.spark, ends))
            _, error = self._tried(lambda: self.append(own, path))
            if error is None:
                ends = ends | ends_in(self.spark.read.schema(S.RECORD).parquet(path))
            else:
                held.add(row["partition"])
                commits.files.delete(path)
        records = sum(ends.values()) - before
        adds = {DEAD: {"from": commits.attempt(DEAD), "records": records}} if records else {}
        return Appended(adds, {DEAD: ends}), held
