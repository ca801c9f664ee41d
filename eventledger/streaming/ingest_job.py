"""The front door as a streaming query: bodies in, events on the log, refusals counted.

The records of a batch and the count of its refusals become visible in one commit.
Of two jobs on one log the one that opened it first is refused, so no offset is
given twice.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators import ingest
from ..sources.record_log import append_records
from .manifest import Manifest
from .store import add, append_to_log, commits_of_log, log_tables

REJECTIONS = T.StructType([
    T.StructField("reason", T.StringType()),
    T.StructField("n", T.LongType()),
])


@dataclass
class IngestJob:
    """``bodies`` has position (unique whole number), body, idempotency_key, occurred_at."""

    spark: SparkSession
    log: str
    rejections: str
    partitions: int = 3

    def __post_init__(self) -> None:
        self._commits: Manifest | None = None
        self._source = ""

    def commits(self) -> Manifest:
        """The commits of the log; the first call takes it over from any other job."""
        if self._commits is None:
            self._commits = commits_of_log(self.spark, self.log).open(log_tables(self.log, rejections=self.rejections))
        return self._commits

    def write(self, batch: DataFrame, batch_id: int) -> None:
        commits = self.commits()
        commits.check()
        if commits.is_done(self._source, batch_id):
            return
        decoded = ingest.decode_requests(batch).persist()
        try:
            accepted = decoded.where(F.col("reject_reason").isNull())
            events = ingest.new_events(accepted, keep=["position"])
            # random ids decide the partition: fix them before offsets are counted
            records = ingest.event_records(events, keep=["position"]).checkpoint()
            appended = append_to_log(
                commits,
                "log",
                lambda end: append_records(records, "position", S.SOURCE_TOPIC, self.partitions, end=end),
            )
            refused = decoded.where(F.col("reject_reason").isNotNull())
            counts = refused.groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))
            adds = appended.adds | {"rejections": add(counts.coalesce(1), commits, "rejections")}
            commits.commit(adds, done={self._source: batch_id}, ends=appended.ends)
        finally:
            decoded.unpersist()

    def start(self, bodies: DataFrame, checkpoint: str) -> StreamingQuery:
        self._source = checkpoint
        return (
            bodies.writeStream.foreachBatch(self.write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
