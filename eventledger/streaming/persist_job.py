"""The worker as a streaming query: read the log, store once, park what fails.

Offsets are committed by the checkpoint after a micro-batch has been written;
a batch that failed comes again with the same id and the same rows. All that a
batch leaves (orders, dead letters, outcomes) becomes visible in one commit, which
notes the batch as well, so a batch that comes again after its commit is passed
over. Together with the lookup of ids already stored this makes at-least-once
delivery end in each event being stored once.
"""

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import schemas as S
from ..operators import persist, replay
from ..operators.scale import number_in_order
from ..sources.record_log import append_records, log_end
from .manifest import Manifest
from .retry import RetryPolicy, SinkError, with_retry
from .store import (
    ORDERS,
    Appended,
    add,
    add_orders,
    append_to_log,
    commits_of_store,
    end_offsets,
    merge_due,
    store_tables,
    stored_with,
    write_orders_table,
)

OUTCOMES = T.StructType([
    T.StructField("outcome", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("n", T.LongType()),
])

# How long each record's batch took to be stored, as counts per bucket.
PROCESSING = T.StructType([
    T.StructField("le", T.DoubleType()),
    T.StructField("n", T.LongType()),
])


# What a job says about itself: a sample per counter and batch.
SAMPLES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("metric", T.StringType()),
    T.StructField("instance", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
# Names of the metrics.
PROCESSED, DEAD_LETTERED, TOOK, LAG = (
    "orders_processed_total", "dlq_messages_total", "order_processing_duration_seconds_bucket", "consumer_lag",
)
COUNTERS, READ = "counters", "read"


@dataclass
class PersistJob:
    """Where one worker query reads its state from and writes to.

    Samples of its counters are left beside the outcomes, one per batch. They go on
    from the commit before, also after a restart. ``log`` is the folder of the log,
    whose end says how far the job is behind.
    """

    spark: SparkSession
    store: str
    dead_letters: str
    outcomes: str
    dlq_partitions: int = 3
    policy: RetryPolicy = field(default_factory=RetryPolicy)
    # called with the rows of each write before it; may raise SinkError, as a store with constraints does
    before_store_write: Callable[[DataFrame, int], None] = lambda rows, batch_id: None
    # failed writes of single records, as the store reports them
    faults: Callable[[DataFrame, int], DataFrame] | None = None
    sleep: Callable[[float], None] | None = None
    instance: str = "worker-0"
    log: str | None = None

    def __post_init__(self) -> None:
        self._commits: Manifest | None = None
        self._source = ""

    def commits(self) -> Manifest:
        """The commits of the job's tables; the first call takes them over from any other job."""
        if self._commits is None:
            tables = store_tables(self.store) | {
                "dead_letters": self.dead_letters, "outcomes": self.outcomes, "seconds": f"{self.outcomes}-seconds",
                "samples": f"{self.outcomes}-samples",
            }
            self._opened_at = dt.datetime.now(dt.timezone.utc)
            self._commits = commits_of_store(self.spark, self.store).open(tables)
        return self._commits

    def stored_ids(self, decoded: DataFrame) -> DataFrame:
        """Rows of earlier batches that share an order or an event with this one."""
        return stored_with(self.spark, self.store, decoded.select("order_id", "event_id"), self.commits())

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: store, dead letters and outcomes, visible together."""
        commits = self.commits()
        commits.check()
        if commits.is_done(self._source, batch_id):
            return
        began = time.monotonic()
        records = batch.select(*[f.name for f in S.RECORD.fields])
        decoded = persist.decode_records(records).persist()
        try:
            stored = self.stored_ids(decoded).persist()
            faults = self.faults(records, batch_id) if self.faults else None
            classified = persist.classify_decoded(decoded, stored, faults).persist()
            refused = self._store(classified, batch_id)
            if refused is not None:
                # what the store did not take is parked; another record may now be the first of its order
                known = refused if faults is None else refused.unionByName(faults.select(*refused.columns))
                classified.unpersist()
                classified = persist.classify_decoded(decoded, stored, known).persist()
                write_orders_table(self._rows(classified), commits.attempt(ORDERS))
            parked = self._park(classified)
            counts = classified.groupBy("outcome", "reason").agg(F.count("*").alias("n")).coalesce(1).persist()
            # one row per outcome and reason
            told = counts.collect()
            persisted = sum(r["n"] for r in told if r["outcome"] == S.PERSISTED)
            adds = add_orders(self._rows(classified), persisted, commits) | parked.adds
            adds["outcomes"] = add(counts, commits, "outcomes")
            took = self._time(persisted, time.monotonic() - began)
            adds["seconds"] = add(took, commits, "seconds")
            samples, ends = self._samples(told, took, classified)
            adds["samples"] = add(samples, commits, "samples")
            commits.commit(adds, done={self._source: batch_id}, ends=parked.ends | ends)
            for table in (counts, classified, stored):
                table.unpersist()
            merge_due(commits)
        finally:
            decoded.unpersist()

    def _rows(self, classified: DataFrame) -> DataFrame:
        return persist.store_rows(classified, F.current_timestamp())

    def _try(self, classified: DataFrame, batch_id: int) -> tuple[int, SinkError | None]:
        rows = self._rows(classified)

        def attempt() -> None:
            self.before_store_write(rows, batch_id)
            write_orders_table(rows, self.commits().attempt(ORDERS))

        return with_retry(attempt, self.policy, **({"sleep": self.sleep} if self.sleep else {}))

    def _store(self, classified: DataFrame, batch_id: int) -> DataFrame | None:
        """Store the batch; the records that were refused, as faults, or None.

        A failure of the environment that outlasts the budget refuses the whole
        batch. A refusal that the data caused is narrowed down: the batch is
        halved, and each half that is refused again, until single records are
        left, so one bad record does not take the others down. A half that the
        environment fails is refused as a whole, like a batch. Each attempt
        overwrites the one before; the caller writes what is left at last.
        """
        attempts, error = self._try(classified, batch_id)
        if error is None:
            return None
        if error.retryable:
            everything = classified.where(F.col("cause").isNull()).select("partition", "offset")
            return self._refused(everything, error, attempts)
        numbered = number_in_order(
            classified.where(F.col("outcome") == S.PERSISTED).select("partition", "offset"),
            [F.col("partition"), F.col("offset")],
            "_number",
        ).persist()
        # half-open ranges of numbers still to be tried; few, as only refused ones are split
        pending = [(1, numbered.count() + 1, error)]
        bad = None
        while pending:
            low, high, error = pending.pop()
            if high - low <= 1:
                one = self._refused(numbered.where(F.col("_number") == low).select("partition", "offset"), error, attempts)
                bad = one if bad is None else bad.unionByName(one)
                continue
            middle = (low + high) // 2
            for part in ((low, middle), (middle, high)):
                chosen = numbered.where((F.col("_number") >= part[0]) & (F.col("_number") < part[1]))
                half = classified.join(chosen.select("partition", "offset"), ["partition", "offset"], "left_semi")
                tries, refusal = self._try(half, batch_id)
                if refusal is not None and refusal.retryable:
                    whole = self._refused(chosen.select("partition", "offset"), refusal, tries)
                    bad = whole if bad is None else bad.unionByName(whole)
                elif refusal is not None:
                    pending.append((*part, refusal))
        if bad is not None:
            bad = bad.checkpoint()
        numbered.unpersist()
        return self._refused(classified.limit(0).select("partition", "offset"), error, attempts) if bad is None else bad

    def _refused(self, positions: DataFrame, error: SinkError, attempts: int) -> DataFrame:
        return positions.select(
            "partition", "offset", F.lit(error.sqlstate or "08000").alias("sqlstate"),
            F.lit(attempts).alias("attempts"), F.lit(False).alias("recovered"),
        )

    def _park(self, classified: DataFrame) -> Appended:
        # a key stays on its source partition, so this keeps the order of each key
        return append_to_log(
            self.commits(),
            "dead_letters",
            lambda end: append_records(
                replay.dead_letters(classified, F.current_timestamp()), "source_offset", S.DEAD_LETTER_TOPIC,
                self.dlq_partitions, end=end, order=["source_partition"],
            ),
        )

    def _time(self, persisted: int, seconds: float) -> DataFrame:
        """Every record of a batch waited for the whole of it."""
        bounds = [*map(float, S.PROCESSING_BUCKETS), float("inf")]
        return self.spark.createDataFrame([(le, persisted if seconds <= le else 0) for le in bounds], PROCESSING).coalesce(1)

    def _samples(self, told: list, took: DataFrame, classified: DataFrame) -> tuple[DataFrame, dict]:
        """Counters after this batch, and the ends that the commit keeps them in.

        The first batch begins with a sample of 0 each, so that it counts in a rate.
        """
        state, now = self.commits().state()["ends"], dt.datetime.now(dt.timezone.utc)
        before = state.get(COUNTERS, {})
        grown = {f"{PROCESSED}|{o}": 0 for o in (S.PERSISTED, S.DUPLICATE, S.DEAD_LETTER)}
        grown |= {f"{DEAD_LETTERED}|{r}": 0 for r in (S.POISON, S.RETRIES_EXHAUSTED)}
        for row in told:
            grown[f"{PROCESSED}|{row['outcome']}"] += row["n"]
            if row["outcome"] == S.DEAD_LETTER:
                grown[f"{DEAD_LETTERED}|{row['reason']}"] += row["n"]
        for row in took.collect():
            grown[f"{TOOK}|{'+Inf' if row['le'] == float('inf') else row['le']}"] = row["n"]
        total = {name: before.get(name, 0) + n for name, n in grown.items()}
        rows = [(now, *name.split("|"), float(n)) for name, n in total.items()]
        if not before:
            rows += [(self._opened_at, *name.split("|"), 0.0) for name in total]
        ends = {COUNTERS: total}
        if self.log is not None:
            # one row per partition
            seen = {r["partition"]: r["next_offset"] for r in log_end(classified).collect()}
            read = {int(p): n for p, n in state.get(READ, {}).items()} | seen
            at_end = {r["partition"]: r["next_offset"] for r in end_offsets(self.spark, self.log).collect()}
            rows += [(now, LAG, str(p), float(max(0, end - read.get(p, 0)))) for p, end in sorted(at_end.items())]
            ends[READ] = seen
        named = [(ts, metric, self.instance, label, value) for ts, metric, label, value in rows]
        return self.spark.createDataFrame(named, SAMPLES).coalesce(1), ends

    def start(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        """Work off what the log holds now, then stop.

        The batch size is an option of the source: ``maxFilesPerTrigger`` for
        files, ``maxOffsetsPerTrigger`` for Kafka. Batches are told apart by their
        number and the checkpoint.
        """
        self._source = checkpoint
        observed = log.observe("arrivals", F.count("*").alias("records"))
        return (
            observed.writeStream.foreachBatch(self.write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


class LagListener(StreamingQueryListener):
    """Keeps the newest lag and arrival count the query itself reports.

    Lag comes from the source's own metrics, not from what the sink has seen: a
    stalled sink would otherwise report the last healthy value.
    """

    def __init__(self) -> None:
        self.records = 0
        self.lag: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        arrivals = event.progress.observedMetrics.get("arrivals")
        if arrivals is not None:
            self.records += arrivals["records"]
        for source in event.progress.sources:
            if source.metrics:
                self.lag.update(source.metrics)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def deduplicated(events: DataFrame, within: str | None = None) -> DataFrame:
    """Drop repeated event ids inside the stream, as an alternative to the store lookup.

    Without ``within`` every id ever seen is remembered (use the RocksDB state
    store). With it, ids are forgotten after that delay on ``occurred_at``: a
    weaker promise with bounded state.
    """
    if within is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("occurred_at", within).dropDuplicatesWithinWatermark(["event_id"])


def live_rate(stored: DataFrame, length: str = "30 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Rows per second in sliding windows of a stream, final once the watermark passed."""
    seconds = (F.unix_micros("window.end") - F.unix_micros("window.start")) / 1e6
    return (
        stored.withWatermark("processed_at", late)
        .groupBy(F.window("processed_at", length, slide))
        .agg(F.count("*").alias("rows"))
        .select(F.col("window.start").alias("window_start"), "rows", (F.col("rows") / seconds).alias("rate"))
    )
