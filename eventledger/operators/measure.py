"""Measurements over the tables the pipeline leaves behind."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import DEAD_LETTER, DUPLICATE, PERSISTED
from .scale import CONTINUOUS, DISCRETE, exact_quantiles

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
# Values that a stored sketch keeps of a level, and how far off the rank of a quantile may be then.
SKETCH_SIZE, RANK_ERROR = 800, 0.01
SERVICE_UNAVAILABLE = 503
ACCEPTED = 202


def elapsed_us(later: str, earlier: str) -> Column:
    return F.unix_micros(F.col(later)) - F.unix_micros(F.col(earlier))


def latency_stats(
    df: DataFrame, elapsed: Column, by: Sequence[str] = (), method: str = CONTINUOUS
) -> DataFrame:
    """count, p50, p95, p99 and max in seconds of an elapsed time in microseconds.

    Exact for groups of any size. Without ``by`` an empty input gives zeros.
    """
    stats = exact_quantiles(df.withColumn("_us", elapsed), "_us", QUANTILES, by, method)
    seconds = [
        (F.coalesce(F.col(c), F.lit(0)).cast("double") / 1e6).alias(f"{c}_seconds")
        for c in [*QUANTILES, "max"]
    ]
    return stats.select(*by, F.col("n").alias("count"), *seconds)


def approximate_latency(df: DataFrame, elapsed: Column, by: Sequence[str] = ()) -> DataFrame:
    """The same from a bounded sketch, for a quick look where exactness is not needed."""
    us = df.withColumn("_us", elapsed)
    sketched = F.percentile_approx("_us", list(QUANTILES.values()), 10_000)
    stats = us.groupBy(*by).agg(F.count("_us").alias("count"), sketched.alias("_q"), F.max("_us").alias("_max"))
    return stats.select(
        *by,
        "count",
        *[(F.col("_q")[i] / 1e6).alias(f"{name}_seconds") for i, name in enumerate(QUANTILES)],
        (F.col("_max") / 1e6).alias("max_seconds"),
    )


def latency_slices(
    df: DataFrame, elapsed: Column, at: str, slice_us: int, by: Sequence[str] = (), size: int = SKETCH_SIZE
) -> DataFrame:
    """One sketch of an elapsed time per slice of time and group, to be stored and merged.

    Columns: slice_us (the slice's start), ``by``, count, max_us, sketch (KLL, binary,
    about ``size`` values however many rows there are). Rows without a time are left out.
    Partial sketches are built before the shuffle, so a hot group costs one sketch a task.
    """
    start = (F.floor(F.unix_micros(F.col(at)) / slice_us) * slice_us).cast("bigint")
    timed = df.withColumn("_us", elapsed.cast("bigint")).withColumn("slice_us", start)
    return (
        timed.where(F.col("_us").isNotNull() & F.col("slice_us").isNotNull())
        .groupBy("slice_us", *by)
        .agg(
            F.count("*").alias("count"),
            F.max("_us").alias("max_us"),
            F.kll_sketch_agg_bigint("_us", size).alias("sketch"),
        )
    )


def merged_latency(slices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The statistics of ``latency_stats`` for any range of slices, read from their sketches.

    ``slices``: rows of ``latency_slices``, of any runs that share the size; filter them
    by slice_us for a range. count and max are exact, a quantile's rank is off by
    the sketch's error (RANK_ERROR at the default size). No slices, no rows.
    """
    merged = slices.groupBy(*by).agg(
        F.count("*").alias("slices"),
        F.sum("count").alias("count"),
        F.max("max_us").alias("_max"),
        F.kll_merge_agg_bigint("sketch").alias("_sketch"),
    ).where(F.col("count") > 0)
    return merged.select(
        *by,
        "slices",
        "count",
        *[
            (F.kll_sketch_get_quantile_bigint("_sketch", F.lit(q)) / 1e6).alias(f"{name}_seconds")
            for name, q in QUANTILES.items()
        ],
        (F.col("_max") / 1e6).alias("max_seconds"),
    )


def throughput(store: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per second between the first and the last of them, from the rows themselves."""
    span = elapsed_us("_last", "_first") / 1e6
    return (
        store.groupBy(*by)
        .agg(
            F.count("*").alias("persisted"),
            F.min("processed_at").alias("_first"),
            F.max("processed_at").alias("_last"),
        )
        .withColumn("throughput", F.col("persisted") / F.greatest(span, F.lit(0.001)))
        .drop("_first", "_last")
    )


def due_latency(requests: DataFrame) -> DataFrame:
    """Latency from the due time, and whether the sender itself was late.

    ``requests``: due, dispatched, done (NULL without an answer), interval_us.
    """
    return requests.withColumn("latency_us", elapsed_us("done", "due")).withColumn(
        "behind", elapsed_us("dispatched", "due") > F.col("interval_us")
    )


def run_report(requests: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Client-side report per run: counts, achieved rate, accept latency, status codes."""
    timed = due_latency(requests)
    answered = F.col("status").isNotNull()
    wall = (F.max(F.unix_micros("done")) - F.min(F.unix_micros("due"))) / 1e6
    counts = timed.groupBy(*by).agg(
        F.count("*").alias("sent"),
        F.count_if(F.col("status") == ACCEPTED).alias("accepted"),
        F.count_if(~answered).alias("failed"),
        F.count_if("behind").alias("scheduler_behind"),
        wall.alias("wall_clock_seconds"),
    )
    # codes: one entry per status code of a run
    codes = (
        timed.where(answered)
        .groupBy(*by, "status")
        .agg(F.count("*").alias("n"))
        .groupBy(*by)
        .agg(
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct(F.col("status").cast("string").alias("code"), "n")))
            ).alias("status_codes")
        )
    )
    latency = latency_stats(timed.where(answered), F.col("latency_us"), by, DISCRETE)
    latency = latency.withColumnsRenamed(
        {c: f"accept_{c}" for c in latency.columns if c not in by}
    )
    return (
        counts.join(codes, list(by), "left")
        .join(latency, list(by), "left")
        .withColumn("achieved_rate", F.col("accepted") / F.col("wall_clock_seconds"))
    )


def reconcile(accepted: DataFrame, store: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: is every accepted event either stored or parked?

    The three sides (each with event_id, order_id) meet in one aggregation by
    event, reduced before the shuffle; nothing is joined.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        flags = [F.lit(1 if name == n else 0).alias(n) for n in ("a", "s", "d")]
        return df.select("event_id", "order_id", *flags)

    per_event = (
        side(accepted, "a")
        .unionByName(side(store, "s"))
        .unionByName(side(dead, "d"))
        .groupBy("event_id", "order_id")
        .agg(*[F.max(n).alias(n) for n in ("a", "s", "d")], F.sum("s").alias("stored_rows"))
    )
    kept = F.greatest("s", "d")
    return per_event.agg(
        F.sum("a").alias("accepted_events"),
        F.sum("stored_rows").alias("stored_rows"),
        F.sum("s").alias("stored_events"),
        F.sum(F.col("a") * F.col("d") * (1 - F.col("s"))).alias("parked_events"),
        F.sum(F.col("a") * (1 - kept)).alias("missing"),
        F.sum((1 - F.col("a")) * kept).alias("unexpected"),
    )


def counts_by(df: DataFrame, *labels: Column) -> DataFrame:
    """A labelled counter: events per combination of labels."""
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(
    df: DataFrame, seconds: Column, bounds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Cumulative bucket counts (``le``, ``bucket_count``) with a last bucket for everything.

    One pass: a conditional count per bound, turned into rows afterwards.
    """
    timed = df.withColumn("_s", seconds)
    names = [(f"_b{i}", bound) for i, bound in enumerate(bounds)]
    wide = timed.groupBy(*by).agg(
        *[F.count_if(F.col("_s") <= F.lit(float(bound))).alias(name) for name, bound in names],
        F.count("_s").alias("_all"),
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(n).alias("bucket_count")) for n, b in names]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("bucket_count")))
    return wide.select(*by, F.explode(F.array(*rows)).alias("_row")).select(*by, "_row.*")


def outcome_counters(classified: DataFrame) -> DataFrame:
    """One row of counters over a classified log."""
    return classified.agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in (PERSISTED, DUPLICATE, DEAD_LETTER)],
        F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).alias("retries"),
    )


def scaling_matrix(store: DataFrame, peak_lag: DataFrame, by: Sequence[str]) -> DataFrame:
    """Throughput, latency in ms and peak backlog per configuration.

    Every input has one row per configuration by the time they are joined.
    """
    stats = latency_stats(store, elapsed_us("processed_at", "occurred_at"), by)
    ms = [
        (F.col(f"{c}_seconds") * 1000).alias(f"{c}_ms") for c in [*QUANTILES, "max"]
    ]
    return (
        throughput(store, by)
        .join(stats, list(by))
        .join(peak_lag, list(by), "left")
        .select(*by, "throughput", *ms, "peak_lag", "persisted")
    )


def ramp_table(requests: DataFrame, store: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Client and pipeline side by side; refusals are kept apart from transport failures."""
    report = run_report(requests, by)
    e2e = latency_stats(store, elapsed_us("processed_at", "occurred_at"), by)
    refused = F.coalesce(F.col("status_codes")[str(SERVICE_UNAVAILABLE)], F.lit(0).cast("bigint"))
    return report.join(
        e2e.select(*by, F.col("count").alias("persisted"), F.col("p99_seconds").alias("e2e_p99")),
        list(by),
        "left",
    ).select(
        *by,
        F.col("achieved_rate").alias("achieved"),
        "accepted",
        refused.alias("rejected_503"),
        "failed",
        F.col("scheduler_behind").alias("sched_behind"),
        (F.col("accept_p99_seconds") * 1000).alias("accept_p99_ms"),
        (F.coalesce("e2e_p99", F.lit(0.0)) * 1000).alias("e2e_p99_ms"),
        F.coalesce("persisted", F.lit(0).cast("bigint")).alias("persisted"),
        (F.col("accepted") - F.coalesce("persisted", F.lit(0))).alias("missing"),
    )


def batch_speedup(store: DataFrame, batch_size: str) -> DataFrame:
    """Throughput per batch size and its ratio to the smallest size (one row per size)."""
    sizes = throughput(store, [batch_size])
    smallest = Window.partitionBy(F.lit(0)).orderBy(batch_size)
    return sizes.withColumn("speedup", F.col("throughput") / F.first("throughput").over(smallest))


def tumbling_rate(df: DataFrame, time: str, every: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per second in fixed windows."""
    return _windowed_rate(df, F.window(time, every), by)


def sliding_rate(df: DataFrame, time: str, length: str, slide: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per second in overlapping windows.

    Rows are first counted per slide, so only counts are multiplied by the overlap.
    """
    per_slide = (
        df.groupBy(F.window(time, slide).alias("_s"), *by)
        .agg(F.count("*").alias("_n"))
        .withColumn("_at", F.col("_s.start"))
    )
    return _windowed_rate(per_slide, F.window("_at", length, slide), by, F.sum("_n"))


def _windowed_rate(df: DataFrame, window: Column, by: Sequence[str], rows: Column | None = None) -> DataFrame:
    span = elapsed_us("window.end", "window.start") / 1e6
    return (
        df.groupBy(window.alias("window"), *by)
        .agg((F.count("*") if rows is None else rows).alias("rows"))
        .select(
            F.col("window.start").alias("window_start"), *by, "rows", (F.col("rows") / span).alias("rate")
        )
    )
