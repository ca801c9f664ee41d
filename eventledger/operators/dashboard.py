"""The overview: one row of instant values over the pipeline's tables and samples."""

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import DUPLICATE, PERSISTED, PRODUCE_BUCKETS
from . import measure, series
from .scale import side_by_side


def tiles(
    at: Column,
    window_us: int,
    samples: DataFrame,
    requests: DataFrame,
    outcomes: DataFrame,
    rejected: DataFrame,
    dead: DataFrame,
    faults: DataFrame,
    frontier: DataFrame,
) -> DataFrame:
    """Fourteen tiles. A value that no sample supports is NULL, not 0.

    Each part is reduced to one row before the parts are put side by side.
    """
    def total(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.agg(F.sum(column).alias(name))

    status = lambda s: F.sum(F.when(F.col("status") == s, F.col("n")))
    counted = outcomes.agg(status(PERSISTED).alias("persisted"), status(DUPLICATE).alias("duplicate"))
    accepted_now = (F.unix_micros(at) - F.unix_micros("done") >= 0) & (
        F.unix_micros(at) - F.unix_micros("done") < window_us
    )
    seconds = window_us / 1e6
    took = measure.elapsed_us("done", "dispatched") / 1e6
    accepted = requests.agg(
        F.count_if(F.col("status") == measure.ACCEPTED).alias("accepted"),
        (F.count_if((F.col("status") == measure.ACCEPTED) & accepted_now) / seconds).alias("accept_rate"),
    )

    produced = measure.histogram(requests.where(accepted_now), took, PRODUCE_BUCKETS)
    p99_accept = series.histogram_quantile(
        produced.withColumn("one", F.lit(1)).withColumn("value", F.col("bucket_count").cast("double")),
        0.99, ["one"],
    ).agg(F.max("quantile").alias("p99_accept"))

    # one pass over the samples for all counters and histograms
    grown = series.increase_at(samples.where(F.col("metric") != "consumer_lag"), at, window_us)
    grown = grown.where(F.col("increase").isNotNull())
    le = F.when(F.col("label") == "+Inf", float("inf")).otherwise(F.col("label").try_cast("double"))
    quantiles = series.histogram_quantile(
        grown.where(F.col("metric").endswith("_bucket")).withColumn("le", le), 0.99, ["metric"], "increase"
    )
    of_metric = lambda metric, name: F.max(F.when(F.col("metric") == metric, F.col("quantile"))).alias(name)
    processed = grown.where(F.col("metric") == "orders_processed_total")
    lag = series.latest(samples.where(F.col("metric") == "consumer_lag"), at)
    parts = [
        accepted,
        counted,
        rejected.agg(F.count("*").alias("rejected")),
        dead.agg(F.count("*").alias("dlq")),
        faults.agg(F.sum(F.col("attempts") - 1).alias("retries")),
        processed.agg((F.sum("increase") / seconds).alias("throughput")),
        total(lag, "value", "lag"),
        frontier.agg(
            F.count("*").alias("partitions_owned"), F.count_if("blocked").alias("partitions_paused")
        ),
        p99_accept,
        quantiles.agg(
            of_metric("order_processing_duration_seconds_bucket", "p99_persist"),
            of_metric("order_end_to_end_latency_seconds_bucket", "p99_e2e"),
        ),
    ]
    return side_by_side(*parts)
