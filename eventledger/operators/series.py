"""Functions over metric samples: rates, quantiles of histograms, slopes, resampling.

A sample is (ts, metric, instance, label, value); a series is the samples of one
(metric, instance, label). Windows reach back (t - w, t]. Counters restart at 0
when they fall.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scale import bucket_of, with_lookback

SERIES = ["metric", "instance", "label"]
STALENESS_US = 5 * 60 * 1_000_000


def _timed(samples: DataFrame) -> DataFrame:
    return samples.withColumn("_us", F.unix_micros("ts"))


def counter_increase(
    samples: DataFrame, window_us: int, series: Sequence[str] = SERIES, extrapolate: bool = False
) -> DataFrame:
    """Adds ``increase`` over the window ending at each sample; NULL below two samples.

    Sums the steps between neighbouring samples inside the window. With
    ``extrapolate`` the result is scaled to the full window the way Prometheus
    does: out to the window's start if the samples begin near it, otherwise by
    half an average gap, and never to before the counter was 0.
    """
    cut, keys = with_lookback(_timed(samples), series, "_us", window_us)
    order = Window.partitionBy(*keys).orderBy("_us")
    frame = order.rangeBetween(-(window_us - 1), 0)
    previous = F.lag("value").over(order)
    step = F.when(F.col("value") < previous, F.col("value")).otherwise(F.col("value") - previous)
    stepped = cut.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    # the first step of the frame starts outside the window
    summed = (
        stepped.withColumn("_n", F.count("*").over(frame))
        .withColumn("_gain", F.sum("_step").over(frame) - F.first("_step").over(frame))
        .withColumn("_first_us", F.first("_us").over(frame))
        .withColumn("_first_value", F.first("value").over(frame))
        .where(~F.col("_earlier"))
    )
    gain = F.col("_gain")
    if extrapolate:
        covered = F.col("_us") - F.col("_first_us")
        gap = covered / (F.col("_n") - 1)
        to_start = F.col("_first_us") - (F.col("_us") - F.lit(window_us))
        to_start = F.when(to_start >= gap * 1.1, gap / 2).otherwise(to_start)
        to_zero = F.when((gain > 0) & (F.col("_first_value") >= 0), covered * F.col("_first_value") / gain)
        # least() passes over NULL
        gain = gain * ((covered + F.least(to_start, to_zero)) / covered)
    return summed.withColumn("increase", F.when(F.col("_n") >= 2, gain)).select(
        *samples.columns, "increase"
    )


def increase_at(
    samples: DataFrame, at: Column, window_us: int, series: Sequence[str] = SERIES
) -> DataFrame:
    """(series, increase) over (at - w, at], whenever the last sample was; NULL below two samples."""
    age = F.unix_micros(at) - F.unix_micros("ts")
    recent = samples.where((age >= 0) & (age < window_us))
    previous = F.lag("value").over(Window.partitionBy(*series).orderBy("ts"))
    step = F.when(F.col("value") < previous, F.col("value")).otherwise(F.col("value") - previous)
    return recent.withColumn("_step", step).groupBy(*series).agg(F.sum("_step").alias("increase"))


def counter_rate(
    samples: DataFrame, window_us: int, series: Sequence[str] = SERIES, extrapolate: bool = False
) -> DataFrame:
    """Adds ``rate``: increase per second of the window."""
    grown = counter_increase(samples, window_us, series, extrapolate)
    return grown.withColumn("rate", F.col("increase") / F.lit(window_us / 1e6)).drop("increase")


def rate_at_ticks(
    samples: DataFrame,
    start: Column,
    end: Column,
    step_us: int,
    window_us: int,
    series: Sequence[str] = SERIES,
    extrapolate: bool = False,
) -> DataFrame:
    """(series, tick, increase, rate) at each tick of [start, end]: a rate drawn over time.

    Ticks need not be samples. A step between two neighbouring samples counts for
    the ticks whose window (t - w, t] holds both of them: it is repeated for those,
    at most w/step + 1, and an aggregation by tick adds them up; nothing is joined.
    A tick with fewer than two samples in its window has no row. ``extrapolate`` is
    as in ``counter_increase``, with the gap behind the last sample treated alike.
    """
    cut, keys = with_lookback(_timed(samples), series, "_us", window_us)
    order = Window.partitionBy(*keys).orderBy("_us")
    stepped = (
        cut.withColumn("_from", F.lag("_us").over(order))
        .withColumn("_value", F.lag("value").over(order))
        .where(~F.col("_earlier") & (F.col("_us") - F.col("_from") < window_us))
        .withColumn("_gain", F.when(F.col("value") < F.col("_value"), F.col("value")).otherwise(F.col("value") - F.col("_value")))
    )
    first, last, step = F.unix_micros(start), F.unix_micros(end), F.lit(step_us)
    low = F.greatest(F.lit(0), F.call_function("div", F.col("_us") - first + step - 1, step))
    until = F.least(last, F.col("_from") + F.lit(window_us - 1)) - first
    high = F.when(until >= 0, F.call_function("div", until, step)).otherwise(-1)
    at_ticks = (
        stepped.withColumn("_low", low)
        .withColumn("_high", high)
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("_tick", F.explode(F.sequence("_low", "_high")))
        .groupBy(*series, "_tick")
        .agg(
            F.sum("_gain").alias("increase"),
            F.count("*").alias("_gaps"),
            F.min("_from").alias("_first"),
            F.max("_us").alias("_last"),
            F.min_by("_value", "_from").alias("_first_value"),
        )
        .withColumn("_at", first + F.col("_tick") * step)
    )
    gain = F.col("increase")
    if extrapolate:
        covered = F.col("_last") - F.col("_first")
        gap = covered / F.col("_gaps")
        reach = lambda far: F.when(far >= gap * 1.1, gap / 2).otherwise(far)
        to_zero = F.when((gain > 0) & (F.col("_first_value") >= 0), covered * F.col("_first_value") / gain)
        # least() passes over NULL
        to_start = F.least(reach(F.col("_first") - (F.col("_at") - F.lit(window_us))), to_zero)
        gain = gain * ((covered + to_start + reach(F.col("_at") - F.col("_last"))) / covered)
    return at_ticks.withColumn("increase", gain).select(
        *series, F.timestamp_micros("_at").alias("tick"), "increase", (F.col("increase") / F.lit(window_us / 1e6)).alias("rate")
    )


def aligned(
    samples: DataFrame, step_us: int, series: Sequence[str] = SERIES, staleness_us: int = STALENESS_US
) -> DataFrame:
    """(series, tick, value): each series at the whole multiples of the step.

    A sample holds from its time until the next one of its series, and no longer than
    the staleness; of samples at one time the greatest holds. Series whose samples
    lie at different times can be added up afterwards.
    """
    # time runs backwards, so that looking back finds the sample that comes next
    turned = F.lit(1 << 61) - F.unix_micros("ts")
    cut, keys = with_lookback(samples.withColumn("_turned", turned), series, "_turned", staleness_us)
    order = Window.partitionBy(*keys).orderBy("_turned", F.desc("value"))
    us = F.lit(1 << 61) - F.col("_turned")
    following = F.lit(1 << 61) - F.lag("_turned").over(order)
    until = F.least(following, us + F.lit(staleness_us))
    held = cut.withColumn("_until", until).where(~F.col("_earlier"))

    def tick_from(at: Column) -> Column:
        """Number of the first tick at or after a time."""
        return F.call_function("div", at - F.pmod(at, F.lit(step_us)), F.lit(step_us)) + (F.pmod(at, F.lit(step_us)) > 0).cast("bigint")

    return (
        held.withColumn("_low", tick_from(us))
        .withColumn("_high", tick_from(F.col("_until")) - 1)
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("_tick", F.explode(F.sequence("_low", "_high")))
        .select(*series, F.timestamp_micros(F.col("_tick") * step_us).alias("tick"), "value")
    )


def sum_at_ticks(
    samples: DataFrame, step_us: int, by: Sequence[str] = (), series: Sequence[str] = SERIES, staleness_us: int = STALENESS_US
) -> DataFrame:
    """(by, tick, value): sum over series that are sampled at times of their own."""
    return aligned(samples, step_us, series, staleness_us).groupBy(*by, "tick").agg(F.sum("value").alias("value"))


def peak_of_sum(
    samples: DataFrame, runs: DataFrame, run: Sequence[str], step_us: int, slot_us: int = 3_600_000_000
) -> DataFrame:
    """Largest sum over all series at any tick of each run's span: the maximum over time of a sum.

    ``runs`` as for ``peak_over_run``, with which it agrees where all series are
    sampled at the same ticks.
    """
    sums = sum_at_ticks(samples, step_us).select(F.col("tick").alias("ts"), "value")
    return peak_over_run(sums, runs, run, slot_us)


def sum_by(samples: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Sum over instances (and whatever else ``by`` leaves out) at each time."""
    return samples.groupBy(*by).agg(F.sum(value).alias(value))


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str], value: str = "value") -> DataFrame:
    """Quantile of cumulative buckets (``le`` as double, last one infinite) per group.

    Linear inside a bucket, 0 below the first; the infinite bucket answers with
    its lower bound. NULL where nothing was observed. A group has as many rows
    as the histogram has bounds.
    """
    merged = sum_by(buckets, value, [*by, "le"])
    order = Window.partitionBy(*by).orderBy("le")
    ranked = merged.select(
        *by,
        "le",
        F.col(value).alias("_upto"),
        F.coalesce(F.lag("le").over(order), F.lit(0.0)).alias("_lower"),
        F.coalesce(F.lag(value).over(order), F.lit(0.0)).alias("_below"),
        F.max(value).over(Window.partitionBy(*by)).alias("_total"),
    )
    target = F.lit(float(q)) * F.col("_total")
    share = (target - F.col("_below")) / (F.col("_upto") - F.col("_below"))
    inside = F.when(
        F.col("le") == float("inf"), F.col("_lower")
    ).otherwise(F.col("_lower") + (F.col("le") - F.col("_lower")) * share)
    holds = (F.col("_total") > 0) & (F.col("_upto") >= target) & (F.col("_upto") > F.col("_below"))
    return ranked.groupBy(*by).agg(
        F.min_by(F.when(holds, inside), F.when(holds, F.col("le"))).alias("quantile")
    )


def slope(samples: DataFrame, window_us: int, series: Sequence[str] = SERIES) -> DataFrame:
    """Adds ``slope`` per second: least squares over the window; NULL below two samples."""
    cut, keys = with_lookback(_timed(samples), series, "_us", window_us)
    frame = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-(window_us - 1), 0)
    # seconds from the slot's start keep the products small
    base = F.col("_slot") * F.lit(window_us)
    seconds = (F.col("_us") - base) / 1e6
    fitted = cut.withColumn("_x", seconds).withColumn(
        "slope", F.when(F.count("*").over(frame) >= 2, F.expr("regr_slope(value, _x)").over(frame))
    )
    return fitted.where(~F.col("_earlier")).select(*samples.columns, "slope")


def peak_over_run(
    samples: DataFrame, runs: DataFrame, run: Sequence[str], step_us: int = 3_600_000_000
) -> DataFrame:
    """Largest sum over all series at one time, within each run's own span.

    ``runs``: run columns, run_start, run_end. Runs are expanded to the steps
    they share with the samples, so the two sides meet on equality and a run
    with a time far off makes no more rows than there are samples' steps.
    """

    def step_of(time: str) -> Column:
        return bucket_of(F.unix_micros(time), step_us)

    ticks = samples.groupBy("ts").agg(F.sum("value").alias("_total")).withColumn("_step", step_of("ts"))
    # one row
    span = ticks.agg(F.min("_step").alias("_low"), F.max("_step").alias("_high"))
    first, last = F.greatest(step_of("run_start"), F.col("_low")), F.least(step_of("run_end"), F.col("_high"))
    covered = (
        runs.join(F.broadcast(span))
        .where(first <= last)
        .withColumn("_step", F.explode(F.sequence(first, last)))
        .drop("_low", "_high")
    )
    return (
        covered.join(ticks, "_step")
        .where((F.col("ts") >= F.col("run_start")) & (F.col("ts") <= F.col("run_end")))
        .groupBy(*run)
        .agg(F.max("_total").alias("peak_lag"))
    )


def resample(
    samples: DataFrame, start: Column, end: Column, step_us: int, series: Sequence[str] = SERIES
) -> DataFrame:
    """Last value at each tick of [start, end], nothing where it is stale.

    A sample counts for the ticks in the five minutes from its time on: it is
    repeated for those, at most staleness/step + 1 of them, and the latest
    sample per tick is kept by an aggregation.
    """
    first, last = F.unix_micros(start), F.unix_micros(end)
    step = F.lit(step_us)
    at = F.unix_micros("ts")
    # tick numbers: first at or after the sample .. last before it goes stale
    low = F.greatest(F.lit(0), F.call_function("div", at - first + step - 1, step))
    high = F.call_function(
        "div", F.least(last, at + F.lit(STALENESS_US - 1)) - first, step
    )
    usable = samples.where((at <= last) & (at > first - F.lit(STALENESS_US)))
    return (
        usable.withColumn("_low", low)
        .withColumn("_high", high)
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("_tick", F.explode(F.sequence("_low", "_high")))
        .groupBy(*series, "_tick")
        .agg(F.max_by("value", "ts").alias("value"))
        .select(*series, F.timestamp_micros(first + F.col("_tick") * step).alias("tick"), "value")
    )


def latest(samples: DataFrame, at: Column, series: Sequence[str] = SERIES) -> DataFrame:
    """The instant value of each series: its last sample not older than five minutes."""
    age = F.unix_micros(at) - F.unix_micros("ts")
    return (
        samples.where((age >= 0) & (age < STALENESS_US))
        .groupBy(*series)
        .agg(F.max_by("value", "ts").alias("value"))
    )
