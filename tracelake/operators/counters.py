"""Rates from counters that are sampled at any time.

A counter (spans sent, send errors) only grows, and is known at irregular moments. Its rate over windows of a
fixed length needs its value at every window's end: the last sample before it, however long ago that was. So

1. samples are reduced to the last value of each window (a hash aggregation; many samples make one row),
2. a calendar of all windows between the first and the last sample is generated, also those without a sample,
3. values are carried forward over the calendar by the ordered scan over ranges (``plans.scan``): as a counter
   only grows, its last value is the largest before. No task sees the whole calendar.

The difference of two window ends by the time that passed is the rate; an idle window has rate 0. The last window
ends with the last sample, so its rate is over the time that really passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ntz
from ..plans.scan import group_scan

def _zero() -> Column:
    return F.lit(0).cast("bigint")


def counter_log(attempts: DataFrame, steps: dict[str, Column], order: tuple[str, ...] = ("ts", "batch_id", "attempt")) -> DataFrame:
    """Counters as samples: ``counter``, ``ts``, ``value`` after each attempt. ``steps`` says by how much an attempt
    moves each counter; ``order`` must be a total order of the attempts."""
    moved = F.explode(F.array(*(F.struct(F.lit(n).alias("counter"), c.cast("bigint").alias("step")) for n, c in steps.items())))
    rows = attempts.select(*order, moved.alias("m")).select(*order, "m.counter", "m.step")
    scanned = group_scan(rows, ["counter"], list(order), "step")
    return scanned.select("counter", "ts", (F.col("prev_sum") + F.col("step")).alias("value"))


def without_resets(samples: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Samples of counters that began again at 0 (a process was restarted) as counters that only grow: a value below the one
    before counts in full."""
    seen = group_scan(samples, ["counter"], list(order), "value")
    before = F.coalesce("prev_value", _zero())
    step = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    moved = seen.select("counter", *order, step.alias("step"))
    grown = group_scan(moved, ["counter"], list(order), "step")
    return grown.select("counter", *order, (F.col("prev_sum") + F.col("step")).alias("value"))


def _ceil_div(a: Column, b: int) -> Column:
    """For integers a >= 0."""
    return F.call_function("div", a + F.lit(b - 1), F.lit(b))


def counter_rates(samples: DataFrame, seconds: int, counters: list[str]) -> DataFrame:
    """``window_start``, ``elapsed_us`` and, for each counter, its name (value at the window's end) and ``<name>_delta``.

    Windows begin at the first sample of all; a sample at a window's end belongs to it, and the first sample to the first
    window. All windows up to the last sample are there. No samples, no rows; null times and values are left out."""
    us = F.unix_micros("ts")
    known = samples.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    first, last = known.select(F.min(us), F.max(us)).first()  # two numbers
    width = seconds * 1_000_000
    if first is None:
        first, last, n = 0, 0, 0
    else:
        n = max(1, -(-(last - first) // width))
    place = F.greatest(F.lit(1).cast("bigint"), _ceil_div(us - F.lit(first), width))
    ends = known.groupBy("counter", place.alias("k")).agg(F.max("value").alias("value"))
    calendar = samples.sparkSession.range(1, n + 1).select(
        F.col("id").alias("k"), F.explode(F.array(*map(F.lit, counters))).alias("counter"))
    rows = calendar.join(ends, ["counter", "k"], "left")
    scanned = group_scan(rows, ["counter"], ["k"], "value")
    before = F.coalesce("prev_max", _zero())
    held = scanned.select("counter", "k", F.greatest(F.coalesce("value", _zero()), before).alias("value"), before.alias("before"))
    of = lambda name, c: F.max(F.when(F.col("counter") == name, c))
    wide = held.groupBy("k").agg(*(x for name in counters for x in (
        of(name, F.col("value")).alias(name), of(name, F.col("value") - F.col("before")).alias(f"{name}_delta"))))
    start = F.lit(first) + (F.col("k") - 1) * width
    return wide.select(ntz(F.timestamp_micros(start)).alias("window_start"),
                       (F.least(start + width, F.lit(last)) - start).alias("elapsed_us"),
                       *(c for name in counters for c in (name, f"{name}_delta")))


def per_second(delta: str) -> Column:
    """A window's rate; null if no time passed (one sample only)."""
    return F.round(F.col(delta) * 1_000_000 / F.when(F.col("elapsed_us") > 0, F.col("elapsed_us")), 6)


def sent() -> Column:
    """Spans that an attempt sent."""
    return F.when(F.col("ok"), F.col("spans")).otherwise(0)


def errors() -> Column:
    """1 for an attempt that failed."""
    return F.when(F.col("ok"), 0).otherwise(1)


def idle_runs(rates: DataFrame, deltas: list[str]) -> DataFrame:
    """Windows in which a counter moved, one row each, and each run of windows between them as one row: ``windows`` is how
    many a row stands for, ``elapsed_us`` their time. Counters stand still in a run, so its values are those of its windows."""
    moved = F.greatest(*(F.col(d) for d in [*deltas, *deltas])) > 0
    rows = rates.select(F.lit(0).alias("_all"), F.unix_micros(F.col("window_start").cast("timestamp")).alias("_at"), moved.cast("bigint").alias("_moved"),
                        *(c for c in rates.columns if c != "window_start"))
    seen = group_scan(rows, ["_all"], ["_at"], "_moved")
    values = [c for c in rates.columns if c not in ("window_start", "elapsed_us")]
    out = seen.groupBy(F.col("prev_sum").alias("_run"), "_moved").agg(
        F.min("_at").alias("_at"), F.count(F.lit(1)).alias("windows"), F.sum("elapsed_us").cast("bigint").alias("elapsed_us"),
        *(F.max(c).alias(c) for c in values))
    return out.select(ntz(F.timestamp_micros("_at")).alias("window_start"), "windows", "elapsed_us", *values)


def achieved_rate(attempts: DataFrame, seconds: int = 2) -> DataFrame:
    """Spans sent in each sample window and the achieved rate; runs of idle windows are one row (``windows``) of rate 0."""
    rates = counter_rates(counter_log(attempts, {"sent": sent()}), seconds, ["sent"])
    return idle_runs(rates, ["sent_delta"]).select("window_start", "windows", F.col("sent_delta").alias("spans"),
                                                   per_second("sent_delta").alias("rate"))


def status_rate(attempts: DataFrame, seconds: int = 5) -> DataFrame:
    """The status line of each interval: spans sent so far, their rate over the time since the last line, errors so far; runs
    of lines in which nothing moved are one row (``windows``)."""
    rates = counter_rates(counter_log(attempts, {"sent": sent(), "errors": errors()}), seconds, ["sent", "errors"])
    return idle_runs(rates, ["sent_delta", "errors_delta"]).select(
        "window_start", "windows", "sent", F.col("sent_delta").alias("spans"), "errors", per_second("sent_delta").alias("rate"))
