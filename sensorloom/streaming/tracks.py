"""Structured Streaming over sensor readings. An extension: the batch operators define the results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(readings: DataFrame, keys: list[str], event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Each re-delivered reading once, as long as its copies come within the watermark; the state kept is bounded by it."""
    return readings.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_rates(readings: DataFrame, source: str, event_time: str, value: str, width: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """(source, start, n, mean, peak) of tumbling windows, closed when the watermark passes."""
    w = readings.withWatermark(event_time, delay).groupBy(source, F.window(event_time, width).alias("w"))
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak")).select(source, F.col("w.start").alias("start"), "n", "mean", "peak")


def sessions(readings: DataFrame, source: str, event_time: str, gap: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """(source, start, end, n): runs of readings without a longer gap."""
    s = readings.withWatermark(event_time, delay).groupBy(source, F.session_window(event_time, gap).alias("w"))
    return s.agg(F.count("*").alias("n")).select(source, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def matched_in_time(left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, tolerance: str = "20 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Pairs of the same entity within the tolerance: an interval join whose state the watermarks bound."""
    a = left.withWatermark(left_time, delay).alias("l")
    b = right.withWatermark(right_time, delay).alias("r")
    at, bt = F.col(f"l.{left_time}"), F.col(f"r.{right_time}")
    tol = F.expr(f"interval {tolerance}")
    return a.join(b, (F.col(f"l.{entity}") == F.col(f"r.{entity}")) & (bt >= at - tol) & (bt <= at + tol))


def held_values(readings: DataFrame, source: str, t: str, value: str, run: int = 8) -> DataFrame:
    """(source, t, length): readings that extend a run of equal values to at least `run`, with the run's length so far.

    State per source: the last value and the length of its run. Readings are taken in the order of t within a batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (float("nan"), 0)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for at, v in zip(rows["t"], rows["value"]):
            n = n + 1 if v == last else 1
            last = v
            if n >= run:
                out.append((key[0], float(at), n))
        state.update((float(last), int(n)))
        yield pd.DataFrame(out, columns=["source", "t", "length"])

    r = readings.select(F.col(source).alias("source"), F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value)")
    return r.groupBy("source").applyInPandasWithState(step, "source string, t double, length int", "last double, n int", "append", GroupStateTimeout.NoTimeout)
