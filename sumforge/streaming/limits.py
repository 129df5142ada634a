"""Stateful and order-dependent operators over event streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sumforge.operators import ranges


def rolling_count(events: DataFrame, *, seconds: int) -> DataFrame:
    """events(user_id, ts, event_id) with the number of the user's events in the window that ends with each, ends included."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("hits", F.count(F.lit(1)).over(w))


class SlidingLog:
    """Admits a hit if fewer than limit admitted ones lie within the last window; those exactly that old still count."""

    def __init__(self, limit: int, window: float, times: list[float] = ()):
        self.limit, self.window, self.times = limit, window, deque(times)

    def admit(self, now: float) -> bool:
        while self.times and now - self.times[0] > self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(now)
        return True


def rate_limited(events: DataFrame, *, limit: int, seconds: float) -> DataFrame:
    """(event_id, user_id, admitted): each user's hits in order of time; rejected hits are not logged. A user is one task's group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        log = SlidingLog(limit, seconds)
        pdf = pdf.sort_values(["ts", "event_id"])
        return pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "admitted": [log.admit(t) for t in pdf["ts"]]})

    rows = events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return rows.groupBy("user_id").applyInPandas(run, "event_id long, user_id long, admitted boolean")


def rate_limited_stream(events: DataFrame, *, limit: int, seconds: float, delay: str = "1 minute") -> DataFrame:
    """rate_limited() for a stream; a user's admitted times are its state, at most limit of them.

    A user's state goes when the watermark has passed the window after its last admitted hit, so only users of late have any. Rows behind the watermark
    are late, and dropped; hits of a user are decided in the order of time within a micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = SlidingLog(limit, seconds, list(state.get[0]) if state.exists else [])
        pdf = pd.concat(list(batches)).sort_values(["at", "event_id"])
        admitted = [log.admit(t) for t in pdf["at"]]
        state.update((list(log.times),))
        last = max(log.times, default=0)
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((last + seconds) * 1000) + 1))
        yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "admitted": admitted})

    rows = events.withWatermark("ts", delay).select("event_id", "user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, admitted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def keep_first_stream(rows: DataFrame, key: str, *, time: str | None = None, within: str = "1 hour") -> DataFrame:
    """Keep-first dedup across micro-batches.

    With a time column, keys are remembered for the given span behind the watermark: a key that comes again within it is dropped, one that comes later
    is new again, and the state stays as large as the keys of that span. Rows later than the watermark are dropped. Without one, every key is kept for ever.
    """
    if time is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def without_curated(rows: DataFrame, log: DataFrame, key: str, *, time: str, log_time: str, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """A stream of rows without those that a stream log(key, log_time, action) removes within a span after them; both sides' state is bounded by it.

    A row comes out once it is certain: when the watermark has passed the span in which it could still be removed. Null keys are never removed.
    """
    left = rows.withWatermark(time, delay)
    right = log.where("action = 'remove'").select(F.col(key).alias("__key"), F.col(log_time).alias("__at")).withWatermark("__at", delay)
    near = (F.col(key) == F.col("__key")) & (F.col("__at") >= F.col(time)) & (F.col("__at") <= F.col(time) + F.expr(f"INTERVAL {within}"))
    return left.join(right, near, "leftOuter").where("__key IS NULL").drop("__key", "__at")


def ema(series: DataFrame, *, alpha: float = 0.9, width: int = ranges.WIDTH) -> DataFrame:
    """series(name, step, value) with last * alpha + (1 - alpha) * value, from the first value on; ordered within a name.

    Each range of width steps is smoothed from zero on; what the ranges before hand on decays by alpha with each row. So
    a task holds one range, and of a whole series one row for each range.
    """
    rows, here = ranges.ranged(series.select("name", "step", F.col("value").cast("double").alias("value")), "step", width=width)
    rows = rows.withColumnRenamed(here, "__range")

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step", ignore_index=True)
        last, out = 0.0, []
        for value in group["value"]:
            last = last * alpha + (1 - alpha) * value
            out.append(last)
        return group.assign(ema=out, n=range(1, len(group) + 1))

    def handed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__range", ignore_index=True)
        carry, out = float(group["first"].iloc[0]), []
        for end, n in zip(group["end"], group["n"], strict=True):
            out.append(carry)
            carry = carry * alpha**n + end
        return group.assign(carry=out)[["name", "__range", "carry"]]

    name, kind = f"name {series.schema['name'].dataType.simpleString()}", series.schema["step"].dataType.simpleString()
    local = rows.groupBy("name", "__range").applyInPandas(smooth, f"{name}, __range int, step {kind}, value double, ema double, n long")
    ends = local.groupBy("name", "__range").agg(F.min_by("value", "n").alias("first"), F.max_by("ema", "n").alias("end"), F.max("n").alias("n"))
    carries = ends.groupBy("name").applyInPandas(handed, f"{name}, __range int, carry double")
    return local.join(carries, ["name", "__range"]).select("name", "step", (F.col("ema") + F.col("carry") * F.pow(F.lit(alpha), "n")).alias("ema"))


def moving_average(series: DataFrame, width: int, *, rows: int = ranges.WIDTH) -> DataFrame:
    """The means of all full windows of width rows, each at its first step. A task holds a range of rows and the next width - 1."""
    found, part, own = ranges.with_halo(series.select("name", "step", "value"), "step", width - 1, by=("name",), width=rows)
    w = Window.partitionBy("name", part).orderBy("step").rowsBetween(0, width - 1)
    found = found.withColumn("mean", F.avg("value").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return found.where((F.col("n") == width) & F.col(own)).select("name", "step", "mean")


def running_best(series: DataFrame) -> DataFrame:
    found = ranges.running(series, "step", "value", of=F.min, merge=F.least, by=("name",), name="best")
    return found.withColumn("is_best", F.col("value") == F.col("best")).select(*series.columns, "best", "is_best")


def evaluation_schedule(steps: DataFrame, tiers: dict[str, int], warm_up: int) -> DataFrame:
    """steps(step) with the tiers that are due: every n steps once warmed up."""
    due = [F.when((F.col("step") >= warm_up) & (F.pmod("step", F.lit(n)) == 0), F.lit(name)) for name, n in tiers.items()]
    return steps.withColumn("tiers", F.array_join(F.array_compact(F.array(*due)), ","))
