"""Progress of long runs, and a stage that can be stopped and taken up again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation of how many there are and of how many meet each condition, filled by the first action."""
    seen = Observation(name)
    kept = [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in counts.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *kept), seen


class Progress(StreamingQueryListener):
    """Rows so far, rows a second and, with a total, the seconds that are left, one entry for each batch."""

    def __init__(self, total: int | None = None):
        self.total, self.rows, self.entries = total, 0, []

    def add(self, rows: int, rate: float) -> dict:
        self.rows += rows
        left = (self.total - self.rows) / rate if self.total is not None and rate > 0 else None
        self.entries.append({"rows": self.rows, "rate": rate, "seconds_left": None if left is None else max(0.0, left)})
        return self.entries[-1]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(event.progress.numInputRows, event.progress.processedRowsPerSecond or 0.0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def append_stage(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, stage) -> int:
    """Runs stage over the JSON files of source that were not read before and appends to target; the rows read.

    The checkpoint knows which files are done, so a run that was stopped goes on where it was.
    """
    rows = spark.readStream.schema(schema).json(source)
    query = stage(rows).writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
