"""Run report of a stream (A10, A11, T8): a row per micro-batch from the progress that Spark reports."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

BATCHES = "run_id STRING, batch_id BIGINT, n_rows BIGINT, n_lines BIGINT, n_rejected BIGINT, n_dropped BIGINT, busy_ms BIGINT"


class RunReport(StreamingQueryListener):
    """Collects a row per micro-batch of the session's queries (``with RunReport(spark) as report: ...``).

    ``n_rows`` are the source's rows, ``n_lines`` and ``n_rejected`` the observed counts of the parser where a query has them,
    ``n_dropped`` rows that stateful steps left out behind the watermark, ``busy_ms`` the time in which the batch ran.
    Reports come in a thread of their own; ``wait_for`` waits until those of a query are there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.ended = spark, {}, threading.Condition()
        self.done: set[str] = set()

    def __enter__(self) -> RunReport:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = next((m for m in p.observedMetrics.values() if "rejected" in m.asDict()), None) if p.observedMetrics else None
        lines, rejected = (int(counts["lines"] or 0), int(counts["rejected"] or 0)) if counts else (0, 0)
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        with self.ended:
            # a batch without data repeats the id of the one before in its idle reports: the first report stands
            self.rows.setdefault((str(p.runId), p.batchId), (str(p.runId), p.batchId, p.numInputRows, lines, rejected, dropped, int(p.durationMs.get("triggerExecution", 0))))

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.done.add(str(event.runId))
            self.ended.notify_all()

    def wait_for(self, query: StreamingQuery, timeout: float = 60) -> None:
        """Until the query's end has been reported, and with it all its batches."""
        with self.ended:
            if not self.ended.wait_for(lambda: str(query.runId) in self.done, timeout):
                raise TimeoutError("the end of the query was not reported")

    def batches(self) -> DataFrame:
        """One row per run and micro-batch."""
        return self.spark.createDataFrame(sorted(self.rows.values()), BATCHES)
