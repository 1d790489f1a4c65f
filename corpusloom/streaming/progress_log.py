"""K9: a log of streaming queries as a table, a row per batch and one for each query's end."""
from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROW = "name string, batch long, at string, rows long, rows_per_second double, milliseconds long, state_rows long, error string"


class ProgressLog(StreamingQueryListener):
    """Writes what the session's streaming queries report below ``path``, each row in a folder of its
    own, so that logs of several drivers share a path and a report that comes twice replaces itself.
    Events: ``batch`` (one per batch), then ``ended`` or ``failed`` with the error. A row that can't be
    written is kept in ``unwritten`` and doesn't disturb the query."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.unwritten = spark, path.rstrip("/"), []
        self._names: dict[str, str | None] = {}
        self._ends: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self._ends.setdefault(run, threading.Event())

    def _write(self, run: str, event: str, row: tuple) -> None:
        try:
            where = f"{self.path}/run={run}/event={event}/batch-{'end' if row[1] is None else row[1]}"
            self.spark.createDataFrame([row], ROW).coalesce(1).write.mode("overwrite").json(where)
        except Exception as e:  # a log must not stop what it reports on
            self.unwritten.append((run, event, row, str(e)))

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        self._write(str(p.runId), "batch", (p.name, p.batchId, p.timestamp, p.numInputRows, p.processedRowsPerSecond, p.batchDuration, state, None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        self._write(run, "failed" if event.exception else "ended", (self._names.pop(run, None), None, None, None, None, None, None, event.exception))
        self._end(run).set()

    def wait(self, run: str, seconds: float = 60.0) -> bool:
        """Whether the end of a run has been written; Spark reports it some time after the query ends."""
        return self._end(str(run)).wait(seconds)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(run, event, name, batch, at, rows, rows_per_second, milliseconds, state_rows, error)."""
    # The last folder's name is no key=value pair, so the files are listed and their keys read from
    # the path.
    d = spark.read.schema(ROW).option("recursiveFileLookup", "true").json(path)
    at = F.col("_metadata.file_path")
    return d.select(F.regexp_extract(at, "/run=([^/]*)/", 1).alias("run"), F.regexp_extract(at, "/event=([^/]*)/", 1).alias("event"), *d.columns)
