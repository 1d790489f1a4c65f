"""Save points of runs whose steps arrive over time."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

#: In a query that keeps running, a run that has been silent for so long is over: its state goes.
SILENT_MS = 86_400_000


def _due(every: int, seconds: float, silent_ms: int | None):
    """On the steps of one dataset that a trigger brings: those at which a snapshot is due."""
    def run(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        seen, fired = state.get if state.exists else (0, 0.0)
        d = pd.concat(list(frames), ignore_index=True).drop_duplicates("step").sort_values("step")
        d = d[d["step"] > seen]
        on = []
        for step, elapsed in zip(d["step"].tolist(), d["elapsed"].tolist()):
            due = step % every == 0 or elapsed - fired >= seconds
            if due:
                fired = elapsed
            on.append(due)
        if len(d):
            state.update((int(d["step"].iloc[-1]), float(fired)))
        if silent_ms:
            state.setTimeoutDuration(silent_ms)
        out = d[on]
        yield pd.DataFrame({"dataset": [key[0]] * len(out), "step": out["step"].astype("int64"), "elapsed": out["elapsed"].astype("float64")})

    return run


def streamed_save_points(steps: DataFrame, every: int = 100, seconds: float = 300.0, silent_ms: int | None = None) -> DataFrame:
    """T3 on a stream of (dataset, step, elapsed): rows as perturb.save_points gives them, as soon as
    their step arrives. The state of a dataset is two numbers, its last step and when it last fired;
    with ``silent_ms`` a timer drops it once the run has been silent (a query with timers never runs out
    of batches, so one that is to end by itself has none). Steps of a dataset arrive in order from trigger to
    trigger; within one they may come in any order, and what comes again is left out. A null dataset is
    a run of its own."""
    return steps.groupBy("dataset").applyInPandasWithState(_due(every, seconds, silent_ms), "dataset string, step long, elapsed double", "step long, fired double", "append", GroupStateTimeout.ProcessingTimeTimeout if silent_ms else GroupStateTimeout.NoTimeout)


def start_save_points(spark: SparkSession, source: str, sink: str, checkpoint: str, every: int = 100, seconds: float = 300.0, files_per_trigger: int | None = None, interval: str | None = None) -> StreamingQuery:
    """Parquet files of steps become Parquet files of save points. Started anew on its checkpoint the
    query goes on where it was; with ``interval`` it keeps running, else it ends with what is there."""
    r = spark.readStream.schema("dataset string, step long, elapsed double")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    w = streamed_save_points(r.parquet(source), every, seconds, SILENT_MS if interval else None).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
