"""Incremental forms: rewriting files as they arrive, and metrics appended batch by batch. An
extension; the batch operators give the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.stats import perplexity
from ..functions.text import RULES, strip
from ..operators.segment import BOUNDARY


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """New text files of a directory. Records end at line ends, so nothing is carried over."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def rewritten(lines: DataFrame) -> DataFrame:
    """(rule, sentence) of a stream or a batch of lines."""
    s = lines.select(F.explode(F.split(strip(F.col("value")), BOUNDARY)).alias("s")).where("s <> ''")
    return s.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), f(F.col("s")).alias("sentence")) for n, f in RULES.items()))).alias("x")).select("x.*")


def start_rewrite(spark: SparkSession, source: str, sink: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Parquet per rule. The checkpoint makes it resume; ``seconds`` sets the trigger, without
    it what is there is worked off and the query ends."""
    w = rewritten(stream_lines(spark, source)).writeStream.format("parquet").partitionBy("rule").option("path", sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def save_points(steps: DataFrame, every: int = 100, seconds: float = 300.0) -> DataFrame:
    """The steps at which a snapshot is due: each ``every`` steps, or ``seconds`` after the last.
    steps: (dataset, step, elapsed), steps numbered from 1 without gaps. A step divisible by ``every``
    is always due, whatever went before, so the time rule starts anew there: the steps from one such to
    the next are folded by themselves, ``every`` of them at a time."""
    rows = steps.groupBy("dataset", F.floor(F.col("step") / every).alias("part")).agg(F.array_sort(F.collect_list(F.struct("step", "elapsed"))).alias("rows"))
    none = F.expr("cast(array() as array<struct<step:bigint,elapsed:double>>)")

    def fold(s, x):
        due = (x["step"] % every == 0) | (x["elapsed"] - s["last"] >= seconds)
        return F.struct(F.when(due, x["elapsed"]).otherwise(s["last"]).alias("last"), F.when(due, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    due = F.aggregate("rows", F.struct(F.lit(0.0).alias("last"), none.alias("out")), fold, lambda s: s["out"])
    return rows.select("dataset", F.explode(due).alias("x")).select("dataset", "x.step", "x.elapsed")


def start_metrics(spark: SparkSession, source: str, sink: str, checkpoint: str, cap: float = 100.0) -> StreamingQuery:
    """Points (dataset, step, loss) that arrive as JSON files are appended with their perplexity, a
    batch at a time. A batch that is repeated after a failure replaces its own rows."""
    points = spark.readStream.schema("dataset string, step long, loss double").json(source)

    def append(batch: DataFrame, number: int) -> None:
        done = batch.select("*", perplexity(F.col("loss"), cap).alias("perplexity"))
        done.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return points.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(states: DataFrame, key: str, order: str) -> DataFrame:
    """T4: the newest row per key."""
    return states.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("rn = 1").drop("rn")
