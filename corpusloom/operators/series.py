"""Metric series: numbering, running means, alignment, retention."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import null_safe_join, number_rows, running_sums, sampled_ranges

#: Losses are summed as decimals, so a sum does not depend on the order of its parts.
EXACT = "decimal(28,10)"


def event_series(events: DataFrame) -> DataFrame:
    """(dataset, epoch, step, event_id, loss, bucket): the event stream as loss series, numbered per
    dataset (W1). Ranges of (ts, event_id), as many as the number of rows asks for, bound what one task
    sorts; rows without a dataset are one of their own, rows without a time come first."""
    e = events.select(F.col("event_type").alias("dataset"), F.date_trunc("day", "ts").alias("epoch"), "ts", "event_id", F.col("value").alias("loss"))
    e = sampled_ranges(e, ["ts", "event_id"], "bucket")
    return number_rows(e, ["dataset"], F.col("bucket"), ["ts", "event_id"], "step")


def running_mean(s: DataFrame) -> DataFrame:
    """The mean since the start of the epoch: an exact decimal sum by the count. Losses that are
    not finite take no part."""
    none = F.lit(0).cast(EXACT)
    exact = F.col("loss").try_cast(EXACT)
    one = F.when(exact.isNotNull(), 1).otherwise(0).cast("long")
    d = running_sums(s, ["dataset", "epoch"], F.col("bucket"), ["step"], {"__sum": F.coalesce(exact, none), "__n": one})
    total = (F.col("__sum") + F.coalesce(exact, none)).cast("double")
    return d.withColumn("running", F.try_divide(total, F.col("__n") + one)).withColumn("in_epoch", F.col("__n") + one).drop("__sum", "__n")


def every(s: DataFrame, k: int, step: str = "step") -> DataFrame:
    """F9 / W3."""
    return s.where(F.col(step) % k == 0)


def tumbling_mean(s: DataFrame, k: int) -> DataFrame:
    """The mean of each k steps, and the first step alone (block -1)."""
    t = s.groupBy("dataset", F.floor((F.col("step") - 1) / k).alias("block")).agg(F.avg("loss").alias("loss"), F.max("step").alias("step"))
    return t.unionByName(s.where("step = 1").select("dataset", F.lit(-1).cast("long").alias("block"), "loss", "step"))


def best_so_far(s: DataFrame) -> DataFrame:
    """Whether a value is below all before it. Each bucket's minimum is known first, so a task
    scans a bucket, not a series."""
    per = s.groupBy("dataset", "bucket").agg(F.min("loss").alias("m"))
    before = per.select("dataset", "bucket", F.min("m").over(Window.partitionBy("dataset").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    w = Window.partitionBy("dataset", "bucket").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return null_safe_join(s.withColumn("so_far", F.min("loss").over(w)), before, ["dataset", "bucket"]).withColumn("is_best", F.coalesce(F.col("loss") < F.least("so_far", "earlier"), F.lit(True))).drop("so_far", "earlier")


def normalised_axis(n: Column, most: Column, step: Column) -> Column:
    """N evenly spaced points from 0 to the longest length."""
    return F.when(n > 1, (step - 1) * most / (n - 1)).otherwise(F.lit(0.0))


def retained(df: DataFrame, key: str, order: list, keep: int, older: bool) -> DataFrame:
    """O2: per key the newest ``keep`` rows, or all older ones."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    d = df.withColumn("rn", rn)
    return d.where(F.col("rn") > keep) if older else d.where(F.col("rn") <= keep)


def cumulative(s: DataFrame, order: DataFrame) -> DataFrame:
    """Dataset k's series is that of datasets 1..k, one after the other. ``order`` has
    (dataset, ord), a row per dataset."""
    n = s.groupBy("dataset").agg(F.count("*").alias("n")).join(order, "dataset")
    first = n.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = order.select(F.col("dataset").alias("run"), F.col("ord").alias("run_ord"))
    return s.join(first, "dataset").join(later, F.col("run_ord") >= F.col("ord")).select("run", (F.col("step") + F.col("offset")).cast("long").alias("step"), "loss")
