"""Sequenced change applier: numbered changes of many clients, applied in order as batches arrive.

Each client's changes carry numbers 1, 2, ...; they arrive out of order, twice or never. A change is
held until all before it have been applied; when a gap lasts too long it is jumped. State is a map from
pages to Arrow blobs: a page is PAGE numbers of one client, keyed by itself in the session's state store, and
holds the changes that wait there and their least day; pages without any are no state. First pages, which are all that most clients
have, share a shelf of about SHELF clients. Only pages that get rows, or whose rows are released, are
loaded; a huge client's pages lie in many tasks.

1. ``numbered``: sequence values become dense ranks, over sampled ranges of (client, value).
2. Per batch its rows, each with its client's pointer, and a release for every page whose held rows are
   due, are written for a streaming query that starts anew on one checkpoint (``_started``). A page
   drops what is released, rejects numbers below the pointer or held already, holds the rest, and
   tells the runs of consecutive numbers it holds with their least day.
3. ``_pointers``: the runs of all pages, which are few and short, tell by aggregation how far each
   client got: up to the end of the run that begins at its pointer; then, at the next batch's start,
   to the end of the run that holds its last overdue change. No client's rows meet in one task.
4. ``_values``: values after each applied change, by windows over ranges of (client, number) and one
   row for each client and range that carries on from one to the next.

Defined cases: repeated rows count once; a null client_id is a client of its own; null sequence values
come first; rows with a null change_id vanish, since their arrival day is drawn from it; days before
the first batch belong to it; balances that are not finite count as null; a change of another kind than
I, U and D is applied without setting anything; an empty table gives an empty result; very long city
names travel whole; rows that share change_id and differ elsewhere come in the order of their numbers; a batch
without rows is run all the same; extra columns, whatever their names, are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.ranking import null_safe_join, number_rows, sampled_ranges
from .common import materialize, new_path, partitions

PAGE, SHELF = 64, 128
#: Beyond every number: the pointer that releases all.
ALL = 1 << 62
_IN = "cell string, key string, at int, next long, upto long, n long, day long, change_id long, op string, city string, cents string"
_OUT = "cell string, kind int, key string, n long, last long, day long, change_id long, op string, city string, cents string, batch int"
REJECTED, APPLIED, RUN, SEEN = range(4)
_HELD = ["key", "n", "day", "change_id", "op", "city", "cents"]


def arrival_hash(change_id: Column) -> Column:
    return F.crc32(change_id.cast("string").cast("binary"))


def numbered(changes: DataFrame, first_day: int, days: int, batches: int) -> DataFrame:
    """(key, n, day, batch, change_id, op, city, cents) of the rows that arrive."""
    h = arrival_hash(F.col("change_id"))
    cents = F.floor(100 * F.col("balance") + 0.5)
    rows = changes.select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").distinct().select(
        F.coalesce(F.col("client_id").cast("string"), F.lit("")).alias("key"), "seq", "change_id", "op", "city", F.when(F.abs("balance") < float("inf"), cents).cast("string").alias("cents"),
        (F.unix_date(F.col("valid_at").cast("date")) + 2 * (h % 4)).cast("long").alias("day"), (h % 11).alias("drawn"))
    rows = materialize(rows, "changes")
    pairs = materialize(rows.select("key", "seq").distinct(), "pairs")
    size = max(1000, -(-pairs.count() // partitions(changes.sparkSession)))
    ranked = number_rows(sampled_ranges(pairs, ["key", "seq"], "b", size), ["key"], F.col("b"), ["seq"], "n").drop("b")
    batch = F.least(F.lit(batches), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - first_day) * batches / days))).cast("int")
    fed = null_safe_join(rows.where("day is not null and drawn <> 0").drop("drawn"), ranked, ["key", "seq"]).withColumn("batch", batch).drop("seq")
    return materialize(fed, "numbered")


def _page_step(cell, frames, state):
    """One page's turn: releases, rejections, what is held now and its runs."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    new = pd.concat(list(frames), ignore_index=True)
    at = int(new["at"].iloc[0])
    pointers = new.drop_duplicates("key").set_index("key")
    new = new[new["n"] > 0].sort_values(["day", "change_id", "n"], kind="stable")
    parts = []

    def say(kind, rows, batch=0):
        parts.append(rows.assign(kind=np.int32(kind), last=np.int64(0), batch=np.int32(batch)) if "last" not in rows else rows.assign(kind=np.int32(kind), batch=np.int32(batch)))

    if state.exists:
        held = pa.ipc.open_stream(state.get[0]).read_all().to_pandas()
        due = held["n"].to_numpy() < held["key"].map(pointers["next"]).fillna(0).to_numpy()
        out = held[due]
        early = out["n"].to_numpy() < out["key"].map(pointers["upto"]).to_numpy()
        say(APPLIED, out[early], at - 1)
        say(APPLIED, out[~early], at)
        held = held[~due]
    else:
        held = new[_HELD].iloc[:0]
    low = (new["n"] < new["next"]).to_numpy()
    both = pd.concat([held, new.loc[~low, _HELD]], ignore_index=True)
    again = both.duplicated(["key", "n"]).to_numpy()
    say(REJECTED, new.loc[low, _HELD], at)
    say(REJECTED, both[again], at)
    held = both[~again].sort_values(["key", "n"], kind="stable", ignore_index=True)
    if len(held):
        batch = pa.RecordBatch.from_arrays([pa.array(held[c], pa.int64() if c in ("n", "day", "change_id") else pa.string(), from_pandas=True) for c in _HELD], names=_HELD)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        state.update((sink.getvalue().to_pybytes(), int(held["day"].min())))
        n, who = held["n"].to_numpy(), held["key"].to_numpy()
        first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (n[1:] != n[:-1] + 1)))
        last = np.append(first[1:], len(n)) - 1
        say(RUN, pd.DataFrame({"key": who[first], "n": n[first], "last": n[last], "day": np.minimum.reduceat(held["day"].to_numpy(), first), "change_id": np.int64(0), "op": None, "city": None, "cents": None}))
    else:
        if state.exists:
            state.remove()
        say(SEEN, pd.DataFrame({"key": [""], "n": [0], "day": [0], "change_id": [0], "op": [None], "city": [None], "cents": [None]}))
    out = pd.concat([p for p in parts if len(p)], ignore_index=True).assign(cell=cell[0])
    for c in ("op", "city", "cents"):
        out[c] = out[c].astype(object).where(out[c].notna(), None)
    yield out[["cell", "kind", "key", "n", "last", "day", "change_id", "op", "city", "cents", "batch"]]


def _started(spark: SparkSession, folder: str, at: int) -> None:
    """Start the query on its checkpoint, let it take what has been written since, and end it."""
    rows = spark.readStream.schema(_IN).parquet(f"{folder}/in")
    pages = rows.groupBy("cell").applyInPandasWithState(_page_step, _OUT, "held binary, min_day long", "append", GroupStateTimeout.NoTimeout)
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out/{at}")
    q = pages.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def _pointers(runs: DataFrame, before: DataFrame, overdue: int | None) -> DataFrame:
    """(key, next, upto) of every client that has begun. ``upto`` is where its pointer stood after the
    batch, ``next`` where it stands at the next one's start: changes of days up to ``overdue`` don't wait."""
    on = runs.where(F.col("first") % PAGE == 0).select("key", (F.col("first") - 1).alias("last"), F.lit(True).alias("goes_on"))
    runs = runs.join(on, ["key", "last"], "left")  # a run may go on in the next page
    ends = F.when(F.col("goes_on").isNull(), F.col("last"))
    heads = runs.groupBy("key").agg(F.min("first").alias("head"), F.min(ends).alias("stop"))
    at = F.coalesce("next", F.lit(1))
    heads = materialize(heads.join(before, "key", "left").select("key", at.alias("next"), F.when(F.col("head") == at, F.col("stop") + 1).otherwise(at).alias("upto")), "heads")
    moved = heads.withColumn("to", F.col("upto"))
    if overdue is not None:
        late = runs.where(F.col("day") <= overdue).join(heads.select("key", "upto"), "key").where(F.col("first") >= F.col("upto"))
        late = materialize(late.groupBy("key").agg(F.max("last").alias("most")), "late")
        jumps = runs.where("goes_on is null").join(late, "key").where(F.col("last") >= F.col("most")).groupBy("key").agg((F.min("last") + 1).alias("jump"))
        moved = heads.join(jumps, "key", "left").withColumn("to", F.coalesce("jump", "upto"))
    new = moved.where(F.col("to") > F.col("next")).select("key", F.col("to").alias("next"), "upto")
    last = before.unionByName(new).groupBy("key").agg(F.max(F.struct("next", "upto")).alias("p"))
    return materialize(last.select("key", "p.next", "p.upto"), "pointers")


def _values(applied: DataFrame) -> DataFrame:
    """Applied changes with missed, city, cents and current."""
    setting = lambda c: F.when(F.col("op").isin("I"), F.struct(F.col(c).alias("v"))).when(F.col("op") == "D", F.struct(F.lit(None).cast("string").alias("v"))).when((F.col("op") == "U") & F.col(c).isNotNull(), F.struct(F.col(c).alias("v")))
    rows = materialize(applied.select("key", "n", "change_id", "batch", F.coalesce(F.col("op") != "D", F.lit(True)).alias("lives"), setting("city").alias("city"), setting("cents").alias("cents")), "applied")
    size = max(1000, -(-rows.count() // partitions(applied.sparkSession)))
    rows = sampled_ranges(rows, ["key", "n"], "b", size)
    w = Window.partitionBy("key", "b").orderBy("n")
    kept = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select("key", "b", "n", "change_id", "batch", "lives", F.lag("n").over(w).alias("prior"), F.lead("n").over(w).isNull().alias("ends"), *(F.last(c, True).over(kept).alias(c) for c in ("city", "cents")))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    parts = rows.groupBy("key", "b").agg(F.max("n").alias("top"), newest("city"), newest("cents"))
    by = Window.partitionBy("key").orderBy("b")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("key", "b", F.lag("top").over(by).alias("top"), F.lead("b").over(by).isNull().alias("final"), *(F.last(c, True).over(earlier).alias(f"old_{c}") for c in ("city", "cents")))
    d = own.join(carried, ["key", "b"])
    value = lambda c: F.coalesce(c, f"old_{c}")["v"]
    return d.select("key", "change_id", F.lit("applied").alias("status"), "batch", (F.col("n") - F.coalesce("prior", "top", F.lit(0)) - 1).alias("missed"), value("city").alias("city"), value("cents").cast("long").alias("cents"), (F.col("ends") & F.col("final") & F.col("lives")).alias("current"))


def apply_changes(changes: DataFrame, batches: int = 8, first_day: int = 19723, days: int = 160, patience: int = 5) -> DataFrame:
    """(change_id, client_id, status, batch, missed, city, cents, current) of every change that arrives."""
    spark = changes.sparkSession
    fed = numbered(changes, first_day, days, batches)
    newest = {r["batch"]: r["day"] for r in fed.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    shelves = max(1, fed.agg(F.approx_count_distinct("key")).first()[0] // SHELF)
    page = F.floor(F.col("n") / PAGE)
    cell = F.when(page == 0, F.concat(F.lit("shelf "), F.pmod(F.xxhash64("key"), F.lit(shelves)).cast("string"))).otherwise(F.concat(F.lit("page "), page.cast("string"), F.lit(" of "), F.col("key")))
    folder = new_path(spark, "stream")
    none = lambda kind: spark.createDataFrame([], kind)
    runs, pointers = none("cell string, key string, first long, last long, day long"), none("key string, next long, upto long")
    out = None
    for at in range(1, batches + 2):
        final = at > batches
        next_, upto = (F.coalesce(c, F.lit(1)) for c in ("next", "upto"))
        held = runs.join(pointers, "key", "left").withColumn("next", F.lit(ALL) if final else next_).withColumn("upto", upto).where(F.col("first") < F.col("next"))
        release = held.select("cell", "key", "next", "upto").distinct().select("cell", "key", F.lit(at).alias("at"), "next", "upto", *(F.lit(0).cast("long").alias(c) for c in ("n", "day", "change_id")), *(F.lit(None).cast("string").alias(c) for c in ("op", "city", "cents")))
        rows = fed.where(F.col("batch") == at).join(pointers, "key", "left").select(cell.alias("cell"), "key", F.lit(at).alias("at"), next_.alias("next"), upto.alias("upto"), "n", "day", "change_id", "op", "city", "cents")
        rows.unionByName(release).write.mode("append").parquet(f"{folder}/in")
        _started(spark, folder, at)
        said = spark.read.schema(_OUT).parquet(f"{folder}/out/{at}")
        out = said if out is None else out.unionByName(said)
        if final:
            break
        now = said.where(F.col("kind") == RUN).select("cell", "key", F.col("n").alias("first"), "last", "day")
        runs = materialize(runs.join(said.select("cell").distinct(), "cell", "left_anti").unionByName(now), "runs")
        days_seen = [d for b, d in newest.items() if b <= at]
        pointers = _pointers(runs, pointers, max(days_seen) - patience if days_seen else None)
    rejected = out.where(F.col("kind") == REJECTED).select("key", "change_id", F.lit("rejected").alias("status"), "batch", F.lit(0).cast("long").alias("missed"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("long").alias("cents"), F.lit(False).alias("current"))
    done = _values(out.where(F.col("kind") == APPLIED)).unionByName(rejected)
    return done.select("change_id", F.when(F.col("key") != "", F.col("key").cast("long")).alias("client_id"), "status", "batch", "missed", "city", "cents", "current")
