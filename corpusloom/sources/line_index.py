"""A sparse index of line starts, and a reader that opens only the stretches of files that are asked for.

Lines end as in Python's text mode: at \\n, \\r\\n or a lone \\r. The index has a row for each ``every``
lines of a file: ``slot`` (line number // every), the line number and byte offset of the record that
holds the slot's first line, and the record's length. A record ends at \\n; it holds several lines if
there are lone \\r in it. Offsets inside a block of a file come from one pass over its records, which
stay where they are read; sums per block, a row each, make them offsets of the file.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.locate import locate

_PART = "file string, size long, modified timestamp, block long, slot_line long, line long, offset long, length long, lines long, bytes long"


def _block_records(every: int):
    """On records in file order: per block, entries (slot_line: a candidate line, within the block) for
    each record that may hold a slot's first line, and one row of totals (slot_line null). Since the
    lines before the block are not known yet, every ``every``-th record start of the block is kept too."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["file", "size", "modified", "block", "slot_line", "line", "offset", "length", "lines", "bytes"]
        state: dict = {"key": None}

        def entries(key, line, offset, length, lines):
            n = len(line)
            return [pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array([key[2]] * n, pa.timestamp("us", "UTC")), pa.array([key[3]] * n, pa.int64()), pa.array(line, pa.int64()), pa.array(line, pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(lines, pa.int64()), pa.nulls(n, pa.int64())]

        def totals():
            k = state["key"]
            return pa.RecordBatch.from_arrays([pa.array([k[0]]), pa.array([k[1]], pa.int64()), pa.array([k[2]], pa.timestamp("us", "UTC")), pa.array([k[3]], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([state["lines"]], pa.int64()), pa.array([state["bytes"]], pa.int64())], names=names)

        for b in batches:
            keys = list(zip(b.column("file").to_pylist(), b.column("size").to_pylist(), b.column("modified").to_pylist(), b.column("block").to_pylist()))
            length, lines = b.column("length").to_numpy(), b.column("lines").to_numpy()
            i = 0
            while i < len(keys):
                j = i + 1
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != state["key"]:
                    if state["key"] is not None:
                        yield totals()
                    state = {"key": keys[i], "lines": 0, "bytes": 0}
                size, count = length[i:j], lines[i:j]
                at, off = state["lines"] + np.cumsum(count) - count, state["bytes"] + np.cumsum(size) - size
                # Records within which a multiple of every // 2 lies: at any shift of the block one of
                # them is near each slot's start.
                step = max(1, every // 2)
                on = ((at + count - 1) // step != (at - 1) // step)
                yield pa.RecordBatch.from_arrays(entries(keys[i], at[on], off[on], size[on], count[on]), names=names)
                state["lines"] += int(count.sum())
                state["bytes"] += int(size.sum())
                i = j
        if state["key"] is not None:
            yield totals()

    return run


def build_line_index(spark: SparkSession, paths: list[str] | str, out: str, every: int = 1000) -> None:
    """Write the index of the files as Parquet to ``out``: about two rows for each ``every`` lines."""
    t = spark.read.option("lineSep", "\n").text(paths)
    lone = F.length(F.regexp_replace(F.col("value"), r"\r$", "")) - F.length(F.replace(F.regexp_replace(F.col("value"), r"\r$", ""), F.lit("\r"), F.lit("")))
    m = F.col("_metadata")
    records = t.select(m["file_path"].alias("file"), m["file_size"].alias("size"), m["file_modification_time"].alias("modified"), m["file_block_start"].alias("block"), (F.octet_length("value") + 1).cast("long").alias("length"), (lone + 1).cast("long").alias("lines"))
    parts = records.mapInArrow(_block_records(every), _PART)
    # One pass writes entries and totals; offsets of blocks are added when the index is read.
    parts.write.mode("errorifexists").option("compression", "zstd").parquet(out)


def read_line_index(spark: SparkSession, out: str) -> DataFrame:
    """(file, size, modified, line, offset, until, stop): where stretches of a file start, as line number
    and byte offset, and where they end."""
    d = spark.read.parquet(out)
    sums = d.where("slot_line is null").select("file", "block", "lines", "bytes")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("file", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"first_{c}") for c in ("lines", "bytes")), *((F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(c)).alias(f"end_{c}") for c in ("lines", "bytes")))
    e = d.where("slot_line is not null").join(first, ["file", "block"])
    e = e.select("file", "size", "modified", "block", (F.col("line") + F.col("first_lines")).alias("line"), (F.col("offset") + F.col("first_bytes")).alias("offset"), "end_lines", "end_bytes")
    # Within a block the next entry, at its end the block's end: no window goes over more than a block.
    after = F.lead("line").over(Window.partitionBy("file", "block").orderBy("line"))
    stops = F.lead("offset").over(Window.partitionBy("file", "block").orderBy("line"))
    return e.select("file", "size", "modified", "line", "offset", F.coalesce(after, "end_lines").alias("until"), F.coalesce(stops, "end_bytes").alias("stop"))


def _read_stretches(batches):
    """On requests sorted by stretch: opens each stretch once and answers its requests."""
    import re

    import pyarrow as pa
    from pyarrow import fs

    cut = re.compile(rb"\r\n|\n|\r")
    held, rows = None, []
    for b in batches:
        out = []
        for r in b.to_pylist():
            line, read = None, 0
            if r["status"] == "ok":
                key = r["file"], r["offset"]
                if held is None or held[0] != key:
                    system, path = fs.FileSystem.from_uri(r["file"].replace("file:/", "file:///", 1) if r["file"].startswith("file:/") and not r["file"].startswith("file://") else r["file"])
                    with system.open_input_file(path) as f:
                        f.seek(r["offset"])
                        raw = f.read(r["stop"] - r["offset"])
                    held, read = (key, cut.split(raw)), len(raw)
                line = held[1][r["n"] - r["line"]].decode("utf-8", "ignore").strip()
            out.append((r["file"], r["n"], r["status"], line, read))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()])], names=["file", "n", "status", "line", "bytes_read"])


def lines_at(spark: SparkSession, requests: DataFrame, index: str) -> DataFrame:
    """Requests (file, n), n from 0, as (file, n, status, line, bytes_read); line is stripped, bytes
    that are no UTF-8 go. status: ok; beyond, past the file's end or below 0; stale, if the file's size
    or time differ from the index's; missing, if the file or its index is not there. Requests meet the
    index in one join; each stretch is opened once per task and bytes_read is told at its first request."""
    idx = read_line_index(spark, index)
    files = idx.groupBy("file").agg(F.first("size").alias("size"), F.first("modified").alias("modified"))
    folders = [r["folder"] for r in files.select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct().collect()]
    now = spark.createDataFrame([], "file string, now_size long, now_modified timestamp")
    for folder in folders:
        listed = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("now_size"), F.col("modificationTime").alias("now_modified"))
        now = now.unionByName(listed)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:///")
    req = requests.select(plain("file").alias("file"), F.col("n").cast("long").alias("n"))
    state = files.withColumn("file", plain("file")).join(now.withColumn("file", plain("file")), "file", "left")
    ask = req.join(state, "file", "left").withColumn("status", F.when(F.col("now_size").isNull(), "missing").when((F.col("now_size") != F.col("size")) | (F.col("now_modified") != F.col("modified")), "stale").otherwise("ok")).select("file", "n", "status")
    spans = idx.select(plain("file").alias("file"), "size", "line", "offset", "stop", (F.col("until") - F.col("line")).alias("span"))
    found = locate(ask.where("status = 'ok'").distinct(), "n", spans, "line", "span", ["file"])
    got = ask.join(found.drop("status"), ["file", "n"], "left").withColumn("status", F.when((F.col("status") == "ok") & F.col("offset").isNull(), "beyond").otherwise(F.col("status")))
    placed = got.repartition("file", "offset").sortWithinPartitions("file", "offset", "n")
    return placed.select("file", "n", "status", "size", "line", "offset", "stop").mapInArrow(_read_stretches, "file string, n long, status string, line string, bytes_read long")
