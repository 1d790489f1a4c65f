"""Which interval a number lies in, as an equi-join on cells, and lookups by global numbers built on it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import null_safe_join, running_offsets, sampled_ranges

#: Intervals that meet in a cell on average.
PER_CELL = 64


def locate(points: DataFrame, at: str, intervals: DataFrame, start: str, length: str, keys: list[str] | None = None) -> DataFrame:
    """points joined with the interval [start, start + length) of their keys that holds ``at``. Cells as
    wide as PER_CELL average intervals make it an equi-join: an interval has a row for each cell that it
    meets, over all about as many as there are intervals. Intervals of a key must not overlap; empty ones
    and those without numbers hold nothing; points that lie in none are left out."""
    whole = intervals.where(F.col(length) > 0)
    n, total = whole.agg(F.count(start), F.sum(length)).first()
    width = max(1, PER_CELL * int(total or 0) // max(n, 1))
    cell = lambda c: F.floor(c / width)
    spread = whole.where(F.col(start).isNotNull()).withColumn("__cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(start) + F.col(length) - 1))))
    placed = points.where(F.col(at).isNotNull()).withColumn("__cell", cell(F.col(at)))
    met = null_safe_join(placed, spread, [*(keys or []), "__cell"]).drop("__cell")
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(length)))


def example_index(lines: DataFrame, key: str, examples: Column) -> DataFrame:
    """(key, first, n): how many examples each line gives, and how many all lines before it give
    together, in the order of the key. Nothing but keys and counts is sorted."""
    d = sampled_ranges(lines.select(key, examples.cast("long").alias("n")), [key], "__range")
    return running_offsets(d, [], F.col("__range"), [key], F.col("n"), "first").drop("__range")


def examples_at(numbers: DataFrame, number: str, index: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Numbers (0 to one less than the count of all examples) joined with their line and
    ``i``, the example's number in it from 1. Only lines that are asked for meet their text."""
    found = locate(numbers, number, index, "first", "n").withColumn("i", (F.col(number) - F.col("first") + 1).cast("int")).drop("first", "n")
    return found.join(lines, key)


def two_level_draws(lines: DataFrame, file: str, key: str, draws: DataFrame, size: int = 65_536) -> DataFrame:
    """(draws' columns, file, key): draws have a file and ``line``, its number in the file's order of
    ``key`` from 1. Counts per (file, bucket of keys), which one scan adds up, tell in which bucket a line
    is; the rows of these buckets alone are sorted, draws * size of them at most where keys are dense."""
    bucket = F.floor(F.col(key) / size)
    rows = lines.select(file, key).withColumn("__bucket", bucket)
    counts = rows.groupBy(file, "__bucket").agg(F.count("*").alias("__n"))
    counts = running_offsets(sampled_ranges(counts, ["__bucket"], "__range"), [file], F.col("__range"), ["__bucket"], F.col("__n"), "__first").drop("__range")
    at = draws.withColumn("__at", F.col("line") - 1)
    found = locate(at, "__at", counts, "__first", "__n", [file]).withColumn("__place", F.col("__at") - F.col("__first") + 1).drop("__at", "__first", "__n")
    wanted = found.select(file, "__bucket").distinct()
    few = null_safe_join(rows, wanted, [file, "__bucket"], "left_semi")
    placed = few.withColumn("__place", F.row_number().over(Window.partitionBy(file, "__bucket").orderBy(key)).cast("long"))
    return null_safe_join(found, placed, [file, "__bucket", "__place"]).drop("__bucket", "__place")


def first_lines(lines: DataFrame, file: str, key: str, most: int, size: int = 65_536) -> DataFrame:
    """The first ``most`` rows in order of (file, key), nulls first, as a filter. Counts per (file,
    bucket of keys) tell which bucket the cap cuts; files and buckets before it are whole, later ones are
    ruled out by literals that reach the scan, and only the cut bucket's keys are sorted: ``size`` rows
    where keys are dense. Of rows that tie at the cut any stay; fewer rows than ``most`` stay all."""
    bucket = F.floor(F.col(key) / size)
    counts = lines.groupBy(file, bucket.alias("__bucket")).agg(F.count("*").alias("__n"))
    first = running_offsets(sampled_ranges(counts, [file, "__bucket"], "__range"), [], F.col("__range"), [file, "__bucket"], F.col("__n"), "__first")
    cut = first.where((F.col("__first") < most) & (F.col("__first") + F.col("__n") > most)).first()
    if cut is None:  # the cap falls between two buckets, or beyond them all
        last = first.where(F.col("__first") + F.col("__n") == most).first()
        if last is None:
            return lines if most > 0 else lines.limit(0)
        return lines.where(_before(file, last[file]) | (_same(file, last[file]) & (_before(key, last["__bucket"], size) | _within(key, last["__bucket"], size))))
    here, b = _same(file, cut[file]), cut["__bucket"]
    whole = lines.where(_before(file, cut[file]) | (here & _before(key, b, size)))
    # At most one bucket's rows: one task sorts them.
    return whole.unionByName(lines.where(here & _within(key, b, size)).orderBy(F.asc_nulls_first(key)).limit(most - cut["__first"]))


def _before(column: str, value, size: int | None = None) -> Column:
    """Rows before a value, or before the bucket of that number, in an ascending order with nulls first."""
    if value is None:
        return F.lit(False)
    return F.col(column).isNull() | (F.col(column) < (value if size is None else value * size))


def _same(column: str, value) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == F.lit(value)


def _within(key: str, bucket: int | None, size: int) -> Column:
    return F.col(key).isNull() if bucket is None else (F.col(key) >= bucket * size) & (F.col(key) < (bucket + 1) * size)
