"""Row numbers over a whole table without one task sorting it. Null keys are keys of their own."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that one task should sort; ranges at most; sampled rows for each range.
ROWS, MOST_RANGES, SAMPLED = 1_000_000, 4096, 64


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right joined on keys of the same names, null with null; the keys are left's."""
    own = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys))
    return left.join(own, same, how).drop(*(f"__right_{k}" for k in keys))


def _place(order: list[Column], df: DataFrame) -> Column:
    """The order columns as one value that compares like them; times as microseconds."""
    kinds = df.select(*(c.alias(f"f{k}") for k, c in enumerate(order))).schema
    plain = [F.unix_micros(c.cast("timestamp")) if f.dataType.typeName().startswith("timestamp") else c for c, f in zip(order, kinds)]
    return F.struct(*(c.alias(f"f{k}") for k, c in enumerate(plain)))


def range_edges(df: DataFrame, place: Column, ranges: int, total: int) -> list:
    """The least sampled place of each range but the first: ranges - 1 values at most, whatever the table."""
    s = df.select(place.alias("s"))
    share = SAMPLED * ranges / max(total, 1)
    s = s.sample(share, seed=11) if share < 0.5 else s
    least = s.repartitionByRange(ranges, "s").groupBy(F.spark_partition_id().alias("p")).agg(F.min("s").alias("s"))
    return [r["s"] for r in sorted(least.collect(), key=lambda r: r["p"])][1:]


def range_number(place: Column, edges: list, kind) -> Column:
    """How many edges are at or below a place, by binary search in a literal array."""
    if not edges:
        return F.lit(0).cast("long")
    array = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(e, kind))) for e in edges))
    steps = [1 << k for k in range(len(edges).bit_length() - 1, -1, -1)]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= place, at + step).otherwise(at))
    return found.cast("long")


def sampled_ranges(df: DataFrame, order: list, name: str, rows: int | None = None) -> DataFrame:
    """df with ``name``: a range number that never decreases along ``order`` (columns, ascending, nulls
    first), as many ranges as ``rows`` go into the table. Ranges are cut at sampled places, so they
    hold about as many rows each, however values lie; the places are literals, so that every branch of
    a plan sees the same ranges. Rows that tie in all of ``order`` share a range."""
    total = df.count()
    ranges = min(MOST_RANGES, -(-total // (rows or ROWS)))
    if ranges < 2:
        return df.withColumn(name, F.lit(0).cast("long"))
    place = _place([F.col(c) if isinstance(c, str) else c for c in order], df)
    return df.withColumn(name, range_number(place, range_edges(df, place, ranges, total), df.select(place.alias("s")).schema["s"].dataType))


def even_buckets(df: DataFrame, value: Column, name: str, rows: int | None = None) -> DataFrame:
    """sampled_ranges along one value."""
    return sampled_ranges(df, [value], name, rows)


def _key(keys: list[str]) -> Column:
    """The keys as one value that is never null and equals itself where they are null."""
    return F.struct(*keys) if keys else F.struct(F.lit(0))


def number_rows(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "rn") -> DataFrame:
    """``row_number`` over (keys, order) where ``bucket`` never decreases along that order. Rows are
    sorted within their bucket only; the buckets' counts, one row each, give the offsets."""
    d = df.withColumns({"__key": _key(keys), "__b": bucket})
    counts = d.groupBy("__key", "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__key", "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__first"))
    own = Window.partitionBy("__key", "__b").orderBy(*order)
    d = null_safe_join(d.withColumn(name, F.row_number().over(own)), first, ["__key", "__b"])
    return d.withColumn(name, (F.col(name) + F.col("__first")).cast("long")).drop("__key", "__b", "__first")


def running_sums(df: DataFrame, keys: list[str], bucket: Column, order: list, sizes: dict[str, Column]) -> DataFrame:
    """For each name the sum of its column over the rows before each one per keys, in an order along
    which ``bucket`` never decreases. Sorted and summed as in number_rows."""
    d = df.withColumns({"__key": _key(keys), "__b": bucket, **{f"__size_{n}": c for n, c in sizes.items()}})
    sums = d.groupBy("__key", "__b").agg(*(F.sum(f"__size_{n}").alias(f"__n_{n}") for n in sizes))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    w = before.partitionBy("__key").orderBy("__b")
    none = lambda n: F.lit(0).cast(d.schema[f"__size_{n}"].dataType)
    first = sums.select("__key", "__b", *(F.coalesce(F.sum(f"__n_{n}").over(w), none(n)).alias(f"__first_{n}") for n in sizes))
    own = before.partitionBy("__key", "__b").orderBy(*order)
    d = null_safe_join(d.withColumns({n: F.coalesce(F.sum(f"__size_{n}").over(own), none(n)) for n in sizes}), first, ["__key", "__b"])
    return d.withColumns({n: F.col(n) + F.col(f"__first_{n}") for n in sizes}).drop("__key", "__b", *(f"__{x}_{n}" for n in sizes for x in ("size", "first")))


def running_offsets(df: DataFrame, keys: list[str], bucket: Column, order: list, size: Column, name: str = "offset") -> DataFrame:
    """running_sums of one column of whole numbers."""
    return running_sums(df, keys, bucket, order, {name: size.cast("long")})
