"""Native span helpers: where a regular expression matches, as DataFrame functions. All are linear in
the number of matches, but for a step of CHUNK elements: an array that grows by one element at a time
is copied each time, so running values are made chunk by chunk."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each element the fold of those before it. merge must be associative, zero its neutral element."""
    none = F.expr(f"cast(array() as array<{kind}>)")

    def scan(array: Column, start: Column) -> Column:
        return F.aggregate(array, F.struct(start.alias("at"), none.alias("out")), lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def chunked(v: Column) -> Column:
        part = lambda c: F.slice(v, c * CHUNK + 1, CHUNK)
        numbers = F.when(F.size(v) > 0, F.sequence(F.lit(0), ((F.size(v) - 1) / CHUNK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        starts = scan(F.transform(numbers, lambda c: F.aggregate(part(c), zero, merge)), zero)
        return let(starts, lambda at: F.flatten(F.transform(numbers, lambda c: scan(part(c), F.get(at, c)))))

    return let(values, chunked)


def match_spans(text: Column, regex: Column, context: int = 0) -> Column:
    """array<struct<start, end, match, before, after>> of all matches, offsets in characters.
    ``regex`` must not match the empty string. ``before`` and ``after`` hold up to ``context``
    characters of the text between this match and its neighbours."""
    def spans(parts: Column) -> Column:
        pairs = F.zip_with(F.regexp_extract_all(text, regex, F.lit(0)), F.slice(parts, 1, F.size(parts) - 1), lambda m, a: F.struct(m.alias("m"), F.right(a, F.lit(context)).alias("a"), F.length(a).alias("gap"), F.length(m).alias("n")))
        pairs = F.zip_with(pairs, F.slice(parts, 2, F.size(parts)), lambda p, b: F.struct(p.alias("p"), F.left(b, F.lit(context)).alias("b")))
        return let(pairs, placed)

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda x: x["p"]["gap"] + x["p"]["n"]), F.lit(0), lambda s, x: s + x)
        return F.zip_with(pairs, before, lambda x, at: F.struct(
            (at + x["p"]["gap"]).alias("start"), (at + x["p"]["gap"] + x["p"]["n"]).alias("end"), x["p"]["m"].alias("match"), x["p"]["a"].alias("before"), x["b"].alias("after")))

    return let(F.split(text, regex, -1), spans)
