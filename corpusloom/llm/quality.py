"""Quality rules with adaptive thresholds (method: mergeable quantile sketches, joined filtering).

One pass turns each text into integer counts. Every ratio goes into a mergeable sketch per
(lang, source): a histogram whose buckets keep six significant bits, so merging adds counts, the
result does not depend on merge order, and a quantile is off by 1/32 at most. Thresholds are outer
fences read from the sketches (upper quartile + 3 interquartile ranges + a slack). A group's ceiling
is drawn towards its language's, and that towards the ceiling of all rows, as if PRIOR more rows had
it: a group of a few rows goes by its language, one of thousands by itself, and there is no size at
which the rule changes. No ceiling is above the bound of its language: the median of the groups'
ceilings plus seven median deviations, or the slack if that is more (the same fence, in measures that
half of the groups cannot shift), so a source that is mostly junk cannot vouch for itself. A language
with fewer than ``min_sources`` groups, which have no majority, takes the bound of all groups. The
ceilings are joined back and applied. A corpus of which half the groups are junk has no such bound to
go by.

Defined cases: null text counts as empty (no words: base_failed); null lang or source is a group
of its own; repeated rows each give a row; an empty table gives an empty result; a very long text is
counted whole, in one task; a ratio equal to its ceiling passes; extra columns, whatever their names,
are ignored by the report and kept by the filter, and only doc_id, text, lang and source are needed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import materialize

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_shout long, n_lines long"
#: metric: (numerator, denominator, slack in thousandths beyond the fence)
METRICS = {
    "symbols": ("n_symbols", "word_chars", 30),
    "repeats": ("n_repeat_words", "n_words", 150),
    "dup_lines": ("n_dup_lines", "n_lines", 250),
    "upper": ("n_upper", "word_chars", 150),
    "shout": ("n_shout", "word_chars", 50),
}
MIN_WORDS, MAX_REPEAT_PERCENT, PRIOR, FENCE, MIN_SOURCES = 50, 50, 40, 3, 3
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS."""
    import numpy as np
    from collections import defaultdict
    from itertools import count

    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * 8
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if n > 3:
        ids = defaultdict(count().__next__)
        a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
        v = len(ids)
        if v < n:
            if v < 1 << 21:
                key = (a[:-2] * v + a[1:-1]) * v + a[2:]
            else:  # number the pairs first, so that keys stay below 2**63
                pair = np.unique(a[:-1] * v + a[1:], return_inverse=True)[1]
                key = pair[:-1] * v + a[2:]
            _, inverse, often = np.unique(key, return_inverse=True, return_counts=True)
            again = often[inverse] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeats = int(covered.sum())
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, upper, text.count("!"), len(lines)


def _count_batches(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in COUNTS.split(", ")]
    for b in batches:
        rows = [count_text(t) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        rest = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), *(pa.array(c, pa.int64()) for c in cols)], names=[*rest, *names])


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the counts of every whole text; the text itself is not carried on."""
    d = docs.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name != "text")
    return d.mapInArrow(_count_batches, f"{kept}, {COUNTS}")


def base_failed(prefix: str = "") -> Column:
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)


def _ratio(metric: str, prefix: str = "") -> Column:
    """In thousandths, rounded down; 0 where there is nothing to divide by."""
    top, below, _ = METRICS[metric]
    top, below = F.col(prefix + top), F.col(prefix + below)
    return F.when(below > 0, F.floor(1000 * top / below)).otherwise(0).cast("long")


def bucket(v: Column) -> Column:
    """The lower end of v's sketch bucket: v with all but its six leading bits cleared."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 6, F.lit(0)))
    return (F.floor(v / step) * step).cast("long")


def sketches(counts: DataFrame) -> DataFrame:
    """(level, lang, source, metric, bucket, n): level 0 for (lang, source), 1 for lang, 2 for all.
    The upper levels are merged from the lower ones, not recounted."""
    long = counts.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(_ratio(m)).alias("bucket")) for m in METRICS))).alias("x"))
    own = long.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    lang = own.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    every = lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    cols = ["level", "lang", "source", "metric", "bucket", "n"]
    return (own.withColumn("level", F.lit(0)).select(cols)
            .unionByName(lang.withColumns({"level": F.lit(1), "source": none}).select(cols))
            .unionByName(every.withColumns({"level": F.lit(2), "lang": none, "source": none}).select(cols)))


def quantiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, metric, total, q1, q3) of every sketch. A sketch has 1,000 buckets at
    most, so the array that one group gathers is bounded whatever the input."""
    groups = sketch.groupBy("level", "lang", "source", "metric").agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("h"))
    at = lambda q: F.aggregate(
        "h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v")),
        lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["v"], F.when((s["seen"] + x["n"]) * 4 >= F.col("total") * q, x["bucket"])).alias("v")),
        lambda s: s["v"])
    return groups.select("level", "lang", "source", "metric", "total", at(1).alias("q1"), at(3).alias("q3"))


def bounds(groups: DataFrame, *keys: str) -> DataFrame:
    """(keys, groups, __bound_<metric>): per key the median of the groups' ceilings and, beyond it, the
    outer fence in median deviations (2 * FENCE + 1 of them, as for a symmetric spread), at least the
    metric's slack."""
    mid = groups.groupBy(*keys).agg(F.count("*").alias("groups"), *(F.median(f"__max_{m}").alias(f"__mid_{m}") for m in METRICS)).alias("m")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"g.{k}").eqNullSafe(F.col(f"m.{k}"))
    off = groups.alias("g").join(mid, same).select(*(F.col(f"g.{k}").alias(k) for k in keys), "groups", *(F.col(f"__mid_{m}") for m in METRICS), *(F.abs(F.col(f"__max_{m}") - F.col(f"__mid_{m}")).alias(f"__off_{m}") for m in METRICS))
    return off.groupBy(*keys).agg(F.max("groups").alias("groups"), *(F.floor(F.max(f"__mid_{m}") + F.greatest((2 * FENCE + 1) * F.median(f"__off_{m}"), F.lit(METRICS[m][2]))).alias(f"__bound_{m}") for m in METRICS))


def thresholds(counts: DataFrame, prior: int = PRIOR, min_sources: int = MIN_SOURCES) -> DataFrame:
    """One row per (lang, source) that occurs, with a ceiling for each metric."""
    q = quantiles(sketches(counts)).withColumn("top", F.col("q3") + FENCE * (F.col("q3") - F.col("q1")))
    tops = materialize(q.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *(F.max(F.when(F.col("metric") == m, F.col("top") + METRICS[m][2])).alias(f"__max_{m}") for m in METRICS)), "fences")
    own, lang, every = (tops.where(F.col("level") == k).alias(f"l{k}") for k in range(3))
    drawn = lambda n, x, y: F.floor((n * x + prior * y) / (n + prior))
    of = lambda k, m: F.col(f"l{k}.__max_{m}")
    total = [F.col(f"l{k}.total") for k in range(2)]
    j = own.join(lang, F.col("l0.lang").eqNullSafe(F.col("l1.lang"))).join(F.broadcast(every), F.col("l2.level") == 2)
    groups = materialize(j.select("l0.lang", "l0.source", *(drawn(total[0], of(0, m), drawn(total[1], of(1, m), of(2, m))).alias(f"__max_{m}") for m in METRICS)), "groups")
    of_lang, of_all = bounds(groups, "lang").where(F.col("groups") >= min_sources).alias("b1"), bounds(groups).alias("b2")
    j = groups.alias("g").join(of_lang, F.col("g.lang").eqNullSafe(F.col("b1.lang")), "left").join(F.broadcast(of_all), F.lit(True), "left")
    return j.select(F.col("g.lang").alias("__t_lang"), F.col("g.source").alias("__t_source"), *(F.least(f"g.__max_{m}", F.coalesce(f"b1.__bound_{m}", f"b2.__bound_{m}")).alias(f"__max_{m}") for m in METRICS))


def judge(counts: DataFrame) -> DataFrame:
    """counts with base_failed, kept and the ceilings that were applied. counts must be
    materialised: it is read for the sketches and again for the join."""
    # Written, so that their size is known and the rows are not dealt out by source to meet them.
    limits = materialize(thresholds(counts), "ceilings")
    ok = F.lit(True)
    for m in METRICS:
        ok = ok & (_ratio(m) <= F.col(f"__max_{m}"))
    j = counts.join(limits, F.col("lang").eqNullSafe(F.col("__t_lang")) & F.col("source").eqNullSafe(F.col("__t_source")), "left")
    return j.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(True))).drop("__t_lang", "__t_source")


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the ceilings, base_failed and kept for every row of docs."""
    return judge(materialize(text_counts(docs, "doc_id", "lang", "source"), "quality"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """docs without the rows that are rejected, all columns as they were. Rows are written with their
    counts, once; the verdict depends on these and on the group's ceilings, so the small table of
    ceilings meets the rows, none is looked up by doc_id, and repeated ids do no harm."""
    names = [x.split()[0] for x in COUNTS.split(", ")]
    at = {n: k for k, n in enumerate(docs.columns)}
    kinds = T.StructType([*(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [count_text(t) for t in b.column(at["text"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names)))], names=kinds.names)

    counted = materialize(docs.mapInArrow(run, kinds), "quality").withColumns({"lang": F.col(f"c{at['lang']}"), "source": F.col(f"c{at['source']}")})
    kept = judge(counted).where("kept")
    return kept.select(*(F.col(f"c{k}").alias(n) for n, k in at.items()))
