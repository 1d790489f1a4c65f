"""URL rules by sort-merge range join.

A rule's canonical key is its host with the labels reversed, a slash, then its path; it is a prefix
of the keys of just the pages that it fits, seen from its own host. So each rule is the interval of
the strings that start with its key, and intervals nest or are disjoint. A page gives one probe for
each of its host's suffixes, no deeper than the deepest rule. Probes and rule starts are range-sorted
together; the sweep carries the latest rule start with the stack of rules around it, and the page
takes the innermost one on the stack that contains the probe. The range sort splits hot hosts; the
rule open at the start of a range is carried in from the ranges before it.

Defined cases: a null url, or one without ``://``, has an empty host and path and takes the default
verdict; of equal rules with both verdicts block wins, of rules of equal length the one with the longer
host; a null page_id is an id like any other; a very long url is one probe for each of its host's
labels, no deeper than the deepest rule; repeated rows each give a row; no pages give no rows, and with
no rules every page takes the default; extra columns, whatever their names, are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack) of each distinct rule of (verdict, host, path): the stack holds the rule and all
    rules around it, innermost first. A key's prefixes meet the other keys in an equi-join."""
    host = F.translate("host", UPPER, LOWER)
    r = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
         .select(F.concat(F.array_join(reversed_labels(host), "."), F.lit("/"), "path").alias("key"), F.concat(host, "path").alias("rule"), "verdict", F.length(host).alias("host_length"))
         .groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"), F.max("host_length").alias("host_length")))
    inner = r.select(F.col("key").alias("own"), F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda k: F.left("key", k))).alias("key"))
    entry = F.struct((-F.length("key")).alias("order"), "key", "rule", "verdict", F.length("rule").alias("size"), "host_length")
    return inner.join(r, "key").groupBy("own").agg(F.array_sort(F.collect_list(entry)).alias("stack")).withColumnRenamed("own", "key")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages."""
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1
    # Rows that agree are judged once; n brings them back.
    urls = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("n"))
    labels = reversed_labels(host_of(F.col("url")))
    probes = (urls.withColumn("labels", labels).withColumn("path", path_of(F.col("url")))
              .withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))))
              .select(F.concat(F.array_join(F.slice("labels", 1, F.col("k")), "."), F.lit("/"), "path").alias("key"), F.lit(1).alias("is_probe"), "page_id", "url", "n"))
    stacks = materialize(rule_stacks(rules), "rules")
    events = probes.withColumn("stack", F.lit(None).cast(stacks.schema["stack"].dataType)).unionByName(stacks.withColumn("is_probe", F.lit(0)), allowMissingColumns=True)
    swept = materialize(events.repartitionByRange("key", "is_probe", "page_id", "url").withColumn("part", F.spark_partition_id()), "sweep")
    order = ["key", "is_probe", "page_id", "url"]
    here = F.last("stack", ignorenulls=True).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # What is open where a range begins: one row per range.
    carried = (swept.groupBy("part").agg(F.max_by("stack", F.when(F.col("is_probe") == 0, F.col("key"))).alias("top"))
               .select("part", F.last("top", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")))
    open_ = F.filter(F.coalesce("here", "carried"), lambda s: F.startswith(F.col("key"), s["key"]))
    best = (swept.withColumn("here", here).where("is_probe = 1").join(carried, "part")
            .select("page_id", "url", "n", F.get(open_, F.lit(0)).alias("r"))
            .groupBy("page_id", "url").agg(F.max("n").alias("n"), F.max(F.when(F.col("r").isNotNull(), F.struct("r.size", "r.host_length", "r.rule", "r.verdict"))).alias("r")))
    return best.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("r.rule").alias("rule"),
                       F.coalesce("r.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).drop("copy")
