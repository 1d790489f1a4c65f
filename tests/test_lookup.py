"""Lookups by number, permuted epochs and draws on an index."""
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import locate, permute, ranking, sampling, tokens


def plain_permuted(x, n, seed):
    a, b = permute.bases(n)
    mix = lambda v, k: int(hashlib.md5(f"{v}/{seed}/{k}".encode()).hexdigest()[:8], 16)
    while True:
        left, right = divmod(x, b)
        left = (left + mix(right, 0)) % a
        right = (right + mix(left, 1)) % b
        left = (left + mix(right, 2)) % a
        right = (right + mix(left, 3)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 31, 1000, 1023, 4097])
def test_permutation_is_a_bijection(spark, n):
    d = spark.range(n).select("id", permute.permuted(F.col("id"), n, "epoch-1").alias("p"), permute.permuted(F.col("id"), n, "epoch-2").alias("q"))
    rows = d.withColumn("back", permute.permuted(F.col("p"), n, "epoch-1", back=True)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) == sorted(r.q for r in rows)
    assert all(r.back == r.id and r.p == plain_permuted(r.id, n, "epoch-1") for r in rows)
    if n >= 31:  # orders differ, and neighbours part
        assert sum(r.p == r.q for r in rows) < 0.2 * n and sum(abs(r.p - r.id) <= 1 for r in rows) < 0.2 * n


def test_batches_of_an_epoch(spark):
    n = 205
    rows = permute.epoch_batches(spark.range(1, n + 1).withColumnRenamed("id", "rn"), n, 3).collect()
    for e in (1, 2, 3):
        own = [r for r in rows if r.epoch == e]
        assert Counter(r.batch for r in own) == Counter(k // 32 for k in range(n))
        for b in (0, 6):
            assert {r.rn for r in permute.batch_numbers(spark, n, e, b).collect()} == {r.rn for r in own if r.batch == b}
    assert {r.rn for r in rows if r.epoch == 1 and r.batch == 0} != {r.rn for r in rows if r.epoch == 2 and r.batch == 0}


def test_locate(spark):
    rng = random.Random(3)
    spans, at = [], Counter()
    for k in range(700):
        key, length = rng.choice([None, "a", "b"]), rng.choice([0, 1, 5, 5, 9, 4000 if k == 300 else 2])
        spans.append((key, k, at[key], length))
        at[key] += length
    points = [(rng.choice([None, "a", "b", "c"]), rng.randrange(-5, 6000), k) for k in range(900)] + [("a", None, -1)]
    found = locate.locate(spark.createDataFrame(points, "key string, at long, p int"), "at", spark.createDataFrame(spans, "key string, span int, first long, n long"), "first", "n", ["key"])
    want = {(p, s) for key, x, p in points for k2, s, f, n in spans if key == k2 and x is not None and f <= x < f + n}
    assert {(r.p, r.span) for r in found.collect()} == want and found.count() == len(want)
    assert locate.locate(spark.createDataFrame(points, "key string, at long, p int"), "at", spark.createDataFrame([], "key string, span int, first long, n long"), "first", "n", ["key"]).count() == 0


def test_examples_at(spark, monkeypatch):
    """Any set of numbers gives the rows of prefix_examples."""
    monkeypatch.setattr(ranking, "ROWS", 30)
    rng = random.Random(4)
    lines = [(k * 3, [rng.randrange(2, 50) for _ in range(rng.choice([0, 1, 2, 3, 40, 200]))]) for k in range(200)]
    d = spark.createDataFrame(lines, "doc_id long, ids array<int>").repartition(4)
    every = [(r.doc_id, r.i, r.input, r.target) for r in tokens.prefix_examples(d).orderBy("doc_id", "i").collect()]
    index = locate.example_index(d, "doc_id", F.greatest(F.size("ids") - 1, F.lit(0)))
    asked = [0, 1, len(every) - 1, len(every), -1, *rng.sample(range(len(every)), 60), 5, 5]
    got = locate.examples_at(spark.createDataFrame([(x,) for x in asked], "number long"), "number", index, d, "doc_id")
    rows = tokens.example(got.select("number", "doc_id", "i", "ids")).collect()
    assert Counter((r.number, r.doc_id, r.i, tuple(r.input), r.target) for r in rows) == Counter((x, a, b, tuple(c), e) for x in asked if 0 <= x < len(every) for a, b, c, e in [every[x]])


def test_draws_sort_only_their_buckets(spark):
    lines = spark.range(200_000).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), "id")
    draws = spark.createDataFrame([(0, "f1", 1), (1, "f2", 66_666), (2, "f1", 30_000), (3, "f1", 1)], "draw int, file string, line long")
    got = locate.two_level_draws(lines, "file", "id", draws, size=1000)
    assert {(r.draw, r.id) for r in got.collect()} == {(0, 1), (1, 199_997), (2, 89_998), (3, 1)}
    # Three buckets of 334 lines at most reach the window.
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    semi, window = plan.find("LeftSemi"), plan.find("Window [row_number")
    assert 0 <= window < semi, "rows are thinned out below the sort"


def test_two_level_sample_with_null_files(spark):
    lines = spark.createDataFrame([(None if k % 3 == 0 else f"s{k % 2}", k) for k in range(300)], "source string, doc_id long")
    rows = sampling.two_level_sample(lines, "source", "doc_id", 500).collect()
    assert len(rows) == 500 and len({r.draw for r in rows}) == 500 and Counter(r.source for r in rows)[None] > 100
