"""Blocks over whole files and capped reads."""
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import locate, ranking, tokens


def lines(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "b", "c"]), None if k % 97 == 0 else k * 3, " ".join(f"w{k}_{j}" for j in range(rng.choice([0, 1, 2, 5, 9, 40])))) for k in range(n)]
    rows += [("c", 50, "")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "source string, doc_id long, text string")


ORDER = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("size", [1, 4, 16])
def test_file_blocks(spark, size):
    rows, df = lines(spark, 300, size)
    want = set()
    for f in {r[0] for r in rows}:
        w = [t for r in sorted((r for r in rows if r[0] == f), key=ORDER) for t in r[2].split()]
        want |= {(f, k, tuple(w[k * size:(k + 1) * size])) for k in range(len(w) // size)}
    got = [(r.source, r.block, tuple(r.tokens)) for r in tokens.file_blocks(df, "source", "doc_id", "text", X.words, size).collect()]
    assert len(got) == len(want) and set(got) == want
    assert tokens.file_blocks(df.limit(0), "source", "doc_id", "text", X.words, size).count() == 0


def test_one_file_lies_in_many_tasks(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", "8")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with texts too large for it
    s.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    df = s.range(800).selectExpr("'a' source", "id doc_id", "repeat(concat(id, ' '), 32) text")
    d = tokens.file_blocks(df, "source", "doc_id", "text", X.words, 16)
    n = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 1600 and max(n) < 400


@pytest.mark.parametrize("rows", [30, 1_000_000])
def test_file_blocks_of_lines_that_tie(spark, monkeypatch, rows):
    monkeypatch.setattr(ranking, "ROWS", rows)
    rng = random.Random(3)
    data = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(12)]), rng.choice([None, "", " ", "x", "x y z", "x y  z w", f"{k} u v w t s"])) for k in range(200)]
    df = spark.createDataFrame(data, "source string, doc_id long, text string").repartition(3)
    want = set()
    for f in {r[0] for r in data}:
        w = [t for r in sorted(((k, (t or "").split()) for g, k, t in data if g == f), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for t in r[1]]
        want |= {(f, k, tuple(w[k * 4:k * 4 + 4])) for k in range(len(w) // 4)}
    got = [(r.source, r.block, tuple(r.tokens)) for r in tokens.file_blocks(df, "source", "doc_id", "text", X.words, 4).collect()]
    assert len(got) == len(want) and set(got) == want


def test_document_blocks(spark):
    rows, df = lines(spark, 200, 5)
    want = {(r[1], k, tuple(r[2].split()[k * 4:k * 4 + 4])) for r in rows if r[1] is not None for k in range(len(r[2].split()) // 4)}
    got = [(r.doc_id, r.block, tuple(r.tokens)) for r in tokens.document_blocks(df.where("doc_id is not null"), "doc_id", X.words(F.col("text")), 4).collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Exchange" not in tokens.document_blocks(df, "doc_id", X.words(F.col("text")))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 1, 3, 60, 75, 76, 150, 299, 300, 301, 5000])
def test_first_lines(spark, most):
    rows, df = lines(spark, 300, 7)
    want = [(r[0], r[1]) for r in sorted(rows, key=ORDER)][:most]
    got = [(r.source, r.doc_id) for r in locate.first_lines(df, "source", "doc_id", most, size=64).collect()]
    assert sorted(got, key=ORDER) == want


def test_cap_reaches_the_scan(spark, tmp_path):
    df = spark.range(1000).selectExpr("concat('f', id % 4) source", "id doc_id", "'x' text")
    df.write.parquet(str(tmp_path / "t"))
    d = locate.first_lines(spark.read.parquet(str(tmp_path / "t")), "source", "doc_id", 300, size=64)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 300 and "PushedFilters: [Or(" in plan and "GreaterThanOrEqual(doc_id," in plan
