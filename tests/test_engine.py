"""Golden, property and oracle tests of the engine."""
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.functions import stats as S, text as X
from corpusloom.operators import ranking, segment, tokens
from corpusloom.plans import registry
from corpusloom.sources import files
from corpusloom.streaming import perturb

SF = "/root/testdata/sf0.001"

GOLDEN = [
    ("The black cat is eating a fresh fish.", "fish fresh a eating is cat black The.", "Not The black cat is eating a fresh fish."),
    ("She can read books quickly.", "quickly books read can She.", "She can read books quickly Not."),
    ("Really?!", "Really.", "Really Not."), ("...", ".", "Not ."), ("", ".", "Not ."), ("a.?! .", "a.?!.", "a.?! Not."),
]


def test_rules(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "s string")
    rows = df.select("s", X.reverse_words(F.col("s")).alias("r"), X.parity_negation(F.col("s")).alias("p")).collect()
    assert [tuple(r) for r in rows] == GOLDEN


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        assert df.count() > 0
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    order = lambda r: tuple((x is None, str(x)) for x in r)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=order) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=order)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "pos", "rule", "result"]


def test_chunks(spark):
    def plain(text, size):
        out, cur = [], ""
        import re
        for s in re.split(r"(?<=[.!?])\s+", text):
            if len(cur) + len(s) < size:
                cur += s + " "
            else:
                if cur:
                    out.append(cur.strip(" "))
                cur = s + " "
        return out + ([cur.strip(" ")] if cur else [])

    rows = registry.docs(spark, SF).limit(50).select("text", segment.chunks(F.col("text"), 500).alias("c")).collect()
    assert all(r.c == plain(r.text, 500) for r in rows)


def test_p_value(spark):
    # two-sided P for one degree of freedom has a closed form
    rows = spark.createDataFrame([(t,) for t in (0.0, 0.3, 1.0, 4.0, 12.0)], "t double").select("t", S.two_sided_p(F.col("t"), F.lit(1.0)).alias("p")).collect()
    assert all(math.isclose(r.p, 1 - 2 / math.pi * math.atan(r.t), rel_tol=1e-6) for r in rows)


def test_degenerate_statistics(spark):
    df = spark.createDataFrame([(1, 2.0, None, 1, 2.0, None), (3, 1.0, 0.0, 3, 1.0, 0.0)], "n1 long, m1 double, s1 double, n2 long, m2 double, s2 double")
    x = [F.col(c) for c in df.columns]
    r = df.select(S.cohens_d(*x).alias("d"), S.effect_class(S.cohens_d(*x)).alias("e"), S.significance(S.welch_t(*x)).alias("s")).collect()
    assert [tuple(y) for y in r] == [(None, "large", "not_significant")] * 2


def test_number_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    got = ranking.number_rows(df, ["k"], F.floor(F.col("id") / 50), ["id"]).where("rn != floor(id / 3) + 1")
    assert got.isEmpty()


def test_file_blocks(spark):
    # A source loses one ragged tail; short documents fill blocks together.
    d = registry.docs(spark, SF)
    n = {r.source: r.n for r in d.groupBy("source").agg(F.sum(F.size(X.words(F.col("text")))).alias("n")).collect()}
    got = {r.source: r.n for r in registry.QUERIES["s9_file_blocks"](spark, SF).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got == {s: k // tokens.WIDTH for s, k in n.items() if k >= tokens.WIDTH}


def test_running_offsets(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    got = {r.id: r.offset for r in ranking.running_offsets(df, ["k"], F.floor(F.col("id") / 50), ["id"], F.col("id") % 7).collect()}
    assert got == {i: sum(j % 7 for j in range(i % 3, i, 3)) for i in range(1000)}


def test_reference_caps(spark, monkeypatch):
    monkeypatch.setattr(registry, "docs", lambda s, d: s.range(100_003).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a").alias("text")))
    assert registry.QUERIES["v3_reference_cap"](spark, "").first().freq == 100_000
    assert registry.QUERIES["o5_reference_cap"](spark, "").count() == 100_000


def test_character_digest(spark, monkeypatch):
    # A change after the twentieth token shows.
    monkeypatch.setattr(registry, "docs", lambda s, d: s.createDataFrame([(1, "a" * 30), (2, "a" * 29 + "b")], "doc_id long, text string"))
    assert len({r.chars_md5 for r in registry.QUERIES["v1_character_digest"](spark, "").collect()}) == 2


def test_framing(spark):
    df = spark.createDataFrame([([2, 3, 4],), ([2],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(tokens.framed(F.col("ids"), F.size("ids"), 2)).collect()] == [[3, 4], [2, 0], [0, 0]]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.train").write_text("One two.\n\n  Three four five!  \n")
    (tmp_path / "in" / "b.txt").write_text("no\n")
    src = str(tmp_path / "in")
    lines = files.read_lines(spark, src, pattern="*.train")
    assert sorted(r.line for r in lines.collect()) == ["One two.", "Three four five!"]
    with pytest.raises(FileNotFoundError):
        files.read_lines(spark, src, pattern="*.none")
    assert files.line_counts(spark, src, "*.train").first().n_lines == 3
    assert files.list_files(spark, src, "*.txt").first().size == 3
    files.write_rules(lines, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert {r.value for r in back.where("rule = 'reversed'").collect()} == {"two One.", "five four Three."}
    files.write_prefixed(lines, str(tmp_path / "pre"))
    assert spark.read.text(str(tmp_path / "pre")).count() == 6
    (tmp_path / "m.json").write_text(json.dumps({"losses": [2.0, 1.0], "perplexities": [7.0, float("inf")], "total_training_time": 3.0, "dataset": "x"}))
    runs = files.read_metrics(spark, str(tmp_path / "m.json"))
    assert runs.first().training_time == 3.0
    assert [tuple(r) for r in files.metric_points(runs).orderBy("step").collect()] == [("x", 1, 2.0, 7.0), ("x", 2, 1.0, float("inf"))]
    assert files.read_latest_state(spark, str(tmp_path / "none")).first().global_step == 0


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One two. Three four five!\nSix.\n")
    q = perturb.start_rewrite(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("rule", "sentence").collect())
    assert got == sorted(tuple(r) for r in perturb.rewritten(spark.read.text(str(tmp_path / "in"))).collect())
