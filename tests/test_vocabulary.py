"""The vocabulary's first places: no text in a sort, null and repeated keys as in SQL."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import tokens
from corpusloom.plans import registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_text_is_sorted(spark):
    lines = spark.createDataFrame([(k, f"line {k} of some text") for k in range(50)], "doc_id long, text string")
    # A least pair, or strings beside a least key, would be aggregated by a sort of all lines per character.
    assert "SortAggregate" not in _plan(tokens.vocabulary(lines))
    assert "SortAggregate" not in _plan(tokens.encoded(lines, tokens.vocabulary(lines)))


@pytest.mark.parametrize("name", ["v4_vocabulary", "v5_vocabulary_size"])
def test_null_and_repeated_keys(spark, tmp_path, name):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "", " \t", "".join(rng.choice("abc deé中\U0001f600 ") for _ in range(rng.randrange(30)))])) for k in range(60)]
    # No two characters tie in key and place.
    rows += [(99, "zzy"), (99, "zy"), (None, "qqwvv"), (None, "q abc"), (98, "w"), (97, "vv")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_text_keys(spark):
    lines = spark.createDataFrame([("b", "xaa"), ("a", "yxy"), ("a", "yya")], "item string, text string")
    assert {r.token: r.id for r in tokens.vocabulary(lines, "item").collect()} == {"<PAD>": 0, "<UNK>": 1, "y": 2, "x": 3, "a": 4}


def test_drawn_examples_look_up_what_they_hold(spark):
    lines = spark.createDataFrame([(1, " " + "ab c" * 60 + "\n"), (2, "é\U0001f600 \U0001f600z"), (3, None), (4, "x"), (5, " ")], "doc_id long, text string")
    vocab = tokens.vocabulary(lines)
    e = tokens.encoded(lines, vocab)
    want = {(r.doc_id, r.i): (r.input, r.target) for r in tokens.prefix_examples(e).collect()}
    at = lines.select("doc_id", "text", tokens.example_count(F.col("text")).alias("n")).where("n > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    got = tokens.encoded_examples(at, vocab)
    assert {(r.doc_id, r.i): (r.input, r.target) for r in got.collect()} == want and len(want) == 239 + 4
