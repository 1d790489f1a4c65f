"""Numbering with outliers, ties and null keys, and the series queries on such tables against SQL."""
import datetime as dt
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ranking
from corpusloom.plans import registry


def test_outlier_leaves_even_ranges(spark):
    # One value far away: equal widths would leave all others in one range.
    d = spark.range(50_000).select(F.when(F.col("id") == 0, F.lit(-1e12)).otherwise(F.col("id").cast("double")).alias("v"), "id")
    sizes = [r["count"] for r in ranking.sampled_ranges(d, ["v", "id"], "b", rows=2_000).groupBy("b").count().collect()]
    assert 20 <= len(sizes) <= 25 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_ties_and_nulls_are_split_by_the_second_column(spark):
    d = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit("same")).alias("v"), "id").repartition(5)
    b = ranking.sampled_ranges(d, ["v", "id"], "b", rows=1_000).cache()
    sizes = [r["count"] for r in b.groupBy("b").count().collect()]
    assert len(sizes) >= 18 and max(sizes) <= 2_000
    ends = b.groupBy("b").agg(F.min(F.struct("v", "id")).alias("lo"), F.max(F.struct("v", "id")).alias("hi")).orderBy("b").collect()
    key = lambda s: (s.v is not None, s.v or "", s.id)
    assert all(key(x.hi) < key(y.lo) for x, y in zip(ends, ends[1:]))


def test_numbers_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(40)]), k) for k in range(5_000)]
    d = ranking.sampled_ranges(spark.createDataFrame(rows, "k string, v long, id long").repartition(4), ["v", "id"], "b", rows=300)
    got = {r.id: (r.rn, r.offset) for r in ranking.running_offsets(ranking.number_rows(d, ["k"], F.col("b"), ["v", "id"]), ["k"], F.col("b"), ["v", "id"], F.col("id") % 7).collect()}
    want, n, total = {}, Counter(), Counter()
    for k, _, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        n[k] += 1
        want[i] = n[k], total[k]
        total[k] += i % 7
    assert got == want


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "k", "y"), (None, "k", "z")], "p int, q string, v string")
    b = spark.createDataFrame([(1, None, 10), (None, "k", 20)], "p int, q string, w int")
    assert sorted((r.v, r.w) for r in ranking.null_safe_join(a, b, ["p", "q"]).collect()) == [("x", 10), ("z", 20)]
    assert ranking.null_safe_join(a, b, ["p", "q"], "left").count() == 3


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with null keys, null times and one event of 1970."""
    d = str(tmp_path_factory.mktemp("odd"))
    rng, t0 = random.Random(9), dt.datetime(2024, 1, 1)
    e = [(k, None if k % 41 == 0 else t0 + dt.timedelta(minutes=rng.randrange(60_000)), k % 7, rng.choice([None, "click", "view", "cart"]), round(rng.uniform(0, 400), 2), "{}") for k in range(3_000)]
    e[17] = (17, dt.datetime(1970, 1, 1), 3, "click", 5.0, "{}")
    spark.createDataFrame(e, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(3).write.parquet(f"{d}/events.parquet")
    docs = [(k, f"a b {k}. c d e{k}", "en", None if k % 5 == 0 else f"s{k % 3}", 9) for k in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["w1_steps", "w2_running_mean", "w3_logged_steps", "w4_tumbling_mean", "w5_best_so_far", "w6_first_last", "w7_common_length", "w8_axis", "g1_curves", "g2_control_curves", "g4_final_vs_min", "a20_series_arrays", "a21_run_summary",
                                  "j4_aligned_series", "o3_head", "o6_early_stop", "r1_exact_split", "r2_batches", "r3_two_level_sample", "s9_file_blocks"])
def test_series_with_nulls(spark, odd, monkeypatch, name):
    monkeypatch.setattr(ranking, "ROWS", 200)  # 15 ranges of events, 2 of documents
    duck = duckdb.connect()
    duck.sql("SET default_null_order = 'nulls_first'")
    for t in ("events", "documents"):
        duck.sql(f"create view {t} as select * from '{odd}/{t}.parquet/*.parquet'")
    want = duck.sql(registry.ORACLE_SQL[name])
    cols = sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    got = Counter(tuple(show(r[c]) for c in cols) for r in registry.QUERIES[name](spark, odd).collect())
    assert got == Counter(tuple(show(r[k]) for k in at) for r in want.fetchall())
