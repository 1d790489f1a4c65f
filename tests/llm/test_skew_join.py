"""Joins by key with and without hot keys."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.common import skew_join


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [False, True])
def test_same_join_whatever_the_keys(spark, hot, how):
    rows = spark.range(6_000).select("id", (F.when(F.col("id") < 3_000, F.lit(7)).otherwise(F.col("id")) if hot else F.col("id") % 3_000).alias("key"))
    one = spark.range(0, 6_000, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v")).unionByName(spark.createDataFrame([(7, 70)], "key long, v long"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("k"))
    got = skew_join(rows, one, ["key"], sizes, 6_000, F.col("id"), how)
    want = rows.join(one, "key", how).select(*got.columns)
    assert Counter(got.collect()) == Counter(want.collect())
    # The join has the same keys in either case, so the counts of two inputs' joins mean the same.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join" in x and "__share" in x for x in plan.splitlines())
