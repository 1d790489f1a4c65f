"""Run summaries, pairwise tests and chart-ready frames."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import stats as S


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """A4-A6 per group."""
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def pairwise_tests(m: DataFrame, group: str) -> DataFrame:
    """J2 with A7-A10: every unordered pair of groups. One row per group goes in."""
    a = m.select(F.col(group).alias("name1"), F.col("n").alias("n1"), F.col("mean").alias("mean1"), F.col("std").alias("std1"))
    b = m.select(F.col(group).alias("name2"), F.col("n").alias("n2"), F.col("mean").alias("mean2"), F.col("std").alias("std2"))
    j = a.join(b, F.col("name1") < F.col("name2"))
    x = [F.col(c) for c in ("n1", "mean1", "std1", "n2", "mean2", "std2")]
    j = j.withColumns({"statistic": S.welch_t(*x), "df": S.welch_df(x[0], x[2], x[3], x[5]), "cohens_d": S.cohens_d(*x), "pooled_std": S.pooled_std(x[0], x[2], x[3], x[5])})
    j = j.withColumn("p_value", S.two_sided_p(F.col("statistic"), F.col("df")))
    return j.withColumns({"significance": S.significance(F.col("p_value")), "effect_size_category": S.effect_class(F.col("cohens_d")), "stars": S.stars(F.col("p_value"))})


def test_results(tests: DataFrame, metric: str = "Loss", alpha: float = 0.05) -> DataFrame:
    """The tests of pairwise_tests as nested rows."""
    group = lambda k: F.struct(F.col(f"name{k}").alias("name"), F.col(f"mean{k}").alias("mean"), F.col(f"std{k}").alias("std"), F.col(f"n{k}").alias("n")).alias(f"group{k}")
    return tests.select("name1", "name2", F.lit(metric).alias("metric_name"), "statistic", "p_value", "cohens_d", "significance", "effect_size_category", F.lit(alpha).alias("alpha"), group(1), group(2))


def test_table(results: DataFrame) -> DataFrame:
    """The ten formatted columns of the table of tests."""
    four = lambda c: F.format_string("%.4f", F.col(c))
    return results.select(
        F.concat("group1.name", F.lit("\nvs\n"), "group2.name").alias("comparison"), four("group1.mean").alias("mean_g1"), four("group1.std").alias("std_g1"), four("group2.mean").alias("mean_g2"), four("group2.std").alias("std_g2"),
        four("statistic").alias("t_stat"), F.format_string("%.2e", F.col("p_value")).alias("p_value"), four("cohens_d").alias("cohens_d"), F.col("effect_size_category").alias("effect"), F.col("significance").alias("sig"))


def grouped_bars(results: DataFrame) -> DataFrame:
    """Per test both means with their deviations, the labels above and the effect."""
    first = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    return results.select(
        F.concat(first("name1"), F.lit("\nvs\n"), first("name2")).alias("comparison"), F.col("group1.mean").alias("mean1"), F.col("group1.std").alias("std1"), F.col("group2.mean").alias("mean2"), F.col("group2.std").alias("std2"),
        "p_value", F.when(F.col("significance") == "significant", "***").otherwise("ns").alias("label"), F.abs("cohens_d").alias("effect_size"), F.col("effect_size_category").alias("effect_label"))


def final_perplexities(s: DataFrame) -> DataFrame:
    """(dataset, final_perplexity) of the datasets whose last perplexity is finite."""
    last = s.groupBy("dataset").agg(F.max_by("loss", "step").alias("loss"))
    return last.select("dataset", S.perplexity(F.col("loss")).alias("final_perplexity")).where(F.col("final_perplexity") < float("inf"))


def run_summary(s: DataFrame) -> DataFrame:
    """One row per dataset of (dataset, step, loss)."""
    first, last = F.min_by("loss", "step"), F.max_by("loss", "step")
    return s.groupBy("dataset").agg(
        F.min("loss").alias("min_loss"), F.max("loss").alias("max_loss"), last.alias("final_loss"), first.alias("first_loss"), F.count("*").alias("steps"),
        F.try_divide(first, last).alias("convergence_ratio"), F.when(F.count("*") > 1, first - last).alias("drop"))


def weighted_perplexity(df: DataFrame, group: str, loss: str, weight: str) -> DataFrame:
    """Exp of the weighted mean; infinity without weight."""
    n = F.sum(weight)
    return df.groupBy(group).agg(F.when(n > 0, F.exp(F.try_divide(F.sum(F.col(loss) * F.col(weight)), n))).otherwise(F.lit(float("inf"))).alias("perplexity"))


def aligned(s: DataFrame, left: str, right: str) -> DataFrame:
    """Two series side by side, as far as the shorter one goes."""
    pick = lambda d, n: s.where(F.col("dataset") == d).select("step", F.col("loss").alias(n))
    return pick(left, "left_loss").join(pick(right, "right_loss"), "step")
