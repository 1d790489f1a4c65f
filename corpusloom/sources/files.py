"""File sources and sinks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import RULES, strip

METRICS = """losses array<double>, perplexities array<double>, final_loss double, min_loss double,
final_perplexity double, min_perplexity double, final_test_perplexity double, total_steps long,
training_time double, total_training_time double, dataset string, data_dir string, file_path string,
test_file_path string, model_dir string, completed_at string"""
STATE = "global_step long, epoch double, save_time string, losses array<double>, perplexities array<double>, total_training_time double"


def without_bad_bytes(value: Column) -> Column:
    """Bytes that are no UTF-8 go; U+FFFD in the text itself stays (held as a noncharacter
    meanwhile, in lines with bad bytes only)."""
    held = F.replace(value, F.lit("\ufffd"), F.lit("\ufdd0"))
    clean = F.replace(F.replace(F.make_valid_utf8(held), F.lit("\ufffd"), F.lit("")), F.lit("\ufdd0"), F.lit("\ufffd"))
    return F.when(F.is_valid_utf8(value), value).otherwise(clean)


def read_lines(spark: SparkSession, *paths: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, line) of every non-blank line, stripped. Bytes that are no UTF-8 go. A file
    that can't be read is skipped, which Spark's log tells as a warning. Raises if no file matches."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    listed = spark.read.option("recursiveFileLookup", str(recursive).lower()).format("binaryFile")
    if (listed.option("pathGlobFilter", pattern) if pattern else listed).load(list(paths)).select("path").isEmpty():
        raise FileNotFoundError(f"no file matches {pattern or '*'} in {paths}")
    return r.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), strip(without_bad_bytes(F.col("value"))).alias("line")).where("line <> ''")


def nth_line(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(line,): the n-th line of one file, from 0, stripped; no row beyond its end. Lines are
    numbered per block of the file: a block's rows follow each other, and one row per block tells how
    many lines stand before it."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = t.groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return t.join(F.broadcast(blocks), "block").where(F.col("before") + F.col("id") - F.col("first") == n).select(strip(F.col("value")).alias("line"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, size); contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))


def list_directories(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(directory, modified) of the sub-directories whose name starts with ``prefix``; the driver
    lists one directory."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(hadoop) if s.isDirectory()]
    return spark.createDataFrame(found, "directory string, modified long").where(F.col("directory").startswith(prefix))


def line_counts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """S6."""
    return spark.read.option("pathGlobFilter", pattern).text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_lines"))


def read_metrics(spark: SparkSession, *paths: str) -> DataFrame:
    """Run metrics in one schema; missing series are empty, both names of the training time
    are one column."""
    d = spark.read.schema(METRICS).option("multiLine", True).json(list(paths))
    none = F.array().cast("array<double>")
    return d.withColumns({"losses": F.coalesce("losses", none), "perplexities": F.coalesce("perplexities", none), "training_time": F.coalesce("training_time", "total_training_time")})


def read_latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest state file, or one row of defaults."""
    default = spark.createDataFrame([(0, 0.0, None, [], [], 0.0)], STATE)
    try:
        d = spark.read.schema(STATE).option("multiLine", True).json(path)
    except Exception as e:  # only a missing path means that there is nothing to resume
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return default
    newest = d.orderBy(F.desc("_metadata.file_modification_time")).limit(1)
    return default if newest.isEmpty() else newest


def metric_points(runs: DataFrame) -> DataFrame:
    """(dataset, step, loss, perplexity): the arrays of run metrics as rows."""
    z = runs.select("dataset", F.posexplode(F.arrays_zip("losses", "perplexities")).alias("i", "x"))
    return z.select("dataset", (F.col("i") + 1).cast("long").alias("step"), F.col("x.losses").alias("loss"), F.col("x.perplexities").alias("perplexity"))


def write_rules(lines: DataFrame, path: str, text: str = "line", file: str | None = None) -> None:
    """Text files per rule, or per file stem and rule, without empty results."""
    rows = [F.struct(F.lit(n).alias("rule"), f(F.col(text)).alias("value")) for n, f in RULES.items()]
    stem = [F.regexp_extract(file, r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem")] if file else []
    out = lines.select(*stem, F.explode(F.array(*rows)).alias("x")).select(*(["stem"] if file else []), "x.*").where("value <> ''")
    out.write.partitionBy(*(["stem"] if file else []), "rule").text(path)


def write_prefixed(lines: DataFrame, path: str, text: str = "line") -> None:
    """K3: each sentence with a prefix, alone, and a blank line."""
    lines.select(F.explode(F.array(F.concat(F.lit("Original: "), text), F.col(text), F.lit(""))).alias("value")).write.text(path)


def run_metrics(points: DataFrame, completed_at: Column) -> DataFrame:
    """One row per dataset of (dataset, step, loss, perplexity, seconds): series as arrays and
    their summary; null where a series is empty. A run's series is one array, as its JSON has it."""
    last = F.array_sort(F.collect_list(F.struct("step", "loss", "perplexity")))
    d = points.groupBy("dataset").agg(last.alias("x"), F.max("seconds").alias("training_time"))
    d = d.select("dataset", F.transform("x", lambda p: p["loss"]).alias("losses"), F.transform("x", lambda p: p["perplexity"]).alias("perplexities"), "training_time")
    end = lambda c: F.try_element_at(c, F.lit(-1))
    return d.select("losses", "perplexities", end("losses").alias("final_loss"), F.array_min("losses").alias("min_loss"), end("perplexities").alias("final_perplexity"), F.array_min("perplexities").alias("min_perplexity"),
                    F.size("losses").cast("long").alias("total_steps"), "training_time", "dataset", completed_at.alias("completed_at"))


def write_json(df: DataFrame, path: str) -> None:
    """K5-K7: one JSON object a row, nested as the columns are."""
    df.write.json(path)
