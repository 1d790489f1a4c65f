"""Which files can be read whole, and why the others can't."""
from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import read_lines

REPORT = "path string, file string, reason string"


def _reason(spark: SparkSession, files: list[str]) -> str | None:
    """None where every line of the files can be read, or else what Spark tells of the failure."""
    strict = spark.read.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false")
    try:
        strict.text(files).agg(F.count("value"), F.sum(F.length("value"))).collect()
    except Exception as e:
        if "FAILED_READ_FILE" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        causes = [x.strip().removeprefix("Caused by: ") for x in str(e).split("\n") if x.startswith("Caused by: ")]
        return causes[-1] if causes else str(e).split("\n")[0]
    return None


def _broken(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """File -> reason. All files are read in one job; where that fails each half is, and so on, so k
    broken files of n take about 2 k log2 n jobs, and none broken takes one."""
    open_, out = [files] if files else [], {}
    while open_:
        group = open_.pop()
        reason = _reason(spark, group)
        if reason and len(group) == 1:
            out[group[0]] = reason
        elif reason:
            open_ += [group[: len(group) // 2], group[len(group) // 2 :]]
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def report_files(spark: SparkSession, *paths: str, pattern: str = "*") -> DataFrame:
    """(path, file, read, reason, rows): a row per file under the paths (files, folders or globs), and
    one with the path alone for each that doesn't exist. A file broken anywhere, a cut archive for
    example, is not read and has no rows; ``rows`` counts the lines of the others, blank ones too. The
    driver holds the list of files, as a scan does; contents stay in the tasks."""
    here = [p for p in dict.fromkeys(paths) if _exists(spark, p)]
    found = []
    if here:
        listed = spark.read.option("pathGlobFilter", pattern).text(here).inputFiles()
        # Written as rows' metadata has them: one slash where no host is named.
        found = [(unquote(f), re.sub("^([^:/]+:)///", r"\1/", f)) for f in sorted(set(listed))]
    broken = _broken(spark, sorted(p for p, _ in found))
    rows = [(p, f, broken.get(p)) for p, f in found] + [(p, None, "no such file or folder") for p in dict.fromkeys(paths) if p not in here]
    files, good = spark.createDataFrame(rows, REPORT), [p for p, _ in found if p not in broken]
    counts = spark.createDataFrame([], "file string, n long")
    if good:
        counts = spark.read.text(good).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    read = F.col("reason").isNull()
    return files.join(counts, "file", "left").select("path", "file", read.alias("read"), "reason", F.when(read, F.coalesce("n", F.lit(0))).alias("rows"))


def read_sound_lines(spark: SparkSession, report: DataFrame) -> DataFrame:
    """(file, line) of the files that a report calls readable, each of them whole."""
    good = [r.path for r in report.where("read").select("path").collect()]
    return read_lines(spark, *good) if good else spark.createDataFrame([], "file string, line string")
