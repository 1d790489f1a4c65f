"""The progress log of streaming queries and the report of files that can't be read."""
import gzip
import json

import pytest

from corpusloom.sources.file_report import read_sound_lines, report_files
from corpusloom.streaming.progress_log import ProgressLog, read_log


@pytest.fixture
def log(spark, tmp_path):
    made = ProgressLog(spark, f"file://{tmp_path}/log")
    spark.streams.addListener(made)
    yield made
    spark.streams.removeListener(made)


def start(spark, tmp_path, name, column="step"):
    points = spark.readStream.schema("step long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    return points.selectExpr(f"{column} AS step").writeStream.queryName(name).format("noop").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()


def test_progress_log(spark, tmp_path, log):
    (tmp_path / "in").mkdir()
    for k, n in enumerate([3, 5]):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"step": i}) + "\n" for i in range(n)))
    good = start(spark, tmp_path, "good")
    good.awaitTermination()
    bad = start(spark, tmp_path, "bad", "CAST(raise_error('no such step') AS BIGINT)")
    with pytest.raises(Exception):
        bad.awaitTermination()
    assert log.wait(good.runId) and log.wait(bad.runId) and not log.unwritten
    rows = read_log(spark, log.path).collect()
    batches = sorted((r.batch, r.rows) for r in rows if r.run == str(good.runId) and r.event == "batch")
    assert [b for b, _ in batches] == [0, 1] and sorted(n for _, n in batches) == [3, 5]
    assert all(r.milliseconds > 0 and r.at and r.name == "good" for r in rows if r.run == str(good.runId) and r.event == "batch")
    ends = {r.run: (r.event, r.name, r.error) for r in rows if r.event != "batch"}
    assert ends[str(good.runId)] == ("ended", "good", None)
    event, name, error = ends[str(bad.runId)]
    assert (event, name) == ("failed", "bad") and "no such step" in error


def test_file_report(spark, tmp_path):
    lines = [f"line {k} {k * k}" for k in range(5000)]
    whole = gzip.compress("\n".join(lines).encode())
    (tmp_path / "whole.train.gz").write_bytes(whole)
    (tmp_path / "cut.train.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "none.train.gz").write_bytes(b"this is no archive at all")
    (tmp_path / "a b.train").write_text("one\n\ntwo\n")
    (tmp_path / "empty.train").write_text("")
    (tmp_path / "other.txt").write_text("x\n")
    for k in range(6):
        (tmp_path / f"more{k}.train").write_text("x\n" * k)
    missing = str(tmp_path / "gone.train")
    report = report_files(spark, str(tmp_path), missing, pattern="*.train*").cache()
    got = {(r.path.rsplit("/", 1)[1]): (r.read, r.rows, r.reason) for r in report.collect()}
    assert {n: x[:2] for n, x in got.items()} == {
        "whole.train.gz": (True, 5000), "cut.train.gz": (False, None), "none.train.gz": (False, None), "a b.train": (True, 3),
        "empty.train": (True, 0), "gone.train": (False, None), **{f"more{k}.train": (True, k) for k in range(6)}}
    assert all(bool(reason) != read for read, _, reason in got.values())
    sound = read_sound_lines(spark, report)
    assert sound.count() == 5000 + 2 + 15
    assert not [r for r in sound.select("file").distinct().collect() if "cut" in r.file or "none" in r.file]


def test_report_of_nothing(spark, tmp_path):
    report = report_files(spark, str(tmp_path / "gone"))
    assert [(r.read, r.rows) for r in report.collect()] == [(False, None)]
    assert read_sound_lines(spark, report).count() == 0
