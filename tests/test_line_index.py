"""The line index against Python's own reading of the files."""
import os
import random

import pytest

from corpusloom.sources import line_index


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d, rng = tmp_path_factory.mktemp("lines"), random.Random(8)
    raw = {"a.txt": b"".join(b"line %d \xc3\xa4" % k + rng.choice([b"\n", b"\n", b"\r\n", b"\r", b"\n\n"]) for k in range(3000)), "b.txt": b"one\r\rtwo\xff!\r\n  three  ", "c.txt": b"", "d.txt": b"\n" * 7, "e.txt": b"x" * 50_000 + b"\ny\r"}
    for n, r in raw.items():
        (d / n).write_bytes(r)
    return d


def python_lines(path):
    with open(path, encoding="utf-8", errors="ignore") as f:
        return [x.strip() for x in f]


@pytest.mark.parametrize("every, block", [(50, 4096), (1, 700), (7, 1 << 20)])
def test_lines_at(spark, files, tmp_path, every, block):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))  # a file lies in many blocks
    try:
        line_index.build_line_index(spark, str(files), str(tmp_path / "index"), every)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {n: python_lines(files / n) for n in ("a.txt", "b.txt", "c.txt", "d.txt", "e.txt")}
    rng = random.Random(every)
    ask = [(f"file://{files}/{n}", k) for n, x in want.items() for k in {0, 1, 2, 3, len(x) - 1, len(x), -1, *rng.choices(range(len(x) + 1), k=40)}]
    rows = line_index.lines_at(spark, spark.createDataFrame([*ask, ask[0], ("file:///none.txt", 0)], "file string, n long"), str(tmp_path / "index")).collect()
    assert len(rows) == len(ask) + 2
    for r in rows:
        x = want.get(os.path.basename(r.file))
        if x is None or os.path.basename(r.file) == "c.txt":
            assert r.status == "missing" and r.line is None
        elif 0 <= r.n < len(x):
            assert (r.status, r.line) == ("ok", x[r.n])
        else:
            assert r.status == "beyond" or (r.status, r.line) == ("ok", "")  # nothing after the last line's end
    assert spark.read.parquet(str(tmp_path / "index")).where("slot_line is not null").count() <= 2 * sum(map(len, want.values())) / every + 300


def test_bytes_read_and_stale_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    p = tmp_path / "in" / "big.txt"
    p.write_text("".join(f"row {k:06d}\n" for k in range(100_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        line_index.build_line_index(spark, str(tmp_path / "in"), str(tmp_path / "index"), 100)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    every = line_index.read_line_index(spark, str(tmp_path / "index"))
    assert every.where("until - line > 100 or stop - offset > 2 * 100 * 11 or stop <= offset").isEmpty()
    ask = spark.createDataFrame([(f"file://{p}", k) for k in (5, 6, 50_000, 99_999)], "file string, n long")
    rows = line_index.lines_at(spark, ask, str(tmp_path / "index")).collect()
    assert {r.n: r.line for r in rows} == {k: f"row {k:06d}" for k in (5, 6, 50_000, 99_999)}
    assert 0 < sum(r.bytes_read for r in rows) <= 4 * 100 * 11
    with open(p, "a") as f:
        f.write("one more\n")
    assert {r.status for r in line_index.lines_at(spark, ask, str(tmp_path / "index")).collect()} == {"stale"}
