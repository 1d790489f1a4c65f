"""File sources and sinks, streaming forms and formats, each against plain Python."""
import gzip
import json
import math
import os

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import ranking, segment, series, summary, tokens
from corpusloom.plans import registry
from corpusloom.sources import files
from corpusloom.streaming import perturb

SF = "/root/testdata/sf0.001"


def test_recursive_walk(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "top.train").write_text("top\n")
    (tmp_path / "a" / "b" / "deep.train").write_text("deep\n")
    (tmp_path / "a" / "skip.txt").write_text("skip\n")
    lines = lambda r: sorted(x.line for x in files.read_lines(spark, str(tmp_path), pattern="*.train", recursive=r).collect())
    assert lines(True) == ["deep", "top"] and lines(False) == ["top"]


def test_bad_bytes(spark, tmp_path):
    raw = b"caf\xc3\xa9 \xff\xfeok\nkept \xef\xbf\xbd here\nboth \xef\xbf\xbd and \xc3 cut\n\xe2\x28\xa1x\n"
    (tmp_path / "x.txt").write_bytes(raw)
    got = [r.line for r in files.read_lines(spark, str(tmp_path)).collect()]
    assert got == ["café ok", "kept � here", "both � and  cut", "(x"]


def test_unreadable_files_are_skipped(spark, tmp_path):
    (tmp_path / "good.txt").write_text("one\n\ntwo\n")
    with gzip.open(tmp_path / "cut.txt.gz", "wt") as f:
        f.write("line\n" * 100_000)
    whole = (tmp_path / "cut.txt.gz").read_bytes()
    (tmp_path / "cut.txt.gz").write_bytes(whole[:10] + b"\x00" * 50)
    got = files.read_lines(spark, str(tmp_path))
    assert sorted(r.line for r in got.where(F.col("file").endswith("good.txt")).collect()) == ["one", "two"]
    assert {r.line for r in got.collect()} <= {"one", "two", "line"}


def test_nth_line(spark, tmp_path):
    (tmp_path / "f.txt").write_text("".join(f"  line {k} \n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # several blocks
    try:
        for n in (0, 1, 2499, 4999):
            assert [r.line for r in files.nth_line(spark, str(tmp_path / "f.txt"), n).collect()] == [f"line {n}"]
        assert files.nth_line(spark, str(tmp_path / "f.txt"), 5000).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_directories(spark, tmp_path):
    for d in ("emergency_1", "emergency_2", "other"):
        (tmp_path / d).mkdir()
    (tmp_path / "emergency_file").write_text("x")
    assert sorted(r.directory for r in files.list_directories(spark, str(tmp_path), "emergency_").collect()) == ["emergency_1", "emergency_2"]


def test_rules_by_stem(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.train").write_text("One two.\n")
    (tmp_path / "in" / "b.train").write_text("Three four five.\n")
    files.write_rules(files.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), file="file")
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted((r.stem, r.rule, r.value) for r in back.collect()) == [
        ("a", "parity_negation", "Not One two."), ("a", "reversed", "two One."), ("b", "parity_negation", "Three four five Not."), ("b", "reversed", "five four Three.")]


def test_run_metrics_json(spark, tmp_path):
    points = [("x", k, 3.0 - k, math.exp(3.0 - k), float(k)) for k in (1, 2, 3)] + [("y", 1, 200.0, math.inf, 0.5)]
    m = files.run_metrics(spark.createDataFrame(points, "dataset string, step long, loss double, perplexity double, seconds double"), F.lit("2024-01-01T00:00:00"))
    files.write_json(m, str(tmp_path / "runs"))
    rows = {}
    for f in os.listdir(tmp_path / "runs"):
        if f.endswith(".json"):
            rows |= {r["dataset"]: r for r in map(json.loads, open(tmp_path / "runs" / f))}
    assert rows["x"]["losses"] == [2.0, 1.0, 0.0] and rows["x"]["final_loss"] == rows["x"]["min_loss"] == 0.0 and rows["x"]["total_steps"] == 3 and rows["x"]["training_time"] == 3.0
    back = {r.dataset: r for r in spark.read.schema(files.METRICS).json(str(tmp_path / "runs")).collect()}
    assert back["x"].perplexities == [math.exp(2.0), math.exp(1.0), 1.0] and back["y"].final_perplexity == math.inf and back["x"].completed_at == "2024-01-01T00:00:00"


def test_missing_keys_have_defaults(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"dataset": "x", "final_loss": 1.0}))
    r = files.read_metrics(spark, str(tmp_path / "m.json")).first()
    assert (r.losses, r.perplexities, r.training_time, r.final_loss) == ([], [], None, 1.0)


def test_resume_state(spark, tmp_path):
    for k, step in enumerate((100, 300, 200)):
        (tmp_path / f"s{k}.json").write_text(json.dumps({"global_step": step, "epoch": 0.5, "perplexities": [1.0]}))
        os.utime(tmp_path / f"s{k}.json", (1_700_000_000 + 10 * k,) * 2)
    r = files.read_latest_state(spark, str(tmp_path)).first()
    assert (r.global_step, r.epoch, r.perplexities, r.losses) == (200, 0.5, [1.0], None)
    states = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "run string, saved long, step long")
    assert sorted((r.run, r.step) for r in perturb.latest(states, "run", "saved").collect()) == [("a", 6), ("b", 7)]


def test_test_results_json(spark, tmp_path):
    tests = summary.pairwise_tests(summary.moments(registry.events(spark, SF), "event_type", "value"), "event_type")
    files.write_json(summary.test_results(tests), str(tmp_path / "t"))
    rows = [json.loads(x) for f in os.listdir(tmp_path / "t") if f.endswith(".json") for x in open(tmp_path / "t" / f)]
    assert len(rows) == 10
    for r in rows:
        assert list(r) == ["name1", "name2", "metric_name", "statistic", "p_value", "cohens_d", "significance", "effect_size_category", "alpha", "group1", "group2"]
        assert r["group1"]["name"] == r["name1"] and set(r["group2"]) == {"name", "mean", "std", "n"} and r["alpha"] == 0.05


def test_metrics_stream_appends_and_resumes(spark, tmp_path):
    src, sink, cp = (str(tmp_path / x) for x in ("src", "sink", "cp"))
    os.makedirs(src)
    (tmp_path / "src" / "1.json").write_text('{"dataset": "x", "step": 1, "loss": 2.0}\n{"dataset": "x", "step": 2, "loss": 200.0}\n')
    perturb.start_metrics(spark, src, sink, cp).awaitTermination(120)
    (tmp_path / "src" / "2.json").write_text('{"dataset": "x", "step": 3, "loss": 0.0}\n')
    perturb.start_metrics(spark, src, sink, cp).awaitTermination(120)
    rows = sorted((r.step, r.perplexity, r.batch) for r in spark.read.parquet(sink).collect())
    assert rows == [(1, math.exp(2.0), 0), (2, math.inf, 0), (3, 1.0, 1)]


def test_rewrite_resumes(spark, tmp_path):
    src, sink, cp = (str(tmp_path / x) for x in ("src", "sink", "cp"))
    os.makedirs(src)
    (tmp_path / "src" / "1.txt").write_text("One two.\n")
    perturb.start_rewrite(spark, src, sink, cp).awaitTermination(120)
    (tmp_path / "src" / "2.txt").write_text("Three.\n")
    perturb.start_rewrite(spark, src, sink, cp).awaitTermination(120)
    got = sorted(r.sentence for r in spark.read.parquet(sink).where("rule = 'reversed'").collect())
    assert got == ["Three.", "two One."]


def test_save_points(spark):
    rows = [("x", k, k * 1.7 if k < 250 else 425 + (k - 250) * 11.0) for k in range(1, 600)]
    got = sorted((r.step, r.elapsed) for r in perturb.save_points(spark.createDataFrame(rows, "dataset string, step long, elapsed double"), 100, 60.0).collect())
    last, want = 0.0, []
    for _, step, elapsed in rows:
        if step % 100 == 0 or elapsed - last >= 60.0:
            last = elapsed
            want.append((step, elapsed))
    assert got == want


def test_head_words(spark):
    rows = [("The cat sat on the mat.", "The cat sat on the mat."), ("a b c d e f g h i j k l!", "a b c d e f g h i j."), ("...", "."), ("One?! ", "One?!.")]
    d = spark.createDataFrame([(s,) for s, _ in rows], "s string")
    assert [r.h for r in d.select(X.head_words(F.col("s")).alias("h")).collect()] == [w for _, w in rows]


def test_chunks_of_every_text(spark):
    def plain(text, size):
        import re
        out, cur = [], ""
        for s in re.split(r"(?<=[.!?])\s+", text):
            if len(cur) + len(s) < size:
                cur += s + " "
            else:
                if cur:
                    out.append(cur.strip(" "))
                cur = s + " "
        return out + ([cur.strip(" ")] if cur else [])

    extra = [("",), ("x" * 3000 + ". y.",), ("One. Two.\u0085Three. Four.",)]
    d = registry.docs(spark, SF).select("text").unionByName(spark.createDataFrame(extra, "text string"))
    for r in d.select("text", segment.chunks(F.col("text"), 300).alias("c"), segment.chunks(F.col("text"), 2000).alias("e")).collect():
        assert r.c == plain(r.text, 300) and r.e == plain(r.text, 2000)


def test_prefix_examples(spark):
    d = spark.createDataFrame([(1, [5, 6, 7]), (2, [9]), (3, [])], "doc_id long, ids array<int>")
    got = sorted((r.doc_id, r.i, r.input, r.target) for r in tokens.prefix_examples(d, 2).collect())
    assert got == [(1, 1, [5, 0], 6), (1, 2, [5, 6], 7)]
    sums = d.where("doc_id = 1").select(*tokens.prefix_sums(F.col("ids"))).first()
    assert tuple(sums) == (2, 13, 17)


def test_encoding_table(spark):
    lines = spark.createDataFrame([(1, "aab 日日"), (2, "b😀😀z"), (3, " "), (4, None)], "doc_id long, text string")
    vocab = {r.token: r.id for r in tokens.vocabulary(lines).collect()}
    assert vocab == {"<PAD>": 0, "<UNK>": 1, "a": 2, "b": 3, "日": 4, "😀": 5}
    got = {r.doc_id: r.ids for r in tokens.encoded(lines, tokens.vocabulary(lines)).collect()}
    assert got == {1: [2, 2, 3, 1, 4, 4], 2: [3, 5, 5, 1], 3: [], 4: []}


def test_formats(spark):
    r = spark.range(1).select(X.megabytes(F.lit(1572864)).alias("m"), X.minutes(F.lit(90)).alias("t"), F.format_string("%.6f", F.lit(1.23456789)).alias("f"), F.format_string("%.6e", F.lit(1.23456789e-5)).alias("e"), F.format_string("%-6s|%6.2f", F.lit("ab"), F.lit(3.14159)).alias("p")).first()
    assert tuple(r) == ("1.50 MB", "1.50 min", "1.234568", "1.234568e-05", "ab    |  3.14")


def test_even_buckets(spark, monkeypatch):
    d = spark.range(1000).withColumn("v", F.col("id") * F.col("id"))
    b = ranking.even_buckets(d, F.col("v"), "b", rows=100)
    assert b.agg(F.min("b"), F.max("b")).first() == (0, 9) and b.count() == 1000
    assert ranking.number_rows(b, [], F.col("b"), ["v"]).where("rn != id + 1").isEmpty()
    assert ranking.even_buckets(d.limit(0), F.col("v"), "b").count() == 0
    assert ranking.even_buckets(spark.createDataFrame([(None,), (3.0,)], "v double"), F.col("v"), "b").count() == 2


def test_running_mean_over_buckets(spark, monkeypatch):
    rows = [("x", 0, k, float(k % 7) + 0.1, k // 10) for k in range(1, 200)] + [("y", 0, 1, math.nan, 0), ("y", 0, 2, 4.0, 0)]
    d = series.running_mean(spark.createDataFrame(rows, "dataset string, epoch long, step long, loss double, bucket long"))
    got = {(r.dataset, r.step): r.running for r in d.collect()}
    total = 0.0
    for _, _, step, loss, _ in rows[:-2]:
        total += loss
        assert math.isclose(got["x", step], total / step, rel_tol=1e-12)
    assert got["y", 1] is None and got["y", 2] == 4.0


def test_final_perplexities(spark):
    d = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 0.0), ("b", 1, 200.0)], "dataset string, step long, loss double")
    assert [tuple(r) for r in summary.final_perplexities(d).collect()] == [("a", 1.0)]
