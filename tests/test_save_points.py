"""Save points of streamed steps against the batch form."""
import random
import time

from corpusloom.streaming import perturb, save_points

KIND = "dataset string, step long, elapsed double"


def test_triggers_and_restart(spark, tmp_path):
    rng, rows = random.Random(1), []
    for name, n in (("a", 950), ("b", 333), (None, 120), ("c", 1)):
        t = 0.0
        for k in range(1, n + 1):
            t += rng.choice([0.1, 1.0, 40.0])
            rows.append((name, k, t))
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    at = 0
    for stop, files in ((300, 1), (301, 1), (1000, 3)):
        # Three starts on one checkpoint; the last brings several triggers and rows that came before.
        part = [r for r in rows if at < r[1] <= stop]
        for k in range(files):
            own = [r for r in part if (r[1] - at - 1) * files // (stop - at) == k]
            rng.shuffle(own)
            spark.createDataFrame(own + part[:2] if k == 0 else own, KIND).coalesce(1).write.mode("append").parquet(src)
        q = save_points.start_save_points(spark, src, out, cp, every=100, seconds=300.0, files_per_trigger=1)
        assert q.awaitTermination(60)
        assert q.lastProgress is None or all(o.numRowsTotal <= 4 for o in q.lastProgress.stateOperators)
        at = stop
    got = sorted((str(r.dataset), r.step, r.elapsed) for r in spark.read.schema(KIND).parquet(out).collect())
    want = sorted((str(r.dataset), r.step, r.elapsed) for r in perturb.save_points(spark.createDataFrame(rows, KIND), 100, 300.0).collect())
    assert got == want and len(got) > 20


def test_silent_runs_lose_their_state(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([(f"run{k}", 1, 0.0) for k in range(5)], KIND).write.parquet(src)
    points = save_points.streamed_save_points(spark.readStream.schema(KIND).parquet(src), silent_ms=1)
    q = points.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(processingTime="100 milliseconds").start()
    try:
        until, left = time.time() + 40, None
        while time.time() < until and left != 0:
            time.sleep(0.5)
            seen = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
            left = seen[-1] if seen and max(seen) == 5 else None
        assert left == 0
    finally:
        q.stop()
