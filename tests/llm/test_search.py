"""Top-k over many blocks and rounds, against brute force."""
import threading

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import common, topk


def test_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 2500
    values = rng.normal(size=(n, 12)) * rng.gamma(1.0, 1.0, size=(n, 1)) + 0.5
    values[1000:1100] = values[1000]  # ties
    values[2000:2005] = 0.0
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values)], "vec_id long, embedding array<double>").withColumn("block", F.lit(7)).repartition(4)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, 5, 25).collect()}
    whole = np.floor(256 * values).astype(np.int64)
    want = {}
    for q in range(0, n, 25):
        s = whole @ whole[q]
        order = sorted((-int(s[v]), v) for v in range(n) if v != q)[:5]
        want |= {(q, k + 1): (v, -x) for k, (x, v) in enumerate(order)}
    assert got == want


def test_components_beyond_doubles(spark):
    """A finite component whose scaled value is none: held at the largest double, scores at a long's ends."""
    values = {0: [1e307, 1.0], 1: [-1e307, 2.0], 2: [1e307, -1e307], 3: [0.5, 0.25], 50: [3.0, 1e300], 51: [0.0, 4.0], 100: [2.0, -1.0]}
    df = spark.createDataFrame(list(values.items()), "vec_id long, embedding array<double>").repartition(3)
    held = lambda c: int(max(-topk.FAR, min(topk.FAR, float(np.floor(256 * c)))))
    with np.errstate(over="ignore"):
        whole = {k: [held(np.float64(c)) for c in v] for k, v in values.items()}
    want = {}
    for q in (0, 50, 100):
        s = {v: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], whole[v])))) for v in values if v != q}
        want |= {(q, k + 1): (v, s[v]) for k, v in enumerate(sorted(s, key=lambda v: (-s[v], v))[:5])}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, 5, 50).collect()} == want


def test_tables_of_two_threads(spark):
    """Each thread hears of its own tables only, so neither deletes the other's."""
    seen, both = {}, threading.Barrier(2)

    def run(name):
        with common.made([]) as own:
            both.wait(20)
            common.materialize(spark.range(3), name)
            with common.made([]) as inner:
                common.new_path(spark, f"{name}-inner")
            both.wait(20)
        seen[name] = own, inner

    threads = [threading.Thread(target=run, args=(n,)) for n in ("first", "second")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    for name, (own, inner) in seen.items():
        assert len(own) == 2 and len(inner) == 1 and all(f"/{name}-" in p for p in own + inner)
    assert len(seen) == 2
