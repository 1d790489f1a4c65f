"""Exact top-k by inner product: norm-sorted vectors, rotated partial sums, Cauchy-Schwarz bounds.

Components become integers first (floor of ``scale`` times the component), so scores are exact.
Vectors are range-sorted by descending length and packed into blocks; queries are packed into
blocks too. A rotation, fitted by SVD on at most ``FIT_ROWS`` vectors (the bound is a documented
parameter; any rotation gives exact results, a good one prunes more), gathers a vector's weight in
its first coordinates. Every query first meets the block of the longest vectors, which gives a
threshold. After that the other blocks come in rounds by descending length (ROUNDS, as shares of the
blocks), and thresholds rise from round to round. In a round only those pairs of blocks meet whose
longest vectors could reach a query's threshold; a block of candidates is sent once to each group of
about TOGETHER query blocks that it meets. Within a pair a query's partial inner product over the
leading coordinates plus the product of the residual lengths bounds the score; candidates below the
threshold go, the others are scored exactly in integers. Bounds carry a margin above rounding error.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; shorter
vectors count as padded with zeros; rows with the same vec_id are separate candidates, only a
query's own row is left out; ties go to the smaller vec_id; fewer than k other rows give fewer
results; scaled components beyond the range of a double are held at its ends, and scores beyond the
range of a long are cut to it; rows with a null vec_id take no part; an
empty table gives an empty result; a very long vector makes its block as much larger; extra columns,
whatever their names, are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

FIT_ROWS, LEADING, BLOCK, QUERY_BLOCK, STEP = 4096, 16, 4096, 512, 512
#: The largest double: scaled components and lengths beyond it are held there.
FAR = 1.7976931348623157e308
#: Levels of block lengths to a doubling.
LEVELS = 16
#: Shares of the blocks, from the longest on, at which a round ends; query blocks sent together.
ROUNDS, TOGETHER = (1 / 32, 1 / 4), 16


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, norm, dim, v): valid vectors as bytes of whole 64-bit floats."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for i, e in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                row += 1
                if i is None or e is None or None in e:
                    continue
                x = np.array(e, np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.clip(np.floor(scale * x), -FAR, FAR)
                        norm = np.sqrt((x * x).sum())
                        if norm > FAR:  # squares overflow before the length does
                            most = np.abs(x).max()
                            norm = min(most * np.sqrt(((x / most) ** 2).sum()), FAR)
                    out.append((row, i, float(norm), len(x), x.tobytes()))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.binary()])], names=["row", "vec_id", "norm", "dim", "v"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "row long, vec_id long, norm double, dim int, v binary")


def rotation(stored: DataFrame, dim: int):
    """An orthogonal dim x dim matrix whose first columns carry most weight in a fixed sample."""
    import numpy as np

    sample = stored.select("v").orderBy(F.xxhash64("vec_id"), "row").limit(FIT_ROWS).collect()
    if not sample or not dim:
        return np.eye(max(dim, 1))
    m = matrix([r["v"] for r in sample], dim)
    return np.linalg.svd(m / max(1.0, np.abs(m).max()), full_matrices=True)[2].T


def matrix(rows: list[bytes], dim: int):
    import numpy as np

    out = np.zeros((len(rows), max(dim, 1)))
    for k, r in enumerate(rows):
        x = np.frombuffer(r, np.float64)
        out[k, : len(x)] = x
    return out


def packed(stored: DataFrame, dim: int, size: int) -> DataFrame:
    """(block, top, n, rows, ids, values): up to ``size`` rows of each partition in one."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list = []

        def emit(rows):
            m = matrix([r["v"] for r in rows], dim)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([max(r["norm"] for r in rows)]), pa.array([len(rows)], pa.int64()), pa.array([np.array([r["row"] for r in rows], np.int64).tobytes()]), pa.array([np.array([r["vec_id"] for r in rows], np.int64).tobytes()]), pa.array([m.tobytes()])], names=["block", "top", "n", "rows", "ids", "body"])

        for b in batches:
            held += b.to_pylist()
            while len(held) >= size:
                yield emit(held[:size])
                held = held[size:]
                block += 1
        if held:
            yield emit(held)

    return stored.mapInArrow(run, "block long, top double, n long, rows binary, ids binary, body binary")


def _best(k: int, scores, ids):
    """Places of the k best, ties to smaller ids."""
    import numpy as np

    return np.lexsort((ids, -scores))[:k]


def search(queries, candidates, turn, k: int, floor):
    """For each query the k best of one block and the candidates scored: arrays of (query, id,
    score). queries and candidates are (rows, ids, values); floor holds scores known to be reached."""
    import numpy as np

    qrow, _, q = queries
    crow, cid, c = candidates
    with np.errstate(over="ignore"):
        exact = q.dtype != object and (np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]) < 2.0**53
    if not exact:
        q, c = (np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape) for m in (q, c))
        most, least = (1 << 63) - 1, -(1 << 63)
        out = []
        for i in range(len(q)):
            s = np.array([max(least, min(most, int(x))) for x in (c @ q[i])], np.int64)
            on = np.flatnonzero(crow != qrow[i])
            b = on[np.lexsort((cid[on], [-int(x) for x in s[on]]))[:k]]
            out += [(i, int(cid[j]), int(s[j])) for j in b]
        return out
    qn, cn = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    o = np.argsort(-cn, kind="stable")
    crow, cid, c, cn = crow[o], cid[o], c[o], cn[o]
    qr, cr = q @ turn[:, :LEADING], c @ turn[:, :LEADING]
    qrest = np.sqrt(np.maximum(0, qn**2 - (qr * qr).sum(1)) + 1e-9 * qn**2)
    crest = np.sqrt(np.maximum(0, cn**2 - (cr * cr).sum(1)) + 1e-9 * cn**2)
    floor = floor.copy()
    none = np.zeros(0, np.int64)
    held = [(none.astype(float), none)] * len(q)
    for at in range(0, len(c), STEP):
        s = slice(at, at + STEP)
        margin = 1e-7 * qn * cn[at] + 1e-3
        live = np.flatnonzero(qn * cn[at] + margin >= floor)
        if not len(live):
            break  # all that follow are shorter still
        bound = qr[live] @ cr[s].T + np.outer(qrest[live], crest[s]) + margin[live, None]
        some = bound >= floor[live, None]
        some &= qrow[live, None] != crow[None, s]
        if some.mean() > 0.2:
            scores = q[live] @ c[s].T
        for j, i in enumerate(live.tolist()):
            on = np.flatnonzero(some[j])
            if not len(on):
                continue
            got = scores[j, on] if some.mean() > 0.2 else c[s][on] @ q[i]
            sc, ids = np.concatenate([held[i][0], got]), np.concatenate([held[i][1], cid[s][on]])
            b = _best(k, sc, ids)
            held[i] = sc[b], ids[b]
            if len(b) == k:
                floor[i] = max(floor[i], sc[b[-1]])
    return [(i, int(x), int(y)) for i, (sc, ids) in enumerate(held) for y, x in zip(sc, ids)]


def _level(length: Column) -> Column:
    """LEVELS levels to a doubling of length; one below all others for length 0."""
    return F.when(length > 0, F.floor(F.log2(length) * LEVELS)).otherwise(F.lit(-1100 * LEVELS)).cast("int")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the k
    best of all other rows."""
    stored = materialize(integers(vectors, scale), "vectors")
    dim = stored.agg(F.max("dim")).first()[0] or 0
    turn = rotation(stored, dim)
    longest = stored.repartitionByRange(F.desc("norm"), "vec_id", "row").sortWithinPartitions(F.desc("norm"), "vec_id", "row")
    cand = materialize(packed(longest, dim, BLOCK), "candidates")
    ask = materialize(packed(stored.where(F.col("vec_id") % every == 0), dim, QUERY_BLOCK), "queries")
    kind = "qblock long, q int, query_row long, query_id long, vec_id long, score long"

    def met(queries: list, candidate):
        """Scores of blocks of queries with one block of candidates; blocks are (rows, ids, body)."""
        import numpy as np

        opened = lambda rows, ids, body: (np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(body, np.float64).reshape(-1, max(dim, 1)))
        c = opened(*candidate)
        for block, floor, *body in queries:
            q = opened(*body)
            known = np.frombuffer(floor, np.float64) if floor is not None else np.full(len(q[0]), -np.inf)
            yield from ((block, i, int(q[0][i]), int(q[1][i]), v, s) for i, v, s in search(q, c, turn, k, known))

    def first_met(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                found = list(met([(r["qblock"], None, r["qrows"], r["qids"], r["qbody"])], (r["crows"], r["cids"], r["cbody"])))
                cols = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), *[pa.int64()] * 4])], names=["qblock", "q", "query_row", "query_id", "vec_id", "score"])

    def group_met(queries, candidate):
        import pandas as pd

        found = []
        for c in candidate[["crows", "cids", "cbody"]].itertuples(index=False):
            found += met(list(queries[["qblock", "floor", "qrows", "qids", "qbody"]].itertuples(index=False, name=None)), tuple(c))
        return pd.DataFrame(found, columns=["qblock", "q", "query_row", "query_id", "vec_id", "score"])

    qs = ask.select(F.col("block").alias("qblock"), F.col("top").alias("qtop"), F.col("n").alias("qn"), F.col("rows").alias("qrows"), F.col("ids").alias("qids"), F.col("body").alias("qbody"))
    cs = cand.select(F.col("block").alias("cblock"), F.col("rows").alias("crows"), F.col("ids").alias("cids"), F.col("body").alias("cbody"))
    first, ends, n_ask = cand.agg(F.min(F.struct((-F.col("top")).alias("t"), "block"))["block"], F.percentile_approx("top", F.array(*(F.lit(1 - x) for x in ROUNDS)), 1000)).first() + ask.agg(F.count("*")).first()
    if first is None:
        return ask.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # One block, of a fixed size, meets all queries.
    best = materialize(qs.join(F.broadcast(cs.where(F.col("cblock") == first)), F.lit(True)).mapInArrow(first_met, kind), "opening")

    # Thresholds by query block: its k-th scores so far. No more than QUERY_BLOCK * k rows a block.
    def floors(key, pdf):
        import numpy as np
        import pandas as pd

        n = int(pdf["qn"].iloc[0])
        got = pdf.groupby("q")["score"].agg(["size", "min"])
        f = np.full(n, -np.inf)
        full = got[got["size"] >= k]
        f[full.index.to_numpy(int)] = full["min"]
        return pd.DataFrame({"qblock": [key[0]], "floor": [f.tobytes()], "lowest": [float(f.min())]})

    groups = max(1, -(-n_ask // TOGETHER))
    heads = materialize(qs.select("qblock", "qtop", "qn"), "heads")
    bounds = [float("inf"), *ends, float("-inf")]
    for high, low in zip(bounds, bounds[1:]):
        # Pairs of block numbers, where the longest vectors of both could still reach a threshold.
        # Lengths are dealt to levels, so that blocks meet by level and no task sees all of them.
        rest = cand.where((F.col("block") != first) & (F.col("top") < high) & (F.col("top") >= low)).select(F.col("block").alias("cblock"), "top", _level(F.col("top")).alias("level"))
        lo, hi = rest.agg(F.min("level"), F.max("level")).first()
        if lo is None:
            continue
        at = best.join(heads.select("qblock", "qn"), "qblock").groupBy("qblock").applyInPandas(floors, "qblock long, floor binary, lowest double")
        now = heads.select("qblock", "qtop").join(at, "qblock", "left")
        need = (F.col("lowest") - 1) / (F.col("qtop") * (1 + 1e-7))
        start = F.when((F.col("qtop") > 0) & (need > 0), F.greatest(_level(need) - 1, F.lit(lo))).otherwise(F.lit(lo))
        reach = now.withColumn("start", start).where(F.col("start") <= hi).withColumn("level", F.explode(F.sequence("start", F.lit(hi))))
        pairs = reach.join(rest, "level").where(F.coalesce(F.col("qtop") * F.col("top") * (1 + 1e-7) + 1 >= F.col("lowest"), F.lit(True)))
        pairs = materialize(pairs.select("qblock", "floor", "cblock", F.pmod(F.xxhash64("qblock"), F.lit(groups)).alias("together")), "pairs")
        left = pairs.join(qs.drop("qtop", "qn"), "qblock").groupBy("cblock", "together")
        right = pairs.select(F.col("cblock").alias("to"), F.col("together").alias("group")).distinct().join(cs.withColumnRenamed("cblock", "to"), "to").groupBy("to", "group")
        found = best.unionByName(left.cogroup(right).applyInPandas(group_met, kind))
        w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        best = materialize(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank"), "best")
    return _ranked(best, k)
