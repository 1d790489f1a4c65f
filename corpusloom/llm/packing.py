"""Packing along a space-filling curve.

Each document's tokens are hashed into a signed count vector, which is projected to a few
dimensions; the cell that it falls into gives a key on the Hilbert curve, and documents in key
order are neighbours in content. They are laid end to end along the curve and cut every
``length`` tokens, so that only the last sequence holds padding.

Ids are made once and written; only (key, doc_id, count) is range-sorted. Each task sums its own
run of the curve, and one row per task gives the global offsets. The offsets then meet the ids by
row, and each document is cut by itself. No step needs a group in one task.

Defined cases: null and empty texts hold the end id alone; equal keys are ordered by doc_id, equal
doc_ids by their place in the input, null doc_ids come first among equal keys; repeated rows are packed
each; a very long text is encoded whole, in one task, and cut into as many pieces as it needs; an empty
table gives no pieces; extra columns, whatever their names, are ignored.
"""
from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, splitmix, tokenizer_path
from .encoder import LibraryCache, id_type, slices, worker_cache

DIMS, BITS, HASHED = 4, 10, 256


def projection(seed: int = 7):
    """A fixed HASHED x DIMS matrix of signs, from a rule."""
    import numpy as np

    with np.errstate(over="ignore"):
        k = splitmix(np.arange(HASHED * DIMS, dtype=np.uint64) + np.uint64(seed << 32))
    return np.where(k & np.uint64(1), 1.0, -1.0).reshape(HASHED, DIMS)


def token_hashes(size: int):
    """Slot and sign of each token id in the hashed vector, from a rule."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = splitmix(np.arange(size, dtype=np.uint64))
    return (h & np.uint64(HASHED - 1)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def cells(ids, ends, matrix, hashes):
    """Grid cells (n x DIMS of 0..2**BITS-1) of the hashed token vectors of documents, laid end to
    end in ids. Counts are damped by a logarithm."""
    import numpy as np

    slot, sign = hashes
    out, starts, n = np.empty((len(ends), DIMS)), np.append(0, ends[:-1]), np.diff(ends, prepend=0)
    for k in range(0, len(ends), 512):  # so that the vectors at hand stay small
        part = ids[starts[k] : ends[min(k + 512, len(ends)) - 1]]
        m = len(ends[k : k + 512])
        at = np.repeat(np.arange(m) * HASHED, n[k : k + 512])
        v = np.bincount(at + slot[part], sign[part], m * HASHED).reshape(m, HASHED)
        v = np.sign(v) * np.log1p(np.abs(v))
        out[k : k + m] = v @ matrix / np.sqrt(np.maximum((v * v).sum(1), 1e-12))[:, None]
    # Each coordinate is about standard normal whatever the data: the logistic curve spreads it.
    return np.clip(((1 << BITS) / (1 + np.exp(-1.7 * out))).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert(points):
    """Index on the Hilbert curve of integer points: bits are taken from the top; where a bit of
    one axis is set the lower bits of the first axis are inverted, else exchanged with that axis;
    then the bits are Gray-decoded and interleaved."""
    import numpy as np

    x = [points[:, k].astype(np.int64).copy() for k in range(points.shape[1])]
    n = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
            # for i == 0 the exchange leaves the axis as it is
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (BITS - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(row, doc_id, curve, n, ids as bytes) of every whole text. ``row`` numbers the rows; it holds
    once the result is written, so rows that agree in everything stay apart."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        cache, matrix = worker_cache(LibraryCache, path), projection()
        hashes = token_hashes(cache.size)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts, doc_ids = b.column("text"), b.column("doc_id")
            for s in slices(texts):
                ids, ends = cache.encode(texts[s])
                ids, n = np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1
                ends = np.cumsum(n)
                at = (np.append(0, ends) * ids.itemsize).astype(np.int32)
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), doc_ids[s], pa.array(hilbert(cells(ids, ends, matrix, hashes))), pa.array(n), raw], names=["row", "doc_id", "curve", "n", "ids"])
                row += len(n)

    return docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, curve long, n long, ids binary")


def offsets(tokens: DataFrame) -> DataFrame:
    """(row, at): where each document begins on the curve."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n")
            local = pc.add(pc.subtract(pc.cumulative_sum(n), n), at)
            at += pc.sum(n).as_py() or 0
            yield pa.RecordBatch.from_arrays([b.column("row"), n, pa.array([part] * b.num_rows, pa.int32()), local], names=["row", "n", "part", "local"])

    order = ["curve", "doc_id", "row"]
    placed = materialize(tokens.select("row", "n", *order[:2]).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "row long, n long, part int, local long"), "curve")
    # One row per task of the sort.
    base = placed.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return placed.join(materialize(base, "bases"), "part").select("row", (F.col("base") + F.col("local")).alias("at"))


def cut(placed: DataFrame, length: int, width: str) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        step = np.dtype(width).itemsize
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, at, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids"))):
                ids = np.frombuffer(raw, width).astype("<u4").tobytes()
                start = 0
                while start < n:
                    seq, off = divmod(at + start, length)
                    m = min(length - off, n - start)
                    for c, v in zip(cols, (doc_id, start, m, zlib.crc32(ids[4 * start : 4 * (start + m)]), n, seq, off)):
                        c.append(v)
                    start += m
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    tokens = materialize(tokenized(docs, path, end_id), "packed")
    placed = tokens.select("row", "doc_id", "n", "ids").join(offsets(tokens), "row")
    return cut(placed, length, id_type(path))
