"""Embedding whitening from an exact integer scatter matrix.

Components become integers x = floor(scale * c) + offset. Over the distinct x vectors (the fit list)
each task subtracts a shift, the offset, and accumulates sums and cross-products in whole numbers of
any size: vectors are cut into digits of DIGIT bits, products of digits are exact in doubles, and the
digits' sums go into Python integers. The parts of all tasks meet as LIMB-bit limbs that Spark sums,
so what reaches the driver is of the order of the square of the dimension, whatever the number of rows.
There n X'X - SS' is formed in whole numbers; only then it becomes a matrix of doubles, which ``eigh``
decomposes. Rows are whitened in tasks. ``identity_error`` is measured: means of the whitened fit list
first, then products of what is centred.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; shorter
vectors count as padded with zeros; scale * c is held within +-2**62, so that x is a long; rows with
null or repeated vec_id are rows of their own; repeated vectors are fitted once and whitened each;
dimensions without variance give fewer components: one whose eigenvalue is within rounding of zero has
whitened null and is left out of ``identity_error``, and without any variance ``explained`` is null;
deviations of over 38 digits are null; an empty table gives an empty result; memory grows with the
square of the longest vector; extra columns, whatever their names, are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from .common import materialize

#: Bits of a digit and rows of a chunk: 2 * 21 + 11 = 53, so that products and sums of digits are exact.
DIGIT, CHUNK, LIMB = 21, 2048, 30
#: scale * c is cut to this range.
MOST = float(1 << 62)


def integer_vectors(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x): valid vectors in whole numbers."""
    c = F.col("embedding")
    valid = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(c, lambda v: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), v.cast("double") * scale))) + F.lit(offset).cast("long"))
    return vectors.where(valid).select("vec_id", whole.alias("x"))


def matrix(column, dim: int, fill: int):
    """A list column as rows of ``dim`` longs; what is missing is ``fill``."""
    import numpy as np

    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if (ends == dim).all():
        return values.astype(np.int64).reshape(len(ends), dim)
    out = np.full((len(ends), dim), fill, np.int64)
    out[np.arange(dim) < ends[:, None]] = values
    return out


def scatter(y):
    """Sums and cross-products of rows of longs, as object arrays of Python integers, exact."""
    import numpy as np

    dim = y.shape[1]
    sums, cross = np.zeros(dim, object), np.zeros((dim, dim), object)
    for k in range(0, len(y), CHUNK):
        rest, digits = y[k : k + CHUNK], []
        while True:  # signed digits; the last one holds the sign
            low = ((rest + (1 << DIGIT - 1)) & ((1 << DIGIT) - 1)) - (1 << DIGIT - 1)
            digits.append(low.astype(np.float64))
            rest = (rest - low) >> DIGIT
            if not rest.any():
                break
        for i, a in enumerate(digits):
            sums += a.sum(0).astype(np.int64).astype(object) << DIGIT * i
            for j, b in enumerate(digits):
                cross += (a.T @ b).astype(np.int64).astype(object) << DIGIT * (i + j)
    return sums, cross


def _scatter_parts(dim: int, offset: int):
    """On x: (i, j, limb, value), the limbs of a task's cross-products, its sums (j = -1) and count (i = -1)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, sums, cross = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            y = matrix(b.column("x"), dim, offset) - offset
            s, c = scatter(y)
            n, sums, cross = n + len(y), sums + s, cross + c
        rows = []
        for i, j, v in [(-1, -1, n), *((i, -1, sums[i]) for i in range(dim)), *((i, j, cross[i, j]) for i in range(dim) for j in range(i, dim))]:
            sign, v, k = (1 if v >= 0 else -1), abs(int(v)), 0
            while v:
                rows.append((i, j, k, sign * (v & ((1 << LIMB) - 1))))
                v, k = v >> LIMB, k + 1
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.int32(), pa.int64()])], names=["i", "j", "limb", "value"])

    return run


@dataclass
class Whitening:
    """A fitted model: n, exact shifted sums, eigenvalues by falling size, eigenvectors as columns."""

    n: int
    dim: int
    offset: int
    sums: list[int]
    values: Any
    vectors: Any
    trace: float
    identity_error: float | None = None

    def live(self) -> int:
        """Components with variance beyond rounding."""
        floor = self.dim * 2.0**-52 * max(self.values[0], 0.0) if self.dim else 0.0
        return int((self.values > floor).sum())

    def centred(self, x):
        """n * (x - offset) - sums in whole numbers, as longs where they and their squares' sum fit."""
        import numpy as np

        y = x - self.offset
        most = self.n * int(max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))) + max((abs(s) for s in self.sums), default=0)
        if most * most * max(self.dim, 1) < 1 << 62:
            return self.n * y - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def whiten(self, z, components: int):
        """Whitened values of centred rows; nan where a component has no variance."""
        import numpy as np

        out = np.full((len(z), components), np.nan)
        live = min(components, self.live())
        if live:
            away = (z / self.n).astype(np.float64) if z.dtype != object else np.array([[v / self.n for v in r] for r in z.tolist()], np.float64).reshape(z.shape)
            out[:, :live] = away @ self.vectors[:, :live] / np.sqrt(self.values[:live])
        return out


def fit(vectors_x: DataFrame, dim: int, offset: int) -> Whitening | None:
    """The model of the rows of (x); None without rows."""
    import numpy as np

    parts = vectors_x.mapInArrow(_scatter_parts(dim, offset), "i int, j int, limb int, value long").groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))
    whole: dict[tuple[int, int], int] = {}
    for r in parts.toLocalIterator():
        whole[r["i"], r["j"]] = whole.get((r["i"], r["j"]), 0) + (r["value"] << LIMB * r["limb"])
    n = whole.get((-1, -1), 0)
    if not n:
        return None
    sums = [whole.get((i, -1), 0) for i in range(dim)]
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            # Division of whole numbers, rounded once.
            v[i, j] = v[j, i] = (n * whole.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    values, turned = np.linalg.eigh(v)
    return Whitening(n, dim, offset, sums, values[::-1].copy(), turned[:, ::-1].copy(), float(np.trace(v)))


def _measured(vectors_x: DataFrame, model: Whitening, components: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    import numpy as np

    k = min(components, model.live())
    dim, offset = model.dim, model.offset

    def sums_of(mean):
        """On x: (i, j, value): sums of whitened values (without mean), or of centred products."""
        def run(batches):
            import pyarrow as pa

            total = np.zeros(k) if mean is None else np.zeros((k, k))
            for b in batches:
                w = model.whiten(model.centred(matrix(b.column("x"), dim, offset)), k)
                total += w.sum(0) if mean is None else (w - mean).T @ (w - mean)
            at = [(i, -1) for i in range(k)] if mean is None else [(i, j) for i in range(k) for j in range(i, k)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([float(total[i] if mean is None else total[i, j]) for i, j in at], pa.float64())], names=["i", "j", "value"])

        return vectors_x.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()

    if not k:
        return 0.0
    mean = np.zeros(k)
    for r in sums_of(None):
        mean[r["i"]] = r["value"] / model.n
    return max(abs(r["value"] / model.n - (r["i"] == r["j"])) for r in sums_of(mean))


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every valid vector and
    of the leading components. ``deviation`` is a whole number of up to 38 digits."""
    spark = vectors.sparkSession
    kind = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = materialize(integer_vectors(vectors, scale, offset), "whole")
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(dim) - F.size("x")))
    once = materialize(rows.select(filled.alias("x")).distinct(), "distinct")
    model = fit(once, dim, offset)
    if model is None or not dim:
        return spark.createDataFrame([], kind)
    shown = min(components, dim)
    model.identity_error = _measured(once, model, shown)

    def run(batches):
        import decimal

        import numpy as np
        import pyarrow as pa

        wide = decimal.Context(prec=60)
        explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values[:shown]]
        for b in batches:
            for s in range(0, b.num_rows, CHUNK):
                part = b.slice(s, CHUNK)
                z = model.centred(matrix(part.column("x"), dim, offset))
                w, m = model.whiten(z, shown), len(z)
                far = [wide.create_decimal(int(d)) if d < 10**38 else None for d in (z * z).sum(1).tolist()]
                each = np.repeat(np.arange(m), shown)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").cast(pa.int64()).take(pa.array(each)), pa.array(np.tile(np.arange(1, shown + 1), m), pa.int32()), pa.array(np.full(m * shown, model.n), pa.int64()),
                    pa.array(far, pa.decimal128(38, 0)).take(pa.array(each)), pa.array(w.ravel(), pa.float64(), from_pandas=True), pa.array(explained * m, pa.float64()), pa.array(np.full(m * shown, model.identity_error), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, kind)
