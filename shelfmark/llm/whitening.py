"""Whitening of embeddings with exact sums from bit-sliced scatter.

Components become whole numbers, floor(scale x) + offset. The fit list holds each distinct vector once.
Its cross-products are counted, not multiplied: every dimension, less its smallest value, is cut into bit
planes, each plane packed across rows into 64-bit words. The product sum of two dimensions is the sum,
over pairs of their planes, of 2^(a+b) times the bits that both planes have set. The sums of all tasks
are added as whole numbers and centred as whole numbers, n Q - S S', before the one division and the
eigenvectors, so the covariance is exact to its last bit.

Only per-dimension sums and one number per pair of dimensions reach the driver, whatever the rows.

Defined cases: vectors that are null, empty, or hold a null, NaN or infinite component take no part.
Components beyond 2^34 are held there. Vectors of each length are whitened for themselves. Rows that
repeat stay repeated, rows without id stay; a vector counts once for the fit. A component whose
eigenvalue is zero to rounding (constant dimensions, fewer vectors than dimensions) has a null
``whitened`` and is left out of ``identity_error``. Empty tables stay empty; other columns are not read.
"""

from __future__ import annotations

from decimal import Context

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import written

SCALE, OFFSET = 64, 1_000_000
#: Scaled components are held within 2 ** LARGEST_BITS, so all sums fit 38 digits.
LARGEST_BITS = 40
#: Rows whose planes are counted at once.
SLICE_ROWS = 4096

_WIDE = pa.decimal128(38, 0)
_EXACT = Context(prec=60)


def fixed_point(vector: Column) -> Column:
    """floor(SCALE * x) + OFFSET of each component, computed in doubles."""
    edge = float(1 << LARGEST_BITS)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-edge), F.least(
        F.lit(edge), F.lit(float(SCALE)) * x.cast("double")))).cast("long") + F.lit(OFFSET))


def _usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & (F.size(vector) > 0)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def _wide(values) -> pa.Array:
    """Whole numbers of any size as decimals."""
    if isinstance(values, np.ndarray) and values.dtype == np.int64:
        return pa.array(values).cast(_WIDE)
    return pa.array([_EXACT.create_decimal(int(v)) for v in values], _WIDE)


def _moments(fit: DataFrame, dim: int) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, and sum, least and greatest of each dimension."""
    def run(batches):
        n, total, low, high = 0, [0] * dim, None, None
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            if len(x):
                n += len(x)
                for at in range(0, len(x), 1 << 20):  # sums of so many fit 64 bits
                    total = [a + b for a, b in zip(total, x[at:at + (1 << 20)].sum(0).tolist())]
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([n] * dim, pa.int64()),
                                              _wide(total), pa.array(low), pa.array(high)], ["d", "n", "total", "low", "high"])
    rows = (fit.select("x").mapInArrow(run, "d int, n long, total decimal(38,0), low long, high long")
            .groupBy("d").agg(F.sum("n"), F.sum("total"), F.min("low"), F.max("high")).orderBy("d").collect())
    return rows[0][1], [int(r[2]) for r in rows], [r[3] for r in rows], [r[4] for r in rows]


def bit_planes(y: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of non-negative numbers: words of every plane, and the dimension and bit of each plane."""
    rows = -(-len(y) // 64) * 64
    planes, dims, bits = [], [], []
    for bit in range(max(widths, default=0)):
        some = np.flatnonzero(np.array(widths) > bit)
        set_ = np.zeros((len(some), rows), np.uint8)
        set_[:, :len(y)] = ((y[:, some] >> bit) & 1).T
        planes.append(np.packbits(set_, axis=1).view(np.uint64))
        dims.append(some)
        bits.append(np.full(len(some), bit))
    if not planes:
        return np.empty((0, rows // 64), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(planes), np.concatenate(dims), np.concatenate(bits)


def cross_products(y: np.ndarray, widths: list[int]) -> np.ndarray:
    """y' y of rows of non-negative numbers of at most ``widths`` bits, from counts of common bits."""
    words, dims, bits = bit_planes(y, widths)
    counts = np.zeros((len(words), len(words)), np.int64)
    for p in range(len(words)):
        counts[p, p:] = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
        counts[p:, p] = counts[p, p:]
    fits = 2 * max(widths, default=0) + len(y).bit_length() < 63
    kind = np.int64 if fits else object
    weights = np.zeros((y.shape[1], len(words)), kind)
    weights[dims, np.arange(len(words))] = [1 << int(b) for b in bits]
    return weights.dot(counts.astype(kind)).dot(weights.T)


def _scatter(fit: DataFrame, low: list[int], widths: list[int]) -> np.ndarray:
    """Sums over all rows of the products of every two dimensions, each less its smallest value."""
    dim = len(low)
    upper = np.triu_indices(dim)

    def run(batches):
        total, held = np.zeros((dim, dim), object), []

        def add():
            nonlocal total
            y = np.concatenate(held) - np.array(low)
            for at in range(0, len(y), SLICE_ROWS):
                total = total + cross_products(y[at:at + SLICE_ROWS], widths).astype(object)
            held.clear()

        for batch in batches:
            held.append(_matrix(batch.column(0), dim))
            if sum(map(len, held)) >= SLICE_ROWS:
                add()
        if held:
            add()
            yield pa.RecordBatch.from_arrays([*(pa.array(u.astype(np.int32)) for u in upper), _wide(total[upper])], ["i", "j", "q"])

    found = (fit.select("x").mapInArrow(run, "i int, j int, q decimal(38,0)")
             .groupBy("i", "j").agg(F.sum("q").alias("q")).toArrow())
    out = np.zeros((dim, dim), object)
    for i, j, q in zip(*(found.column(c).to_pylist() for c in "ijq")):
        out[i, j] = out[j, i] = int(q)
    return out


class Whitener:
    """What is needed to whiten a vector: sums, and components by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int], scatter: np.ndarray, most: int):
        self.n, self.low = n, np.array(low, np.int64)
        #: n times the mean, less n times the smallest value, per dimension.
        self.rest = [s - n * a for s, a in zip(sums, low)]
        dim = len(low)
        self.covariance = np.array([[(n * scatter[i, j] - self.rest[i] * self.rest[j]) / (n * n) for j in range(dim)]
                                    for i in range(dim)], np.float64)
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")[:most]
        self.values, self.vectors = np.maximum(values[order], 0), vectors[:, order]
        at = np.abs(self.vectors).argmax(axis=0)
        self.vectors = self.vectors * np.where(self.vectors[at, np.arange(len(order))] < 0, -1.0, 1.0)
        self.sound = self.values > max(values.max(initial=0), 0) * dim * np.finfo(float).eps
        trace = float(sum(n * scatter[i, i] - self.rest[i] ** 2 for i in range(dim)) / (n * n))
        self.explained = self.values / trace if trace else np.zeros(len(order))
        #: n (x - mean) stays below this.
        self.reach = n * max((b - a for a, b in zip(low, high)), default=0) + 1
        self.scaling = np.where(self.sound, 1 / np.sqrt(np.where(self.sound, self.values, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        kind = np.int64 if self.reach < 2 ** 62 else object
        return (x - self.low).astype(kind) * self.n - np.array(self.rest, kind)

    def deviations(self, centred: np.ndarray):
        fits = centred.dtype == np.int64 and self.reach ** 2 * centred.shape[1] < 2 ** 63
        return (centred ** 2).sum(axis=1) if fits else (centred.astype(object) ** 2).sum(axis=1)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.vectors * self.scaling


def _identity_error(fit: DataFrame, model: Whitener) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, over sound components."""
    dim, wide = len(model.low), len(model.values)

    def run(batches):
        n, total, square = 0, np.zeros(wide), np.zeros((wide, wide))
        for batch in batches:
            z = model.whitened(model.centred(_matrix(batch.column(0), dim)))
            n, total, square = n + len(z), total + z.sum(0), square + z.T @ z
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide * (wide + 1), dtype=np.int32)),
                                              pa.array(np.concatenate([total, square.ravel()]))], ["at", "v"])
    sums = np.zeros(wide * (wide + 1))
    for at, v in fit.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
        sums[at] = v
    mean, square = sums[:wide] / model.n, sums[wide:].reshape(wide, wide) / model.n
    apart = np.abs(square - np.outer(mean, mean) - np.eye(wide))[np.ix_(model.sound, model.sound)]
    return float(apart.max(initial=0))


def fit_list(vectors: DataFrame, *, vector: str = "embedding") -> DataFrame:
    """Each distinct fixed-point vector ``x`` once."""
    return (vectors.where(_usable(vectors[vector])).select(fixed_point(vectors[vector]).alias("x")).distinct())


def fit(distinct: DataFrame, dim: int, components: int) -> tuple[Whitener, float]:
    """The whitener of a written fit list of vectors of ``dim`` components, and its identity error."""
    n, sums, low, high = _moments(distinct, dim)
    scatter = _scatter(distinct, low, [(b - a).bit_length() for a, b in zip(low, high)])
    model = Whitener(n, sums, low, high, scatter, components)
    return model, _identity_error(distinct, model)


def _apply(rows: DataFrame, dim: int, model: Whitener, error: float) -> DataFrame:
    wide = len(model.values)

    def run(batches):
        for batch in batches:
            centred = model.centred(_matrix(batch.column(1), dim))
            many = len(centred)
            white = model.whitened(centred)
            at = pa.array(np.repeat(np.arange(many), wide))
            each = lambda values: pa.array(np.tile(values, many))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), each(np.arange(1, wide + 1, dtype=np.int32)),
                 pa.array(np.full(many * wide, model.n)), _wide(model.deviations(centred)).take(at),
                 pa.array(white.ravel(), mask=np.tile(~model.sound, many)), each(model.explained),
                 pa.array(np.full(many * wide, error))], names)

    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.select("id", "x").mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = 16, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row per vector and component.

    ``deviation`` is the sum over dimensions of (n x - S)^2, a decimal of up to 38 digits.
    """
    rows = (vectors.where(_usable(vectors[vector]))
            .select(vectors[id].cast("long").alias("id"), fixed_point(vectors[vector]).alias("x")))
    distinct = written(fit_list(vectors, vector=vector), "fit-list")
    found = None
    for (dim,) in sorted(distinct.select(F.size("x")).distinct().collect()):
        same = F.size("x") == dim
        part = _apply(rows.where(same), dim, *fit(distinct.where(same), dim, components))
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, component int, n long, deviation decimal(38,0), "
                                                         "whitened double, explained double, identity_error double")
    return found.withColumnRenamed("id", id)
