"""Whitening of embeddings by their leading principal components.

Components become whole numbers, x = floor(256 c). The fit list holds each
distinct x once; it is stored as packed matrices, and everything after that is a
pass over it: one for the sums, one for each block of the iteration, one for the
check of the result. The covariance is never formed. A pass multiplies the centred
rows by a block B and gives back Xc'(Xc B), summed by dimension in Spark, so what
a driver sees is dimensions x block, whatever the number of rows.

Block Lanczos with full reorthogonalisation builds the basis: each new block is
made orthogonal to all before it, twice. A column that vanishes in this (breakdown:
the space so far is invariant) is restarted with a random direction orthogonal to
the basis. After each pass the wanted pairs are read from the basis and their
residuals |V u - e u| are computed from products that are already there; the
iteration ends when all of them are below `tolerance` times the largest
eigenvalue, or when the basis spans the whole space. As pairs of equal size can
hide behind one another, one more pair than asked has to converge too.

The trace comes from the exact deviations of the fit list, so shares are known
without the other eigenvalues. Components whose eigenvalue is below 1e-12 of the
trace have no direction of their own and are left out; without variance there are
no components and so no rows. Rows whose vector is null or holds null or
non-finite components take no part, nor do vectors of another length than the
commonest (the shorter of equally common ones). Null ids pass through, repeated
rows stay repeated; a deviation beyond a long's range is null. An empty table gives
an empty result. Other columns have no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import matrices, packed, unpacked, whole_vectors

Pass = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Model:
    """`n` distinct vectors with sums `sums` (exact); `vectors` (dim x k) and `values` of the leading components; the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def block_lanczos(apply: Pass, dim: int, pairs: int, block: int = 16, tolerance: float = 1e-13, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The `pairs` largest eigenvalues of the symmetric matrix that `apply` multiplies with, falling, and their unit eigenvectors."""
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))

    def orthogonal(w: np.ndarray) -> np.ndarray:
        """`w` made orthonormal and orthogonal to the basis, column by column; vanished columns are restarted while there is room."""
        out = basis
        for column in w.T:
            if out.shape[1] == dim:
                break
            size = np.linalg.norm(column)
            for _ in range(20):
                left = column
                for _ in range(2):
                    left = left - out @ (out.T @ left)
                if np.linalg.norm(left) > 1e-10 * size and size > 0:
                    break
                column = rng.standard_normal(dim)
                size = np.linalg.norm(column)
            left = left / np.linalg.norm(left)
            left = left - out @ (out.T @ left)
            out = np.column_stack([out, left / np.linalg.norm(left)])
        return out[:, basis.shape[1] :]

    block = min(block, dim)
    new = orthogonal(rng.standard_normal((dim, block)))
    while True:
        done = apply(new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, done])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        asked = min(pairs + 1, len(values))
        residuals = np.linalg.norm(image @ turn[:, :asked] - basis @ turn[:, :asked] * values[:asked], axis=0)
        if basis.shape[1] == dim or (asked > pairs and residuals.max() <= tolerance * max(values[0], 0.0)):
            u = basis @ turn[:, :pairs]
            return values[:pairs], u / np.linalg.norm(u, axis=0)
        new = orthogonal(done)


def _exact_sums(pieces: DataFrame) -> tuple[int, list[int]]:
    """Rows and the exact sum of each dimension: the high and low halves of the longs are summed apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = unpacked(r["kind"], r["x"], r["dim"], r["n"]).astype(np.int64)
                parts = [np.arange(-1, r["dim"]), np.concatenate(([0], (x >> 32).sum(axis=0))), np.concatenate(([r["n"]], (x & 0xFFFFFFFF).sum(axis=0)))]
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in parts], ["at", "high", "low"])

    rows = pieces.mapInArrow(run, "at long, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    found = {r["at"]: (r["high"] << 32) + r["low"] for r in rows}
    return found.pop(-1, 0), [found[i] for i in range(len(found))]


def _centred(x: np.ndarray, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x less the mean, whose whole part is taken away exactly."""
    return (x - mean).astype(np.float64) - rest


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    whole = [s // n for s in sums]
    return np.array(whole, dtype=np.int64), np.array([float(Fraction(s - w * n, n)) for s, w in zip(sums, whole)])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n x - S)**2 for each row."""
    far, most, dim = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0, max(map(abs, sums), default=0), max(len(sums), 1)
    if far * max(far, most) * dim < 1 << 63:
        # n*n*xx - 2*n*xS + SS: sums of longs, and one whole number of any size for each row.
        squares, mixed = (x * x).sum(axis=1).tolist(), (x * np.array(sums, dtype=np.int64)).sum(axis=1).tolist()
        own = sum(v * v for v in sums)
        return [n * n * a - 2 * n * b + own for a, b in zip(squares, mixed)]
    d = x.astype(object) * n - np.array(sums, dtype=object)
    return (d * d).sum(axis=1).tolist()


def _summed(pieces: DataFrame, width: int, sums_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all pieces of the matrix (any number of rows, `width` columns) that `sums_of` makes of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for r in b.to_pylist():
                part = sums_of(unpacked(r["kind"], r["x"], r["dim"], r["n"]).astype(np.int64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(c) for c in total.T]], ["at", *names])

    names = [f"s{j}" for j in range(width)]
    rows = pieces.mapInArrow(run, "at long, " + ", ".join(f"{c} double" for c in names)).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros((len(rows), width))
    for r in rows:
        out[r["at"]] = [r[c] for c in names]
    return out


def fit(df: DataFrame, components: int = 4, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = 16, tolerance: float = 1e-13) -> Model | None:
    """The leading `components` of the distinct vectors of `df`; None where there is no vector."""
    spark = df.sparkSession
    whole = whole_vectors(df, vec_id, vector, scale)
    lengths = whole.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return None
    dim = lengths["dim"]
    distinct = whole.filter(F.size("x") == dim).select("x").distinct().select(F.lit(0).cast("long").alias("vec_id"), "x")
    pieces = written(spark, packed(distinct), "distinct")
    n, sums = _exact_sums(pieces)
    mean, rest = _mean(n, sums)
    trace = _summed(pieces, 1, lambda x: np.array([[float(sum(deviations(x, n, sums)))]]))[0, 0] / float(n) ** 3 if dim else 0.0

    def apply(b: np.ndarray) -> np.ndarray:
        def sums_of(x: np.ndarray) -> np.ndarray:
            y = _centred(x, mean, rest)
            return y.T @ (y @ b)

        return _summed(pieces, b.shape[1], sums_of) / n

    if not trace > 0:
        return Model(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0)
    values, vectors = block_lanczos(apply, dim, min(components, dim), block, tolerance)
    there = values > 1e-12 * trace
    values, vectors = values[there], vectors[:, there]
    into = vectors / np.sqrt(values)

    def products(x: np.ndarray) -> np.ndarray:
        z = _centred(x, mean, rest) @ into
        return np.vstack([z.sum(axis=0), z.T @ z])

    found = _summed(pieces, len(values), products) / n
    error = np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(len(values))).max()
    return Model(n, sums, values, vectors, float(trace), float(error))


def whiten(df: DataFrame, model: Model | None, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row with a vector of the model's length and each component."""
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    n, k, sums = model.n, len(model.values), model.sums
    mean, rest = _mean(n, sums)
    into = model.vectors / np.sqrt(model.values)
    explained, error = model.values / model.trace, model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in matrices(b.column(1)):
                m = len(x)
                each = pa.array([v if v < 1 << 63 else None for v in deviations(x, n, sums)], type=pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, dtype=np.int64)),
                        each,
                        pa.array((_centred(x, mean, rest) @ into).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    rows = whole_vectors(df, vec_id, vector, scale)
    return rows.filter(F.size("x") == len(sums)).mapInArrow(run, schema)
