"""Vectors as whole numbers, packed into matrices that tasks multiply."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "piece long, dim int, n int, ids binary, kind string, x binary"


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x): each vector's components c as the long floor(scale * c).

    Vectors that are null or hold null or non-finite components are left out, and
    so are those with a component that is no long when scaled.
    """
    v = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    # NaN is above every number and null is not true, so one comparison tells all of them.
    v = v.filter(F.col("v").isNotNull() & F.forall("v", lambda c: F.abs(c) * scale < float(1 << 63)))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the rows of each length in an array of lists without nulls."""
    lengths = np.asarray(column.value_lengths())
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        same = column if len(at) == len(lengths) else column.take(pa.array(at))
        yield at, np.asarray(same.flatten(), dtype=np.int64).reshape(len(at), dim)


def packed_bytes(x: np.ndarray) -> tuple[str, bytes]:
    """A matrix of longs in two bytes each where they fit, else in eight."""
    kind = "<i2" if not x.size or (x.min() >= -(1 << 15) and x.max() < 1 << 15) else "<i8"
    return kind, x.astype(kind).tobytes()


def unpacked(kind: str, x: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(x, dtype=kind).reshape(n, dim)


def packed(vectors: DataFrame, piece_bytes: int = 2 << 20) -> DataFrame:
    """`vectors` (vec_id, x) in pieces of one length of vector; a piece has at most `piece_bytes`, counted as eight bytes a number, or one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 32

        def cut(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, x = (np.concatenate(part) for part in held[dim])
            most = max(1, piece_bytes // (8 * max(dim, 1)))
            at = 0
            while len(ids) - at >= max(1, min(least, most)):
                kind, raw = packed_bytes(x[at : at + most])
                own = ids[at : at + most]
                yield pa.RecordBatch.from_pylist([{"piece": number, "dim": dim, "n": len(own), "ids": own.tobytes(), "kind": kind, "x": raw}], schema=made)
                number += 1
                at += len(own)
            held[dim] = ([ids[at:]], [x[at:]])

        for b in batches:
            ids = np.asarray(b.column(0))
            for at, x in matrices(b.column(1)):
                mine = held.setdefault(x.shape[1], ([], []))
                mine[0].append(ids[at])
                mine[1].append(x)
                if sum(map(len, mine[0])) * 8 * max(x.shape[1], 1) >= piece_bytes:
                    yield from cut(x.shape[1], 1 << 62)
        for dim in held:
            yield from cut(dim, 1)

    made = pa.schema([("piece", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("x", pa.binary())])
    return vectors.select("vec_id", "x").mapInArrow(run, PACKED)
