"""Exact top-k search by inner product, over tiles of queries and candidates.

Queries and candidates are packed into matrices, stored once and dealt to a grid:
a cell has a group of queries and a group of candidates, both of a bounded number
of bytes, and every pair of groups meets in one cell. A task multiplies its cell
tile by tile, picks the k best of each query in a tile, and merges them into the
cell's list. The lists of the cells are merged in a tree, at most about `fan` at a
time, so no task has all lists of a query. Groups are dealt by a hash of their
pieces, never by the vectors, so equal vectors are no hot key.

Products are exact: single precision where no sum can reach 2**24, double
precision below 2**40, whole numbers of any size beyond. A score beyond a long's
range is given as the range's end.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without an id. Only vectors of a query's own length are its candidates; an
empty vector scores zero. Rows with the query's id are its own and no candidates.
Other repeated rows are candidates each; repeated query rows each get their list.
Equal scores go by the smaller id. A query without candidates has no rows; an
empty table gives an empty result. Other columns have no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import packed, unpacked, whole_vectors

_TOP = "array<struct<low: bigint, vec_id: bigint>>"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _products(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Both matrices in the type that keeps every product exact, and the tile that suits it."""
    size = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    bound = size(q) * size(x) * max(q.shape[1], 1)
    if bound < 1 << 24:
        return q.astype(np.float32), x.astype(np.float32), 1024, 4096
    if bound < 1 << 40:
        return q.astype(np.float64), x.astype(np.float64), 1024, 4096
    return q.astype(object), x.astype(object), 64, 1024


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), each queries x k, best first; -inf where there are no more. `ids` have to be sorted."""
    q, x, height, width = _products(q, x)
    exact = q.dtype == object
    scores = np.full((len(q), k), -np.inf, dtype=object if exact else np.float64)
    found = np.zeros((len(q), k), dtype=np.int64)
    for a in range(0, len(q), height):
        rows = slice(a, a + height)
        for c in range(0, len(x), width):
            own = ids[c : c + width]
            s = q[rows] @ x[c : c + width].T if q.shape[1] else np.zeros((len(q[rows]), len(own)))
            s = np.clip(s, _LEAST, _MOST) if exact else s
            # One number tells score and place: of equal scores the smaller id is ahead.
            key = s.astype(scores.dtype) * width + (width - 1 - np.arange(len(own)))
            first, last = np.searchsorted(own, q_ids[rows], "left"), np.searchsorted(own, q_ids[rows], "right")
            for r in np.flatnonzero(last > first):
                key[r, first[r] : last[r]] = -np.inf
            n = min(k, len(own))
            at = np.argsort(key, axis=1)[:, -n:] if exact else np.argpartition(key, len(own) - n, axis=1)[:, len(own) - n :]
            s = np.where(np.take_along_axis(key, at, 1) == -np.inf, -np.inf, np.take_along_axis(s.astype(scores.dtype), at, 1))
            both, named = np.concatenate([scores[rows], s], 1), np.concatenate([found[rows], own[at]], 1)
            order = np.argsort(named, axis=1, kind="stable")
            both, named = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :k]
            scores[rows], found[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)
    return scores, found


def _stacked(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a group as one matrix, by id."""
    rows = sorted(side.select(["piece", "kind", "x", "dim", "n", "ids"]).to_pylist(), key=lambda r: r["piece"])
    x = np.concatenate([unpacked(r["kind"], r["x"], r["dim"], r["n"]) for r in rows])
    ids = np.concatenate([np.frombuffer(r["ids"], dtype=np.int64) for r in rows])
    order = np.argsort(ids, kind="stable")
    return x[order], ids[order]


def _cells(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(dim, query, query_id, node, top) of every cell; a query is told by its length, its group and its place there."""
    schema = pa.schema([("dim", pa.int32()), ("query", pa.int64()), ("query_id", pa.int64()), ("node", pa.int32()), ("top", pa.list_(pa.struct([("low", pa.int64()), ("vec_id", pa.int64())])))])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        g, h, dim = (x.as_py() for x in key)
        q, q_ids = _stacked(left)
        scores, found = best(q, q_ids, *_stacked(right), k)
        there = scores != -np.inf
        sizes = there.sum(axis=1)
        low = ~scores[there].astype(np.int64)
        top = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.StructArray.from_arrays([pa.array(low), pa.array(found[there])], ["low", "vec_id"]))
        number = (h << 32) + np.arange(len(q))
        same = lambda x: pa.array(np.full(len(q), x, dtype=np.int32))
        return pa.Table.from_arrays([same(dim), pa.array(number), pa.array(q_ids), same(g), top], schema=schema)

    sides = [side.groupBy("g", "h", "dim") for side in (queries, candidates)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, f"dim int, query long, query_id long, node int, top {_TOP}")


def _groups(pieces: DataFrame, group_bytes: int, least: int) -> int:
    """How many groups of about `group_bytes` there are; `least` of them, if there are so many pieces, keep every core at work."""
    size, count = pieces.agg(F.sum(F.col("n").cast("long") * F.col("dim") * 8), F.count("*")).first()
    return min(max(count, 1), max(least, math.ceil((size or 0) / group_bytes)))


def merged(lists: DataFrame, nodes: int, k: int, fan: int = 32) -> DataFrame:
    """The lists of each query merged in a tree: about `fan` at each node, level by level, to one."""
    joined = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    while True:
        nodes = math.ceil(nodes / fan)
        lists = lists.groupBy("dim", "query", "query_id", F.expr(f"node % {nodes}").cast("int").alias("node")).agg(joined)
        if nodes == 1:
            return lists.select("query_id", "top")


def search(
    queries: DataFrame, candidates: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, group_bytes: int = 32 << 20, least_groups: int = 48, fan: int = 32
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` candidates with the highest inner product for each row of `queries`.

    `group_bytes` bounds, on average, what a side of a cell holds as doubles.
    """
    spark = queries.sparkSession
    store = lambda df, name: written(spark, packed(whole_vectors(df, vec_id, vector, scale).filter("vec_id is not null")), name)
    asked, rows = store(queries, "queries"), store(candidates, "candidates")
    down, across = _groups(asked, group_bytes, 1), _groups(rows, group_bytes, least_groups)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = lambda n, name: F.pmod(F.xxhash64("piece"), F.lit(n)).cast("int").alias(name)
    left = asked.select("*", dealt(down, "h"), every(across, "g"))
    right = rows.select("*", dealt(across, "g"), every(down, "h"))
    top = merged(_cells(left, right, k), across, k, fan).select("query_id", F.posexplode("top").alias("at", "best"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("best.vec_id").alias("vec_id"), F.bitwise_not("best.low").alias("score"))


def oracle_sql(k: int = 5, every: int = 50) -> str:
    """The search of every `every`th row of `embeddings` among all others, in DuckDB SQL."""
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
