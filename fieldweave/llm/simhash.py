"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves, fewer than the usual four. If two
fingerprints differ in at most three bits, one half differs in at most one. So
each half is indexed under one exact variant and 32 variants that leave out one
bit, and an equality join on the variants finds every candidate. In the variant
without bit b only fingerprints with b clear meet those with b set, so a pair
meets once in a half; a pair that meets in both halves is kept from the first.

Texts with the same fingerprint are one node: the join, the links and the
components run over distinct fingerprints, so a group of exact copies costs one
row. Fingerprints that more than a thousandth of all rows have, which are fewer
than a thousand, get their component by a broadcast, so no task has all rows of
one. Components come from a loop of min-label hooking and shortcutting whose
tables are checkpointed to the shared folder.

Null texts count as empty and have fingerprint zero, which links like any other.
Texts of any length are read whole. Null ids are kept; a component of null ids
only has a null id. Repeated rows stay repeated in the result, and rows that
share an id are one document to `without_near_duplicates`. Ties have no part in
it: a component's id is its smallest. Other columns may have any name. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, kept

HALF = 32
_SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of the XXH64 values of a text's word shingles, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[-1:] if len(words) < shingle else ends[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SLICE):
        pairs = zip(starts[at : min(n, at + _SLICE)].tolist(), last[at : at + _SLICE].tolist())
        h = np.array([digest(joined[a:b], seed) for a, b in pairs], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer, one row per row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, distance: int = 3, fp: str = "fp") -> DataFrame:
    """Every pair (a, b) of distinct fingerprints at most `distance` (3 or less) bits apart, once."""
    if not 0 < distance <= 3:
        raise ValueError("two halves with one free bit cover distances from 1 to 3")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.shiftrightunsigned(fp, HALF).alias("part")),
        F.struct(F.lit(1).alias("half"), F.col(fp).bitwiseAND((1 << HALF) - 1).alias("part")),
    )
    base = fps.select(F.col(fp).alias("fp"), F.explode(halves).alias("x")).select("fp", "x.half", "x.part")
    one = "transform(sequence(0, 31), b -> named_struct('bit', b, 'side', (shiftright(part, b) & 1), 'key', part & ~shiftleft(1L, b)))"
    out = base.select("fp", "half", "part", F.explode(F.expr(one)).alias("v")).select(
        "fp", "half", "v.bit", "v.side", "v.key"
    )
    same = base.select("fp", "half", F.lit(-1).alias("bit"), F.col("part").alias("key"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    # A pair of the second half counts only if the first half differs in two bits or more.
    first = lambda a, b: (F.col("half") == 0) | (F.bit_count(F.shiftrightunsigned(F.col(a).bitwiseXOR(F.col(b)), HALF)) >= 2)
    left = out.filter("side = 0").select("half", "bit", "key", F.col("fp").alias("a")).unionByName(
        same.select("half", "bit", "key", F.col("fp").alias("a"))
    )
    right = out.filter("side = 1").select("half", "bit", "key", F.col("fp").alias("b")).unionByName(
        same.select("half", "bit", "key", F.col("fp").alias("b"))
    )
    joined = left.join(right, ["half", "bit", "key"]).filter(
        near("a", "b") & first("a", "b") & ((F.col("bit") >= 0) | (F.col("a") < F.col("b")))
    )
    return joined.select("a", "b")


def components(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `pairs` (a, b) reaches.

    Each round points every node at the smallest label around it and at its
    label's label. Every table is checkpointed, so a lost executor costs a
    reread and not a recomputation. The loop ends when nothing changes.
    """
    both = kept(spark, pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(around, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # Roots follow what their members found, then everyone follows the root.
        found = hooked.groupBy(F.col("was").alias("top")).agg(F.min("root").alias("best"))
        moved = hooked.join(found, hooked["root"] == found["top"], "left").select(
            "node", "was", F.least("root", F.coalesce("best", "root")).alias("root")
        )
        moved = kept(spark, moved)
        changed = moved.filter("root <> was").limit(1).count()
        labels = moved.select("node", "root")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3, common: int = 1000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`; fingerprints of more than one row in `common` are broadcast."""
    spark = docs.sparkSession
    found = kept(spark, fingerprints(docs, doc_id, text))
    nodes = kept(spark, found.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    roots = components(spark, links(nodes, distance))
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least_id")
    smallest = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = nodes.join(
        linked.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "fp", "left"
    ).select("fp", "n", F.coalesce("component_id", "least_id").alias("component_id"))
    by_fp = kept(spark, by_fp)
    most = (nodes.agg(F.sum("n")).first()[0] or 0) / common
    hot = F.broadcast(by_fp.filter(F.col("n") > most).drop("n"))
    rare = found.join(hot, "fp", "left_anti").join(by_fp.filter(F.col("n") <= most).drop("n"), "fp")
    every = found.join(hot, "fp").unionByName(rare)
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the one document of each component that has its smallest id.

    Rows that repeat that id stay together: they are one document. Rows with a
    null id are never the smallest and cannot be told apart, so they all stay.
    """
    (own,) = free_names(docs.columns, "keep")
    keep = near_duplicates(docs, doc_id, text).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(own)).distinct()
    named = docs.filter(F.col(f"`{doc_id}`").isNotNull())
    kept_rows = named.join(keep, F.col(f"`{doc_id}`") == F.col(own), "left_semi")
    return kept_rows.unionByName(docs.filter(F.col(f"`{doc_id}`").isNull()))
