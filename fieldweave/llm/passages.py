"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is 50 consecutive words of one document; each word of a window that
also starts in a document with a smaller id goes. Comparing every window with
every other would shuffle the whole corpus several times over, so the job works
in steps. Documents are dealt to shards of a few megabytes by a hash of their
id; what a step has to know about a shard is sent to it once, whatever number of
its documents asks for it. So a passage that a third of all documents share
costs a row for each shard and no task gathers its documents.

0. Copies. Documents with the text of a smaller one, by its MD5, are wholly
   covered and take no part in steps 1 and 2.
1. Anchors. Each window names the least hash among its 24-word grams. Equal
   windows name equal anchors, and about one gram in 14 is one. Anchors that only
   one document names need no further look; grams of half a window leave little
   else to look at.
2. Confirmed passages. Windows with a recurring anchor are told apart by a
   96-bit hash; the smallest (document, place) owns a window. A passage is a
   block of 64 places of an owner with the words of their windows, and a shard
   asks for the blocks that own windows of its documents. A document that asks
   for a block has a window in it, so what is sent grows as the texts do.
3. Automata. Each shard compiles the anchors of its passages, a word being one
   symbol; many passages go through several automata in turn.
4. Streaming. Every document of a shard runs through its automata; each hit in a
   passage of a smaller document is extended both ways, word by word, and what
   reaches 50 words is covered.

So hashes only decide what is looked at, and word-by-word comparison decides
what goes. Texts are shuffled once: they are stored by shard, and the three steps
that need them read that table where it lies.

Null texts have no words. Documents with a null id lose nothing and take nothing
from others. Rows that repeat an id are one document: they take nothing from
each other. Of other columns none is read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bucketed, kept, place, removed, run_hashes, word_hashes, word_spans, written

WINDOW, GRAM, BLOCK = 50, 24, 64
_OTHER = 0xD6E8FEB86659FD93
_SHARD_BYTES = 4_000_000
_SYMBOLS = 0x10FFFF - 0xE000
_TOGETHER = 256  # so many shards at most ask together for a passage


def hashed_words(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, dtype=np.uint8)
    return word_hashes(raw, *word_spans(raw))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(x) - width + 1
    if n < 1:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def window_anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor that each window names, as signed 64-bit integers."""
    return sliding_min(run_hashes(words, gram), window - gram + 1).view(np.int64)


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, doc_id), each once for a row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                found, ids = [], []
                part = b.slice(k, 500)
                for key, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary())):
                    x = np.unique(window_anchors(hashed_words(t.as_py()), window, gram))
                    found.append(x)
                    ids.append(np.full(len(x), key, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))], names=["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor long, doc_id long")


def shard_of(shards: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards))


def copies(prints: DataFrame) -> DataFrame:
    """(shard, doc_id) of ids whose text a smaller id has as well, from (doc_id, print, shard); ids on several rows are left out.

    The first id of a print goes back to its documents by shard, so that no task gets all copies of a text.
    """
    per = prints.groupBy("print", "shard").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    first = per.groupBy("print").agg(F.min("least").alias("first_id"), F.sum("n").alias("n")).filter("n > 1")
    known = per.join(first.drop("n"), "print").select("print", "shard", "first_id")
    single = prints.groupBy("doc_id").agg(F.count("*").alias("rows"), F.first("print").alias("print"), F.first("shard").alias("shard")).filter("rows = 1")
    return single.join(known, ["print", "shard"]).filter("first_id < doc_id").select("shard", "doc_id")


def recurring_anchors(named: DataFrame) -> DataFrame:
    """(shard, anchor): anchors of a shard's documents that another document names as well, from (anchor, doc_id, shard).

    The common anchors are found by an aggregation, which sums up before it
    shuffles, and go back to the shards by a join, which splits a hot one.
    """
    per = named.groupBy("anchor", "shard").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    common = per.groupBy("anchor").agg(F.min("least").alias("lo"), F.max("most").alias("hi")).filter("lo < hi").select("anchor")
    return per.join(common, "anchor", "left_semi").select("shard", "anchor")


def _texts(docs: pa.Table) -> Iterator[tuple[int, bytes]]:
    for key, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.large_binary())):
        yield key, t.as_py()


def windows(docs: DataFrame, facts: DataFrame, window: int, gram: int) -> DataFrame:
    """(h1, h2, doc_id, place, last): each shard's distinct windows with a recurring anchor, where they first start and the last document that has them.

    `docs` is (shard, doc_id, text); `facts` is (shard, anchor, copy) with the recurring anchors, and the documents that are copies.
    """
    kinds = {"h1": pa.int64(), "h2": pa.int32(), "doc_id": pa.int64(), "place": pa.int32(), "last": pa.int64()}
    schema = pa.schema(list(kinds.items()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        named = np.sort(right.column("anchor").drop_null().to_numpy())
        copied = set(right.column("copy").drop_null().to_pylist())
        found: list[tuple[np.ndarray, ...]] = []
        for key, t in _texts(left) if len(named) else ():
            if key in copied:
                continue
            words = hashed_words(t)
            x = window_anchors(words, window, gram)
            at = np.flatnonzero(named[np.minimum(np.searchsorted(named, x), len(named) - 1)] == x)
            if len(at):
                h1, h2 = run_hashes(words, window)[at].view(np.int64), run_hashes(words, window, _OTHER)[at]
                found.append((h1, h2.astype(np.uint32).view(np.int32), np.full(len(at), key, dtype=np.int64), at.astype(np.int32)))
        if not found:
            return schema.empty_table()
        h1, h2, ids, at = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((at, ids, h2, h1))
        h1, h2, ids, at = h1[order], h2[order], ids[order], at[order]
        edge = np.flatnonzero((np.diff(h1) != 0) | (np.diff(h2) != 0))
        first, last = np.append(0, edge + 1), np.append(edge, len(h1) - 1)
        return pa.Table.from_arrays([pa.array(x) for x in (h1[first], h2[first], ids[first], at[first], ids[last])], schema=schema)

    out = "h1 long, h2 int, doc_id long, place int, last long"
    return docs.groupBy("shard").cogroup(facts.groupBy("shard")).applyInArrow(run, out)


def needed(found: DataFrame, shard: Column, block: int = BLOCK) -> DataFrame:
    """(shard, owner_id, block), once each: the blocks that own a window of a shard's later documents. A window has a row per shard at most.

    As with anchors, owners are aggregated and joined back: no task has all rows of a window.
    """
    keys = ["h1", "h2"]
    # Single numbers are summed up in place, a struct of two would be sorted for; a document has one row for a window.
    owners = found.groupBy(*keys).agg(F.min("doc_id").alias("owner_id"), F.min_by("place", "doc_id").alias("at"), F.max("last").alias("most")).filter("owner_id < most").drop("most")
    d = found.select(*keys, shard.alias("shard"), "last").join(owners, keys).filter("owner_id < last")
    return d.select("shard", "owner_id", F.expr(f"at div {block}").alias("block")).distinct()


def passages(docs: DataFrame, wanted: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """(owner_id, block, passage) for the distinct rows (shard, owner_id, block) of `wanted`, whose shard is the owner's: each once."""
    schema = pa.schema([("owner_id", pa.int64()), ("block", pa.int64()), ("passage", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks: dict[int, list[int]] = {}
        for owner, k in zip(*(right.column(c).to_pylist() for c in ("owner_id", "block"))):
            blocks.setdefault(owner, []).append(k)
        ids, at, found = [], [], []
        for key, t in _texts(left):
            if key not in blocks:
                continue
            words = t.split()
            for k in blocks[key]:
                line = words[k * block : (k + 1) * block + window - 1]
                if len(line) >= window:
                    ids.append(key)
                    at.append(k)
                    found.append(b" ".join(line))
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], schema=schema)

    out = "owner_id long, block long, passage string"
    return docs.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(run, out)


class Shard:
    """An automaton over the anchors of some passages (owner_id, text)."""

    def __init__(self, shared: list[tuple[int, bytes]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.half = (window - gram + 1) // 2  # a window around a hit reaches at least so far to one side of it
        self.symbols: dict[bytes, int] = {}
        self.owners: list[int] = []
        self.words: list[np.ndarray] = []
        self.lines: list[str] = []
        hits: dict[str, list[tuple[int, int]]] = {}
        for owner, passage in shared:
            codes, hashes = self.coded(passage.split()), hashed_words(passage)
            named = np.isin(run_hashes(hashes, gram).view(np.int64), window_anchors(hashes, window, gram))
            line = self.line(codes)
            for at in np.flatnonzero(named).tolist():
                hits.setdefault(line[at : at + gram], []).append((len(self.words), at))
            self.owners.append(owner)
            self.words.append(codes)
            self.lines.append(line)
        self.automaton = ahocorasick.Automaton()
        for phrase, where in hits.items():
            self.automaton.add_word(phrase, where)
        self.automaton.make_automaton()

    def coded(self, words: list[bytes]) -> np.ndarray:
        symbols = self.symbols
        return np.array([symbols.setdefault(w, len(symbols)) for w in words], dtype=np.int64)

    def looked_up(self, words: list[bytes]) -> np.ndarray:
        """As `coded`, but words that no passage has share one symbol."""
        find = self.symbols.get
        return np.array([find(w, -1) for w in words], dtype=np.int64)

    @staticmethod
    def line(codes: np.ndarray) -> str:
        """One character a word; more words than characters share some, which costs hits but no correctness."""
        x = (codes + 1) % _SYMBOLS
        return np.where(x < 0xD7FF, x + 1, x + 0x801).astype("<u4").tobytes().decode("utf-32-le")

    def cover(self, doc_id: int, words: list[bytes], out: np.ndarray) -> None:
        """Marks in `out` the words that lie in a window that a passage of a smaller document has too."""
        n, window, gram, half = len(words), self.window, self.gram, self.half
        if n < window or not self.words:
            return
        codes = self.looked_up(words)
        line = self.line(codes)
        reached: dict[tuple[int, int], int] = {}
        clear = 0  # up to here, the words around a hit are known to be covered
        for end, where in self.automaton.iter(line):
            at = end - gram + 1
            if min(n, at + window) <= clear:
                continue
            before, after = line[max(0, at - half) : at], line[end + 1 : end + 1 + half]
            for passage, place in where:
                if self.owners[passage] >= doc_id or reached.get((passage, at - place), 0) > at:
                    continue
                other, stop = self.lines[passage], place + gram
                if not (other[stop : stop + half] == after and len(after) == half or place >= half and other[place - half : place] == before):
                    continue
                theirs = self.words[passage]
                back = min(at, place)
                differ = np.flatnonzero(codes[at - back : at] != theirs[place - back : place])
                begin = at - back + (int(differ[-1]) + 1 if len(differ) else 0)
                ahead = min(n - at, len(theirs) - place)
                differ = np.flatnonzero(codes[at : at + ahead] != theirs[place : place + ahead])
                stop = at + (int(differ[0]) if len(differ) else ahead)
                reached[passage, at - place] = stop
                if stop - begin >= window:
                    out[begin:stop] = True
                    if begin <= max(clear, at - window + gram):
                        # No window around later hits before `stop` has a word left to cover.
                        clear = max(clear, stop)


def streamed(docs: DataFrame, facts: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) from (shard, doc_id, text) and (shard, owner_id, passage).

    Rows of `facts` without a passage name a document that is a copy: it goes as a whole if it has a window.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        copied: set[int] = set()
        groups: list[list[tuple[int, bytes]]] = [[]]
        size = 0
        for owner, p in zip(right.column("owner_id").to_pylist(), right.column("passage").cast(pa.large_binary()).to_pylist()):
            if p is None:
                copied.add(owner)
                continue
            if size + len(p) > _SHARD_BYTES:
                groups.append([])
                size = 0
            groups[-1].append((owner, p))
            size += len(p)
        split = [(key, t.split()) for key, t in _texts(left)]
        covered = [np.full(len(w), key in copied and len(w) >= window) for key, w in split]
        for shared in groups:
            shard = Shard(shared, window, gram)
            for (key, words), out in zip(split, covered):
                if key not in copied:
                    shard.cover(key, words, out)
        texts = [b" ".join([w for w, x in zip(words, out.tolist()) if not x] if out.any() else words) for (_, words), out in zip(split, covered)]
        columns = [[key for key, _ in split], [len(w) for _, w in split], [int(out.sum()) for out in covered]]
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    out = "doc_id long, n_words long, n_removed long, kept string"
    return docs.groupBy("shard").cogroup(facts.groupBy("shard")).applyInArrow(run, out)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_bytes: int = _SHARD_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row; `kept` is what stays, its words joined by one space."""
    spark = docs.sparkSession
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = every.filter("doc_id is not null")
    prints = kept(spark, known.select("doc_id", F.unhex(F.md5("text")).alias("print"), F.octet_length("text").cast("long").alias("bytes")))
    shards = 1 + (prints.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes
    copied = kept(spark, copies(prints.select("doc_id", "print", shard_of(shards).alias("shard"))))
    dealt = bucketed(spark, known.withColumn("shard", shard_of(shards)), "shard", "passages")
    names = place(spark, "anchors")
    named = written(spark, anchors(known, window, gram).join(copied, "doc_id", "left_anti").withColumn("shard", shard_of(shards)), names)

    none = F.lit(None).cast("long")
    facts = recurring_anchors(named).withColumn("copy", none).unionByName(copied.select("shard", none.alias("anchor"), F.col("doc_id").alias("copy")))
    found_at = place(spark, "windows")
    found = written(spark, windows(dealt, facts, window, gram), found_at)
    wanted = written(spark, needed(found, shard_of(shards)), "blocks")
    removed(spark, names)
    removed(spark, found_at)
    # An owner's shard gives each block once. Its askers are counted off into groups, and the block is
    # copied for each group in a row of its own, so that no task has all that want a common one.
    asked = wanted.select(shard_of(shards, "owner_id").alias("shard"), "owner_id", "block").distinct()
    blocks = passages(dealt, asked, window)
    some = F.expr(f"shard div {_TOGETHER}")
    groups = wanted.select("owner_id", "block", some.alias("some")).distinct()
    copied_out = groups.join(blocks, ["owner_id", "block"])
    shared = wanted.withColumn("some", some).join(copied_out, ["owner_id", "block", "some"]).select("shard", "owner_id", "passage")
    facts = shared.unionByName(copied.select("shard", F.col("doc_id").alias("owner_id"), F.lit(None).cast("string").alias("passage")))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    lost = every.filter("doc_id is null").select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(words, " ").alias("kept")
    )
    return streamed(dealt, facts, window, gram).unionByName(lost)


def kept_digest(removed: DataFrame) -> DataFrame:
    """The digest form of `remove_repeats`."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
