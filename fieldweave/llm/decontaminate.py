"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of 32 words, a new one every 16. Words are
hashed; their TF-IDF vectors are projected to the leading right singular vectors
of the passage matrix, scaled by the singular values. That decomposition is a
randomised one over all passages: every passage's term counts are added with a
random sign to one row of a small sketch, Spark sums the tasks' sketches, and the
sketch, of fixed size and weighted by IDF, is decomposed on the driver. Row and
sign come from the passage and its document's id, so copies do not add up in
step. One pass counts document frequencies and makes the sketch.

Benchmark items are stored in the shared folder in files of a fixed number of
items. The search is one pass over the documents: each task holds some documents'
passages and takes the item files in turn, so neither the number of items nor
that of their windows has a bound. Windows of items are compared with passages by
cosine. A window of n words that lies in a passage has a cosine of about the
square root of its share of the passage (24 words at most, as the cuts may be 8
words apart); a passage that reaches 0.5 of that is a candidate. Every candidate
is checked in place: the longest common subsequence of the item's words and the
words around the passage must hold most of the item, and so must that of the
item's answer, its last sentence, unless that has fewer than four words or nine
tenths of the item are there. Word order may thus be loosened and words changed,
as a paraphrase does.

Words are compared in lower case (A-Z) without ASCII punctuation. Null or empty
texts and items match nothing. Very long texts go in parts that share a passage.
`contaminated` reports rows that repeat an id once with their best match, the
greatest share in common, then answer, then cosine, and leaves out pairs with a
null id. `without_contamination` judges every row by its own text, with or without
an id, and items without an id count there. Other columns may have any name.
Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, place, word_hashes, word_spans
from .records import store_of

DIM, ROWS, RANK = 1 << 12, 512, 224
PASSAGE, STEP = 32, 16
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else (c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))
_CHUNK = 4_000_000
_PART = 250_000  # words of documents whose passages a task holds at a time
_ACROSS = 2048  # windows of items that are compared with them at a time
_SENTENCE = re.compile(r"[.!?]\s+|\n+")


def plain(text: str) -> bytes:
    """The text in UTF-8 with A-Z lowered and ASCII punctuation and controls as spaces."""
    return text.encode().translate(_PLAIN)


def hashed(raw: bytes) -> np.ndarray:
    """The feature of each word."""
    a = np.frombuffer(raw, dtype=np.uint8)
    return (word_hashes(a, *word_spans(a)) & np.uint64(DIM - 1)).astype(np.int64)


def hashed_all(texts: list[bytes]) -> list[np.ndarray]:
    """The features of many plain texts, hashed together."""
    a = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    starts, ends = word_spans(a)
    f = (word_hashes(a, starts, ends) & np.uint64(DIM - 1)).astype(np.int64)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, begins).tolist()
    return [f[i:j] for i, j in zip(cuts, cuts[1:])]


def common_length(words: list[bytes], other: list[bytes]) -> int:
    """The length of the longest common subsequence, by bits of one large integer."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(words):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(words)) - 1
    v = full
    for w in other:
        m = places.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(words) - v.bit_count()


@dataclass(frozen=True)
class Space:
    """The latent space: a row of weights for each feature, and a last one of zeros."""

    weights: np.ndarray

    def blocks(self, features: np.ndarray) -> np.ndarray:
        """Sums of the words' vectors over steps of STEP words; the last step is filled up with nothing."""
        steps = -(-len(features) // STEP)
        at = np.full(steps * STEP, len(self.weights) - 1)
        at[: len(features)] = features
        rows = self.weights.take(at, axis=0, mode="clip").reshape(steps, STEP, -1)
        return np.matmul(np.ones((1, STEP), dtype=np.float32), rows)[:, 0]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)


def _featured(b: pa.RecordBatch, column: int, most: int = 300_000) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(row, plain text, features) of each row that has a word, hashed some texts at a time."""
    texts: list[bytes] = []
    size = 0
    rows = b.column(column).cast(pa.large_binary())
    for i, t in enumerate(rows):
        texts.append((t.as_py() or b"").translate(_PLAIN))
        size += len(texts[-1])
        if size > most or i == len(rows) - 1:
            first = i + 1 - len(texts)
            for k, f in enumerate(hashed_all(texts)):
                if len(f):
                    yield first + k, texts[k], f
            texts, size = [], 0


def sketched(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Over all passages of (text, salt): a sketch (ROWS x DIM) of their term counts, in how many each feature is, and their number.

    A task's sketch has 17 MB whatever it read, so there are at most eight tasks a core.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n = np.zeros(ROWS * DIM), np.zeros(DIM), 0
        waiting: list[np.ndarray] = []
        salts: list[int] = []
        held = 0

        def add() -> int:
            f = np.concatenate(waiting)
            # Every text starts a passage; a passage's hash gives its row and sign.
            lengths = np.array([len(x) for x in waiting])
            inside = np.arange(len(f)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            starts = np.flatnonzero(inside % PASSAGE == 0)
            sizes = np.diff(np.append(starts, len(f)))
            salt = np.repeat(np.array(salts, dtype=np.int64).view(np.uint64), -(-lengths // PASSAGE))
            key = mixed(np.add.reduceat((f + 1) * (inside % PASSAGE * 2 + 1), starts).astype(np.uint64) + salt)
            row = (key >> np.uint64(8)).astype(np.int64) % ROWS
            sign = np.where(key & np.uint64(1), 1.0, -1.0) / np.sqrt(sizes)
            total.__iadd__(np.bincount(np.repeat(row, sizes) * DIM + f, np.repeat(sign, sizes), minlength=ROWS * DIM))
            pair = np.sort(np.repeat(np.arange(len(starts)), sizes) * DIM + f)
            seen.__iadd__(np.bincount(pair[np.append(True, pair[1:] != pair[:-1])] & (DIM - 1), minlength=DIM))
            waiting.clear()
            salts.clear()
            return len(starts)

        for b in batches:
            own = b.column(1).to_numpy()
            for i, _, f in _featured(b, 0):
                waiting.append(f)
                salts.append(int(own[i]))
                held += len(f)
                if held > _CHUNK // 8:
                    n += add()
                    held = 0
        if waiting:
            n += add()
        count = np.zeros(DIM)
        count[0] = n
        rows = np.vstack([total.reshape(ROWS, DIM), seen, count])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ROWS + 2)), pa.array(list(rows), pa.list_(pa.float64()))], names=["row", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for row, x in zip(b.column(0).to_pylist(), b.column(1)):
                sums[row] = sums.get(row, 0) + x.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["row", "sums"])

    schema = "row long, sums array<double>"
    out = np.zeros((ROWS + 2, DIM))
    spark = docs.sparkSession
    tasks = docs.coalesce(8 * spark.sparkContext.defaultParallelism).mapInArrow(run, schema)
    for r in tasks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row").mapInArrow(merge, schema).collect():
        out[r["row"]] += np.array(r["sums"])
    return out[:ROWS], out[ROWS], int(out[ROWS + 1, 0])


def fit(docs: DataFrame) -> Space:
    """The latent space of all passages of (text, salt)."""
    sketch, counts, n = sketched(docs)
    idf = np.log((1 + n) / (1 + counts)) + 1e-3
    _, s, vt = np.linalg.svd(sketch * idf, full_matrices=False)
    # Directions that no passage has (in small tables) stay out.
    rank = min(RANK, int((s > max(float(s[0]) * 1e-7, 1e-9)).sum()))
    weights = idf[:, None] * (vt[:rank].T / s[:rank])
    # Centred on the mean word, so that unrelated passages are near zero.
    weights -= np.average(weights, axis=0, weights=counts + 1e-9)
    # Rows must lie together in memory: they are what is looked up.
    return Space(np.ascontiguousarray(np.vstack([weights, np.zeros((1, rank))]), dtype=np.float32))


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: their words, answers and the vectors of their windows."""

    ids: list[int | None]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    vectors: np.ndarray
    item_of: np.ndarray
    least: np.ndarray


def prepared(rows: list[tuple[int | None, str]], space: Space, reach: float = 0.5) -> Items:
    ids, words, answers, vectors, item_of, sizes = [], [], [], [], [], []
    for key, text in rows:
        w = plain(text).split()
        if not w:
            continue
        parts = [p for p in _SENTENCE.split(text) if plain(p).split()]
        f = hashed(plain(text))
        starts = [*range(0, max(len(w) - PASSAGE, 0), PASSAGE), max(len(w) - PASSAGE, 0)]
        for a in dict.fromkeys(starts):
            vectors.append(space.weights[f[a : a + PASSAGE]].sum(axis=0))
            item_of.append(len(ids))
            sizes.append(min(len(w), PASSAGE - STEP // 2))
        ids.append(key)
        words.append(w)
        answers.append(plain(parts[-1]).split())
    v = unit(np.array(vectors, dtype=np.float32).reshape(len(vectors), space.weights.shape[1]))
    return Items(ids, words, answers, v, np.array(item_of, dtype=np.int64), reach * np.sqrt(np.array(sizes, dtype=np.float32) / PASSAGE))


class Words:
    """The words of a plain text, split when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.held: list[bytes] | None = None

    def get(self) -> list[bytes]:
        if self.held is None:
            self.held = self.raw.split()
        return self.held


@dataclass(frozen=True)
class Check:
    """What share of an item and of its answer must be there."""

    least_common: float = 0.7
    least_answer: float = 0.5

    def matches(self, words: Words, first: int, cosines: np.ndarray, items: Items, start: int, out: dict[int, tuple[float, float, float]]) -> None:
        """Puts item -> (cosine, share in common, share of the answer in common) into `out`, for passages from the word `first` on and item windows from `start` on."""
        places, windows = np.nonzero(cosines >= items.least[start : start + cosines.shape[1]])
        for p, q in zip(places.tolist(), windows.tolist()):
            k = int(items.item_of[start + q])
            if k in out and out[k][1] == 1.0:
                continue
            want, at = items.words[k], first + p * STEP
            around = words.get()[max(0, at - len(want)) : at + PASSAGE + len(want)]
            # Words that do not occur are in no common subsequence.
            if sum(map(set(around).__contains__, want)) < self.least_common * len(want):
                continue
            share = common_length(want, around) / len(want)
            if share < self.least_common or (k in out and out[k][1] >= share):
                continue
            answer = common_length(items.answers[k], around) / len(items.answers[k])
            if answer >= self.least_answer or share >= 0.9 or len(items.answers[k]) < 4:
                out[k] = (float(cosines[p, q]), share, answer)


class Blocks:
    """The stored items of a benchmark, a file at a time; the last few stay in memory."""

    def __init__(self, files: list[str], space: Space, reach: float, most: int = 16):
        self.files, self.space, self.reach, self.most = files, space, reach, most
        self.held: dict[str, Items] = {}

    def __iter__(self) -> Iterator[Items]:
        for name in self.files:
            if name not in self.held:
                store, where = store_of(name)
                t = pq.read_table(where, filesystem=store, columns=["item_id", "text"])
                if len(self.held) >= self.most:
                    self.held.pop(next(iter(self.held)))
                self.held[name] = prepared(list(zip(t.column(0).to_pylist(), t.column(1).to_pylist())), self.space, self.reach)
            yield self.held[name]


def searched(b: pa.RecordBatch, column: int, blocks: Blocks, check: Check) -> Iterator[tuple[int, int | None, tuple[float, float, float]]]:
    """(row, item id, measures) of every item that a row of the batch holds."""
    waiting: list[tuple[int, Words, int, np.ndarray]] = []

    def flush() -> Iterator[tuple[int, int | None, tuple[float, float, float]]]:
        rows = np.concatenate([x for *_, x in waiting])
        cuts = np.cumsum([0] + [len(x) for *_, x in waiting]).tolist()
        for items in blocks:
            found: dict[int, dict[int, tuple[float, float, float]]] = {}
            for start in range(0, len(items.vectors), _ACROSS):
                got = rows @ items.vectors[start : start + _ACROSS].T
                hit = np.flatnonzero((got >= items.least[start : start + _ACROSS]).any(axis=1))
                for k in np.unique(np.searchsorted(cuts, hit, side="right") - 1).tolist():
                    i, words, first, _ = waiting[k]
                    check.matches(words, first, got[cuts[k] : cuts[k + 1]], items, start, found.setdefault(i, {}))
            for i, some in found.items():
                for k, v in some.items():
                    yield i, items.ids[k], v
        waiting.clear()

    size = 0
    for i, raw, f in _featured(b, column):
        words = Words(raw)
        for first in range(0, len(f), _PART):
            # Long texts go in parts that share a passage.
            x = blocks.space.blocks(f[first : first + _PART + PASSAGE])
            x[:-1] += x[1:].copy()
            waiting.append((i, words, first, unit(x)))
            size += len(x) * STEP
            if size > _PART:
                yield from flush()
                size = 0
    if waiting:
        yield from flush()


def _stored(benchmark: DataFrame, item_id: str, item_text: str, block_items: int) -> list[str]:
    """The files of a benchmark's items in the shared folder, at most `block_items` in each."""
    spark = benchmark.sparkSession
    path = place(spark, "items")
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("text is not null")
    items.write.option("maxRecordsPerFile", block_items).parquet(path)
    return sorted(spark.read.schema(items.schema).parquet(path).inputFiles())


def fit_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Space:
    """The latent space of the passages of all documents."""
    return fit(docs.select(F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{doc_id}`")).alias("salt")).filter("text is not null"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    reach: float = 0.5,
    check: Check = Check(),
    block_items: int = 256,
    space: Space | None = None,
) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer) of every document that holds most of an item."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(space or fit_documents(docs, doc_id, text))
    files = _stored(benchmark, item_id, item_text, block_items)
    names = ["doc_id", "item_id", "cosine", "common", "answer"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files, held.value, reach)
        for b in batches:
            keys = b.column(0).to_pylist()
            found = [(keys[i], item, *v) for i, item, v in searched(b, 1, blocks, check) if keys[i] is not None and item is not None]
            columns = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = own.mapInArrow(run, "doc_id long, item_id long, cosine double, common double, answer double")
    best = F.max_by(F.struct("cosine", "common", "answer"), F.struct("common", "answer", "cosine")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.common", "best.answer")


def without_contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    reach: float = 0.5, check: Check = Check(), block_items: int = 256, space: Space | None = None,
) -> DataFrame:
    """`docs` without the rows that hold most of a benchmark item."""
    held = docs.sparkSession.sparkContext.broadcast(space or fit_documents(docs, doc_id, text))
    files = _stored(benchmark, item_id, item_text, block_items)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files, held.value, reach)
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            for i, _, _ in searched(b, at, blocks, check):
                keep[i] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
