"""Language identification by the nearest of several centroids per language.

A text becomes counts of its hashed letter 1-, 2- and 3-grams, weighted by
1 + ln(count) and by inverse document frequency, and scaled to length one.
Document frequencies are counted over all training rows. Centroids come from
spherical k-means within each language, on a sample whose expected size per
language is a parameter; their seeds leave out a language's most unusual texts, so
that no centroid stands for a single one. A text takes the language of the
centroid with the greatest cosine, the first by name on a tie; it is rejected if
that cosine is under half of what nearly all of the centroid's own texts have.
Short texts have few grams and so a small cosine with any centroid, which the
bound allows for.

Null texts and texts without a letter are `und` with score 0, and rejected. Long
texts are counted whole, in slices. Repeated rows get a row each; null ids pass
through (their hash part counts as training, without an effect on the result's
shape); columns called like the new ones give way, others may have any name; an
empty table gives an empty result; with no training rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1 << 13
UND = "und"
_HALF_GRAMS = 150
_SLICE = 1 << 20
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed grams, or None if the text has no letter.

    Every run of other characters is one gap, so grams know where words begin and end.
    """
    table = _letter_table()
    counts = np.zeros(DIM, dtype=np.int64)
    seen = False
    for at in range(0, len(text), _SLICE):
        codes = np.frombuffer(f" {text[at : at + _SLICE].lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = table[codes]
        if not letter.any():
            continue
        seen = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:-1] |= letter[1:]
        codes = np.where(letter, codes, 32)[keep].astype(np.uint32)
        # Two gaps in a row stand between words only if one character did.
        two = codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0x27D4EB2F)
        for salt, g in ((1, codes), (2, two), (3, three)):
            h = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(salt * 0x21C88647)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39)
            counts += np.bincount(h >> np.uint32(32 - 13), minlength=DIM)
    return counts if seen else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the normalised TF-IDF vector."""
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(v @ v)
    return at, (v / norm if norm else v)


def cluster(vectors: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds among the nine tenths nearest to the mean: (centroids, least cosine within each by the 1 % quantile)."""
    near = vectors @ vectors.mean(axis=0)
    usual = np.flatnonzero(near >= np.quantile(near, 0.1))
    seeds = [int(np.argmax(near))]
    while len(seeds) < min(k, len(usual)):
        seeds.append(int(usual[np.argmin((vectors[usual] @ vectors[seeds].T).max(axis=1))]))
    centers = vectors[seeds]
    for _ in range(rounds):
        own = np.argmax(vectors @ centers.T, axis=1)
        sums = np.stack([vectors[own == j].sum(axis=0) if (own == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cos = vectors @ centers.T
    own = np.argmax(cos, axis=1)
    least = np.array([np.quantile(cos[own == j, j], 0.01) if (own == j).any() else 0.0 for j in range(len(centers))])
    return centers, least


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    centers: np.ndarray
    least: np.ndarray

    def predict(self, text: str | None, slack: float) -> tuple[str, float, bool]:
        counts = gram_counts(text) if text else None
        if counts is None or not self.languages:
            return UND, 0.0, True
        at, v = weighted(counts, self.idf)
        cos = self.centers[:, at] @ v
        best = int(np.argmax(cos))
        score = float(np.clip(cos[best], 0.0, 1.0))
        # A text of g distinct grams reaches about this share of a long text's cosine.
        share = np.sqrt(len(at) / (len(at) + _HALF_GRAMS))
        return self.languages[best], score, bool(score < self.least[best] * slack * share)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many texts have each hashed gram, over all rows, and how many texts have a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0):
                counts = gram_counts(t.as_py() or "")
                if counts is not None:
                    total += counts > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["gram", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    found = {r["gram"]: r["n"] for r in rows}
    n = found.pop(-1, 0)
    out = np.zeros(DIM, dtype=np.int64)
    for g, c in found.items():
        out[g] = c
    return out, n


def fit(train: DataFrame, lang: str = "lang", text: str = "text", sample_per_language: int = 400, clusters: int = 4, most_languages: int = 256) -> LanguageModel:
    """Learns from `train`; rows without a language are left out.

    Frequencies cover all rows; the centroids are fitted on about
    `sample_per_language` distinct texts of each language, chosen by a hash of the
    text, so that copies count once. Of more than `most_languages` names only those
    with the most texts, then the first by name, are learnt.
    """
    train = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("draw")
    )
    seen, n = document_frequencies(train.select("text"))
    idf = np.log((1 + n) / (1 + seen)) + 1.0
    counted = train.select("lang", "draw").distinct().groupBy("lang").count()
    sizes = {r["lang"]: r["count"] for r in counted.orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not sizes or not n:
        return LanguageModel((), idf, np.zeros((0, DIM)), np.zeros(0))
    share = F.lit(0.0)
    for name, size in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample_per_language / size))).otherwise(share)
    picked = train.filter(F.pmod("draw", F.lit(1 << 30)) < share * F.lit(float(1 << 30))).select("lang", "text").distinct()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ats, values = [], [], []
            for name, t in zip(b.column(0).to_pylist(), b.column(1)):
                counts = gram_counts(t.as_py() or "")
                if counts is not None:
                    at, v = weighted(counts, idf)
                    names.append(name)
                    ats.append(at.astype(np.int32))
                    values.append(v.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ats, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "at", "v"])

    def centers(pdf):
        import pandas as pd

        dense = np.zeros((len(pdf), DIM))
        for i, (at, v) in enumerate(zip(pdf["at"], pdf["v"])):
            dense[i, at] = v
        dense = dense[np.lexsort(dense[:, ::97].T)]  # the same order on every run
        found, least = cluster(dense, clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "center": list(found.astype(np.float32)), "least": least})

    rows = picked.mapInArrow(vectors, "lang string, at array<int>, v array<float>").groupBy("lang").applyInPandas(centers, "lang string, center array<float>, least double").collect()
    rows.sort(key=lambda r: (r["lang"], -r["least"], r["center"][:64]))
    return LanguageModel(tuple(r["lang"] for r in rows), idf, np.array([r["center"] for r in rows]).reshape(-1, DIM), np.array([r["least"] for r in rows]))


def is_held_out(doc_id: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", slack: float = 0.45) -> DataFrame:
    """`docs` with `lang_pred`, `score` and `rejected`; columns of those names give way.

    A text is rejected if it is `und`, or if its cosine is under `slack` times
    the 1 % quantile of the centroid's own sample, or less for short texts.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own.index(text)
        for b in batches:
            found = [held.value.predict(t.as_py(), slack) for t in b.column(at)]
            new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*own, "lang_pred", "score", "rejected"])

    return docs.select(*own).mapInArrow(run, schema)
