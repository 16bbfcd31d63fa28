"""Hot keys of passages, languages by brute force, and sampling that no id steers."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from fieldweave.llm import langid, passages

MASK = (1 << 32) - 1


def plain_grams(text):
    """Hashed 1-, 2- and 3-grams of letters, every run of other characters being one gap, in plain Python."""
    kept, letters = [], [c.isalpha() for c in f" {text.lower()} "]
    for k, c in enumerate(f" {text.lower()} "):
        if letters[k]:
            kept.append(ord(c))
        elif (k and letters[k - 1]) or (k + 1 < len(letters) and letters[k + 1]):
            kept.append(32)

    def place(salt, g):
        h = (g ^ g >> 15) * 0x2C1B3C6D + salt * 0x21C88647 & MASK
        return ((h ^ h >> 13) * 0x297A2D39 & MASK) >> 19

    pair = lambda a, b: a * 0x9E3779B1 & MASK ^ b
    out = Counter(place(1, c) for c in kept)
    out.update(place(2, pair(a, b)) for a, b in zip(kept, kept[1:]))
    out.update(place(3, pair(a, b) * 0x85EBCA6B & MASK ^ c * 0x27D4EB2F & MASK) for a, b, c in zip(kept, kept[1:], kept[2:]))
    return out


def brute_language(text, model):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    grams = plain_grams(text)
    v = {g: (1 + math.log(n)) * model.idf[g] for g, n in grams.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    cos = [sum(c[g] * x for g, x in v.items()) / norm for c in model.centers]
    best = max(range(len(cos)), key=lambda k: (round(cos[k], 9), -k))
    return model.languages[best], min(1.0, max(0.0, cos[best]))


def rows(words, lang, first):
    return [(first + i, " ".join(random.Random(first + i).choices(words, k=30)), lang) for i in range(60)]


def test_languages_are_the_nearest_centroids_by_brute_force(spark):
    train = rows(["the", "and", "thing", "other"], "en", 0) + rows(["été", "où", "élève", "garçon"], "fr", 100) + rows(["straße", "über", "und", "nicht"], "de", 200)
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample_per_language=30)
    texts = ["the other thing", "l'élève où", "über die Straße and so on", "x", "", None, "123 !?", "𠀀𠀁 \U00030000\U00031000", "é" * 5000 + " the", *[t for _, t, _ in train[::17]]]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        lang, score = brute_language(r.text, model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-5
    assert got[7].lang_pred != "und"  # letters of every plane are letters


def test_languages_with_equal_centroids_go_by_name(spark):
    words = ["same", "words", "here"]
    both = [(i, " ".join(random.Random(i // 2).choices(words, k=9)), "bb" if i % 2 else "aa") for i in range(80)]
    docs = spark.createDataFrame(both, "doc_id long, text string, lang string")
    out = langid.identify(docs, langid.fit(docs, clusters=1))
    assert {r.lang_pred for r in out.collect()} == {"aa"}


def test_the_sample_depends_on_texts_alone(spark):
    train = rows(["the", "and", "thing", "other"], "en", 0) + rows(["été", "où", "élève", "garçon"], "fr", 100)
    fit = lambda r: langid.fit(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(3), sample_per_language=20)
    one, other = fit(train), fit([(-7 * i, t, lang) for i, t, lang in train])
    assert one.languages == other.languages and np.array_equal(one.centers, other.centers)
    assert fit([(i, f"text {i}", f"lang{i:03d}") for i in range(300)]).languages[:2] == ("lang000", "lang001")


def test_a_passage_that_every_shard_has(spark):
    """Hundreds of shards with one passage: the same removals, and no window over all rows of a key."""
    rng = random.Random(3)
    common = " ".join(rng.choices([f"w{k}" for k in range(90)], k=70))
    docs = [(i, f"{' '.join(rng.choices('abcdefgh', k=20))} x{i} {common} y{i}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r for r in passages.remove_repeats(df, shard_bytes=300).collect()}
    assert len(out) == 400 and out[0].n_removed == 0 and all(r.n_removed == 70 for i, r in out.items() if i)
    assert all(r.kept.split()[-1] == f"y{i}" and f"x{i}" in r.kept for i, r in out.items())
    named = passages.anchors(df, 50, 24).withColumn("shard", passages.shard_of(50))
    assert "Window" not in passages.recurring_anchors(named)._jdf.queryExecution().toString()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("passages")]
