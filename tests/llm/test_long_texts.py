"""Very long and dense texts: whole results in time and memory that grow as the texts do."""

from __future__ import annotations

import itertools
import random
import subprocess
import sys
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from fieldweave.llm import html, licences, pieces, quality

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def took(f, *args):
    began = time.perf_counter()
    f(*args)
    return time.perf_counter() - began


# licences


def brute_licences(text, least=0.85):
    """Best coefficient of each licence over all segments and windows, by trying every window."""
    import re

    words = lambda s: re.findall(r"[^\W_]+", s.lower())
    pairs = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:])]
    found: dict[str, float] = {}
    every = pairs(words(text))
    segments = [set(pairs(words(s))) for s in (*text.split("\n"), *re.split(r"\n\s*\n", text), text)]
    for name, template in licences.TEMPLATES:
        t = set(licences.bigrams(template))
        high = len(t) * (2 - least) / least
        windows = (set(every[a:b]) for a in range(len(every)) if every[a] in t for b in range(a + 1, min(len(every), a + int(high + 1e-9)) + 1) if every[b - 1] in t)
        for g in itertools.chain(segments, windows):
            dice = 2 * len(g & t) / (len(g) + len(t))
            if dice >= least - 1e-9:
                found[name] = max(found.get(name, 0), dice)
    return {k: round(v, 6) for k, v in found.items()}


def test_licence_windows_are_the_brute_force_ones(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(licences.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["other", "the", "License", "software"])
            parts.append(" ".join(words[rng.choice([0, 0, 2]) :] + ["and", "so", "on"][: rng.randint(0, 3)]))
        texts.append(rng.choice([" ", "\n", "\n\n"]).join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {x["name"]: round(x["dice"], 6) for x in r.licences} for r in licences.scan(docs).collect()}
    assert got == {i: brute_licences(t) for i, t in enumerate(texts)}


def test_texts_full_of_licences_need_little_memory():
    """65,000 words of one licence, and 20,000 of all notices, in a session of 1 GB."""
    code = """
from pyspark.sql import SparkSession
from fieldweave.llm import licences
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").getOrCreate()
mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 600)
mix = (" ".join(t for _, t in licences.TEMPLATES).split() * 40)[:20000]
rows = spark.createDataFrame([(1, " ".join([mit] * 400)), (2, " ".join(mix))], "doc_id long, text string")
found = {r.doc_id: [x["name"] for x in r.licences] for r in licences.scan(rows).collect()}
assert found[1] == ["MIT"] and found[2] == sorted({n for n, _ in licences.TEMPLATES}), found
print("fine")
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]


# quality


def test_counts_do_not_depend_on_ansi_mode(spark, docs):
    texts = ["one two three four", "", None, "a a a a a", "x " * 30_000, "line\n" * 20_000, "word " * 99 + "end"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    got = []
    for mode in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", mode)
        try:
            got.append(sorted(map(str, quality.quality_rules(df).drop("failed_rule").collect())))
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
    assert got[0] == got[1]
    rows = {r.doc_id: r for r in quality.quality_rules(df).collect() if r.doc_id is not None and r.doc_id >= 100}
    assert [rows[100 + i].n_repeat_words for i in range(7)] == [0, 0, 0, 5, 30_000, 20_000, 99]


def test_rules_are_timed_as_they_are_asked(docs):
    """Comparisons of counts that are there cost less than a walk over the words."""
    texts = docs.selectExpr("concat(coalesce(text, ''), repeat(' some more words of it', 4000)) AS text")
    x = quality.Inputs(*[quality.F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "words")])
    sample = quality.measured(texts).select("text", "words", "n_lines", *quality.COUNTS).cache()
    sample.count()
    times = {r.name: seconds for r, seconds, _ in quality.ordered(sample, quality.default_rules(x), runs=4)}
    sample.unpersist()
    assert times["no_letters"] > times["symbols"]


# pages


def test_attributes_of_any_length_take_linear_time():
    for page in (lambda n: f"<div {'x' * n}>text</div>", lambda n: '<a ">" ' * (n // 7), lambda n: f"<p {'a= ' * (n // 3)}>", lambda n: "<script>" + "</script " * (n // 9), lambda n: f"<i a='{'b' * n}>"):
        assert took(html.parse, page(1_000_000)) < 5 and took(html.parse, page(200_000)) < 1.5


def test_attributes_are_read_as_before():
    nodes, _ = html.parse("<div class=\"one two\" id='mainPart' data-x=three role = nav / title=\"class=four\">x</div>")
    assert nodes[1].tokens == {"div", "one", "two", "main", "part", "nav"}


def test_decoding_is_the_best_of_all_consistent_sets():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        nodes = [html.Node("", -1, 0)] + [html.Node("div", int(rng.integers(0, i)), 1) for i in range(1, n)]
        odds = rng.standard_normal(n)
        sets = [k for k in itertools.product([False, True], repeat=n) if all(k[nodes[i].parent] or not k[i] for i in range(1, n))]
        best = max(sets, key=lambda k: odds[np.array(k)].sum())
        assert html.decode(nodes, odds).tolist() == list(best)


# token ids


@pytest.mark.parametrize("text", [" " * 200_000, "ab" * 60_000, "a" * 50_001 + " " * 7_000 + "the" * 5_000, "".join(random.Random(2).choices("thequickbrown", k=60_000)), "\n" * 9_000 + "▁" * 9_000 + "中" * 9_000])
def test_long_units_are_encoded_as_the_library_does(text):
    encoder = pieces.piece_encoder(MODEL)
    assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)


def test_a_unit_of_ten_million_characters():
    code = f"""
import resource
from fieldweave.llm import pieces
encoder = pieces.PieceEncoder({MODEL!r})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(encoder.encode(" " * 10_000_000)) == 4 * 625_001
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert int(out.stdout.split()[-1]) < 500_000, out.stderr[-2000:]


def test_merging_by_a_queue_is_merging_pair_by_pair():
    encoder = pieces.piece_encoder(MODEL)

    def plainly(parts):
        while True:
            found = [(-s[0], k) for k in range(len(parts) - 1) if (s := encoder.score.get(parts[k] + parts[k + 1]))]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(3)
    for _ in range(1500):
        word = "".join(rng.choices("abcdest▁ing中", k=rng.randint(1, 40)))
        assert encoder.merged(word) == plainly(list(word))
