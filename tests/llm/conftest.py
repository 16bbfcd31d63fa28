from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def corpus():
    """Rows of (doc_id, text, lang): nulls, empty and one-word texts, copies, long runs, repeated rows."""
    words = [f"{a}{b}{c}" for a in ("th", "er", "on", "an") for b in ("e", "ing", "ou", "a") for c in ("st", "nd", "ly", "re")]
    base = " ".join(random.Random(1).choices(words, k=160))
    long = " ".join(random.Random(2).choices(words, k=4000))
    rows = [
        (0, base, "en"),
        (1, base, "en"),
        (2, base + " tail words here", "en"),
        (3, "Prefix of another kind. " + " ".join(base.split()[20:110]) + " and then an end.", "en"),
        (4, None, "en"),
        (5, "", None),
        (6, "word", "fr"),
        (7, long, "en"),
        (8, "x" * 100_000, None),
        (9, "\n".join(["same line of some words again and again"] * 40), "en"),
        (10, "élève à l'école où était né François\n" * 9, "fr"),
        (11, "12345 !!! ???", None),
        (12, "Write to jo.doe@mail.example.com or +1 (017) 555-7713, host 10.20.30.40, card 4417744280351547.", "en"),
        (13, "a\tb\x0bc\x0cd\re  f\n\n g\x00h\x1ci\x85j k", "de"),
        (14, "Some text.\n\nReleased under the MIT License.\nMore text.", "en"),
        (None, base, "en"),
        (6, "word", "fr"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(*r, "src", 7, "clash") for r in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, fp string")
