"""Every operator over rows with nulls, empty and very long texts, ties, repeats and columns named like its own."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldweave.llm import decontaminate, html, langid, licences, passages, pieces, pii, quality, records, simhash

NAMES = [
    "row", "c0", "c1", "words", "windows", "repeats", "lines", "grams", "known", "hits", "all", "keep", "_keep", "__keep", "bad", "_bad", "fp", "n", "node",
    "root", "component_id", "fingerprint", "shard", "print", "anchor", "copy", "owner_id", "block", "passage", "kept", "n_removed", "lang_pred", "score",
    "rejected", "held_out", "draw", "salt", "ids", "decoded", "licences", "n_lines", "_words", "_text", "_hits", "_again", "n_words", "failed_rule", "votes",
    "kind", "spans", "item_id", "cosine", "tie", "start", "part", "seq",
]
MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.drop("fp").withColumns({c: F.lit(f"own {c}") for c in NAMES}).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "some words of an item that no text has in it"), (None, None), (2, "")], "item_id long, text string")


def near(docs, items):
    return simhash.without_near_duplicates(docs)


def clean(docs, items):
    return decontaminate.without_contamination(docs, items)


KEEPING = {
    "language": (lambda d, i: langid.identify(d, langid.fit(d)), {"lang_pred", "score", "rejected"}),
    "near_duplicates": (near, set()),
    "benchmark": (clean, set()),
    "personal_data": (lambda d, i: pii.redact(d), set()),
    "licences": (lambda d, i: licences.scan(d), {"licences"}),
    "quality": (lambda d, i: quality.quality_rules(d), {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept"}),
    "verdicts": (lambda d, i: quality.verdicts(d), {"failed_rule", "kept"}),
    "pieces": (lambda d, i: pieces.encode_pieces(d, MODEL), {"ids", "decoded"}),
    "html": (lambda d, i: html.extract(d.withColumnRenamed("text", "html").withColumnRenamed("doc_id", "page_id")), {"text", "n_chars"}),
}
OTHERS = {
    "near_duplicates": lambda d, i: simhash.near_duplicates(d),
    "contaminated": lambda d, i: decontaminate.contaminated(d, i),
    "spans": lambda d, i: pii.find_spans(d),
    "passages": lambda d, i: passages.remove_repeats(d),
    "records": lambda d, i: records.read_records(records.write_records(d, VOCABULARY)),
    "digests": lambda d, i: pieces.piece_digests(d, MODEL),
}


@pytest.mark.parametrize("name", KEEPING)
def test_columns_stay_whatever_their_names(clashing, items, name):
    f, new = KEEPING[name]
    out = f(clashing, items)
    mine = [c for c in NAMES if c not in new]
    assert set(mine) | new <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    rows = out.select(*mine).distinct().collect()
    assert [r.asDict() for r in rows] == [{c: f"own {c}" for c in mine}]
    assert out.count() == (clashing.count() if name not in ("near_duplicates", "benchmark") else out.count())


@pytest.mark.parametrize("name", OTHERS)
def test_results_do_not_depend_on_other_columns(docs, clashing, items, name):
    rows = lambda d: sorted(map(str, OTHERS[name](d, items).drop("path").collect()))
    assert rows(clashing) == rows(docs.select("doc_id", "text"))


@pytest.mark.parametrize("name", KEEPING)
def test_empty_tables_and_null_rows(spark, clashing, items, name):
    f, new = KEEPING[name]
    assert f(clashing.limit(0), items.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (None, None, None), (1, None, None), (1, "", "en")], "doc_id long, text string, lang string")
    assert 1 <= f(nulls, items).count() <= 4


def test_stages_of_the_pipeline_with_clashing_columns(spark, clashing, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns and 0 < out.count() <= clashing.count()
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, str(tmp_path)).count() == clashing.count()
