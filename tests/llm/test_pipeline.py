"""The pipeline's stages on the awkward corpus, each against what its operator says."""

from __future__ import annotations

import public_tokenizers
import sentencepiece

import corpus_pipeline
from fieldweave.llm import simhash


def test_stages(spark, docs, tmp_path):
    docs = docs.drop("fp")
    bench = "thest thend thely there ondst only anest erest ouly something else again"
    docs = docs.unionByName(spark.createDataFrame([(70, "Clean words before it. " + bench + " And clean words after it.", "en", "s", 1)], docs.schema))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "benchmark", "personal_data", "token_ids"]
    a = stages["language"](spark, docs, str(tmp_path)).cache()
    ids = {r.doc_id for r in a.collect()}
    assert not {4, 5, 11} & ids and {0, 1, 2, 3, 7, 9, 10, 12, 70} <= ids and a.columns == docs.columns
    b = stages["near_duplicates"](spark, a, str(tmp_path)).cache()
    want = {r.doc_id for r in simhash.near_duplicates(a).collect() if r.doc_id is not None and r.doc_id == r.component_id} | {None}
    assert {r.doc_id for r in b.collect()} == want and b.columns == docs.columns
    c = stages["benchmark"](spark, b, str(tmp_path)).cache()
    assert {r.doc_id for r in c.collect()} == want - {70} and c.columns == docs.columns
    d = stages["personal_data"](spark, c, str(tmp_path)).cache()
    assert d.columns == docs.columns and d.count() == c.count()
    assert "<EMAIL>" in d.filter("doc_id = 12").first().text
    e = stages["token_ids"](spark, d, str(tmp_path)).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in d.collect()}
    assert len(e) == d.count() and all(r.ids == model.encode(text[r.doc_id], add_bos=True, add_eos=True) and r.n_tokens == len(r.ids) for r in e)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(str(r.doc_id) for r in e)


def test_empty_tables(spark, empty, tmp_path):
    empty.drop("fp").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
