"""What the corpus jobs register: one query per operator, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, html, langid, licences, passages, pieces, pii, quality, records, simhash, topk, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.is_held_out())
    model = langid.fit(docs.filter("not held_out"))
    found = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.kept_digest(passages.remove_repeats(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    read = records.read_records(records.write_records(table(spark, sf_dir, "documents"), vocabulary))
    return read.select("doc_id", "start", "n_tokens", records.ids_crc32().alias("ids_crc32"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows.filter("vec_id % 50 = 0"), rows)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit(rows))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^ \t\n\x0B\f\r]')) AS lines
  FROM documents),
t AS (SELECT *, list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2]) AS grams FROM w),
g AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS pos FROM t),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + o) AS n FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(words, lambda x: x = '|')) AS n_bars,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered
  FROM t LEFT JOIN covered c ON c.doc_id = t.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 10 > word_chars OR n_bars * 4 > n_words
    OR (n_dup_lines * 2 > n_lines AND n_lines >= 4) OR word_chars < 2 * n_words OR word_chars > 30 * n_words
    OR n_lettered * 2 < n_words) AS kept
FROM m
"""

QUERIES: dict[str, Query] = {
    "op1_language": op1_language,
    "op2_html": op2_html,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_licences": op5_licences,
    "op6_decontaminate": op6_decontaminate,
    "op7_passages": op7_passages,
    "op8_quality": op8_quality,
    "op9_records": op9_records,
    "op10_pieces": op10_pieces,
    "op11_topk": op11_topk,
    "op12_whitening": op12_whitening,
    "op13_repair": op13_repair,
}

ORACLES: dict[str, str] = {
    "op5_licences": licences.oracle_sql(),
    "op8_quality": OP8_SQL,
    "op11_topk": topk.oracle_sql(),
    "op13_repair": conversations.oracle_sql(),
}
