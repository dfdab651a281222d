"""The operators of this subpackage as named queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, conversation_repair, embedding_dedup, exact_dedup, lattice_lm, line_dedup, mixing, quality_model, quality_rules, sharding, simhash_dedup, spelling_variants, token_counts
from tidemark.llm.common import WORD_CLASS, table
from tidemark.session import configure

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(configure(spark), sf_dir, "documents")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(configure(spark), sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"), scan=True)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    mixed = mixing.mix(docs, F.regexp_count("text", F.lit(WORD_CLASS + "+")))
    size = F.col("mix_size")
    return mixed.select("doc_id", size.alias("size"), F.col("source_size"), "target", (size * F.col("copies")).alias("taken"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), metadata=("n_chars_level",), derive=_n_chars_level)


def _n_chars_level(docs: DataFrame) -> DataFrame:
    """Metadata of a document: the order of magnitude of its stated number of characters."""
    return docs.withColumn("n_chars_level", F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_docs(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_docs(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(_docs(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), ["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer("byte_bpe_multi_50k.tiktoken"), importlib.import_module("public_tokenizers").PATTERN
    return byte_bpe.round_trip(_docs(spark, sf_dir), path, pattern, ["doc_id"])


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(_docs(spark, sf_dir).select("doc_id", "text"), _tokenizer("piece_bpe_32k.model"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(_docs(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.corpus_words(_docs(spark, sf_dir), misspell=97))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(table(configure(spark), sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_line_dedup, op3_mix_sources, op4_quality_model, op5_quality_rules, op6_shard,
        op7_token_counts, op8_byte_bpe, op9_lattice_lm, op10_simhash_dedup, op11_spelling_variants, op12_conversation_repair, op13_exact_dedup, pipeline,
    )
}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: Exact links by brute force: every pair of usable vectors, components by the smallest id reachable.
_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings
  UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.a
), c AS (SELECT a, min(c) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, c.a = c.c AS kept FROM c LEFT JOIN n USING (a)
"""


def _op5() -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in quality_rules.STOP_FORMS)
    tests = []
    for rule in quality_rules.RULES:
        value = "({} / nullif({}, 0))".format(*quality_rules.RATIOS[rule.measure]) if rule.measure in quality_rules.RATIOS else rule.measure
        tests += [f"coalesce({value} {op} {bound}, true)" for op, bound in ((">=", rule.least), ("<=", rule.most)) if bound is not None]
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
), g AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM w WHERE len(w) > 2
), h AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM h),
z AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words,
    (length(t) - length(replace(t, '!!', ''))) // 2 AS n_bang, length(t) - length(replace(t, '|', '')) AS n_bars
  FROM w LEFT JOIN z ON w.doc_id = z.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept
FROM b
"""


_OP13 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

SQL: dict[str, str] = {"op1_embedding_dedup": _OP1, "op5_quality_rules": _op5(), "op13_exact_dedup": _OP13}
