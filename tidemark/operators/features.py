"""Text features: vocabulary, smoothed tf-idf weights, sparse vectors, out-of-vocabulary rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Normalizer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokenize_words, word_tokens
from tidemark.operators.sampling import bottom_n, dense_index
from tidemark.operators.winners import largest_n
from tidemark.session import cut


def term_counts(docs: DataFrame, ngrams: tuple[int, ...] = (1, 2), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, term, tf)."""
    return (
        docs.select(doc_id, F.explode(tokenize_words(text, ngrams)).alias("term"))
        .groupBy(doc_id, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(docs: DataFrame, min_df: int = 5, ngrams: tuple[int, ...] = (1,), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(term, df) for terms in at least min_df documents.

    Terms are made distinct inside each document, so the shuffle counts documents directly.
    """
    terms = docs.select(F.explode(F.array_distinct(tokenize_words(text, ngrams))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)


def tfidf_terms(
    docs: DataFrame, min_df: int = 5, max_terms: int = 1_000_000, ngrams: tuple[int, ...] = (1, 2), text: str = "text"
) -> DataFrame:
    """(term, df, cf, idf): terms in min_df documents, the max_terms most frequent ones, idf = ln((1+n)/(1+df)) + 1.

    Tokens are sorted inside each document, so the first of a run counts the document and every token
    counts the corpus: one explode and one shuffle of partial counts by term. The cut at max_terms comes from histograms
    of the written counts.
    """
    sorted_tokens = docs.select(F.sort_array(tokenize_words(text, ngrams)).alias("_t"))
    before = lambda i: F.get(F.col("_t"), i - 1)
    marked = F.transform("_t", lambda x, i: F.struct(x.alias("term"), F.coalesce(before(i) != x, F.lit(True)).alias("first")))
    tokens = sorted_tokens.select(F.explode(marked).alias("t"))
    counts = (
        tokens.groupBy("t.term").agg(F.count_if("t.first").alias("df"), F.count(F.lit(1)).alias("cf")).filter(F.col("df") >= min_df)
    )
    top = largest_n(counts, max_terms, "cf", "term")
    n = docs.agg(F.count(F.lit(1))).scalar()
    idf = F.log((F.lit(1) + F.col("_n")) / (F.lit(1) + F.col("df"))) + F.lit(1.0)
    return top.withColumn("_n", n).select("term", "df", "cf", idf.alias("idf"))


def _lookup_side(terms: DataFrame, max_terms: int | None) -> DataFrame:
    """A vocabulary cut at max_terms has a known bound; a common word would skew a shuffled join on term."""
    return F.broadcast(terms) if max_terms is not None and max_terms <= 1_000_000 else terms


def tfidf_weights(
    docs: DataFrame, terms: DataFrame, ngrams: tuple[int, ...] = (1, 2), doc_id: str = "doc_id", max_terms: int | None = None
) -> DataFrame:
    """(doc, term, weight): (1 + ln tf) * idf, scaled to unit length per document."""
    raw = term_counts(docs, ngrams, doc_id=doc_id).join(_lookup_side(terms, max_terms), "term").select(
        doc_id, "term", ((F.lit(1.0) + F.log("tf")) * F.col("idf")).alias("_w")
    )
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc_id)))
    return raw.select(doc_id, "term", (F.col("_w") / norm).alias("weight"))


def tfidf_vectors(
    docs: DataFrame, terms: DataFrame, size: int, ngrams: tuple[int, ...] = (1, 2), doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` plus a unit-length sparse ``features`` column over an indexed term table (term, idx, idf).

    ``size`` is the most terms there can be. Vectors are as wide as the table's last ``idx`` asks for, so that a model over
    them has no coefficients without a term.
    """
    last = terms.agg(F.max("idx")).first()[0]
    width = 1 if last is None else last + 1
    lookup = _lookup_side(terms.select("term", "idx", "idf"), size)
    tokens = docs.select(doc_id, F.explode(tokenize_words("text", ngrams)).alias("term")).join(lookup, "term")
    parts = _token_counts(tokens.select(doc_id, "idx", "idf"), doc_id)
    pairs = parts.groupBy(doc_id).agg(F.collect_list(F.struct("idx", "tf", "idf")).alias("_e"))

    @F.arrow_udf(VectorUDT())
    def sparse(idx: pa.Array, tf: pa.Array, idf: pa.Array) -> pa.Array:
        rows, counts = len(idx), _numpy(idx.value_lengths())
        key = (np.repeat(np.arange(rows), counts) << 32) | _numpy(idx.flatten())
        key, first, where = np.unique(key, return_index=True, return_inverse=True)
        weights = (1.0 + np.log(np.bincount(where, _numpy(tf.flatten()), len(key)))) * _numpy(idf.flatten())[first]
        ends = pa.array(np.searchsorted(key, np.arange(rows + 1) << 32).astype(np.int32))
        indices = pa.ListArray.from_arrays(ends, pa.array((key & 0xFFFFFFFF).astype(np.int32)))
        fields = [pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, width, np.int32)), indices, pa.ListArray.from_arrays(ends, pa.array(weights))]
        return pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"])

    # A document without terms has no entries.
    flat = lambda name, kind: F.coalesce(F.flatten(F.col(f"_e.{name}")), F.array().cast(f"array<{kind}>"))
    raw = docs.join(pairs, doc_id, "left").withColumn("_raw", sparse(flat("idx", "int"), flat("tf", "bigint"), flat("idf", "double")))
    return Normalizer(inputCol="_raw", outputCol="features").transform(raw).drop("_e", "_raw")


def _numpy(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _token_counts(tokens: DataFrame, doc_id: str) -> DataFrame:
    """(doc, idx[], tf[], idf[]): the counted tokens of a document, folded where they were read.

    A document's tokens follow each other, so a batch folds them without a shuffle; a document in several batches, or rows of
    the same id, are several rows.
    """

    def fold(batches):
        for batch in batches:
            n, doc = len(batch), batch[doc_id]
            if not n:
                continue
            other = np.ones(n, bool)
            other[1:] = _numpy(pc.fill_null(pc.not_equal(doc.slice(1), doc.slice(0, n - 1)), True))
            run = np.cumsum(other) - 1
            key, first, tf = np.unique((run << 32) | _numpy(batch["idx"]), return_index=True, return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(run[-1] + 2) << 32).astype(np.int32))
            listed = [(key & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int64), _numpy(batch["idf"])[first]]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in listed]
            yield pa.RecordBatch.from_arrays([doc.filter(pa.array(other)), *lists], [doc_id, "idx", "tf", "idf"])

    kind = tokens.schema[doc_id].dataType.simpleString()
    return tokens.mapInArrow(fold, f"`{doc_id}` {kind}, idx array<int>, tf array<bigint>, idf array<double>")


def indexed_terms(terms: DataFrame) -> DataFrame:
    """A term table with a dense ``idx``, written once: counting and numbering it, and all vectors over it, read that copy.

    Terms are numbered by octaves of ``df``, frequent ones first, so that most steps of a fit touch neighbouring coefficients that
    stay in a core's cache; inside an octave they come in hash order.
    """
    rows = cut(terms).withColumn("_octave", F.length(F.bin("df")))
    sizes = rows.groupBy("_octave").agg(F.count(F.lit(1)).alias("_n"))
    larger = F.sum("_n").over(Window.orderBy(F.desc("_octave"))) - F.col("_n")  # at most 64 rows
    numbered = dense_index(rows, "term", "idx", "_at", ["_octave"], 64).join(F.broadcast(sizes.withColumn("_larger", larger)), "_octave")
    return cut(numbered.withColumn("idx", (F.col("_larger") + F.col("_at")).cast("int")).select(*terms.columns, "idx"))


def oov_rate(
    tests: DataFrame, vocab: DataFrame, keys: tuple[str, ...] = ("test_set",), text: str = "text", n: int | None = None, seed: int = 0, doc_id: str = "doc_id"
) -> DataFrame:
    """(keys, n_tokens, oov_rate). Tokens are counted per (set, term) before the vocabulary join.

    With ``n`` only the first n documents of a set count, in the order of their hash: an order that rows cannot change.
    """
    if n is not None:
        tests = bottom_n(tests, doc_id, n, seed, keys)
    counts = (
        tests.select(*keys, F.explode(word_tokens(text)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("_n"))
    )
    known = vocab.select("term", F.lit(1).alias("_known"))
    joined = counts.join(known, "term", "left")
    out = joined.groupBy(*keys).agg(
        F.sum("_n").alias("n_tokens"),
        F.sum(F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0)).alias("_oov"),
    )
    return out.select(*keys, "n_tokens", F.try_divide("_oov", "n_tokens").alias("oov_rate"))
