"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form each of them stands for.

Of two words that may differ by one edit the longer one (of equal ones the smaller) contributes two disjoint chunks, its
halves; the other contributes its positional grams of the lengths of those halves. One edit touches one half only, so the
other half is a gram of the other word, at the same place or one further: the words meet in a join on (length, chunk,
gram) and are verified there by their edit distance. Halves are as long as two chunks can be, so a gram is shared by few.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_ASCII, text_of, text_steps
from tidemark.session import cut

#: Letters of a word after A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Different words that a counting task holds before it passes them on.
HELD_WORDS = 200_000


def _count(batches, least: int, misspell: int):
    """(word, n): occurrences of the words of ``least`` or more letters, folded in the task."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")  # shorter runs cannot become longer

    def rows(counts: Counter):
        words = list(counts)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    crc = zlib.crc32
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for start, _, raw in text_steps(batch.column(1)):
            for key, text in zip(keys[start : start + len(raw)], raw, strict=True):
                own = Counter(runs.findall(text.translate(LOWER_ASCII).decode("utf-8", "replace")))
                if misspell:
                    begun = crc(f"{key}:".encode())
                    for word in [w for w in own if not crc(w.encode(), begun) % misspell]:
                        n, at = own.pop(word), crc(word.encode(), begun) % len(word)
                        if len(word) > least:
                            counts[word[:at] + word[at + 1 :]] += n
                counts.update(own)
                if len(counts) > HELD_WORDS:
                    yield from rows(counts)
                    counts = Counter()
    yield from rows(counts)


def corpus_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5, least_n: int = 3, misspell: int = 0) -> DataFrame:
    """(word, n): maximal runs of letters of all whole texts, A-Z lower-cased, of ``least_letters`` or more code points and
    ``least_n`` or more occurrences. With ``misspell`` runs are damaged first, to measure what is found: where it divides the
    crc32 of ``key:run`` the run loses its code point number crc32 modulo length. A null text has no words, a null key is an
    empty text there; repeated rows count as often as they occur; an empty table has no words.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), text_of(text).alias("t"))
    counted = rows.mapInArrow(partial(_count, least=least_letters, misspell=misspell), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def chunks(words: DataFrame) -> DataFrame:
    """(size, at, gram, word, n): the halves of every word; ``size`` is its length and ``at`` where the half begins."""
    half = F.floor(F.length("word") / 2).cast("int")
    own = words.withColumns({"size": F.length("word"), "half": half})
    halves = F.array(F.struct(F.lit(0).alias("at"), F.left("word", F.col("half")).alias("gram")), F.struct(F.col("half").alias("at"), F.expr("substr(word, half + 1)").alias("gram")))
    return own.withColumn("c", F.explode(halves)).select("size", "c.at", "c.gram", "word", "n")


def grams(words: DataFrame) -> DataFrame:
    """(size, at, gram, word, n): the positional grams that may be a half of a word as long as this one or longer by one.

    ``size`` is the length of that word and ``at`` where its half begins; grams begin there, or one before or after.
    """
    own = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    own = own.withColumn("half", F.floor(F.col("size") / 2).cast("int"))
    own = own.withColumn("c", F.explode(F.expr("array(struct(0 as at, half as q), struct(half as at, size - half as q))"))).select("word", "n", "size", "c.at", "c.q")
    own = own.withColumn("p", F.explode(F.expr("sequence(greatest(at - 1, 0), at + 1)"))).filter(F.expr("p + q <= length(word)"))
    return own.select("size", "at", F.expr("substr(word, p + 1, q)").alias("gram"), "word", "n").distinct()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by exactly one code point, in both directions.

    ``words`` has every word once, of at least two code points. A gram that very many words share is split by the join.
    """
    a, b = chunks(words).alias("a"), grams(words).withColumnsRenamed({"word": "near", "n": "near_n"}).alias("b")
    meet = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("size", "at", "gram")]
    longer = (F.col("a.size") > F.length("b.near")) | (F.col("a.word") < F.col("b.near"))
    found = a.join(b, [*meet, longer, F.levenshtein("a.word", "b.near", 1) == 1]).select("word", "n", "near", "near_n").distinct()
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _follow(links: DataFrame) -> DataFrame:
    """(word, root): the end of every chain of links, by doubling jumps; a chain of d links takes about log2 d rounds."""
    jumps = cut(links)
    while True:
        ends = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = cut(jumps.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not jumps.filter("moved").limit(1).count():
            return jumps.select("word", "root")
        jumps = jumps.drop("moved")


def variants(words: DataFrame, least_ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n), words being different.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word of the
    largest n, of several the smallest in code-point order, if that n is ``least_ratio`` (2 or more) times the word's own, else
    null; ``root`` follows forms to the last one, the word itself if it has none. ``n_near`` counts near words.
    """
    words = cut(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    # A word has at most some hundred near words for each of its letters, so no group is large.
    near = cut(near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best).select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")))
    fits = F.col("near_n") >= least_ratio * F.col("n")
    formed = near.select("word", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    roots = _follow(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    out = words.join(formed, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
