"""Language-model scores from a subword lattice: the probability of a text summed over all its segmentations.

The pieces and the order of their scores come from an existing vocabulary; their weights are re-estimated on the training
documents by expectation maximisation over the lattice. A word is reached by all sequences of pieces that spell it, and by
one more arc, the word as a whole, whose weight is its discounted frequency in the training documents. The mass that the
discount sets free is what the spelled sequences share, so the arcs of all tokens sum to at most one, and the product over
the tokens of a document, each summed over its arcs, is the marginal probability of the document over all segmentations.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import LOWER_ASCII, fresh, schema_with, text_of, text_steps
from tidemark.session import cut

#: Rounds of re-estimation.
ROUNDS = 1
#: Words that every task keeps in memory: the most frequent ones, at most so many and each of at most so many bytes.
HEAD_WORDS, HEAD_BYTES = 150_000, 64
#: Different words that a counting task holds before it passes them on.
HELD_WORDS = 200_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str) -> dict[bytes, float]:
    """Bytes of every piece with its score; the word mark is a space, a byte piece is its byte, control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {bytes([b]): -math.inf for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i)
        piece = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
        if not model.is_byte(i):
            found[piece] = max(found.get(piece, -math.inf), model.get_score(i))
    return found


def start_weights(scores: list[float]) -> np.ndarray:
    """Log weights of the pieces and of the end of a word: by Zipf's law over the order of the existing scores."""
    order = np.argsort(-np.array(scores), kind="stable")
    weights = np.empty(len(scores) + 1)
    weights[order] = 1.0 / (np.arange(len(scores)) + 10.0)
    weights[-1] = weights[:-1].sum() / 4  # about one word end for every three pieces
    return np.log(weights / weights.sum())


class Lattice:
    """All segmentations of words over one set of pieces, many words of one length at a time."""

    def __init__(self, pieces: list[bytes]):
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.longest = max(map(len, pieces))
        # One bit for the top bits of every hash: most substrings are no piece, and this table of 1 MB says so at once.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_PRIME) + b + 1) % 2**64
        return h

    def arcs(self, letters: np.ndarray) -> list[np.ndarray]:
        """For every piece length the piece that starts at each place of each word, or -1."""
        n, length = letters.shape
        values, found, h = letters.astype(np.uint64) + np.uint64(1), [], np.zeros((n, length), np.uint64)
        for m in range(1, min(self.longest, length) + 1):
            h = h[:, : length - m + 1] * _PRIME + values[:, m - 1 :]
            piece = np.full(h.shape, -1, np.int32)
            likely = self.maybe[h >> np.uint64(44)]
            own = h[likely]
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            piece[likely] = np.where(self.hashes[at] == own, self.order[at], -1)
            found.append(piece)
        return found

    def forward(self, arcs: list[np.ndarray], log_q: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all ways from the start of a word to each place."""
        n, length = arcs[0].shape
        padded = np.append(log_q[:-1], -np.inf)
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(1, length + 1):
            # Of the lengths above one only those that some word has a piece of here.
            live = [m for m in range(1, min(len(arcs), j) + 1) if m == 1 or (arcs[m - 1][:, j - m] >= 0).any()]
            ways = np.stack([alpha[:, j - m] + padded[arcs[m - 1][:, j - m]] for m in live])
            top = ways.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(ways - top).sum(axis=0))
        return alpha

    def expected(self, arcs: list[np.ndarray], log_q: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, and of the end, in ``times`` occurrences of each word."""
        alpha = self.forward(arcs, log_q)
        n, length = arcs[0].shape
        padded = np.append(log_q[:-1], -np.inf)
        beta = np.full((n, length + 1), -np.inf)
        beta[:, length] = 0.0
        total = alpha[:, length]
        uses, weights = [], []
        for i in range(length - 1, -1, -1):
            live = [m for m in range(1, min(len(arcs), length - i) + 1) if m == 1 or (arcs[m - 1][:, i] >= 0).any()]
            arc = np.stack([arcs[m - 1][:, i] for m in live])
            ways = padded[arc] + np.stack([beta[:, i + m] for m in live])
            top = ways.max(axis=0)
            odds = np.exp(ways - top)
            mass = odds.sum(axis=0)
            beta[:, i] = top + np.log(mass)
            found = arc >= 0
            uses.append(arc[found])
            weights.append((odds * (np.exp(alpha[:, i] + top - total) * times))[found])
        counts = np.bincount(np.concatenate(uses), weights=np.concatenate(weights), minlength=len(log_q))
        counts[-1] = times.sum()
        return counts


def _by_length(words: list[bytes], most: int = 400_000):
    """(places in the list, letters as a matrix with a leading space) of words of one length, a bounded number at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        step = max(1, most // (int(length) + 1))
        for i in range(0, len(places), step):
            own = places[i : i + step]
            letters = np.frombuffer(b"".join([b" " + words[p] for p in own]), np.uint8).reshape(len(own), -1)
            yield own, letters


def _count_words(batches, text: str, held: str):
    """(word, occurrences in training documents) for all words, folded in the task."""

    def rows(counts: Counter, seen: set):
        words = list(seen)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])

    counts, seen = Counter(), set()
    for batch in batches:
        out = batch.column(batch.schema.get_field_index(held)).to_pylist()
        for start, _, raw in text_steps(batch.column(batch.schema.get_field_index(text))):
            for i, x in enumerate(raw, start):
                words = x.translate(LOWER_ASCII).split()
                seen.update(words)
                if not out[i]:
                    counts.update(words)
                if len(seen) > HELD_WORDS:
                    yield from rows(counts, seen)
                    counts, seen = Counter(), set()
    yield from rows(counts, seen)


def _expect(batches, pieces: list[bytes], log_q: np.ndarray):
    lattice, total = Lattice(pieces), np.zeros(len(log_q))
    for batch in batches:
        for _, _, words in text_steps(batch.column(0), 1_000_000):
            for own, letters in _by_length(words):
                total += lattice.expected(lattice.arcs(letters), log_q, np.ones(len(own)))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "used"])


def _spell(batches, pieces: list[bytes], log_q: np.ndarray):
    """log10 of the weight of all spelled ways of each word."""
    lattice = Lattice(pieces)
    for batch in batches:
        for start, stop, words in text_steps(batch.column(0), 1_000_000):
            spelled = np.empty(len(words))
            for own, letters in _by_length(words):
                spelled[own] = (lattice.forward(lattice.arcs(letters), log_q)[:, -1] + log_q[-1]) / math.log(10)
            part = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spelled)], names=["word", "c", "spelled"])


def fit_pieces(words: DataFrame, vocabulary: dict[bytes, float], rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray]:
    """Pieces and log weights after ``rounds`` of re-estimation on different training words (each counts once).

    Every task returns at most one expected count a piece, so what is summed and sent is bounded by the vocabulary.
    """
    pieces = sorted(vocabulary)
    log_q = start_weights([vocabulary[p] for p in pieces])
    for _ in range(rounds):
        got = words.select("word").mapInArrow(partial(_expect, pieces=pieces, log_q=log_q), "piece int, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect()
        weights = np.full(len(log_q), 0.01)  # a piece that was never used stays possible
        for r in got:
            weights[r.piece] += r.used
        if got:
            log_q = np.log(weights / weights.sum())
    return pieces, log_q


def _documents(batches, text: str, keep: list[str], head):
    """Sums over the words of each document that are in memory, and the other words with their numbers."""
    known, base, score = head.value
    for batch in batches:
        for start, stop, raw in text_steps(batch.column(batch.schema.get_field_index(text))):
            n_words, n_known, bases, scores, tails, times = [], [], [], [], [], []
            for x in raw:
                counts = Counter(x.translate(LOWER_ASCII).split())
                k, b, s, tail, many = 0, [], [], [], []
                for w, n in counts.items():
                    i = known.get(w)
                    if i is None:
                        tail.append(w)
                        many.append(n)
                    else:
                        k += n
                        b.append(n * base[i])
                        s.append(n * score[i])
                n_words.append(counts.total())
                n_known.append(k)
                bases.append(math.fsum(b))
                scores.append(math.fsum(s))
                tails.append(tail)
                times.append(many)
            part = batch.slice(start, stop - start)
            columns = [part.column(part.schema.get_field_index(c)) for c in keep]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_known, pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64())]
            columns += [pa.array(tails, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "n_known", "base", "score", "tail", "times"])


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are the words of the text with A-Z lower-cased, then one end. Rows whose crc32 of the key as text leaves 2 when
    divided by 7 are held out (a null key is not): nothing is learnt from them. ``base_score`` is the add-one unigram
    log10 probability, ``score`` that of the lattice. A null text is empty; an empty text is its end. Repeated rows count
    as often as they occur. Without training rows the base is 0 and the lattice has the vocabulary's own weights.

    Words are counted in the tasks and summed up by word. The most frequent ones, at most 150,000 of at most 64 bytes, go
    to every task; all others stay in a table of words that is joined to the documents' words. A word that fills a third
    of the table is among the most frequent, or is held out and then split by the join.
    """
    body = fresh(docs, "body")
    rows = docs.select(F.col(key).alias("k"), held_out(key).alias("held"), text_of(text).alias(body))
    counted = rows.select(body, "held").mapInArrow(partial(_count_words, text=body, held="held"), "word string, n long")
    words = cut(counted.groupBy("word").agg(F.sum("n").alias("c")))
    ends = rows.filter(~F.col("held")).count()
    n_words, distinct, once, twice = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))
    ).first()
    n, v = n_words + ends, distinct + (ends > 0)
    discount = once / (once + 2 * twice) if once else 0.5
    spare = discount * distinct / n if n else 0.5
    end_probability = ends / n if n else 0.5
    pieces, log_q = fit_pieces(words.filter("c > 0"), read_vocabulary(vocabulary), rounds)
    spelled = cut(words.select("word", "c").mapInArrow(partial(_spell, pieces=pieces, log_q=log_q), "word string, c long, spelled double"))
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    # log10 of whole-word arc + spelled arcs; the spelled ones stay in logarithms, as long words have tiny weights.
    seen = F.greatest(F.col("c") - F.lit(discount), F.lit(0.0)) / F.lit(float(max(n, 1)))
    apart = F.col("spelled") + F.lit(math.log10(spare) if spare else -400.0)
    score = F.when(seen > 0, F.log10(seen + F.pow(F.lit(10.0), F.greatest(apart, F.lit(-300.0))))).otherwise(apart)
    scored = spelled.select("word", "c", base.alias("base"), score.alias("score"))
    # Least count of the words in memory, from a histogram of the counts' logarithms.
    steps = words.filter("c > 0").groupBy(F.floor(F.log2("c") * 16).alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("s")).collect()
    least, held = None, 0
    for r in steps:
        held += r.n
        if held > HEAD_WORDS:
            break
        least = r.s
    frequent = F.floor(F.log2("c") * 16) >= least if least is not None else F.lit(False)
    in_head = F.coalesce((F.col("c") > 0) & frequent & (F.octet_length("word") <= HEAD_BYTES), F.lit(False))
    top = scored.filter(in_head).collect()
    head = docs.sparkSession.sparkContext.broadcast(
        ({r.word.encode(): i for i, r in enumerate(top)}, np.array([r.base for r in top]).tolist(), np.array([r.score for r in top]).tolist())
    )
    del top
    longs, doubles = T.LongType(), T.DoubleType()
    schema = schema_with(rows, ["k", "held"], n_words=longs, n_known=longs, base=doubles, score=doubles, tail=T.ArrayType(T.StringType()), times=T.ArrayType(T.IntegerType()))
    partly = cut(rows.mapInArrow(partial(_documents, text=body, keep=["k", "held"], head=head), schema).withColumn("row", F.monotonically_increasing_id()))
    tail = partly.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("n"))
    found = tail.join(scored.filter(~in_head), "word").select(
        "row", F.lit(None).cast(rows.schema["k"].dataType).alias("k"), F.lit(None).cast("boolean").alias("held"), F.lit(0).cast("long").alias("n_words"),
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long").alias("n_known"), (F.col("n") * F.col("base")).alias("base"), (F.col("n") * F.col("score")).alias("score"),
    )
    whole = partly.drop("tail", "times").select(*found.columns).unionByName(found).groupBy("row").agg(
        F.max("k").alias("k"), F.max("held").alias("held"), *[F.sum(c).alias(c) for c in ("n_words", "n_known", "base", "score")]
    )
    return whole.select(
        F.col("k").alias(key),
        F.col("held").alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10((ends + 1) / (n + v + 1)))).alias("base_score"),
        (F.col("score") + F.lit(math.log10(end_probability) if end_probability else -400.0)).alias("score"),
    )
