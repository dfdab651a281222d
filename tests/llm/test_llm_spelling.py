"""Spelling variants against brute force over all pairs of words."""

import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm import spelling_variants as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def count(rows, misspell=97):
    n = collections.Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_words_near_forms_and_roots_equal_brute_force(spark):
    rng = random.Random(6)
    n = collections.Counter()
    for _ in range(40):
        word = "".join(rng.choice("abéÿ×") for _ in range(rng.randint(5, 9)))
        for _ in range(25):
            n[word] = rng.choice([3, 4, 6, 7, 12, 13, 50, 100, 1000])
            at, letter = rng.randrange(len(word) + 1), rng.choice("abcé")
            word = rng.choice([word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :] if len(word) > 5 else word])
    n["x" * 5000], n["x" * 5001] = 3, 60
    frame = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    got = S.variants(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute(n)
    assert S.variants(frame.limit(0)).count() == 0


def test_words_of_documents_equal_brute_force(spark):
    rng = random.Random(8)
    base = ["Reading", "reader", "Straße", "naïveté", "ÀÉÎÕÜ", "thought", "×signs÷", "four", "z" * 3000]
    rows = [(i, " ".join(rng.choice(base) + rng.choice([",", "1", "-", "\n", "Ā", " "]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(None, "reading reading reading abcde"), (7, None), (7, ""), rows[3], rows[3], (-5, "ABCDE abcde"), (5000, "the same word " * 3000)]
    frame = spark.createDataFrame([(t, k, 1, "n") for k, t in rows], "text string, doc_id long, n int, word string").repartition(5)
    for misspell in (97, 3, 0):
        words = S.corpus_words(frame, misspell=misspell)
        assert {r.word: r.n for r in words.collect()} == count(rows, misspell)
    got = S.variants(S.corpus_words(frame, misspell=97))
    assert {tuple(r) for r in got.collect()} == brute(count(rows))
    assert S.corpus_words(frame.limit(0)).count() == 0
    hot = S.corpus_words(frame.withColumn("text", F.lit("sharedword")), misspell=0).collect()
    assert [tuple(r) for r in hot] == [("sharedword", len(rows))]
