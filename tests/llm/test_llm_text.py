"""Quality rules, token counts, byte-level BPE, language model, classifier."""

import hashlib
import math
import random

import pytest

from tests.llm import helpers as H
from tidemark.llm import byte_bpe, lattice_lm, quality_model, quality_rules, token_counts

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    parts = ["the", "of", "Haus", "été", "a", "b!!", "|", "#x", "  ", "\n", "\t", " ", "'s", "12", "<|endoftext|>", " ", "\x1c", "\U0001f642"]
    return [*H.CASES, *["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 150))) for _ in range(150)]]


@pytest.fixture(scope="module")
def frame(spark, texts):
    rows = [(i, t, "x", -1) for i, t in enumerate(texts)] + [(0, texts[0], "x", -1), (None, "null key", "x", -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(5).cache()


def test_quality_counts(frame, texts):
    got = quality_rules.quality_rules(frame, ["doc_id"]).collect()
    assert len(got) == frame.count()
    for r in got:
        if r.doc_id is None:
            continue
        text = texts[r.doc_id] or ""
        ws = H.words(text)
        lines = [x for x in text.split("\n") if H.WORD.search(x)]
        assert r.n_words == len(ws) and r.word_chars == sum(map(len, ws))
        assert r.n_symbols == sum(text.count(c) for c in quality_rules.SYMBOLS)
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == H.repeat_words(ws)
        assert r.base_failed == (len(ws) < 50 or 100 * H.repeat_words(ws) > 50 * len(ws)) and not (r.kept and r.base_failed)


def test_quality_long_text_path(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_PACKED", 10)
    text = "a b c d e f g h a b c x y z a b c d q w e r t"
    got = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert got.n_repeat_words == H.repeat_words(text.split())


def test_quality_rules_are_native_and_filters_stay_above(frame):
    out = quality_rules.quality_rules(frame, ["doc_id"]).filter("kept")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.index("Filter") < plan.index("Generate")


def test_token_counts_equal_the_library(frame, texts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.token_counts(frame, path, ["doc_id"]).collect()
    assert len(got) == frame.count()
    for r in got:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))


def test_safe_cuts_join_back(texts):
    assert all("".join(token_counts.safe_cuts(t)) == t for t in texts if t)


def test_byte_bpe_equals_tiktoken_and_round_trips(frame, texts):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    encoded = byte_bpe.encode(frame, path, P.PATTERN, ["doc_id"], offsets=True).cache()
    for r in encoded.collect():
        if r.doc_id is None:
            continue
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text)
        assert len(r.starts) == len(r.ends) == len(r.ids)
        for i, a, b in zip(r.ids[:200], r.starts, r.ends, strict=False):
            token = library.decode_single_token_bytes(i)
            assert token in text[a:b].encode()
    for r in byte_bpe.decode(encoded, path, P.PATTERN, ["doc_id"], as_text=True).collect():
        assert r.doc_id is None or r.decoded == (texts[r.doc_id] or "")
    in_one = byte_bpe.round_trip(frame, path, P.PATTERN, ["doc_id"])
    assert in_one.count() == frame.count()
    for r in [*byte_bpe.digests(encoded, path, P.PATTERN, ["doc_id"]).collect(), *in_one.collect()]:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            ids = library.encode_ordinary(text)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens == len(ids)


def test_split_characters_come_out_whole():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    table = byte_bpe.id_bytes(byte_bpe.library_tokenizer(ranks, P.PATTERN))
    assert {t: i for i, t in enumerate(table)} == ranks
    single = [ranks[bytes([b])] for b in "a\U0001f642é".encode()]
    parts = byte_bpe.stream_text(table, single)
    assert "".join(parts) == "a\U0001f642é" and parts[1:4] == ["", "", ""]
    assert byte_bpe.stream_text(table, []) == []


def test_text_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = P.path("byte_bpe_50k.json")
    assert quality_rules.quality_rules(none, ["doc_id"]).count() == 0
    assert token_counts.token_counts(none, path, ["doc_id"]).count() == 0
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.digests(byte_bpe.encode(none, ranks, P.PATTERN, ["doc_id"]), ranks, P.PATTERN, ["doc_id"]).count() == 0
    assert byte_bpe.round_trip(none, ranks, P.PATTERN, ["doc_id"]).count() == 0
    assert lattice_lm.score_documents(none, P.path("piece_bpe_32k.model")).count() == 0


def test_lattice_base_scores(frame, texts, monkeypatch):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    numbered = [(k, t) for k, t in rows if k is not None]
    frame = frame.filter("doc_id is not null")
    base, n = H.base_scores(numbered)
    for head in (150_000, 3):  # all words in memory, and nearly all of them joined
        monkeypatch.setattr(lattice_lm, "HEAD_WORDS", head)
        got = lattice_lm.score_documents(frame, P.path("piece_bpe_32k.model")).collect()
        assert len(got) == len(numbered)
        for r in got:
            assert r.held_out == (H.crc(r.doc_id) % 7 == 2) and r.train_tokens == n
            assert r.n_tokens == len(H.words(texts[r.doc_id])) + 1
            assert math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9)
            assert r.score < 0 and math.isfinite(r.score)


def test_lattice_sums_all_segmentations():
    import numpy as np

    pieces = sorted([b" ", b"a", b"b", b"ab", b" a", b"ba", b" ab"])
    log_q = np.log(np.array([0.1, 0.15, 0.2, 0.05, 0.1, 0.1, 0.2, 0.1]))
    lattice = lattice_lm.Lattice(pieces)
    weight = dict(zip(pieces, np.exp(log_q), strict=False))

    def ways(rest):
        return [[p, *w] for p in pieces if rest.startswith(p) for w in ways(rest[len(p) :])] if rest else [[]]

    for word in (b"abab", b"a", b"bba"):
        ((_, letters),) = lattice_lm._by_length([word])
        arcs = lattice.arcs(letters)
        total = sum(math.prod(weight[p] for p in w) for w in ways(b" " + word))
        assert math.isclose(lattice.forward(arcs, log_q)[0, -1], math.log(total))
        expected = lattice.expected(arcs, log_q, np.ones(1))
        for i, p in enumerate(pieces):
            assert math.isclose(expected[i], sum(w.count(p) * math.prod(weight[x] for x in w) for w in ways(b" " + word)) / total, abs_tol=1e-12)


def test_lattice_has_every_piece_of_the_vocabulary():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
    found = lattice_lm.read_vocabulary(path)
    assert {x.replace("▁", " ").encode() for x in names} <= set(found)
    assert b" relationship" in found


def test_lattice_word_weights_are_a_distribution(spark):
    """With a closed set of words the token probabilities may not sum to more than one."""
    rows = [(i, "aa ab ba") for i in range(40)] + [(i, "ab bb") for i in range(40, 60)]
    rows += [(1000 + i, a + b) for i, (a, b) in enumerate((a, b) for a in "abc" for b in "abc")]
    got = {r.doc_id: r for r in lattice_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path("piece_bpe_32k.model")).collect()}
    end = sum(1 for k, _ in rows if H.crc(k) % 7 != 2) / got[0].train_tokens
    assert sum(10 ** got[1000 + i].score / end for i in range(9)) + end <= 1 + 1e-9


def test_quality_model_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "house", "of", "green", "fields", "and"]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "###", "CLICK!!", "$$$", "win"]) for _ in range(60)) for _ in range(150)]
    rows = [(i, t, None) for i, t in enumerate(good + bad)] + [(900, None, "m"), (901, "", "m"), (None, "x", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    # Labels of held-out rows are turned round: a model that saw them would be wrong there.
    labels = spark.createDataFrame([(i, int(i < 150) if H.crc(i) % 5 else int(i >= 150)) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    small = quality_model.Settings(word_buckets=256, stat_buckets=128, iterations=30)
    got = quality_model.quality_scores(docs, labels, settings=small, metadata=("score",)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    named = [r for r in got if r.doc_id is not None and r.doc_id < 300]
    assert all(r.held_out == (H.crc(r.doc_id) % 5 == 0) for r in named)
    assert sum(r.predicted == int(r.doc_id < 150) for r in named if r.held_out) >= 0.95 * sum(r.held_out for r in named)


def test_quality_model_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.quality_scores(docs, none).collect()} == {0.5}
    assert quality_model.quality_scores(docs.limit(0), none).count() == 0


def test_quality_scores_are_the_sum_over_all_pairs(spark):
    """The linear-time score against the definition: every pair of features with the product of their factors."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["One", "two", "THREE!", "4", "#five", "six\n"][i % 3 :]) for _ in range(rng.randint(0, 25))), float(i % 2)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label double")
    settings = quality_model.Settings(word_buckets=32, stat_buckets=64, factors=3, iterations=8)
    shaped = quality_model.features(docs, ["doc_id", "label"])
    model = quality_model.train(shaped, settings)
    machine = model.stages[-1]
    v, w = machine.factors.toArray(), machine.linear.toArray()
    got = {r.doc_id: r.score for r in quality_model.score(shaped, model, ["doc_id"]).collect()}
    for r in model.transform(shaped).select("doc_id", "_x").collect():
        x = r["_x"].toArray()
        pairs = sum(float(v[i] @ v[j]) * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-(machine.intercept + float(w @ x) + pairs))), rel_tol=1e-9)


def test_quality_statistics(spark):
    text = "Ab CD ab!? 12\n#x x x\nAb CD ab!? 12\nÜber"
    names = quality_model.features(spark.createDataFrame([(1, text, None), (2, None, "m")], "doc_id long, text string, k string"), ["doc_id"], metadata=("k",)).collect()
    first, empty = (set(r.stats) for r in sorted(names, key=lambda r: r.doc_id))
    # 12 words of 29 characters: 1 symbol, 4 marks, 7 capitals, 4 digits, 4 lines of which 3 differ, 7 different words.
    assert first == {"words=2", "length=2", "symbols=3", "marks=5", "upper=6", "digits=5", "lines=6", "different=6", "different_lines=4", "meta0=null"}
    assert set(names[0].words) == {"ab", "cd", "ab!?", "12", "#x", "x", "über"}
    assert empty == {"words=0", "length=0", "symbols=0", "marks=0", "upper=0", "digits=0", "lines=0", "different=0", "different_lines=6", "meta0=m"} and names[1].words == []
