"""Exact deduplication against brute force, and the parts of its index."""

import collections
import hashlib
import random

import pyarrow as pa
import pytest

from tests.llm import helpers as H
from tidemark.llm import exact_dedup as X


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        top = iter([True])
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep and next(top, False), sha) for i in ids]
    return collections.Counter(out)


def test_directory_owns_every_key_once_and_splits_what_is_overfull():
    rng = random.Random(3)
    for bits in (1, 4, 9):
        cells = {p: rng.randint(1, 60) for p in range(1 << bits) if rng.random() < 0.7}
        cells[5 % (1 << bits)] = 5000  # cannot be split any further
        d = X.Directory.build(cells, 100, bits)
        assert len(d.slots) == 1 << d.depth and set(d.slots) == set(range(len(d.depths)))
        owned = collections.Counter(d.slots)
        held = collections.Counter()
        for p, n in cells.items():
            held[d.slots[p >> (bits - d.depth)]] += n
        for bucket, own in enumerate(d.depths):
            places = [i for i, b in enumerate(d.slots) if b == bucket]
            assert owned[bucket] == 1 << (d.depth - own) and places == list(range(places[0], places[0] + len(places)))
            assert held[bucket] <= 100 or own == bits
    assert X.Directory.build({}) == X.Directory(0, (0,), (0,)) == X.Directory.build({7: 100}, 100)


def test_owner_chains_texts_of_one_key_by_their_bytes():
    links = [(1, b"a", 2, 5, 1), (1, b"b", 1, 9, 1), (1, b"a", 3, 5, 2), (1, b"b", 1, None, 1), (2, b"a", 1, None, 1), (2, b"a", 1, None, 2)]
    columns = [pa.array(c, k) for c, k in zip(zip(*links), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=X._LINK)
    got = {(h, sha): rest for b in X._own([batch.slice(0, 3), batch.slice(3)], pa.int64()) for h, sha, *rest in zip(*(c.to_pylist() for c in b.columns))}
    a, b = hashlib.sha256(b"a").digest(), hashlib.sha256(b"b").digest()
    assert got == {(1, a): [5, 5, 3], (1, b): [2, 9, 1], (2, a): [2, None, 3]}


@pytest.mark.parametrize("capacity", [X.CAPACITY, 100])
def test_exact_duplicates_equal_brute_force(spark, capacity):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(H.CASES)] + [(50, ""), (None, "only null ids"), (None, "only null ids"), (None, "one"), (3, "one"), (3, "one")]
    rows += [(rng.randint(100, 140), rng.choice(["A", "a", "a ", "é", "é", "x" * 9000])) for _ in range(120)]
    rows += [(1000 + i, "one text that a third of all rows share") for i in range(90)] + [(2000 + i, f"different {i}") for i in range(60)]
    frame = spark.createDataFrame([(i, t, 7, "h", "r") for i, t in rows], "doc_id long, text string, rows int, sha string, body string").repartition(5)
    got = X.exact_duplicates(frame, capacity=capacity)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == brute(rows)


def test_exact_duplicates_of_named_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t"), ("z", None)], "h string, body string")
    got = {tuple(r)[:4] for r in X.exact_duplicates(frame, "h", "body").collect()}
    assert got == {("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("z", "z", 1, True)}
    assert X.exact_duplicates(frame.limit(0), "h", "body").count() == 0
