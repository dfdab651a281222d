"""Hash draws: many hashes at once, counted in the tasks that make them."""

import hashlib
from collections import Counter

import pytest

from tidemark.functions.hashes import ph_numbered
from tidemark.functions.labels import CLASSES
from tidemark.operators import bootstrap as B


def ph(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("prefix", ["", "42:1997:0:", "x" * 46, "x" * 47, "x" * 60, "é:"])
def test_numbered_hashes(prefix):
    for first, last in ((0, 1203), (9_995, 10_007), (2**32 - 3, 2**32 + 3), (5, 5)):
        assert ph_numbered(prefix, first, last).tolist() == [ph(f"{prefix}{j}") for j in range(first, last)]


CELLS = [(yr, y, code, 1 + (7 * code + yr) % 5) for yr in (1, 2) for y in range(3) for code in range(40)] + [(3, 0, 0, 4)]


def drawn(yr: int, rep: int, seed: str) -> Counter:
    own = sorted(c for c in CELLS if c[0] == yr)
    at = [c[:3] for c in own for _ in range(c[3])]
    return Counter(at[ph(f"{seed}:{yr}:{rep}:{j}") % len(at)] for j in range(len(at)))


@pytest.mark.parametrize("unit", [1 << 22, 50])
def test_weights_of_cells_without_a_shuffle_of_draws(spark, monkeypatch, unit):
    monkeypatch.setattr(B, "UNIT", unit)
    cells = spark.createDataFrame([*CELLS, (None, 1, 1, 9)], "yr int, y int, code_0 long, n long").repartition(3)
    weights = B.draw_cells(cells, ["yr"], ["y", "code_0"], 5, 9)
    got = {(tuple(r)[:3], r.rep): r.w for r in weights.collect()}
    assert got == {(cell, rep): w for yr in (1, 2, 3) for rep in range(5) for cell, w in drawn(yr, rep, "9").items()}
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "pos" not in plan and "Generate explode(sequence(_k" not in plan


@pytest.mark.parametrize("unit,part", [(1 << 22, 1 << 14), (50, 16)])
def test_items_and_their_sums(spark, monkeypatch, unit, part):
    monkeypatch.setattr(B, "UNIT", unit)
    monkeypatch.setattr(B, "PART", part)
    items = [f"i{k}" for k in range(170)]
    order = sorted(items, key=lambda i: (ph(f"3:{i}"), i))
    expected = Counter((b, order[ph(f"3:{b}:{j}") % 170]) for b in range(70) for j in range(170))
    df = spark.createDataFrame([(i,) for i in items], "item_id string").repartition(3)
    assert {(r.rep, r.item_id): r.weight for r in B.resample_with_replacement(df, 70, 3).collect()} == expected
    sums = {r.item_id: (r.drawn, r.n_reps, r.most) for r in B.resample_totals(df, 70, 3).collect()}
    by_item = {i: [w for (_, x), w in expected.items() if x == i] for i in items}
    assert sums == {i: (sum(w), len(w), max(w)) for i, w in by_item.items()}


@pytest.mark.parametrize("unit,part", [(1 << 22, 1 << 14), (50, 16)])
def test_clusters_drawn_by_parts(spark, monkeypatch, unit, part):
    monkeypatch.setattr(B, "UNIT", unit)
    monkeypatch.setattr(B, "PART", part)
    rows = [(yr, f"u{u}", (u + k) % 3, (5 * u + k) % 9, 1 + k) for yr in (1, 2) for u in range(60) for k in range(1 + u % 3)]
    members = [("a", "t", 1), ("b", "t", 1)]
    df = spark.createDataFrame(rows, "yr int, user_id string, y int, code_0 long, n long").repartition(3)
    got = {(r.yr, r.rep, r.model): [r[f"f1_{c}"] for c in CLASSES] for r in B.cluster_hash_f1(df, "user_id", members, 6, 5).collect()}
    assert len(got) == 2 * 6 * 2
    for (yr, rep, model), f1 in got.items():
        order = sorted({u for x, u, *_ in rows if x == yr}, key=lambda u: (ph(f"5:{u}"), u))
        m = Counter(order[ph(f"5:user_id:{yr}:{rep}:{j}") % len(order)] for j in range(len(order)))
        own = [(y, code // (3 if model == "b" else 1) % 3, m[u] * n) for x, u, y, code, n in rows if x == yr]
        for c in CLASSES:
            hit = sum(w for y, p, w in own if y == p == c)
            total = sum(w for y, _, w in own if y == c) + sum(w for _, p, w in own if p == c)
            assert f1[c] == pytest.approx(2 * hit / total if total else 0.0)


def test_runs_are_counted_where_draws_meet_cells(spark):
    members = [("m", "t", s) for s in range(4)]
    cells = spark.createDataFrame(CELLS, "yr int, y int, code_0 long, n long").repartition(3)
    keys = ["yr", "rep", *B.MEMBER]
    values = ["f1_0", "f1_1", "f1_2", "macro_f1"]
    by_cell = B.member_f1(B.draw_cells(cells, ["yr"], ["y", "code_0"], 5, 9), members, ["yr", "rep"], "w")
    f1 = B.replicate_f1(cells, members, ["yr"], 5, 9, "hash")
    at = lambda df: {tuple(r[: len(keys)]): tuple(r[len(keys) :]) for r in df.select(*keys, *values).collect()}
    assert at(f1) == at(by_cell) and f1.count() == 3 * 5 * 4
    assert "explode(array" not in f1._jdf.queryExecution().executedPlan().toString()
