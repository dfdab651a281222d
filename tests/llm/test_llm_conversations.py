"""Conversation repair against brute force over all strings of edits."""

import collections
import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from tidemark.llm import conversation_repair as C

sys.setrecursionlimit(20_000)
SHAPE = re.compile("(s?(ua)+)?")
LAST = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def cheapest(rows):
    """(cost, audit, repaired rows) by the least suffix from every (row, state); states are the initials written so far."""

    def after(state, c):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(c)

    @functools.cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 4:
            for c, role in (("u", "user"), ("a", "assistant")):
                if after(state, c):
                    cost, audit, out = best(i, after(state, c), inserts + 1)
                    ways.append((cost + 5, "I" + audit, ((role, ""), *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                for c, new, fee in ((role[:1], role, 0), ("u", "user", 1), ("a", "assistant", 1)):
                    if after(state, c):
                        cost, audit, out = best(i + 1, after(state, c), 0)
                        ways.append((cost + extra + fee, "KR"[fee] + audit, ((new, text), *out)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    return best(0, "", 0)


def brute(table):
    """The contract, one conversation at a time."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in table:
        out = convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    result = set()
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        seen, marked = set(), []
        for _, role, text in rows:
            fault = "blank" if not text.strip(C.SPACE) else "duplicate" if (role, text) in seen else "" if LAST.search(text) else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, out = cheapest(tuple(marked))
        assert SHAPE.fullmatch("".join(r[:1] for r, _ in out))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        count = collections.Counter(m[2] for m in marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        result.add((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha))
    return result


def table(rng, convs):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            rows.append((conv, rng.choice([turn, turn, 3 * turn, None]), role, rng.choice(["Yes.", "No", "Why? ", "Well!\n", "", " \t", None, "x" * 300, "Yes."])))
    return rows


def test_divide_and_conquer_equals_the_least_string():
    rng = random.Random(2)
    names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    for _ in range(1500):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(1, 12)))
        items = [C.row_element(c) for c in codes]
        end, cost = C.last_state(items)
        audit = C.block_letters(codes, 0, end) + "I" * C._TAIL[end]
        assert (cost, audit) == cheapest(tuple(("sua?"[c >> 2], "t", names[c & 3]) for c in codes))[:2]


def test_blocks_compose_to_the_whole():
    rng = random.Random(4)
    for _ in range(300):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(2, 40)))
        cuts = sorted(rng.sample(range(1, len(codes)), rng.randint(0, min(6, len(codes) - 1))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        blocks = [C.block_element(p) for p in parts]
        end, cost = C.last_state(blocks)
        assert (end, cost) == C.last_state([C.row_element(c) for c in codes])
        letters = "".join(C.block_letters(p, *step) for p, step in zip(parts, C.crossings(blocks, 0, end)))
        assert letters == C.block_letters(codes, 0, end)


@pytest.mark.parametrize("bits", [C.BLOCK_BITS, 1])
def test_repair_equals_brute_force(spark, monkeypatch, bits):
    rng = random.Random(9)
    rows = table(rng, 120) + [(None, t, r, "To null.") for t, r in enumerate(["user", "assistant", "user"])]
    rows += [(500, t, ("user", "assistant")[t % 3 % 2], f"Turn {t // 2}.") for t in range(300)]  # one conversation with a third of all rows
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, conv string").repartition(5)
    monkeypatch.setattr(C.Repair.__init__, "__defaults__", ("conv_id", "turn", "role", "text", bits))
    got = C.damaged_and_repaired(frame)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert C.damaged_and_repaired(frame.limit(0)).count() == 0


def test_repaired_rows_have_the_shape(spark):
    rows = table(random.Random(1), 60)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repair = C.Repair(frame)
    audits = {r.conv: r.audit for r in repair.digest().collect()}
    found = collections.defaultdict(list)
    for r in sorted(repair.rows().collect(), key=lambda r: (r.conv, r.place)):
        found[r.conv].append(r)
    assert {c: "".join(r.edit for r in rs) for c, rs in found.items()} == audits
    for rs in found.values():
        assert [r.place for r in rs] == list(range(1, len(rs) + 1))
        assert SHAPE.fullmatch("".join(r.role[:1] for r in rs if r.edit != "D"))
