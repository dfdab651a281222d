"""Brute-force versions of the operators, in plain Python."""

import collections
import math
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
CASES = [None, "", " \t\n", "one", "two words", "a b c a b c a b c", "Ünïcode wörds \U0001f642 here", "x" * 70_000, "line one is here\nline one is here\nline two is there"]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeat_words(ws):
    seen = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    return len({j for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def fingerprint(text):
    import xxhash

    ws = words(lower(text))
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def crc(key):
    return zlib.crc32(str(key).encode())


def targets(sizes):
    """Shares of 150 % by weights 5, 2, 1 in code-point order, null last, each at most twice its source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return out


def minimax(sizes, shards):
    """Smallest capacity of contiguous shards, by dynamic programming."""
    upto = [0]
    for s in sizes:
        upto.append(upto[-1] + s)
    best = upto[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], upto[i] - upto[j]) for j in range(i + 1)) for i in range(len(upto))]
    return best[-1]


def base_scores(rows):
    train = collections.Counter()
    for key, text in rows:
        if crc(key) % 7 != 2:
            train.update([*words(lower(text)), None])
    n, v = train.total(), len(train)
    return {key: sum(math.log10((train[t] + 1) / (n + v + 1)) for t in [*words(lower(text)), None]) for key, text in rows}, n


def shingles(line, k=7):
    return {line[i : i + k] for i in range(len(line) - k + 1)}


def alike(a, b, least=0.8):
    """Jaccard similarity of two sets of at least ``least``."""
    return len(a & b) >= least * len(a | b)
