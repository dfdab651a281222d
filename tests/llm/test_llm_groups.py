"""Near-duplicates, components, line dedup, mixing, sharding, the pipeline."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidemark.llm import common
from tidemark.llm import components as C
from tidemark.llm import embedding_dedup, line_dedup, mixing, sharding, simhash_dedup

TEXT = "doc_id long, text string, source string, copies string, h string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "on", "er", "a", "ti", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, t, None if i % 3 else "b", "x", "y") for i, t in enumerate(H.CASES)]
    for i in range(60):
        text = prose(rng, rng.randint(5, 200))
        out.append((100 + i, text, f"s{i % 4}", "x", "y"))
        if i % 4 == 0:
            out.append((200 + i, text, "s0", "x", "y"))
        if i % 5 == 0:
            ws = text.split()
            ws[len(ws) // 2] = "changed"
            out.append((300 + i, " ".join(ws), "S", "x", "y"))
    out += [(900 + i, "Same text for very many rows of one source", "hot", "x", "y") for i in range(80)]
    return out + [out[0], out[20], out[20]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, TEXT).repartition(6).cache()


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    edges += [(rng.randint(3000, 3400), rng.randint(3000, 3400)) for _ in range(260)] + [(7, 7), (-5, 0)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long").repartition(7)
    want = {n: r for n, r in H.roots({n for e in edges for n in e}, edges).items() if n != r}
    assert {r.node: r.component for r in C.components(frame).collect()} == want
    assert C.components(frame.limit(0)).count() == 0


def test_simhash_classes_equal_brute_force(docs, rows):
    for tile in (simhash_dedup.TILE, 5):
        prints = {t: H.fingerprint(t) for _, t, *_ in rows}
        close = [(a, b) for a in set(prints.values()) for b in set(prints.values()) if a < b and (a ^ b).bit_count() <= 3]
        root = H.roots(set(prints.values()), close)
        least = {}
        for i, t, *_ in rows:
            r = root[prints[t]]
            least[r] = min(least.get(r, i), i)
        hashed = simhash_dedup.fingerprints(docs, ["doc_id"]).select("fp").distinct()
        got = simhash_dedup.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        text = {i: t for i, t, *_ in rows}
        assert all(r.fp % 2**64 == prints[text[r.doc_id]] and r.component_id == least[root[prints[text[r.doc_id]]]] for r in got)
        links = simhash_dedup.near_links(hashed, tile=tile).collect()
        got_root = H.roots(set(prints.values()), [(r.a % 2**64, r.b % 2**64) for r in links])
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
        assert groups(got_root) == groups(root)


def test_simhash_tiles_find_all_close_random_prints(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(150)]
    near = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 4))) for b in base for _ in range(3)]
    values = sorted({*base, *near, 0, 2**64 - 1, 7})
    frame = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    got = simhash_dedup.near_links(frame, tile=50).collect()
    want = H.roots(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3])
    have = H.roots(values, [(r.a % 2**64, r.b % 2**64) for r in got])
    pairs = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert pairs(have) == pairs(want)


def test_simhash_of_very_long_texts_in_steps(monkeypatch):
    text = prose(random.Random(3), 3000).encode() + b" " * 400 + b"z" * 900 + b"\n\n" + b"END of it"
    want = H.fingerprint(text.decode())
    for step in (3, 10, 100_000):
        monkeypatch.setattr(simhash_dedup, "STEP_WORDS", step)
        assert simhash_dedup.simhash(text) == want
    assert simhash_dedup.simhash(b"") == simhash_dedup.simhash(b" \n ") == 0


def vectors(seed=0, n=300, width=64):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    cosines = rng.choice([0.93, 0.951, 0.96, 0.99], size=n)[:, None]
    y = cosines * x + np.sqrt(1 - cosines**2) * turn
    return [*x.tolist(), *y.tolist(), *(2 * x[:20]).tolist(), *x[:5].tolist(), *[x[0].tolist()] * 40]


def test_embedding_links_equal_brute_force(spark):
    import numpy as np

    xs = vectors()
    odd = [None, [], [0.0] * 64, [None, *xs[0][1:]], [float("nan"), *xs[0][1:]], [float("inf"), *xs[0][1:]], [1.0, 2.0]]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(xs + odd)] + [(None, xs[0], 1)], "vec_id long, embedding array<double>, kept int").repartition(5)
    u = np.array(xs) / np.linalg.norm(xs, axis=1)[:, None]
    close = np.triu(u @ u.T >= 0.95, 1)
    edges = list(zip(*map(list, np.nonzero(close)), strict=True))
    links = collections.Counter(int(i) for e in edges for i in e)
    root = H.roots(range(len(xs) + len(odd)), edges)
    for tile in (embedding_dedup.TILE, 16):
        got = embedding_dedup.near_duplicates(frame, tile=tile).collect()
        assert len(got) == len(xs) + len(odd) + 1
        named = [r for r in got if r.vec_id is not None]
        found = sum(r.n_links for r in named)
        assert found <= 2 * len(edges) and found >= 0.99 * 2 * len(edges)
        assert sum(r.component_id == root[r.vec_id] for r in named) >= 0.99 * len(named)
        assert all(r.n_links <= links[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in named)
        assert all(r.n_links == 0 and r.kept for r in named if r.vec_id >= len(xs))
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0
    assert all(r.kept for r in embedding_dedup.near_duplicates(frame.filter("embedding is null")).collect())


def test_embedding_cluster_of_near_copies_loses_no_link(spark):
    """A third of all vectors are near copies of one: pivots are drawn among them too."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 32))
    x[:270] = x[0] + 0.05 * rng.normal(size=(270, 32))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(links.tolist()))
    only = spark.createDataFrame([(i, v) for i, v in enumerate(x[:100].tolist())], "vec_id long, embedding array<double>")
    assert {r.component_id for r in embedding_dedup.near_duplicates(only).collect()} == {0}


def brute_lines(rows):
    """Texts without the lines that repeat another one of their component, by comparing all pairs of lines."""
    lines = {}
    for n, (i, text, *_) in enumerate(rows):
        for j, line in enumerate((text or "").split("\n")):
            line = line.strip(line_dedup.BLANK)
            if line:
                lines.setdefault(line, []).append((i, n, j))
    names = list(lines)
    sets = [H.shingles(x, line_dedup.SHINGLE) for x in names]
    links = [(i, j) for i in range(len(names)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = H.roots(range(len(names)), links)
    first = {}
    for k, name in enumerate(names):
        first[root[k]] = min(first.get(root[k], (1e9,)), min(lines[name]))
    keep = {(n, j) for k, name in enumerate(names) for (i, n, j) in lines[name] if (i, n, j) == first[root[k]]}
    out = []
    for n, (i, text, *_) in enumerate(rows):
        own = None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if not x.strip(line_dedup.BLANK) or (n, j) in keep)
        out.append((i, own))
    return out


def line_rows(seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.randint(8, 40)) for _ in range(60)]
    out = []
    for i in range(80):
        chosen = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(pool)
            if rng.random() < 0.4:
                ws = line.split()
                ws[rng.randrange(len(ws))] = "zz"
                line = " ".join(ws)
            chosen.append(rng.choice(["", " ", "\t"]) + line + rng.choice(["", "\r"]))
            if rng.random() < 0.2:
                chosen.append(rng.choice(["", "  ", "Tiny.", "Ja"]))
        out.append((i, "\n".join(chosen)))
    return out + [(500, None), (501, ""), (502, " \n\n"), out[3], out[3]]


@pytest.mark.parametrize(("tile", "bucket_rows"), [(256, 200_000), (3, 2)])
def test_line_dedup_equals_brute_force(spark, tmp_path, monkeypatch, tile, bucket_rows):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    monkeypatch.setattr(line_dedup, "BUCKET_ROWS", bucket_rows)
    rows = line_rows(8)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "q", 5) for i, t in rows], "doc_id long, text string, line string, n_dropped int").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    got = line_dedup.dedup_lines(docs, scan=True).collect()
    assert len(got) == len(rows) and got[0].line == "q"
    want = brute_lines(rows)
    key = lambda x: (x[0], x[1] is None, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)
    filled = lambda pairs: sum(bool(x.strip(line_dedup.BLANK)) for _, t in pairs for x in (t or "").split("\n"))
    assert sum(r.n_dropped for r in got) == filled(rows) - filled(want)


def test_line_dedup_compares_lines_unlike_the_smallest(spark):
    """A chain: the ends are unlike each other, so a star around one end alone would lose the link to the other."""
    rng = random.Random(12)
    base = [prose(rng, 1) for _ in range(60)]
    chain = []
    for step in range(4):
        ws = list(base)
        ws[: 4 * step] = [f"q{step}{i}" for i in range(4 * step)]
        chain.append(" ".join(ws))
    rows = [(i, x) for i, x in enumerate(chain)] + [(9, "other line that is like nothing here")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(brute_lines(rows))


def test_line_dedup_links_across_the_parts_of_a_hot_bucket(spark, monkeypatch):
    """Smallest line G in one part; R, unlike G, heads the part of a, which is like both: a is to link them."""
    import xxhash

    monkeypatch.setattr(line_dedup, "BUCKET_ROWS", 1)
    part = lambda h: xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), 42)
    part3 = lambda h: ((part(h) ^ 1 << 63) - (1 << 63)) % 3
    rng = random.Random(5)
    for _ in range(20_000):
        a = prose(rng, 30)[:80]
        r, g = prose(rng, 2)[:7] + a[7:], a[:-7] + prose(rng, 2)[:7]
        lines = [x.strip() for x in (g, r, a)]
        hg, hr, ha = (line_dedup.line_hash(x.encode()) for x in lines)
        if not (hg < hr < ha and part3(hr) == part3(ha) != part3(hg)):
            continue
        sg, sr, sa = (H.shingles(x, line_dedup.SHINGLE) for x in lines)
        if not (H.alike(sa, sr) and H.alike(sa, sg) and not H.alike(sr, sg)):
            continue
        if len({int(k) for k in line_dedup.band_keys(line_dedup.signatures(lines, bins=1), 1)[:, 0]}) == 1:
            break
    else:
        raise AssertionError("no such lines")
    rows = list(enumerate(lines))
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=1).collect()}
    assert got == {0: lines[0], 1: "", 2: ""} == dict(brute_lines(rows))


def test_line_dedup_when_the_splits_change_between_jobs(spark, tmp_path, monkeypatch):
    """An executor that comes or goes changes how files are cut into tasks; the rows keep their numbers."""
    rows = [(i, f"line number {i} of its own {i * 7919}\na line that all of the texts repeat") for i in range(60)]
    path, inner = str(tmp_path / "docs"), line_dedup.shared_buckets
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(path)

    def later(signed):
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
        return inner(signed)

    monkeypatch.setattr(line_dedup, "shared_buckets", later)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.read.parquet(path), scan=True).collect()}
    finally:
        for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)
    assert got == {i: t if i == 0 else t.split("\n")[0] for i, t in rows}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_hash_is_sparks(spark):
    got = spark.createDataFrame([("abc dé",)], "x string").select(F.xxhash64("x").alias("h")).first().h
    assert got == line_dedup.line_hash("abc dé".encode())


def test_signatures_estimate_jaccard():
    rng = random.Random(6)
    lines = [prose(rng, 40) for _ in range(30)]
    near = [x[:-30] + prose(rng, 6) for x in lines]
    sig = line_dedup.signatures(lines + near + ["1234567"], bins=480)
    for i in range(30):
        a, b = (H.shingles(x, line_dedup.SHINGLE) for x in (lines[i], near[i]))
        assert abs((sig[i] == sig[30 + i]).mean() - len(a & b) / len(a | b)) < 0.12
    assert len(set(sig[60].tolist())) == 1


def size_of(text):
    return len(H.words(text))


def test_mix_meets_targets(docs, rows):
    size = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))
    got = mixing.mix(docs, size, key=("doc_id", "text")).collect()
    assert len(got) == len(rows) and {"h", "doc_id", "source"} <= set(got[0].asDict())
    sizes, largest = collections.Counter(), collections.Counter()
    for _, t, s, *_ in rows:
        sizes[s] += size_of(t)
        largest[s] = max(largest[s], size_of(t))
    want, taken = H.targets(sizes), collections.Counter()
    for r in got:
        assert r.mix_size == size_of(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and r.copies in (0, 1, 2)
        taken[r.source] += r.mix_size * r.copies
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.mix(docs.repartition(2), size, key=("doc_id", "text")).select("doc_id", "source", "copies")
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in mixing.mix(docs, size).select("doc_id", "source", "copies").collect())


def test_mix_splits_repeated_rows(spark):
    """All rows of a source are one row repeated: the budget ends inside them."""
    rows = [(1, "a b c", "a")] * 300 + [(i, "w " * 50, "b") for i in range(40)] + [(5, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), F.size(F.split("text", " "))).collect()
    by = collections.Counter()
    for r in got:
        by[r.source] += r.mix_size * r.copies
    target = {r.source: r.target for r in got}
    assert len(got) == 341 and all(abs(by[s] - target[s]) <= 51 for s in target)


def test_smaller_budgets_are_nested(docs):
    size = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))
    taken = [{(r.doc_id, r.source): r.copies for r in mixing.mix(docs, size, total_share=s, most=1).collect()} for s in (0.2, 0.4, 0.8)]
    for less, more in zip(taken, taken[1:], strict=False):
        assert all(more[k] >= n for k, n in less.items())


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none, F.length("text")).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "a")], none.schema), F.length("text")).first().copies == 0


def test_shards_are_minimax_and_gapless(docs, rows):
    got = sharding.shard(docs, 8).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    groups, where = collections.Counter(), collections.defaultdict(set)
    for r in got:
        t = text[r.doc_id]
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        groups[t] += r.size
        where[t].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    slots = collections.defaultdict(list)
    sums = collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    import xxhash

    order = sorted(groups, key=lambda t: xxhash.xxh64_intdigest(t.encode(), 42))
    assert max(sums.values()) == H.minimax([groups[t] for t in order], 8)
    again = sharding.shard(docs.repartition(2), 8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("n", [0, 1, 3, 700])
def test_minimax_capacity_is_exact(spark, n):
    rng = random.Random(n)
    sizes = [(rng.getrandbits(64) - 2**63, int(rng.paretovariate(1.0)) + 1) for _ in range(n)]
    frame = spark.createDataFrame(sizes, "g long, size long")
    starts, capacity = sharding.minimax_cuts(frame, 5)
    ordered = sorted(sizes, key=lambda x: x[0] % 2**64)
    assert capacity == (H.minimax([s for _, s in ordered], 5) if n else 0)
    sums = collections.Counter()
    for g, s in ordered:
        sums[sum(g % 2**64 >= b for b in starts)] += s
    assert max(sums.values(), default=0) <= capacity


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(21)
    lines = [prose(rng, 12).capitalize() + " the of and." for _ in range(400)]
    texts = ["\n".join(rng.sample(lines, 8)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[0], "en", "s0", len(texts[0]), "x") for i in range(20)] + [(200, None, None, None, None, "x"), (201, "", "en", "s1", 0, "x"), (202, "### $$$ " * 100, "en", "s1", 800, "x"), (None, texts[1] + " more", "en", "s1", 9, "x")]
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").coalesce(3).write.parquet(str(folder / "documents.parquet"))
    docs, seen = spark.read.parquet(str(folder / "documents.parquet")), []
    for name, stage in P.STAGES:
        stage(spark, docs, str(folder)).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append((before.collect(), docs.collect(), docs.columns))
    columns = ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert [c for *_, c in seen[:4]] == [columns] * 4
    ids = lambda rs: collections.Counter(r.doc_id for r in rs)
    quality, line, near, mixed, coded = seen
    assert set(ids(quality[0])) - set(ids(quality[1])) == {200, 201, 202}
    assert ids(line[0]) == ids(line[1])
    want = brute_lines([(-1 if r.doc_id is None else r.doc_id, r.text) for r in line[0]])  # null keys come first
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in line[1]) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in line[1] if r.doc_id is not None)
    prints = {r.doc_id: H.fingerprint(r.text) for r in near[0] if r.doc_id is not None}
    root = H.roots(set(prints.values()), [(a, b) for a in prints.values() for b in prints.values() if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(least.get(root[p], i), i)
    assert {r.doc_id for r in near[1]} - {None} == set(least.values())
    assert max(ids(mixed[1]).values()) <= 2 and set(ids(mixed[1])) <= set(ids(mixed[0]))
    assert ids(coded[1]) == ids(mixed[1]) and coded[2] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(P.run(spark, str(folder)).collect()) == collections.Counter(coded[1])


def test_shingle_numbers_are_exact_sets():
    rng = random.Random(12)
    for alphabet in ("ab", "abcdefghij \U0001f642é", [chr(c) for c in range(0x100, 0x500)]):
        lines = ["".join(rng.choice(alphabet) for _ in range(rng.randint(7, 60))) for _ in range(40)]
        lines += [x[:20] + "zzz" + x[23:] for x in lines if len(x) > 25]
        sets = line_dedup.shingle_sets(lines, 7)
        for i, a in enumerate(lines):
            assert len(sets[i]) == len(H.shingles(a))
            for j, b in enumerate(lines[:i]):
                assert len(np.intersect1d(sets[i], sets[j])) == len(H.shingles(a) & H.shingles(b))
                for least in (0.3, 0.8):
                    assert line_dedup.jaccard_at_least(sets[i], sets[j], least) == H.alike(H.shingles(a), H.shingles(b), least)


def test_embeddings_of_several_widths(spark):
    """Every width is an index of its own; links within each are those of brute force."""
    rng = np.random.default_rng(3)
    rows = []
    for width, n in ((3, 60), (2, 40), (64, 90), (5, 1)):
        base = rng.normal(size=(n // 3 + 1, width))
        for i in range(n):
            rows.append((len(rows), [float(x) for x in base[i % len(base)] + (i % 2) * 0.05 * rng.normal(size=width)]))
    rows += [(1000 + i, [1.0, 2.0, 2.0]) for i in range(5)] + [(1100 + i, [1.0, 2.0]) for i in range(3)] + [(2000, None), (2001, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    links = [(i, j) for i in usable for j in usable if i < j and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= 0.95]
    degree = collections.Counter(x for pair in links for x in pair)
    roots = H.roots([i for i, _ in rows], links)
    assert got == {i: (degree[i], roots[i]) for i, _ in rows}


def test_names_of_the_mix_and_of_row_numbers_may_be_taken(spark):
    """Columns of the input named like the operator's own: nothing is ambiguous, and the columns come back as they were."""
    names = ["cut_hash", "cut_rows", "cut_take", "_whole", "_source", "target", "_n", "_before", "_inside", "_mix_target", "mix_source"]
    rows = [(i % 7, f"text {i % 30}", f"s{i % 3}", *range(len(names))) for i in range(90)]
    frame = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"{n} int" for n in names)]))
    mixed = mixing.mix(frame, F.length("text"))
    got = mixed.collect()
    assert len(got) == 90 and all(r[n] == i for r in got for i, n in enumerate(names) if n != "target")
    plain = mixing.mix(frame.select("doc_id", "text", "source"), F.length("text"))
    assert sorted((r.doc_id, r.text, r.copies) for r in got) == sorted((r.doc_id, r.text, r.copies) for r in plain.collect())
    numbered = common.positions(frame, "source")
    assert collections.Counter((r.source, r.position) for r in numbered.collect()) == {(f"s{k}", i): 1 for k in range(3) for i in range(30)}


def test_texts_under_one_id_are_documents_of_their_own(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "m"), (2, a, "n"), (2, b, "o"), (None, b, "p"), (None, c, "q"), (None, c, "r")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, row string"), "")
    assert out.columns == ["doc_id", "text", "row"]
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (None, c)], key=str)


def test_lines_of_rows_that_agree_in_all_but_other_columns(spark):
    """Rows with one key and one text: one of them keeps its lines, the others lose every line; other columns stay."""
    text = "a first line of some length\n\n  a second line of some length  \nshort"
    rows = [(1, "keeps its own", i, text) for i in range(30)] + [(2, "x", 50, "short\nanother line that nobody else has"), (None, "y", 51, text), (None, "z", 52, None), (None, "z", 53, None)]
    frame = spark.createDataFrame(rows, "k long, text string, n int, body string").repartition(4)
    for scan in (True, False):
        got = line_dedup.dedup_lines(frame.cache(), "k", "body", scan=scan).collect()
        assert len(got) == len(rows) and {(r.n, r.text) for r in got} == {(r[2], r[1]) for r in rows}
        by = {r.n: r for r in got}
        assert by[51].body == text and by[51].n_dropped == 0 and by[52].body is None and by[53].n_dropped == 0
        assert {(by[i].body, by[i].n_dropped) for i in range(30)} == {("", 3)}
        assert (by[50].body, by[50].n_dropped) == ("another line that nobody else has", 1)
    alone = line_dedup.dedup_lines(frame.filter("n < 30"), "k", "body", scan=True).collect()
    assert sorted((r.body, r.n_dropped) for r in alone) == [("", 3)] * 29 + [(text, 0)]
