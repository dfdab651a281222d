"""Statistical identities, brute force on small data, and agreement of the two ways to draw."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as B
from tidemark.operators import drift as D
from tidemark.operators import duplicates as DU
from tidemark.operators import features as FT
from tidemark.operators import leakage as LK
from tidemark.operators import metrics as M
from tidemark.operators import models as ML
from tidemark.operators import profile as P
from tidemark.operators import raters as R
from tidemark.operators import stats as ST
from tidemark.plans.views import Views

EARLY = list(Views.early)


def test_dedup_is_idempotent_and_keeps_the_most_helpful(spark):
    rows = [("u", "a", 1_000_000_000_000, "h", v, 4.0, "p", "text", 4, True) for v in (1, 9, 3)] * 400
    rows += [("u", "b", 1_000_000_000_000, "h", 2, 5.0, "p", "text", 4, True)]
    df = spark.createDataFrame(
        rows,
        "user_id string, asin string, ts long, text_hash string, helpful_vote long, rating double, parent_asin string, text string, text_len int, verified_purchase boolean",
    )
    pool = DU.dedup_pool(df, 2001, 2001)
    assert {(r.asin, r.helpful_vote) for r in pool.collect()} == {("a", 9), ("b", 2)}
    again = DU.dedup_pool(pool, 2001, 2001)
    assert {r.item_id for r in again.collect()} == {r.item_id for r in pool.collect()}


def test_text_sharing_gives_the_types_of_full_counts(views):
    full = {tuple(r) for r in DU.duplicate_types(DU.duplicate_groups(views.reviews)).collect()}
    assert full == {tuple(r) for r in DU.duplicate_types(DU.text_sharing(views.reviews)).collect()}


def test_looser_match_never_leaks_less(views):
    keys = DU.match_keys(views.reviews, keep=["item_key", "user_id", "parent_asin"])
    out = LK.leakage_matrix(keys, LK.standard_splits("item_key"), ["exact", "loose", "prefix"])
    leak = {(r.split, r.match): r.n_leak for r in out.collect()}
    for s in ("random_row", "group_parent_asin", "group_user"):
        assert leak[s, "exact"] <= leak[s, "loose"] <= leak[s, "prefix"]


def test_leakage_with_one_hot_text(spark):
    d = spark.range(3000).select(
        F.when(F.col("id") < 1100, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 5 < 4).alias("tr")
    )
    r = LK.seen_in_train(d, F.col("tr"), "k").first()
    assert (r.n_test, r.n_leak) == (600, 220)


def test_shares_sum_to_one(views):
    assert P.rating_distribution(views.reviews).agg(F.sum("pct")).first()[0] == pytest.approx(100)
    for r in P.category_share_by_year(views.pool, views.meta).groupBy("yr").agg(F.sum("share").alias("s")).collect():
        assert r.s == pytest.approx(1)


def test_category_counts_do_not_depend_on_the_join(views):
    small = P.count_by_category(views.pool, ["yr"], views.meta)
    large = P.count_by_category(views.pool, ["yr"], views.meta, max_rows=0)
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in large.collect()}
    assert small.agg(F.sum("n")).first()[0] == views.pool.count()


def test_f1_of_absent_class_is_zero(spark):
    d = spark.createDataFrame([(0, 0), (0, 2), (2, 2)], "y int, pred int")
    r = M.class_f1(d, []).first()
    assert r.f1_1 == 0.0 and r.macro_f1 == pytest.approx((2 / 3 + 0 + 2 / 3) / 3)


def naive_f1(y, p):
    out = []
    for c in range(3):
        tp = sum(a == c and b == c for a, b in zip(y, p))
        tot = sum(a == c for a in y) + sum(b == c for b in p)
        out.append(2 * tp / tot if tot else 0.0)
    return sum(out) / 3


def test_joint_cells_keep_every_run(spark):
    rng = random.Random(1)
    members = [(f"m{i}", "t", 1) for i in range(42)]  # more than one code column
    rows = [(m, t, s, str(i), 2000, i % 3, rng.randrange(3)) for i in range(60) for m, t, s in members]
    df = spark.createDataFrame(rows, "model string, train_set string, seed int, item_id string, yr int, y int, pred int")
    got = {r.model: r.macro_f1 for r in B.member_f1(B.joint_cells(df, members, ["yr"]), members, ["yr"]).collect()}
    for m, _, _ in members:
        mine = [r for r in rows if r[0] == m]
        assert got[m] == pytest.approx(naive_f1([r[5] for r in mine], [r[6] for r in mine]))


def test_incomplete_runs_are_refused(views):
    broken = views.preds.filter(~((F.col("seed") == 43) & (F.col("item_id") < "3")))
    with pytest.raises(Exception, match="same items"):
        B.joint_cells(broken, EARLY, ["yr"])


def test_hash_and_multinomial_draws_agree(views):
    a = {r.model: r for r in B.bootstrap_slope(views.preds, EARLY, 150, 1, draws="hash").collect()}
    b = {r.model: r for r in B.bootstrap_slope(views.preds, EARLY, 150, 1, draws="multinomial").collect()}
    for m in a:
        assert a[m].slope == pytest.approx(b[m].slope)
        width = a[m].hi - a[m].lo
        assert abs(a[m].lo - b[m].lo) < 0.3 * width and abs(a[m].hi - b[m].hi) < 0.3 * width


def test_split_draws_follow_the_same_law(views):
    cells = B.joint_cells(views.preds, EARLY, ["yr"])
    mean = {}
    for parts in (1, 7):
        reps = B.multinomial_f1(cells, EARLY, ["yr"], 200, 3, parts=parts)
        mean[parts] = {
            (r.yr, r.model, r.seed): (r.m, r.s)
            for r in reps.groupBy("yr", "model", "seed").agg(F.avg("macro_f1").alias("m"), F.stddev_samp("macro_f1").alias("s")).collect()
        }
    assert mean[1].keys() == mean[7].keys()
    for k, (m, s) in mean[1].items():
        assert abs(m - mean[7][k][0]) < 0.4 * s and 0.75 < s / mean[7][k][1] < 1.35


def test_cluster_draws_agree(views):
    a = {r.model: r for r in B.cluster_bootstrap(views.preds, EARLY, "parent_asin", 100, 2, "hash")[0].collect()}
    b = {r.model: r for r in B.cluster_bootstrap(views.preds, EARLY, "parent_asin", 100, 2, "multinomial")[0].collect()}
    for m in a:
        width = a[m].hi - a[m].lo
        assert a[m].slope == pytest.approx(b[m].slope)
        assert abs((b[m].hi - b[m].lo) - width) < 0.4 * width


def test_replicates_do_not_depend_on_partitioning(views):
    a = B.bootstrap_macro_f1(views.preds, EARLY, ["yr"], 5, 9)
    b = B.bootstrap_macro_f1(views.preds.repartition(3, "seed"), EARLY, ["yr"], 5, 9)
    key = lambda df: {(r.yr, r.model, r.seed): (r.f1, r.lo, r.hi) for r in df.collect()}
    assert key(a) == key(b)


def test_draws_cover_n_positions(spark):
    totals = spark.createDataFrame([("a", 1), ("b", 40_000)], "g string, total long")
    out = B.hash_draws(totals, ["g"], 3, 1, chunk=1000).groupBy("g", "rep").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    rows = out.collect()
    assert len(rows) == 6
    assert all(r.n == (1 if r.g == "a" else 40_000) and r.lo >= 0 and r.hi < r.n for r in rows)


def test_shift_share_adds_up(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["early", "late"]), rng.choice("ABC"), rng.random()) for _ in range(500)] + [("late", "D", 0.5)]
    r = D.shift_share(spark.createDataFrame(rows, "period string, label string, share_neu double")).first()
    assert r.composition + r.within + r.interaction == pytest.approx(r.total, abs=1e-12)
    early = [x for p, _, x in rows if p == "early"]
    assert r.r_early == pytest.approx(sum(early) / len(early))


def test_reweighting_to_the_same_year_changes_nothing(views):
    items = views.pool.filter("yr >= 1997")
    for r in D.mix_reweighted_f1(views.preds, items, views.meta, 1997).filter("yr = 1997").collect():
        assert r.raw == pytest.approx(r.reweighted)


def test_kappa_of_equal_and_naive(spark):
    rng = random.Random(3)
    labs = R.LABELS
    data = [(i, r, rng.choice(labs[:3])) for i in range(200) for r in "ab"] + [(i, "c", None) for i in range(5)]
    data = [d for d in data if d[2]]
    data += [(i, "copy", lab) for i, r, lab in data if r == "a"]
    out = {(r.a, r.b): r for r in R.cohen_kappa(spark.createDataFrame(data, "item_id long, rater string, label string"), ["a", "b", "copy"]).collect()}
    assert out["a", "copy"].kappa == pytest.approx(1.0)
    a = {i: lab for i, r, lab in data if r == "a"}
    b = {i: lab for i, r, lab in data if r == "b"}
    po = sum(a[i] == b[i] for i in a) / 200
    pe = sum((sum(v == x for v in a.values()) / 200) * (sum(v == x for v in b.values()) / 200) for x in labs)
    assert out["a", "b"].kappa == pytest.approx((po - pe) / (1 - pe))


def test_fleiss_of_perfect_agreement(spark):
    rows = [(i, r, R.LABELS[i % 3]) for i in range(30) for r in "abc"]
    assert R.fleiss_kappa(spark.createDataFrame(rows, "item_id long, rater string, label string")).first().kappa == pytest.approx(1.0)


def test_majority_needs_more_than_half(spark):
    rows = []
    for i, combo in enumerate(itertools.product(R.LABELS, repeat=3)):
        rows += [(i, r, lab) for r, lab in zip("abc", combo)]
    got = {r.item_id: (r.majority, r.unanimous) for r in R.majority_vote(spark.createDataFrame(rows, "item_id long, rater string, label string")).collect()}
    for i, combo in enumerate(itertools.product(R.LABELS, repeat=3)):
        best = max(set(combo), key=combo.count)
        assert got[i] == (best if combo.count(best) >= 2 else "NO_MAJORITY", combo.count(best) == 3)


@pytest.fixture(scope="module")
def trend(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        x, cat = rng.randrange(8), rng.choice(["u", "v", "w"])
        p = 1 / (1 + math.exp(-(-1 + 0.25 * x + (0.5 if cat == "v" else 0))))
        rows.append((x, int(x >= 4), cat, int(rng.random() < p)))
    return spark.createDataFrame(rows, "x int, late int, cat string, y int")


def test_closed_form_logit_equals_the_fit(trend):
    exact = ST.binary_logit(trend, "y", "late").first()
    fit = {r.term: r for r in ST.logit_trend(trend, "y", ["late"]).collect()}["late"]
    assert fit.b == pytest.approx(exact.b, rel=1e-6) and fit.se == pytest.approx(exact.se, rel=1e-4)
    assert fit.lo == pytest.approx(exact.lo, rel=1e-4)


def test_logit_finds_the_trend_under_category_effects(trend):
    fit = {r.term: r for r in ST.logit_trend(trend, "y", ["x"], "cat").collect()}
    assert abs(fit["x"].b - 0.25) < 0.08 and fit["x"].p < 1e-6 and len(fit) == 4


def test_linear_probability_model(trend):
    rows = [(r.x, r.y) for r in trend.collect()]
    x = np.array([[1.0, a] for a, _ in rows])
    y = np.array([b for _, b in rows], dtype=float)
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    e = y - x @ beta
    inv = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(inv @ (x.T * e**2) @ x @ inv) * len(y) / (len(y) - 2))
    full = {r.term: r for r in ST.lpm_hc1(trend, "y", ["x"]).collect()}["x"]
    single = ST.lpm_hc1_single(trend, "y", "x").first()
    assert full.b == pytest.approx(beta[1]) and full.se_hc1 == pytest.approx(se[1])
    assert single.b == pytest.approx(beta[1]) and single.se_hc1 == pytest.approx(se[1])


@pytest.mark.parametrize("t,dof,p", [(2.228138852, 10, 0.05), (12.7062047, 1, 0.05), (1.959963985, 1e7, 0.05), (0.0, 5, 1.0), (3.169272673, 10, 0.01)])
def test_student_p(t, dof, p):
    assert ST._t_two_sided(t, dof) == pytest.approx(p, abs=1e-6)


def test_quantile_bins_keep_ties_together(spark):
    d = spark.createDataFrame([(v,) for v in [1] * 10 + [2, 3, 4]], "v int")
    out = {r.v: r.bin for r in ST.quantile_bins(d, "v").select("v", "bin").distinct().collect()}
    assert out[1] == "short" and out[4] == "long"


def test_tfidf_against_hand_count(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, "bb")], "doc_id long, text string")
    terms = {r.term: r for r in FT.tfidf_terms(docs, 1, 100, (1,)).collect()}
    assert (terms["aa"].df, terms["aa"].cf) == (1, 2) and (terms["bb"].df, terms["bb"].cf) == (3, 3)
    assert terms["aa"].idf == pytest.approx(math.log(4 / 2) + 1)
    w = {(r.doc_id, r.term): r.weight for r in FT.tfidf_weights(docs, FT.tfidf_terms(docs, 1, 100, (1,)), (1,)).collect()}
    a, b = (1 + math.log(2)) * terms["aa"].idf, terms["bb"].idf
    assert w[1, "aa"] == pytest.approx(a / math.hypot(a, b)) and w[3, "bb"] == pytest.approx(1.0)
    vec = FT.tfidf_vectors(docs, FT.indexed_terms(FT.tfidf_terms(docs, 1, 100, (1,))), 100, (1,))
    assert all(r.features.norm(2) == pytest.approx(1.0) for r in vec.collect())


def test_classifier_beats_majority(views):
    train, tests = views.doc_samples()
    terms = FT.indexed_terms(FT.tfidf_terms(train, 5, 5000))
    model = ML.text_classifier(FT.tfidf_vectors(train.select("doc_id", "text", "y"), terms, 5000), 20, labels=train)
    scored = ML.score_predictions(model, FT.tfidf_vectors(tests.select("doc_id", "text", "y"), terms, 5000))
    ours = M.class_f1(scored, []).first().macro_f1
    base = M.class_f1(ML.majority_baseline(train, tests.select("doc_id", "y")), []).first().macro_f1
    assert ours > base + 0.2
    r = scored.first()
    assert r.p_neg + r.p_neu + r.p_pos == pytest.approx(1.0)


def _bad_preds(spark, rows):
    return spark.createDataFrame(rows, "model string, train_set string, seed int, item_id string, yr int, y int, pred int")


def test_alignment_refuses_bad_input(spark):
    members = [("m", "t", 1), ("m", "t", 2)]
    row = lambda item, seed, pred, y=1: ("m", "t", seed, item, 2000, y, pred)
    rows = [row("good", 1, 1), row("good", 2, 0)]
    rows += [row("doubled", 1, 1), row("doubled", 1, 1)] + [row("missing", 1, 1)]
    rows += [row("null", 1, 1), row("null", 2, None)] + [row("foreign", 1, 1), row("foreign", 2, 7)]
    rows += [row("disagrees", 1, 1, 1), row("disagrees", 2, 1, 2)] + [row("no class", 1, 1, None), row("no class", 2, 1, None)]
    rows += [row("thrice", 1, 1), row("thrice", 2, 1), row("thrice", 2, 1)]
    got = {r.item_id: r.complete for r in B.align_predictions(_bad_preds(spark, rows), members, ["yr"]).collect()}
    assert got == {k: k == "good" for k in got} and len(got) == 8


def test_alignment_of_many_runs(spark):
    members = [("m", "t", i) for i in range(45)]
    rows = [("m", "t", i, "all", 2000, 1, i % 3) for i in range(45)] + [("m", "t", min(i, 43), "last missing", 2000, 1, 0) for i in range(45)]
    got = {r.item_id: r.complete for r in B.align_predictions(_bad_preds(spark, rows), members, ["yr"]).collect()}
    assert got == {"all": True, "last missing": False}


def test_multinomial_weights_have_the_right_law(spark):
    import numpy as np

    cells = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 20, 75])] + [("b", 0, 9)], "g string, c int, n long")
    got = B.multinomial_weights(cells, ["g"], ["c"], 4000, 3).toPandas()
    assert (got.groupby(["g", "rep"]).w.sum().unstack(0) == [100, 9]).all().all()
    a = got[got.g == "a"].pivot(index="rep", columns="c", values="w").fillna(0).to_numpy()
    p = np.array([0.05, 0.2, 0.75])
    assert np.abs(a.mean(axis=0) - 100 * p).max() < 0.4 and np.abs(a.var(axis=0) / (100 * p * (1 - p)) - 1).max() < 0.12
    again = B.multinomial_weights(cells.repartition(3), ["g"], ["c"], 4000, 3).toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, got.to_numpy()))


def test_drift_without_anything_to_divide_by(spark):
    from tidemark.operators import drift as D

    flat = spark.createDataFrame([("m", "t", 2000, 0.0), ("m", "t", 2001, 0.5)], "model string, train_set string, yr int, macro_f1 double")
    assert D.yearly_slope(flat, ["model"]).first().rel_slope is None
    months = spark.createDataFrame([(2000, 11, 1), (2001, 3, 0)], "yr int, month int, y int")
    got = {r.yr: (r.kept_share, r.neg) for r in D.month_mix(months).collect()}
    assert got == {2000: (0.0, None), 2001: (1.0, 1.0)}
    same = [("m", t, y, 0.5) for t in ("early", "recent") for y in (2000, 2001)]
    assert D.recovery_share(spark.createDataFrame(same, flat.schema), 2000, [2001]).first().recovered is None
    early = spark.createDataFrame([("early", "A", 1.0)], "period string, label string, share_neu double")
    assert D.shift_share(early).first().r_late is None


def test_leakage_of_an_empty_test_side(spark):
    from tidemark.operators import leakage as LK

    rows = spark.createDataFrame([("a",), ("b",)], "key string")
    assert LK.seen_in_train(rows, F.lit(True), "key").first().leak_pct is None
    got = LK.leakage_matrix(rows, {"all": F.lit(True)}, ["key"]).first()
    assert (got.n_test, got.leak_pct) == (0, None)


def _rated(spark, rows):
    return spark.createDataFrame(rows, "item_id int, rater string, label string")


def test_agreement_without_chance_or_raters(spark):
    import pytest
    from tidemark.operators import raters as R

    same = _rated(spark, [(i, r, "POSITIVE") for i in range(3) for r in "ab"])
    assert R.cohen_kappa(same, ["a", "b"]).first().kappa is None
    assert R.fleiss_kappa(same).first().kappa is None
    assert R.fleiss_kappa(_rated(spark, [(1, "a", "POSITIVE"), (2, "a", "NEGATIVE")])).first().kappa is None
    with pytest.raises(Exception, match="different numbers"):
        R.fleiss_kappa(_rated(spark, [(1, "a", "POSITIVE"), (2, "a", "MIXED"), (2, "b", "MIXED")])).collect()
    with pytest.raises(Exception, match="unknown label"):
        R.majority_vote(_rated(spark, [(1, r, "odd") for r in "abc"])).collect()


def test_regressions_without_error_or_cells(spark):
    from tidemark.operators import stats as ST

    line = spark.createDataFrame([("two", 1, 1.0), ("two", 2, 3.0), ("flat", 1, 2.0), ("flat", 2, 2.0), ("flat", 3, 2.0)], "g string, x int, y double")
    got = {r.g: r for r in ST.linear_trend_p(line, ["g"], "x", "y").collect()}
    assert got["two"].slope == 2.0 and got["two"].se is None and got["two"].p is None
    assert got["flat"].slope == 0.0 and got["flat"].t is None
    empty = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "y int, x int")
    r = ST.binary_logit(empty, "y", "x").first()
    assert r.b is None and r.share_1 == 1.0 and r.share_0 == 0.5


def test_hashed_model_gives_probabilities_and_tags(spark):
    from tidemark.operators import models as ML

    words = {0: "bad broken awful", 1: "okay fine average", 2: "great good lovely"}
    rows = [(f"i{i}", " ".join(random.Random(i).choice(words[i % 3].split()) for _ in range(6)), i % 3) for i in range(150)]
    pool = spark.createDataFrame(rows, "item_id string, text string, y int")
    model = ML.hashed_full_pool_model(pool, bits=10, max_iter=15)
    got = ML.score_hashed(model, pool.unionByName(spark.createDataFrame([("none", None, 1)], pool.schema)), {"model": F.lit("hashed"), "seed": F.lit(7)}).collect()
    assert len(got) == 151 and {(r.model, r.seed) for r in got} == {("hashed", 7)}
    for r in got:
        p = [r.p_neg, r.p_neu, r.p_pos]
        assert sum(p) == pytest.approx(1.0) and min(p) >= 0 and p[r.pred] == max(p)
    assert sum(r.pred == r.y for r in got) >= 148


def test_sets_compared_by_group(spark):
    from tidemark.operators import joins as J

    a = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2), ("t", 1), (None, 5)], "g string, k int")
    b = spark.createDataFrame([("s", 2), ("s", 1), ("t", 1), ("t", 9), ("u", 3), (None, 5)], "g string, k int")
    assert {(r.g, r.n, r.same) for r in J.same_sets(a, b, "k", ["g"]).collect()} == {("s", 2, True), ("t", 1, False), ("u", 0, False), (None, 1, True)}


def test_robustness_points_equal_the_single_checks(views):
    from tidemark.operators import drift as D

    spread, diffs = D.robustness(views.preds, list(views.early), [("big/early", "small/early")], [2001], 60, 3)
    got = {(r.variant, r.model): r for r in spread.collect()}
    early = views.preds.filter("train_set = 'early'")
    for name, one in (("all", D.model_slopes(early)), ("dropped", D.drop_period(early, [2001])), ("binary", D.binary_task(early)[1])):
        for r in one.collect():
            assert got[name, r.model].slope == pytest.approx(r.slope) and got[name, r.model].lo < got[name, r.model].hi
    for r in D.month_matched_slopes(early).collect():
        assert got["months", r.model].slope == pytest.approx(r.slope_matched)
    for r in diffs.collect():
        assert r.slope_diff == pytest.approx(got[r.variant, "big"].slope - got[r.variant, "small"].slope) and r.lo <= r.hi
