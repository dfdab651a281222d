"""Metrics, bootstrap intervals and drift checks on the long prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from tidemark.operators import bootstrap as B
from tidemark.operators import drift as D
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import profile as P
from tidemark.operators import sampling as S
from tidemark.plans.views import Views

MEMBERS, EARLY = list(Views.members), list(Views.early)
# Replicates, and those of clusters. Hash draws over the whole prediction table, which SQL repeats, cost replicates x items
# on either side, so these twins draw fewer; the multinomial queries draw all.
REPS, CLUSTER_REPS, TWIN_REPS = 1000, 500, 200
RUN4 = "model, train_set, seed, yr"


def tally(keys: str, source: str = "preds", weight: str = "1", classes=(0, 1, 2), pred: str = "pred") -> str:
    """SQL: per-class F1 and their mean for each group."""
    sums, f1 = [], []
    for c in classes:
        sums.append(f"sum(CASE WHEN y={c} AND {pred}={c} THEN {weight} ELSE 0 END)::DOUBLE AS c{c}")
        sums.append(f"(sum(CASE WHEN y={c} THEN {weight} ELSE 0 END)+sum(CASE WHEN {pred}={c} THEN {weight} ELSE 0 END))::DOUBLE AS t{c}")
        f1.append(f"CASE WHEN t{c}>0 THEN 2*c{c}/t{c} ELSE 0 END AS f1_{c}")
    mean = "+".join(f"f1_{c}" for c in classes)
    return f"""SELECT {keys}, n, accuracy, {", ".join(f"f1_{c}" for c in classes)}, ({mean})/{len(classes)}.0::DOUBLE AS macro_f1 FROM (SELECT *, {", ".join(f1)}
      FROM (SELECT {keys}, count(*) AS n, avg(({pred}=y)::INT) AS accuracy, {", ".join(sums)} FROM {source} GROUP BY ALL))"""


# ---- metrics --------------------------------------------------------------------------------

query(
    "EV1_confusion_matrix",
    """SELECT k.model, k.train_set, k.seed, k.test_set, a.c AS y, b.c AS pred, count(p.item_id) AS n FROM (SELECT DISTINCT model, train_set, seed, test_set FROM preds) k,
      (VALUES (0),(1),(2)) a(c), (VALUES (0),(1),(2)) b(c) LEFT JOIN preds p ON p.model=k.model AND p.train_set=k.train_set AND p.seed=k.seed
      AND p.test_set=k.test_set AND p.y=a.c AND p.pred=b.c GROUP BY ALL""",
)(lambda v: M.confusion_matrix(v.preds, M.RUN))
query("EV2_class_f1", f"SELECT {RUN4}, f1_0, f1_1, f1_2, macro_f1 FROM ({tally(RUN4)})")(lambda v: M.class_f1(v.preds, RUN4.split(", ")))
query("EV3_accuracy", "SELECT model, train_set, seed, test_set, avg((y=pred)::INT) AS accuracy FROM preds GROUP BY ALL")(
    lambda v: M.accuracy(v.preds, M.RUN)
)
query("EV4_metric_table", tally("model, train_set, seed, test_set"))(lambda v: M.metric_table(v.preds))
query(
    "EV5_weighted_macro_f1",
    f"""SELECT {RUN4}, round(macro_f1,8) AS macro_f1 FROM ({tally(RUN4, "wp", "w")})""",
    {"wp": "SELECT *, CASE WHEN month<=6 THEN 0.5 ELSE 1.5 END::DOUBLE AS w FROM preds"},
)(
    lambda v: rounded(
        M.class_f1(v.preds, RUN4.split(", "), weight=F.when(F.col("month") <= 6, 0.5).otherwise(1.5)).select(*RUN4.split(", "), "macro_f1"),
        "macro_f1",
    )
)
query(
    "EV6_pred_share",
    "SELECT model, train_set, test_set, avg((pred=0)::INT) pred_neg, avg((pred=1)::INT) pred_neu, avg((pred=2)::INT) pred_pos FROM preds GROUP BY ALL",
)(lambda v: M.pred_share(v.preds, ["model", "train_set", "test_set"]))
query(
    "AG26_seed_summary",
    "SELECT model, train_set, yr, round(avg(macro_f1),8) AS mean, round(stddev_samp(macro_f1),8) AS sd, count(*) AS n_seeds FROM f1_runs GROUP BY ALL",
)(lambda v: rounded(P.seed_summary(M.class_f1(v.preds, RUN4.split(", ")), ["model", "train_set", "yr"]), "mean", "sd"))


# ---- alignment --------------------------------------------------------------------------------

def member_sql(members) -> str:
    rows = ", ".join(f"('{m}','{t}',{s},{i},{3**i}::BIGINT)" for i, (m, t, s) in enumerate(members))
    return f"SELECT * FROM (VALUES {rows}) x(model,train_set,seed,i,pw)"


def cell_ctes(members, tag: str = "", where: str = "true", source: str = "preds", carry: str = "") -> dict[str, str]:
    c = f", {carry}" if carry else ""
    return {
        "mem": member_sql(members),
        "aligned": f"""SELECT yr, item_id, min(y) AS y, sum(pred*pw)::BIGINT AS code, count(*) AS n_runs{', min(' + carry + ') AS ' + carry if carry else ''}
          FROM {source} JOIN mem USING (model, train_set, seed) WHERE {where} GROUP BY yr, item_id""",
        "cells": f"SELECT yr, y, code{c}, count(*) AS n FROM aligned GROUP BY ALL",
    }


def draw_ctes(seed: str, reps: int = TWIN_REPS) -> dict[str, str]:
    return {
        "ranged": "SELECT *, hi-n AS lo FROM (SELECT *, (sum(n) OVER (PARTITION BY yr ORDER BY y, code))::BIGINT AS hi FROM cells)",
        "totals": "SELECT yr, sum(n)::BIGINT AS total FROM cells GROUP BY yr",
        "draws": f"""SELECT yr, b, ph('{seed}:'||yr||':'||b||':'||j)%total AS pos FROM (SELECT yr, total, b, unnest(range(total)) AS j
          FROM (SELECT yr, total, unnest(range({reps})) AS b FROM totals))""",
        "weighted": """SELECT d.yr, d.b AS rep, r.y, r.code, count(*) AS w FROM draws d ASOF JOIN ranged r ON d.yr=r.yr AND d.pos>=r.lo GROUP BY ALL""",
    }


#: Levels of the SQL's tree of cells: up to 4,096 cells a year. A deeper tree draws the same, as empty halves draw nothing.
LEVELS = 12


def tree_ctes(seed: str, reps: int, order: str = "y, code") -> dict[str, str]:
    """Replicates by splitting each one's draws down a tree over the ordered cells: binomial quantiles of portable hashes.

    Every quantile comes from a table of the whole distribution, written out by the binomial formula.
    """
    out = {
        "leaf": f"SELECT *, row_number() OVER (PARTITION BY yr ORDER BY {order})-1 AS i FROM cells",
        f"m{LEVELS}": f"SELECT yr, 0::BIGINT AS j, unnest(range({reps})) AS b, total AS m FROM (SELECT yr, sum(n)::BIGINT AS total FROM cells GROUP BY yr)",
        "nd0": "SELECT yr, i AS j, n FROM leaf",
    }
    for h in range(1, LEVELS):
        out[f"nd{h}"] = f"SELECT yr, j//2 AS j, sum(n)::BIGINT AS n FROM nd{h - 1} GROUP BY ALL"
    for h in range(LEVELS, 0, -1):
        out[f"s{h}"] = f"""SELECT m.yr, m.j, m.b, m.m, CASE WHEN r.n IS NULL THEN 1.0 ELSE l.n/(l.n+r.n)::DOUBLE END AS p,
          ph('{seed}:'||m.yr||':'||m.b||':{h}:'||m.j)/1152921504606846976.0::DOUBLE AS u FROM m{h} m JOIN nd{h - 1} l ON l.yr=m.yr AND l.j=2*m.j LEFT JOIN nd{h - 1} r ON r.yr=m.yr AND r.j=2*m.j+1"""
        out[f"c{h}"] = f"""SELECT yr, j, m, k, sum(e) OVER (PARTITION BY yr, j, m ORDER BY k)/sum(e) OVER (PARTITION BY yr, j, m) AS cdf FROM
          (SELECT *, exp(lgamma(m+1)-lgamma(k+1)-lgamma(m-k+1)+k*ln(p)+(m-k)*ln(1-p)) AS e FROM
            (SELECT *, unnest(range(greatest(0, floor(m*p-10*sqrt(m*p*(1-p))-10))::BIGINT, least(m, floor(m*p+10*sqrt(m*p*(1-p))+10)::BIGINT+1)+1)) AS k FROM
              (SELECT DISTINCT yr, j, m, p FROM s{h} WHERE p<1)))"""
        out[f"k{h}"] = f"""SELECT s.yr, s.j, s.b, s.m, c.k FROM (SELECT * FROM s{h} WHERE p<1) s ASOF JOIN c{h} c ON s.yr=c.yr AND s.j=c.j AND s.m=c.m AND s.u<c.cdf
          UNION ALL SELECT yr, j, b, m, m FROM s{h} WHERE p=1"""
        out[f"m{h - 1}"] = f"SELECT yr, 2*j AS j, b, k AS m FROM k{h} WHERE k>0 UNION ALL SELECT yr, 2*j+1, b, m-k FROM k{h} WHERE m>k"
    out["weighted"] = f"SELECT l.yr, m0.b AS rep, {', '.join('l.' + c for c in order.split(', '))}, m0.m AS w FROM m0 JOIN leaf l ON l.yr=m0.yr AND l.i=m0.j"
    return out


def f1_ctes(source: str, weight: str, keys: str, name: str) -> dict[str, str]:
    """F1 per (keys, run) from weighted cells."""
    long = f"{name}_long"
    return {
        long: f"SELECT {keys}, model, train_set, seed, y, ((code // pw) % 3)::INT AS pred, {weight} AS w FROM {source}, mem",
        name: tally(f"{keys}, model, train_set, seed", long, "w"),
    }


def boot(members, seed: str, where: str = "true", source: str = "preds", reps: int = TWIN_REPS, tree: bool = False) -> dict[str, str]:
    return {
        **cell_ctes(members, where=where, source=source), **(tree_ctes(seed, REPS) if tree else draw_ctes(seed, reps)),
        **f1_ctes("cells", "n", "yr", "pt"), **f1_ctes("weighted", "w", "yr, rep", "rp"),
    }


query(
    "JN12_align_predictions",
    "SELECT yr, item_id, y, code AS code_0, n_runs, n_runs=12 AS complete FROM aligned",
    cell_ctes(MEMBERS),
)(lambda v: B.align_predictions(v.preds, MEMBERS, ["yr"]))
query("JN12_joint_cells", "SELECT yr, y, code AS code_0, n FROM cells", cell_ctes(EARLY))(lambda v: B.joint_cells(v.preds, EARLY, ["yr"]))
query(
    "JN13_paired_subset",
    "SELECT model, train_set, seed, item_id, y, pred FROM preds WHERE item_id IN (SELECT item_id FROM zero_shot)",
)(lambda v: J.semi(v.preds.select("model", "train_set", "seed", "item_id", "y", "pred"), v.zero_shot, "item_id"))

# ---- bootstrap ----------------------------------------------------------------------------------

Q = "quantile_cont({0},0.025) AS {1}, quantile_cont({0},0.975) AS {2}"


def r8(cols: str) -> str:
    return ", ".join(f"round({c},8) AS {c}" for c in cols.split(", "))


_F1_SQL = f"""SELECT yr, model, train_set, seed, {r8("f1, lo, hi")} FROM (SELECT yr, model, train_set, seed, macro_f1 AS f1 FROM pt)
      JOIN (SELECT yr, model, train_set, seed, {Q.format("macro_f1", "lo", "hi")} FROM rp GROUP BY ALL) USING (yr, model, train_set, seed)"""
query("BO1_bootstrap_macro_f1", _F1_SQL, boot(EARLY, "42"))(lambda v: rounded(B.bootstrap_macro_f1(v.preds, EARLY, ["yr"], TWIN_REPS, 42, "hash"), "f1", "lo", "hi"))
# The default draws, all replicates. The tree in SQL takes minutes over whole prediction tables, so it is registered for the
# zero-shot items (BO5), whose number is fixed by their sample; equal draws were found for all of these at sf0.001.
query("BO1_bootstrap_macro_f1_multinomial")(
    lambda v: rounded(B.bootstrap_macro_f1(v.preds, EARLY, ["yr"], REPS, 42), "f1", "lo", "hi")
)

SLOPES = lambda col: {
    "pts": f"SELECT model, train_set, regr_slope(f, yr) AS slope, avg(f) AS level FROM (SELECT model, train_set, yr, avg({col}) AS f FROM pt GROUP BY ALL) GROUP BY ALL",
    "rps": f"SELECT model, train_set, rep, regr_slope(f, yr) AS slope, avg(f) AS level FROM (SELECT model, train_set, yr, rep, avg({col}) AS f FROM rp GROUP BY ALL) GROUP BY ALL",
}
_SLOPE_SQL = f"""SELECT model, train_set, {r8("slope, lo, hi")} FROM (SELECT model, train_set, slope FROM pts)
  JOIN (SELECT model, train_set, {Q.format("slope", "lo", "hi")} FROM rps GROUP BY ALL) USING (model, train_set)"""
query("BO2_bootstrap_slope", _SLOPE_SQL, {**boot(EARLY, "11"), **SLOPES("macro_f1")})(
    lambda v: rounded(B.bootstrap_slope(v.preds, EARLY, TWIN_REPS, 11, draws="hash"), "slope", "lo", "hi")
)
query("BO2_bootstrap_slope_neutral", _SLOPE_SQL, {**boot(EARLY, "11"), **SLOPES("f1_1")})(
    lambda v: rounded(B.bootstrap_slope(v.preds, EARLY, TWIN_REPS, 11, "f1_1", draws="hash"), "slope", "lo", "hi")
)
for _name, _value in (("BO2_bootstrap_slope_multinomial", "macro_f1"), ("BO2_bootstrap_slope_neutral_multinomial", "f1_1")):
    query(_name)(
        lambda v, value=_value: rounded(B.bootstrap_slope(v.preds, EARLY, REPS, 11, value), "slope", "lo", "hi")
    )

PAIRS = [("big/early", "small/early")]


def diff_sql(a: tuple[str, str], b: tuple[str, str]) -> str:
    on = f"a.model='{a[0]}' AND a.train_set='{a[1]}' AND b.model='{b[0]}' AND b.train_set='{b[1]}'"
    return f"""SELECT '{a[0]}/{a[1]}' AS a, '{b[0]}/{b[1]}' AS b, {r8("slope_diff, level_diff, slope_lo, slope_hi, p_neg, level_lo, level_hi")} FROM
      (SELECT a.slope-b.slope AS slope_diff, a.level-b.level AS level_diff FROM pts a, pts b WHERE {on}),
      (SELECT {Q.format("s", "slope_lo", "slope_hi")}, avg((s<0)::INT) AS p_neg, {Q.format("l", "level_lo", "level_hi")} FROM
        (SELECT a.slope-b.slope AS s, a.level-b.level AS l FROM rps a, rps b WHERE a.rep=b.rep AND {on}))"""


_DIFFS = ("slope_diff", "level_diff", "slope_lo", "slope_hi", "p_neg", "level_lo", "level_hi")
query("BO3_paired_slope_diff", diff_sql(("big", "early"), ("small", "early")), {**boot(EARLY, "11"), **SLOPES("macro_f1")})(
    lambda v: rounded(B.paired_slope_diff(v.preds, EARLY, PAIRS, TWIN_REPS, 11, draws="hash"), *_DIFFS)
)


def cluster_ctes(cluster: str, seed: int) -> dict[str, str]:
    return {
        **cell_ctes(EARLY, carry=cluster),
        "clusters": f"""SELECT yr, {cluster}, row_number() OVER (PARTITION BY yr ORDER BY ph('{seed}:'||{cluster}), {cluster})-1 AS pos
          FROM (SELECT DISTINCT yr, {cluster} FROM cells)""",
        "draws": f"""SELECT yr, b AS rep, ph('{seed}:{cluster}:'||yr||':'||b||':'||j)%total AS pos, count(*) AS m FROM (SELECT yr, total, b, unnest(range(total)) AS j
          FROM (SELECT yr, count(*) AS total, unnest(range({CLUSTER_REPS})) AS b FROM clusters GROUP BY yr)) GROUP BY ALL""",
        "weighted": f"SELECT yr, rep, y, code, sum(m*n)::BIGINT AS w FROM draws JOIN clusters USING (yr, pos) JOIN cells USING (yr, {cluster}) GROUP BY ALL",
        **f1_ctes("cells", "n", "yr", "pt"), **f1_ctes("weighted", "w", "yr, rep", "rp"), **SLOPES("macro_f1"),
    }


for _c in ("parent_asin", "user_id"):
    query(f"BO4_cluster_bootstrap_{_c}", _SLOPE_SQL, cluster_ctes(_c, 5))(
        lambda v, c=_c: rounded(B.cluster_bootstrap(v.preds, EARLY, c, CLUSTER_REPS, 5, "hash")[0], "slope", "lo", "hi")
    )
query(
    "BO4_cluster_pair_diff",
    f"""SELECT 'big/early' AS a, 'small/early' AS b, {r8("lo, hi")} FROM (SELECT {Q.format("s", "lo", "hi")} FROM
      (SELECT a.slope-b.slope AS s FROM rps a JOIN rps b USING (rep) WHERE a.model='big' AND b.model='small'))""",
    cluster_ctes("user_id", 5),
)(lambda v: rounded(B.cluster_pair_diff(B.cluster_bootstrap(v.preds, EARLY, "user_id", CLUSTER_REPS, 5, "hash")[1], PAIRS), "lo", "hi"))
query("BO4_cluster_bootstrap_multinomial")(
    lambda v: B.cluster_bootstrap(v.preds, EARLY, "parent_asin", CLUSTER_REPS, 5)[0]
)


def with_zero_shot(v):
    """Trained runs on the items the label-only run covers, plus that run itself."""
    from tidemark.functions.labels import encode_label

    cols = ["model", "train_set", "seed", "item_id", "yr", "y", "pred"]
    trained = J.semi(v.preds.filter("train_set = 'early'"), v.zero_shot, "item_id").select(*cols)
    truth = v.items.select("item_id", "y")
    zs = v.zero_shot.join(truth, "item_id").select(
        F.lit("zs").alias("model"), F.lit("none").alias("train_set"), F.lit(0).alias("seed"), "item_id", "yr", "y",
        encode_label("label").alias("pred"),
    )
    return trained.unionByName(zs)


ZS_MEMBERS = [*EARLY, ("zs", "none", 0)]
ZS = {
    "zs_preds": """SELECT model, train_set, seed, item_id, yr, y, pred FROM preds WHERE train_set='early' AND item_id IN (SELECT item_id FROM zero_shot)
      UNION ALL SELECT 'zs','none',0,item_id,yr,y,CASE label WHEN 'NEGATIVE' THEN 0 WHEN 'NEUTRAL' THEN 1 ELSE 2 END FROM zero_shot"""
}
query(
    "BO5_paired_zero_shot",
    diff_sql(("big", "early"), ("zs", "none")) + " UNION ALL " + diff_sql(("small", "early"), ("zs", "none")),
    {**ZS, **boot(ZS_MEMBERS, "7", source="zs_preds", reps=REPS), **SLOPES("macro_f1")},
)(
    lambda v: rounded(
        B.paired_slope_diff(with_zero_shot(v), ZS_MEMBERS, [("big/early", "zs/none"), ("small/early", "zs/none")], REPS, 7, draws="hash"), *_DIFFS
    )
)
_UN = "(SELECT *, unnest([{'k':'macro','v':macro_f1},{'k':'0','v':f1_0},{'k':'1','v':f1_1},{'k':'2','v':f1_2}]) AS u FROM %s)"
GAIN_MEMBERS = [(m, t, s) for m in ("big", "small") for t in ("early", "recent") for s in (42, 43, 44)]
GAINS = {
    "gp": f"""SELECT model, u.k AS cls, avg(CASE WHEN train_set='early' THEN u.v END) AS old, avg(CASE WHEN train_set='recent' THEN u.v END) AS new
      FROM {_UN % 'pt'} GROUP BY ALL""",
    "gr": f"""SELECT model, rep, u.k AS cls, avg(CASE WHEN train_set='recent' THEN u.v END)-avg(CASE WHEN train_set='early' THEN u.v END) AS gain
      FROM {_UN % 'rp'} GROUP BY ALL""",
}
_GAIN_SQL = f"""SELECT model, cls, {r8("old, new, gain, lo, hi")} FROM (SELECT *, new-old AS gain FROM gp)
      JOIN (SELECT model, cls, {Q.format("gain", "lo", "hi")} FROM gr GROUP BY ALL) USING (model, cls)"""
query(
    "BO6_retraining_gain",
    _GAIN_SQL,
    {**boot(GAIN_MEMBERS, "77", "yr IN (2000,2001)"), **GAINS},
)(
    lambda v: rounded(
        B.retraining_gain(v.preds, ["big", "small"], [42, 43, 44], [2000, 2001], TWIN_REPS, 77, draws="hash"), "old", "new", "gain", "lo", "hi"
    )
)
CONTRASTS = {"size": ("big/early", "small/early"), "small_new_vs_big_old": ("small/recent", "big/early")}
_CT = " UNION ALL ".join(
    f"""SELECT '{k}' AS contrast, {r8("diff, lo, hi")} FROM (SELECT a.f-b.f AS diff FROM cp a, cp b WHERE a.who='{x}' AND b.who='{y}'),
    (SELECT {Q.format("d", "lo", "hi")} FROM (SELECT a.f-b.f AS d FROM cr a JOIN cr b USING (rep) WHERE a.who='{x}' AND b.who='{y}'))"""
    for k, (x, y) in CONTRASTS.items()
)
_CONTRAST = {
    "cp": "SELECT model||'/'||train_set AS who, avg(macro_f1) AS f FROM pt GROUP BY ALL",
    "cr": "SELECT model||'/'||train_set AS who, rep, avg(macro_f1) AS f FROM rp GROUP BY ALL",
}
query(
    "BO6_gain_contrast",
    _CT,
    {**boot(MEMBERS, "77", "yr IN (2000,2001)"), **_CONTRAST},
)(lambda v: rounded(B.gain_contrast(v.preds, CONTRASTS, MEMBERS, [2000, 2001], TWIN_REPS, 77, draws="hash"), "diff", "lo", "hi"))

query("BO6_gain_contrast_multinomial")(
    lambda v: rounded(B.gain_contrast(v.preds, CONTRASTS, MEMBERS, [2000, 2001], REPS, 77), "diff", "lo", "hi")
)
_SERIES_SQL = f"""SELECT yr, model, train_set, {r8("macro, lo, hi, neu")} FROM (SELECT yr, model, train_set, avg(macro_f1) AS macro, avg(f1_1) AS neu FROM pt GROUP BY ALL)
  JOIN (SELECT yr, model, train_set, {Q.format("f", "lo", "hi")} FROM (SELECT yr, model, train_set, rep, avg(macro_f1) AS f FROM rp GROUP BY ALL) GROUP BY ALL)
  USING (yr, model, train_set)"""
query("BO3_paired_slope_diff_multinomial")(
    lambda v: rounded(B.paired_slope_diff(v.preds, EARLY, PAIRS, REPS, 11), *_DIFFS)
)
query(
    "BO5_paired_zero_shot_multinomial",
    diff_sql(("big", "early"), ("zs", "none")) + " UNION ALL " + diff_sql(("small", "early"), ("zs", "none")),
    {**ZS, **boot(ZS_MEMBERS, "7", source="zs_preds", tree=True), **SLOPES("macro_f1")},
)(lambda v: rounded(B.paired_slope_diff(with_zero_shot(v), ZS_MEMBERS, [("big/early", "zs/none"), ("small/early", "zs/none")], REPS, 7), *_DIFFS))
query("BO6_retraining_gain_multinomial")(
    lambda v: rounded(B.retraining_gain(v.preds, ["big", "small"], [42, 43, 44], [2000, 2001], REPS, 77), "old", "new", "gain", "lo", "hi")
)
query("DR11_figure_series_multinomial")(
    lambda v: rounded(D.figure_series(v.preds, EARLY, REPS, 11), "macro", "lo", "hi", "neu")
)

# ---- drift ----------------------------------------------------------------------------------------

SLOPE = """SELECT model, train_set, {0} FROM (SELECT model, train_set, regr_slope(f,yr) AS slope, regr_slope(f,yr)/arg_min(f,yr) AS rel_slope
  FROM (SELECT model, train_set, yr, avg(macro_f1) AS f FROM {1} GROUP BY ALL) GROUP BY ALL)"""
query("DR1_yearly_slope", SLOPE.format(r8("slope, rel_slope"), "f1_runs"))(lambda v: rounded(D.model_slopes(v.preds), "slope", "rel_slope"))
query(
    "DR2_per_seed_slopes",
    f"""SELECT model, train_set, seed, {r8("slope, mean, sd")} FROM (SELECT *, avg(slope) OVER w AS mean, stddev_samp(slope) OVER w AS sd FROM
      (SELECT model, train_set, seed, regr_slope(macro_f1,yr) AS slope FROM f1_runs GROUP BY ALL) WINDOW w AS (PARTITION BY model, train_set))""",
)(lambda v: rounded(D.per_seed_slopes(v.preds), "slope", "mean", "sd"))
query("DR3_drop_period", SLOPE.format(r8("slope, rel_slope"), "(SELECT * FROM f1_runs WHERE yr<>2001)"))(
    lambda v: rounded(D.drop_period(v.preds, [2001]), "slope", "rel_slope")
)
_TWO = tally(RUN4, "(SELECT * FROM preds WHERE y<>1)", classes=(0, 2), pred="(CASE WHEN p_neg>p_pos THEN 0 ELSE 2 END)")
query("DR4_binary_task_f1", f"SELECT {RUN4}, f1_0, f1_2, macro_f1 FROM ({_TWO})")(lambda v: D.binary_task(v.preds)[0])
query("DR4_binary_task_slope", SLOPE.format(r8("slope, rel_slope"), f"({_TWO})"))(
    lambda v: rounded(D.binary_task(v.preds)[1], "slope", "rel_slope")
)
query(
    "DR5_month_mix",
    """SELECT yr, count(*) n, avg((month<=9)::INT) AS kept_share, sum((month<=9 AND y=0)::INT)/sum((month<=9)::INT) AS neg,
      sum((month<=9 AND y=1)::INT)/sum((month<=9)::INT) AS neu, sum((month<=9 AND y=2)::INT)/sum((month<=9)::INT) AS pos FROM pool GROUP BY yr""",
)(lambda v: D.month_mix(v.items))
query(
    "DR5_month_matched_slopes",
    f"""SELECT a.model, a.train_set, round(a.slope,8) AS slope_all, round(b.slope,8) AS slope_matched FROM ({SLOPE.format("slope", "f1_runs")}) a
      JOIN ({SLOPE.format("slope", "(" + tally(RUN4, "(SELECT * FROM preds WHERE month<=9)") + ")")}) b USING (model, train_set)""",
)(lambda v: rounded(D.month_matched_slopes(v.preds), "slope_all", "slope_matched"))
# Both decodings of every run in one code, and the flag of the first months: one set of draws for all robustness runs.
_TWICE = [(*m, d) for m in EARLY for d in (0, 1)]
_ROBUST = {
    "mem": "SELECT * FROM (VALUES " + ", ".join(f"('{m}','{t}',{s},{d},{i},{3**i}::BIGINT)" for i, (m, t, s, d) in enumerate(_TWICE)) + ") x(model,train_set,seed,d,i,pw)",
    "aligned": """SELECT yr, item_id, min(y) AS y, sum(pw*CASE WHEN d=0 THEN pred WHEN p_neg>p_pos THEN 0 ELSE 2 END)::BIGINT AS code, min((month<=9)::INT) AS f
      FROM preds JOIN mem USING (model, train_set, seed) GROUP BY yr, item_id""",
    "cells": "SELECT yr, y, code, f, count(*) AS n FROM aligned GROUP BY ALL",
    "ranged": "SELECT *, hi-n AS lo FROM (SELECT *, (sum(n) OVER (PARTITION BY yr ORDER BY y, code, f))::BIGINT AS hi FROM cells)",
    "totals": "SELECT yr, sum(n)::BIGINT AS total FROM cells GROUP BY yr",
    "draws": f"""SELECT yr, b, ph('13:'||yr||':'||b||':'||j)%total AS pos FROM (SELECT yr, total, b, unnest(range(total)) AS j
      FROM (SELECT yr, total, unnest(range({TWIN_REPS})) AS b FROM totals))""",
    "weighted": "SELECT d.yr, d.b AS rep, r.y, r.code, r.f, count(*) AS w FROM draws d ASOF JOIN ranged r ON d.yr=r.yr AND d.pos>=r.lo GROUP BY ALL",
    "allcells": "SELECT yr, -1 AS rep, y, code, f, n AS w FROM cells UNION ALL SELECT yr, rep, y, code, f, w FROM weighted",
    "told": "SELECT yr, rep, model, train_set, seed, d, y, f, w, ((code // pw) % 3)::INT AS pred FROM allcells, mem",
    "robust": "SELECT variant, model, train_set, rep, regr_slope(v, yr) AS slope FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS variant, model, train_set, yr, rep, avg(macro_f1) AS v FROM ({tally('model, train_set, seed, yr, rep', f'(SELECT * FROM told WHERE {keep})', 'w', classes)}) GROUP BY ALL"
        for name, keep, classes in (
            ("all", "d=0", (0, 1, 2)), ("dropped", "d=0 AND yr<>2001", (0, 1, 2)), ("binary", "d=1 AND y<>1", (0, 2)), ("months", "d=0 AND f=1", (0, 1, 2)),
        )
    ) + ") GROUP BY ALL",
}
_ROBUST_SLOPE = f"""SELECT variant, model, train_set, {r8("slope, lo, hi")} FROM (SELECT variant, model, train_set, slope FROM robust WHERE rep<0)
  JOIN (SELECT variant, model, train_set, {Q.format("slope", "lo", "hi")} FROM robust WHERE rep>=0 GROUP BY ALL) USING (variant, model, train_set) WHERE variant IN ({{0}})"""
_ROBUST_DIFF = f"""SELECT variant, 'big/early' AS a, 'small/early' AS b, {r8("slope_diff, lo, hi")} FROM
  (SELECT variant, slope AS slope_diff FROM rdiff WHERE rep<0) JOIN (SELECT variant, {Q.format("slope", "lo", "hi")} FROM rdiff WHERE rep>=0 GROUP BY 1) USING (variant)"""


def robust(v, B: int, draws: str):
    return D.robustness(v.preds, EARLY, PAIRS, [2001], B, 13, draws=draws)


for _name, _kinds in (("DR3_drop_period_interval", ("all", "dropped")), ("DR4_binary_task_interval", ("binary",)), ("DR5_month_matched_interval", ("all", "months"))):
    query(_name, _ROBUST_SLOPE.format(", ".join(f"'{k}'" for k in _kinds)), _ROBUST)(
        lambda v, kinds=_kinds: rounded(robust(v, TWIN_REPS, "hash")[0].filter(F.col("variant").isin(*kinds)), "slope", "lo", "hi")
    )
query(
    "DR3_robustness_diffs", _ROBUST_DIFF,
    {**_ROBUST, "rdiff": "SELECT a.variant, a.rep, a.slope-b.slope AS slope FROM robust a JOIN robust b USING (variant, rep) WHERE a.model='big' AND b.model='small'"},
)(lambda v: rounded(robust(v, TWIN_REPS, "hash")[1], "slope_diff", "lo", "hi"))
query("DR3_robustness_multinomial")(
    lambda v: rounded(robust(v, REPS, "tree")[0], "slope", "lo", "hi")
)
MIX = {
    "items": """SELECT p.yr, COALESCE(c.cat_l1,'(none)') AS cat_l1, p.item_id FROM pool p LEFT JOIN cats c ON c.parent_asin=p.parent_asin WHERE p.yr>=1997""",
    "mixw": """SELECT a.yr, a.cat_l1, COALESCE(b.share,0)/a.share AS w FROM (SELECT yr, cat_l1, count(*)/sum(count(*)) OVER (PARTITION BY yr) AS share FROM items GROUP BY 1,2) a
      LEFT JOIN (SELECT yr, cat_l1, count(*)/sum(count(*)) OVER (PARTITION BY yr) AS share FROM items GROUP BY 1,2) b ON b.cat_l1=a.cat_l1 AND b.yr=1997""",
    "wpreds": "SELECT p.*, w FROM preds p JOIN items i ON i.item_id=p.item_id JOIN mixw m ON m.yr=i.yr AND m.cat_l1=i.cat_l1",
    "mix": f"""SELECT model, train_set, yr, avg(a.macro_f1) AS raw, avg(b.macro_f1) AS reweighted FROM ({tally(RUN4, "wpreds")}) a
      JOIN ({tally(RUN4, "wpreds", "w")}) b USING ({RUN4}) GROUP BY ALL""",
}


def mix(v):
    return D.mix_reweighted_f1(v.preds_by_item, v.items.filter("yr >= 1997"), v.meta, 1997, v.run_columns)


query("DR6_mix_reweighted_f1", f"SELECT model, train_set, yr, {r8('raw, reweighted')} FROM mix", MIX)(lambda v: rounded(mix(v), "raw", "reweighted"))
query(
    "DR6_mix_reweighted_slopes",
    "SELECT model, train_set, round(regr_slope(raw,yr),8) AS raw_slope, round(regr_slope(reweighted,yr),8) AS reweighted_slope FROM mix GROUP BY ALL",
    MIX,
)(lambda v: rounded(D.mix_reweighted_slopes(mix(v)), "raw_slope", "reweighted_slope"))
query(
    "DR7_recovery_share",
    f"""SELECT model, {r8("old_base, old_late, new_late, loss, recovered")} FROM (SELECT *, old_late-old_base AS loss, (new_late-old_late)/(old_base-old_late) AS recovered FROM (
      SELECT model, avg(CASE WHEN train_set='early' AND yr=1997 THEN f END) AS old_base, avg(CASE WHEN train_set='early' AND yr>=2000 THEN f END) AS old_late,
      avg(CASE WHEN train_set='recent' AND yr>=2000 THEN f END) AS new_late FROM (SELECT model, train_set, yr, avg(macro_f1) AS f FROM f1_runs GROUP BY ALL) GROUP BY model))""",
)(
    lambda v: rounded(
        D.recovery_share(M.class_f1(v.preds, RUN4.split(", ")), 1997, [2000, 2001]), "old_base", "old_late", "new_late", "loss", "recovered"
    )
)
query(
    "DR9_seed_vote_share",
    "SELECT model, train_set, item_id, avg((pred=0)::INT) share_neg, avg((pred=1)::INT) share_neu, avg((pred=2)::INT) share_pos FROM preds GROUP BY ALL",
)(lambda v: D.seed_vote_share(v.preds, ["model", "train_set", "item_id"]))
query(
    "DR11_figure_series",
    _SERIES_SQL,
    boot(EARLY, "11"),
)(lambda v: rounded(D.figure_series(v.preds, EARLY, TWIN_REPS, 11, "hash"), "macro", "lo", "hi", "neu"))
query(
    "DR11_zero_shot_series",
    f"""SELECT model, train_set, yr, {r8("macro_f1")} FROM (SELECT model, train_set, yr, avg(macro_f1) AS macro_f1 FROM ({tally(RUN4, "zs_preds")}) GROUP BY ALL)""",
    ZS,
)(
    lambda v: rounded(
        D.seed_averaged(M.class_f1(with_zero_shot(v), RUN4.split(", ")), ["model", "train_set", "yr"]), "macro_f1"
    )
)
