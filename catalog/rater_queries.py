"""Rater agreement, gold labels, trend regressions and shift-share."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fitsql
from catalog.registry import query, rounded
from catalog.sqlviews import VIEWS
from tidemark.functions import labels as L
from tidemark.functions import text as X
from tidemark.operators import drift as D
from tidemark.operators import raters as R
from tidemark.operators import stats as ST

RATERS = ("rater_a", "rater_b", "rater_c")
LABELS = ("POSITIVE", "NEGATIVE", "MIXED", "NEUTRAL", "UNCLEAR")


def complete(v):
    return R.complete_cases(v.raters, 3)


def voted(v):
    return v.rated_items.join(R.majority_vote(complete(v)), "item_id")


PAIRS = """SELECT a.item_id, a.rater AS a, b.rater AS b, a.label AS la, b.label AS lb FROM {0} a JOIN {0} b ON a.item_id=b.item_id AND a.rater<b.rater"""


def kappa_sql(keys: str, source: str) -> str:
    """Observed and chance agreement per group of (la, lb) pairs."""
    return f"""SELECT {keys}, n, round(po,8) AS agreement, round((po-pe)/(1-pe),8) AS kappa FROM
      (SELECT {keys}, count(*) AS n, avg((la=lb)::INT) AS po FROM {source} GROUP BY ALL) JOIN
      (SELECT {keys}, sum(pa*pb) AS pe FROM (SELECT {keys}, la AS l, count(*)/sum(count(*)) OVER (PARTITION BY {keys}) AS pa FROM {source} GROUP BY {keys}, la)
        JOIN (SELECT {keys}, lb AS l, count(*)/sum(count(*)) OVER (PARTITION BY {keys}) AS pb FROM {source} GROUP BY {keys}, lb) USING ({keys}, l) GROUP BY ALL)
      USING ({keys})"""


query("AN1_cohen_kappa", kappa_sql("a, b", "pr"), {"pr": PAIRS.format("complete")})(
    lambda v: rounded(R.cohen_kappa(complete(v), RATERS), "agreement", "kappa")
)
query(
    "AN1_cohen_kappa_by_period",
    kappa_sql("period, a, b", "pr"),
    {"pr": f"SELECT p.*, period FROM ({PAIRS.format('complete')}) p JOIN rated_items USING (item_id) WHERE period IS NOT NULL"},
)(
    lambda v: rounded(
        R.cohen_kappa(complete(v).join(v.rated_items.filter("period IS NOT NULL").select("item_id", "period"), "item_id"), RATERS, ["period"]),
        "agreement", "kappa",
    )
)
query(
    "AN2_fleiss_kappa",
    """SELECT n_items, round((pb-pe)/(1-pe),8) AS kappa FROM
      (SELECT count(*) AS n_items, avg(p) AS pb FROM (SELECT item_id, (sum(c*c)-3)/6 AS p FROM (SELECT item_id, label, count(*) c FROM complete GROUP BY ALL) GROUP BY 1)),
      (SELECT sum(s*s) AS pe FROM (SELECT count(*)/sum(count(*)) OVER () AS s FROM complete GROUP BY label))""",
)(lambda v: rounded(R.fleiss_kappa(complete(v)), "kappa"))
query("AN3_majority_vote", "SELECT item_id, majority, unanimous FROM votes")(lambda v: R.majority_vote(complete(v)))
query(
    "AN3_single_rater",
    "SELECT item_id, label AS majority, true AS unanimous FROM raters WHERE rater='rater_b'",
)(lambda v: R.majority_vote(v.raters.filter("rater = 'rater_b'")))
_EN = """SELECT doc_id AS item_id FROM documents WHERE lang='fr'"""
query("AN4_complete_cases", f"SELECT item_id, rater, label FROM complete WHERE item_id NOT IN ({_EN})")(
    lambda v: R.complete_cases(v.raters, 3, v.table("documents").filter("lang = 'fr'").select(F.col("doc_id").alias("item_id")))
)
_ALL = "SELECT item_id, rater, label FROM complete UNION ALL SELECT item_id, 'majority', majority FROM votes"
_GOLD = f"SELECT rater AS a, label AS la, gold AS lb, 'g' AS b FROM ({_ALL}) JOIN rated_items USING (item_id)"
_REC = ", ".join(f"sum((lb='{g}' AND la='{g}')::INT)/greatest(sum((lb='{g}')::INT),1) AS \"recall_{g}\"" for g in LABELS[:4])
query(
    "AN5_gold_accuracy",
    f"""SELECT k.a AS rater, k.n, agreement AS accuracy, kappa, {', '.join(f'"recall_{g}"' for g in LABELS[:4])}
      FROM ({kappa_sql('a, b', 'pr')}) k JOIN (SELECT a, {_REC} FROM pr GROUP BY a) r ON r.a=k.a""",
    {"pr": _GOLD},
)(lambda v: rounded(R.gold_accuracy(complete(v), v.rated_items), "accuracy", "kappa"))
_ALLLAB = ", ".join(f"('{x}')" for x in (*LABELS, "NO_MAJORITY"))
query(
    "AN5_gold_confusion",
    f"""SELECT k.rater, g.l AS gold, p.l AS label, count(pr.a) AS n FROM (VALUES ('rater_a'),('rater_b'),('rater_c'),('majority')) k(rater),
      (SELECT * FROM (VALUES {_ALLLAB}) t(l) WHERE l<>'NO_MAJORITY') g, (VALUES {_ALLLAB}) p(l)
      LEFT JOIN pr ON pr.a=k.rater AND pr.lb=g.l AND pr.la=p.l GROUP BY ALL""",
    {"pr": _GOLD},
)(lambda v: R.gold_confusion(complete(v), v.rated_items))
_AGREE = """SELECT item_id FROM complete WHERE rater IN ('rater_a','rater_b') GROUP BY item_id HAVING count(DISTINCT label)=1"""
query(
    "AN6_agreement_subsets",
    kappa_sql("a, b", "pr"),
    {"pr": f"SELECT * FROM ({PAIRS.format('complete')}) WHERE item_id IN ({_AGREE})"},
)(
    lambda v: rounded(
        R.cohen_kappa(
            complete(v).join(
                complete(v).filter(F.col("rater").isin("rater_a", "rater_b")).groupBy("item_id")
                .agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x = y").select("item_id"),
                "item_id", "left_semi",
            ),
            RATERS,
        ),
        "agreement", "kappa",
    )
)

_UNSURE = "item_id IN (SELECT item_id FROM complete GROUP BY item_id HAVING bool_or(label='UNCLEAR'))"
_SUBSETS = {
    "a and b agree": f"item_id IN ({_AGREE})",
    "none is unsure": f"NOT {_UNSURE}",
    "early": "item_id IN (SELECT item_id FROM rated_items WHERE period='early')",
    "late and none is unsure": f"item_id IN (SELECT item_id FROM rated_items WHERE period='late') AND NOT {_UNSURE}",
}
query(
    "AN6_agreement_by_subset",
    kappa_sql("subset, a, b", "pr"),
    {"pr": " UNION ALL ".join(f"SELECT '{name}' AS subset, * FROM ({PAIRS.format('complete')}) WHERE {keep}" for name, keep in _SUBSETS.items())},
)(
    lambda v: rounded(
        R.agreement_subsets(
            complete(v),
            RATERS,
            {
                "a and b agree": F.col("rater_a") == F.col("rater_b"),
                "none is unsure": ~F.array_contains(F.array(*RATERS), "UNCLEAR"),
                "early": F.col("period") == "early",
                "late and none is unsure": (F.col("period") == "late") & ~F.array_contains(F.array(*RATERS), "UNCLEAR"),
            },
            v.rated_items.select("item_id", "period"),
        ),
        "agreement", "kappa",
    )
)

# ---- trends ---------------------------------------------------------------------------------------

query(
    "ST1_collapse_rare",
    """SELECT item_id, CASE WHEN cat_l1 IN (SELECT cat_l1 FROM rated_items GROUP BY 1 HAVING count(*)>=50) THEN cat_l1 ELSE '(other)' END AS cat FROM rated_items""",
)(lambda v: ST.collapse_rare(v.rated_items.select("item_id", "cat_l1"), "cat_l1", 50).select("item_id", "cat"))


def three_star(v, star: int = 3):
    t = ST.collapse_rare(voted(v).filter(F.col("rating_star") == star), "cat_l1", 17)
    neg = (F.col("majority") == "NEGATIVE").cast("int")
    return t.select(
        "item_id", "majority", "cat", "text_len", "yr", "period",
        (F.col("yr") - 2013).alias("yc"), neg.alias("neg"), (F.col("majority") == "MIXED").cast("int").alias("mix"),
        F.log("text_len").alias("loglen"), L.flag("verified").alias("ver"), F.log1p("helpful_vote").alias("loghelp"),
    )


query(
    "ST2_binary_period_logit",
    """SELECT n, share_0, share_1, round(b,8) AS b, round(se,8) AS se, round(exp(b),8) AS odds_ratio, round(exp(b-1.959963984540054*se),8) AS lo,
      round(exp(b+1.959963984540054*se),8) AS hi FROM (SELECT n, c/(c+d) AS share_0, a/(a+bb) AS share_1, ln(a*d/(bb*c)) AS b, sqrt(1/a+1/bb+1/c+1/d) AS se FROM
      (SELECT count(*) AS n, sum((majority='NEGATIVE' AND period='late')::INT)::DOUBLE AS a, sum((majority<>'NEGATIVE' AND period='late')::INT)::DOUBLE AS bb,
        sum((majority='NEGATIVE' AND period='early')::INT)::DOUBLE AS c, sum((majority<>'NEGATIVE' AND period='early')::INT)::DOUBLE AS d
        FROM voted WHERE rating_star=3 AND period IS NOT NULL))""",
)(
    lambda v: rounded(
        ST.binary_logit(
            three_star(v).filter("period IS NOT NULL").withColumn("late", (F.col("period") == "late").cast("int")), "neg", "late"
        ),
        "b", "se", "odds_ratio", "lo", "hi",
    )
)
_CAT = "CASE WHEN cat_l1 IN (SELECT cat_l1 FROM voted WHERE rating_star={0} GROUP BY 1 HAVING count(*)>=17) THEN cat_l1 ELSE '(other)' END"
_FIT = ("b", "se", "odds_ratio", "lo", "hi", "p")
_X = {"yc": "(yr-2013)::DOUBLE", "loglen": "ln(text_len)", "ver": "(lower(verified)='true')::INT::DOUBLE", "loghelp": "ln(1+helpful_vote)"}


def fit_rows(x: list[str], cat: bool, star: int = 3, g: str = "0", y: str = "(majority='NEGATIVE')::INT", source: str = "voted", keep: str = "true") -> str:
    """Rows of a fit: group, level, outcome, covariates."""
    level = _CAT.format(star) if cat else "''"
    return f"SELECT {g} AS g, {level} AS lvl, {y} AS y, {', '.join(f'{_X[c]} AS x{i}' for i, c in enumerate(x))} FROM {source} WHERE rating_star={star} AND {keep}"


def fit_query(name: str, rows: str, x: list[str], cat: bool, fit, group: str | None = None, where: str = "true", group_cols: str = "g") -> None:
    final, parts = fitsql.logit(rows, len(x), x, "cat" if cat else None)
    shown = f"{group_cols} AS {group}, " if group else ""
    query(name, f"SELECT {shown}term, {', '.join(_FIT)} FROM ({final}) WHERE {where}", parts)(lambda v: rounded(fit(v), *_FIT, digits=6))


fit_query("ST2_logit_trend", fit_rows(["yc"], False), ["yc"], False, lambda v: ST.logit_trend(three_star(v), "neg", ["yc"]))
fit_query("ST2_logit_trend_category", fit_rows(["yc"], True), ["yc"], True, lambda v: ST.logit_trend(three_star(v), "neg", ["yc"], "cat"))
_CONTROLS = ["yc", "loglen", "ver", "loghelp"]
fit_query("ST2_logit_trend_controls", fit_rows(_CONTROLS, True), _CONTROLS, True, lambda v: ST.logit_trend(three_star(v), "neg", _CONTROLS, "cat"))
_CEN = """(SELECT *, x-avg(x) OVER () AS dx, y-avg(y) OVER () AS dy FROM (SELECT (yr-2013)::DOUBLE AS x, (majority='NEGATIVE')::INT::DOUBLE AS y FROM voted WHERE rating_star=3))"""
query(
    "ST3_lpm_hc1_single",
    f"""SELECT n, round(b,8) AS b, round(sqrt(n/(n-2)*meat/(sxx*sxx)),8) AS se_hc1 FROM (SELECT any_value(n)::DOUBLE AS n, any_value(b) AS b, any_value(sxx) AS sxx, sum(dx*dx*(dy-b*dx)*(dy-b*dx)) AS meat FROM
      {_CEN}, (SELECT count(*) AS n, sum(dx*dy)/sum(dx*dx) AS b, sum(dx*dx) AS sxx FROM {_CEN}))""",
)(lambda v: rounded(ST.lpm_hc1_single(three_star(v), "neg", "yc"), "b", "se_hc1"))
_OLS, _OLS_PARTS = fitsql.ols_hc1(fit_rows(["yc"], True), 1, ["yc"], "cat")
query("ST3_lpm_hc1_category", f"SELECT term, b, se_hc1, p FROM ({_OLS})", _OLS_PARTS)(
    lambda v: rounded(ST.lpm_hc1(three_star(v), "neg", ["yc"], "cat"), "b", "se_hc1", "p", digits=6)
)
_BINS = """(SELECT v.*, CASE WHEN text_len<=c[1] THEN 'short' WHEN text_len<=c[2] THEN 'medium' ELSE 'long' END AS bin FROM voted v,
  (SELECT quantile_cont(text_len, [1/3, 2/3]) AS c FROM voted WHERE rating_star=3))"""
fit_query(
    "ST4_tertile_trends", fit_rows(["yc"], False, g="bin", source=_BINS), ["yc"], False,
    lambda v: ST.stratified_trend(ST.quantile_bins(three_star(v), "text_len"), "bin", ["short", "medium", "long"], "neg", ["yc"]), "stratum",
)
fit_query("ST4_four_star_trend", fit_rows(["yc", "loglen"], True, 4), ["yc", "loglen"], True, lambda v: ST.logit_trend(three_star(v, 4), "neg", ["yc", "loglen"], "cat"))
query(
    "ST5_linear_trend",
    """SELECT rating_star, n, round(slope,8) AS slope, round(se,8) AS se, round(slope/se,8) AS t FROM (SELECT rating_star, count(*) AS n, regr_slope(y,x) AS slope,
      sqrt((regr_syy(y,x)-regr_slope(y,x)*regr_sxy(y,x))/(count(*)-2)/regr_sxx(y,x)) AS se FROM (SELECT rating_star, yr::DOUBLE AS x, (majority='NEGATIVE')::INT::DOUBLE AS y FROM voted) GROUP BY 1)""",
)(
    lambda v: rounded(
        ST.linear_trend(voted(v).withColumn("neg", (F.col("majority") == "NEGATIVE").cast("int")), ["rating_star"], "yr", "neg"), "slope", "se", "t"
    )
)
query("ST5_linear_trend_p")(
    lambda v: ST.linear_trend_p(voted(v).withColumn("neg", (F.col("majority") == "NEGATIVE").cast("int")), ["rating_star"], "yr", "neg")
)
query("ST6_negative_share", "SELECT rating_star, yr, count(*) n, avg((majority='NEGATIVE')::INT) AS share FROM voted GROUP BY 1, 2")(
    lambda v: ST.negative_share_by_year_star(voted(v))
)
_VARIANTS = {
    "negative": ("true", "majority='NEGATIVE'"),
    "neutral": ("true", "majority='NEUTRAL'"),
    "neutral_or_mixed": ("true", "majority IN ('NEUTRAL','MIXED')"),
    "negative_without_unclear": ("majority NOT IN ('NO_MAJORITY','UNCLEAR')", "majority='NEGATIVE'"),
}
fit_query(
    "ST7_sensitivity_set",
    " UNION ALL ".join(fit_rows(["yc"], True, g=f"'{name}'", y=f"({y})::INT", keep=keep) for name, (keep, y) in _VARIANTS.items()),
    ["yc"], True,
    lambda v: ST.sensitivity_set(three_star(v), {name: (None if keep == "true" else F.expr(keep), F.expr(y)) for name, (keep, y) in _VARIANTS.items()}, ["yc"], "cat"),
    "variant", "term='yc'",
)

# ---- shift-share -------------------------------------------------------------------------------

_VOTE = "ph(s||':'||item_id)%3"
VIEWS["item_votes"] = f"""
SELECT item_id, avg((p=0)::INT) AS share_neg, avg((p=1)::INT) AS share_neu, avg((p=2)::INT) AS share_pos
FROM (SELECT item_id, CASE WHEN base='NEGATIVE' AND ph('p'||s||':'||item_id)%10<6 THEN 0 ELSE {_VOTE} END AS p
  FROM rated_items, (VALUES (42),(43),(44)) t(s)) GROUP BY item_id"""
VIEWS["period_items"] = """
SELECT period, CASE WHEN majority IN ('NEGATIVE','MIXED','NEUTRAL','POSITIVE') THEN majority ELSE 'OTHER' END AS label, share_neg, share_neu, share_pos
FROM voted JOIN item_votes USING (item_id) WHERE period IS NOT NULL"""
_TERMS = "r_early, r_late, total, composition, within, interaction"


def period_items(v):
    """Rated items with the share of three seeds that predict each class, and a folded text label."""
    from tidemark.plans.views import mod, pre

    seeded = v.rated_items.select("item_id", "base", F.explode(F.array(F.lit(42), F.lit(43), F.lit(44))).alias("seed"))
    k = F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("item_id").cast("string"))
    p = F.when((F.col("base") == "NEGATIVE") & (mod(pre("p", k), 10) < 6), 0).otherwise(mod(k, 3))
    votes = D.seed_vote_share(seeded.withColumn("pred", p.cast("int")))
    items = voted(v).filter("period IS NOT NULL").join(votes, "item_id")
    label = F.when(F.col("majority").isin("NEGATIVE", "MIXED", "NEUTRAL", "POSITIVE"), F.col("majority")).otherwise("OTHER")
    return items.select("period", label.alias("label"), "share_neg", "share_neu", "share_pos")


def ss_sql(keys: str, source: str, w: str) -> str:
    k, part = (f"{keys},", f"PARTITION BY {keys}") if keys else ("", "")
    return f"""SELECT {k} sum(we*re) AS r_early, sum(wl*rl) AS r_late, sum(wl*rl)-sum(we*re) AS total, sum((wl-we)*re) AS composition,
      sum(we*(rl-re)) AS within, sum((wl-we)*(rl-re)) AS interaction FROM (SELECT {k} ne/sum(ne) OVER ({part}) AS we, nl/sum(nl) OVER ({part}) AS wl,
        CASE WHEN ne>0 THEN se/ne ELSE 0 END AS re, CASE WHEN nl>0 THEN sl/nl ELSE 0 END AS rl FROM (SELECT {k} label,
        sum(CASE WHEN period='early' THEN {w} ELSE 0 END)::DOUBLE AS ne, sum(CASE WHEN period='late' THEN {w} ELSE 0 END)::DOUBLE AS nl,
        sum(CASE WHEN period='early' THEN {w}*share_neu ELSE 0 END) AS se, sum(CASE WHEN period='late' THEN {w}*share_neu ELSE 0 END) AS sl
        FROM {source} GROUP BY {k} label)) {'GROUP BY ' + keys if keys else ''}"""


query("DR8_shift_share", f"SELECT {', '.join(f'round({t},8) AS {t}' for t in _TERMS.split(', '))} FROM ({ss_sql('', 'period_items', '1')})")(
    lambda v: rounded(D.shift_share(period_items(v)), *_TERMS.split(", "))
)
_REPS = 1000
_LONG = "unnest([{t: 'r_early', v: r_early}, {t: 'r_late', v: r_late}, {t: 'total', v: total}, {t: 'composition', v: composition}, {t: 'within', v: within}, {t: 'interaction', v: interaction}])"
query(
    "BO7_shift_share_bootstrap",
    f"""SELECT term, round(estimate,8) AS estimate, round(lo,8) AS lo, round(hi,8) AS hi FROM (SELECT u.t AS term, u.v AS estimate FROM (SELECT {_LONG} AS u FROM ({ss_sql('', 'sc', 'n')})))
      JOIN (SELECT u.t AS term, quantile_cont(u.v,0.025) AS lo, quantile_cont(u.v,0.975) AS hi FROM (SELECT {_LONG} AS u FROM ({ss_sql('rep', 'sw', 'w')})) GROUP BY 1) USING (term)""",
    {
        "sc": "SELECT period, label, share_neu, count(*) AS n FROM period_items GROUP BY ALL",
        "sr": "SELECT *, hi-n AS lo FROM (SELECT *, (sum(n) OVER (PARTITION BY period ORDER BY label, share_neu))::BIGINT AS hi FROM sc)",
        "sd": f"""SELECT period, b, ph('11:'||period||':'||b||':'||j)%total AS pos FROM (SELECT period, total, b, unnest(range(total)) AS j FROM
          (SELECT period, sum(n)::BIGINT AS total, unnest(range({_REPS})) AS b FROM sc GROUP BY period))""",
        "sw": "SELECT d.period, d.b AS rep, r.label, r.share_neu, count(*) AS w FROM sd d ASOF JOIN sr r ON d.period=r.period AND d.pos>=r.lo GROUP BY ALL",
    },
)(lambda v: rounded(D.shift_share_bootstrap(period_items(v), _REPS, 11, draws="hash"), "estimate", "lo", "hi"))
query("BO7_shift_share_bootstrap_multinomial")(lambda v: D.shift_share_bootstrap(period_items(v), _REPS, 11))
query(
    "DR10_pred_dist_given_text",
    """SELECT period, count(*) n, round(avg(share_neg),8) AS share_neg, round(avg(share_neu),8) AS share_neu, round(avg(share_pos),8) AS share_pos
      FROM period_items WHERE label='NEGATIVE' GROUP BY period""",
)(lambda v: rounded(D.pred_dist_given_text(period_items(v), "NEGATIVE"), "share_neg", "share_neu", "share_pos"))
