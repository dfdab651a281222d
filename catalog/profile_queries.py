"""Scalar functions, profiles, duplicates and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.sqlviews import LOOSE, TEXT_HASH
from tidemark.functions import keys as K
from tidemark.functions import labels as L
from tidemark.functions import text as X
from tidemark.functions import time as TM
from tidemark.operators import duplicates as D
from tidemark.operators import joins as J
from tidemark.operators import profile as P

# ---- projections, filters, scalar functions ------------------------------------------------

query("PR1_project_rename", "SELECT item_key, rating, ts AS event_ms, helpful_vote FROM reviews")(
    lambda v: v.reviews.select("item_key", "rating", F.col("ts").alias("event_ms"), "helpful_vote")
)
query(
    "PR2_null_defaults",
    """SELECT item_key, COALESCE(text,'') AS text, COALESCE(NULLIF(text,''),'(none)') AS text_or_none, n_images FROM reviews""",
)(
    lambda v: v.reviews.select(
        "item_key",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.nullif("text", F.lit("")), F.lit("(none)")).alias("text_or_none"),
        "n_images",
    )
)
query("PR3_text_hash", f"SELECT doc_id, {TEXT_HASH} AS text_hash FROM documents")(
    lambda v: v.table("documents").select("doc_id", X.text_hash("text").alias("text_hash"))
)
query("PR4_text_len", "SELECT doc_id, CAST(length(COALESCE(text,'')) AS INT) AS text_len FROM documents")(
    lambda v: v.table("documents").select("doc_id", X.text_len("text").alias("text_len"))
)
query("PR5_loose_norm", f"SELECT doc_id, {LOOSE} AS loose FROM documents")(
    lambda v: v.table("documents").select("doc_id", X.loose_norm("text").alias("loose"))
)
query("PR6_prefix_key", f"SELECT doc_id, left({LOOSE},120) AS prefix FROM documents")(
    lambda v: v.table("documents").select("doc_id", X.prefix_key(X.loose_norm("text")).alias("prefix"))
)
query(
    "PR7_epoch_parts",
    "SELECT item_key, CAST(year(epoch_ms(ts)) AS INT) AS yr, CAST(month(epoch_ms(ts)) AS INT) AS month FROM reviews",
)(lambda v: v.reviews.select("item_key", TM.epoch_year("ts").alias("yr"), TM.epoch_month("ts").alias("month")))
query(
    "PR8_rating_to_label",
    "SELECT item_key, CASE WHEN rating<=2 THEN 0 WHEN rating=3 THEN 1 ELSE 2 END AS y FROM reviews WHERE rating>0",
)(lambda v: v.reviews.filter("rating > 0").select("item_key", L.rating_to_label("rating").alias("y")))
query(
    "PR9_label_recode",
    """SELECT model, seed, train_set, item_id, CASE y WHEN 0 THEN 'neg' WHEN 1 THEN 'neu' ELSE 'pos' END AS label,
       CASE pred WHEN 0 THEN 'LOW' WHEN 2 THEN 'HIGH' ELSE 'OTHER' END AS coarse FROM preds""",
)(
    lambda v: v.preds.select(
        "model", "seed", "train_set", "item_id", L.decode_class("y").alias("label"),
        L.recode("pred", {0: "LOW", 2: "HIGH"}, "OTHER").alias("coarse"),
    )
)
query(
    "PR9_label_encode",
    "SELECT item_id, CASE label WHEN 'NEGATIVE' THEN 0 WHEN 'NEUTRAL' THEN 1 WHEN 'POSITIVE' THEN 2 END AS pred FROM zero_shot",
)(lambda v: v.zero_shot.select("item_id", L.encode_label("label").alias("pred")))
query(
    "PR10_range_filters",
    """SELECT item_key, rating, yr, text_len FROM reviews WHERE rating BETWEEN 1 AND 5 AND text_len BETWEEN 20 AND 2000
       AND yr BETWEEN 1996 AND 1999 AND month(epoch_ms(ts))<=9""",
)(
    lambda v: v.reviews.filter(
        F.col("rating").between(1, 5) & F.col("text_len").between(20, 2000) & TM.in_years("ts", 1996, 1999)
        & (TM.epoch_month("ts") <= 9)
    ).select("item_key", "rating", "yr", "text_len")
)
query("PR11_in_list", "SELECT item_key, rating FROM reviews WHERE rating IN (2,3,4)")(
    lambda v: v.reviews.filter(F.col("rating").isin(2, 3, 4)).select("item_key", "rating")
)
query(
    "PR12_array_element",
    """SELECT parent_asin, rating_number, COALESCE(NULLIF(categories[2],''),'(none)') AS cat_l1,
       COALESCE(NULLIF(categories[3],''),'(none)') AS cat_l2 FROM meta""",
)(
    lambda v: v.meta.select(
        "parent_asin", "rating_number", L.array_element("categories", 2).alias("cat_l1"), L.array_element("categories", 3).alias("cat_l2")
    )
)


def _different(column: str) -> str:
    return f"SELECT text_hash, count(*) AS n FROM (SELECT DISTINCT text_hash, {column} FROM lengthy WHERE {column} IS NOT NULL) GROUP BY text_hash"


# One table for each count of different values, joined to the sums; the variance comes from whole sums of ratings.
# One table of distinct pairs for each counted key beside the operator's distinct counts in one aggregate: it checks that
# counts of several keys do not disturb one another. Rating sums are whole numbers, so the spread is exact.
GROUP_TABLES = {
    "lengthy": "SELECT * FROM reviews WHERE text_len >= 50",
    "by_user": _different("user_id"),
    "by_parent": _different("parent_asin"),
    "by_asin": _different("asin"),
    "sums": """SELECT text_hash, count(*) AS k, sum(rating)::BIGINT AS r, sum(rating*rating)::BIGINT AS rr, min(text_len) AS len FROM lengthy GROUP BY text_hash""",
    "g": """SELECT s.text_hash, s.k AS n_rows, COALESCE(u.n,0) AS n_users, COALESCE(p.n,0) AS n_parent, COALESCE(a.n,0) AS n_asin, s.r/s.k AS mean_rating,
      s.k*s.rr-s.r*s.r AS spread, sqrt(s.k*s.rr-s.r*s.r)/s.k AS sd_rating, s.len
      FROM sums s LEFT JOIN by_user u USING (text_hash) LEFT JOIN by_parent p USING (text_hash) LEFT JOIN by_asin a USING (text_hash)""",
}
# Fixed by the definition: the names of the kinds of sharing and their order.
DUP_TYPE = """CASE WHEN n_rows=1 THEN '0_unique' WHEN n_users=1 AND n_parent=1 THEN '1_same_user_same_parent'
  WHEN n_users=1 THEN '2_same_user_cross_product' ELSE '3_cross_user' END"""
# A table of ranges beside the operator's chain of upper edges: it checks that the edges leave no gap and no overlap.
SIZE = """(SELECT s.name FROM (VALUES ('1',1,1),('2-5',2,5),('6-20',6,20),('21-50',21,50),('>50',51,9223372036854775807)) s(name,lo,hi) WHERE n_rows BETWEEN s.lo AND s.hi)"""
query("PR13_dup_type", f"SELECT text_hash, {DUP_TYPE} AS dup_type FROM g", GROUP_TABLES)(
    lambda v: D.duplicate_groups(v.records).select("text_hash", L.dup_type("n_rows", "n_users", "n_parent").alias("dup_type"))
)
query(
    "PR14_buckets",
    f"SELECT text_hash, {SIZE} AS size_bucket, CASE WHEN len<=60 THEN 'short' WHEN len<=90 THEN 'medium' ELSE 'long' END AS len_bucket FROM g",
    GROUP_TABLES,
)(
    lambda v: v.records.filter("text_len >= 50").groupBy("text_hash").agg(F.count(F.lit(1)).alias("n_rows"), F.min("text_len").alias("len"))
    .select(
        "text_hash", L.group_size("n_rows", (1, 5, 20, 50)).alias("size_bucket"),
        L.bucket("len", [60, 90], ["short", "medium", "long"]).alias("len_bucket"),
    )
)
query(
    "PR14_period",
    "SELECT item_id, CASE WHEN yr<=2016 THEN 'early' WHEN yr BETWEEN 2019 AND 2022 THEN 'late' END AS period FROM rated_items",
)(lambda v: v.rated_items.select("item_id", L.period("yr").alias("period")))
query(
    "PR15_length_features",
    """SELECT doc_id, round(ln(1.0::DOUBLE+text_len),8) AS loglen, round(power(ln(1.0::DOUBLE+text_len),2),8) AS loglen2,
       round(ln(text_len::DOUBLE),8) AS log_plain FROM docs WHERE text_len>0""",
)(
    lambda v: rounded(
        v.docs.filter("text_len > 0").select(
            "doc_id", L.length_features("text_len")[0].alias("loglen"), L.length_features("text_len")[1].alias("loglen2"),
            F.log(F.col("text_len").cast("double")).alias("log_plain"),
        ),
        "loglen", "loglen2", "log_plain",
    )
)
query(
    "PR16_flag_parse",
    "SELECT item_id, (lower(verified)='true')::INT AS ver FROM rated_items",
)(lambda v: v.rated_items.select("item_id", L.flag("verified").alias("ver")))
query(
    "PR17_composite_key",
    "SELECT item_key, user_id||'|'||asin||'|'||ts AS key, ph(user_id||'|'||asin||'|'||ts) AS key_hash FROM reviews",
)(
    lambda v: v.reviews.select(
        "item_key", K.composite_key("user_id", "asin", "ts").alias("key"), K.ph(K.composite_key("user_id", "asin", "ts")).alias("key_hash")
    )
)
query("PR18_preview", "SELECT doc_id, left(text,250) AS preview FROM documents")(
    lambda v: v.table("documents").select("doc_id", X.preview("text", 250).alias("preview"))
)
query(
    "PR19_pred_from_probs",
    """SELECT model, train_set, seed, item_id, CASE WHEN p_neg>=p_neu AND p_neg>=p_pos THEN 0 WHEN p_neu>=p_pos THEN 1 ELSE 2 END AS top,
       CASE WHEN p_neg>p_pos THEN 0 ELSE 2 END AS two FROM preds""",
)(
    lambda v: v.preds.select(
        "model", "train_set", "seed", "item_id", L.pred_from_probs(["p_neg", "p_neu", "p_pos"]).alias("top"), L.binary_pred().alias("two")
    )
)
_HITS = ", ".join(
    f"len(list_filter(w, lambda x: list_contains({sorted(set(ws.split()))!r}, x))) AS h_{lang}" for lang, ws in X.LANGUAGE_WORDS.items()
)
query(
    "PR20_language_flag",
    f"""SELECT doc_id, len(w)<3 OR NOT (greatest(h_es,h_pt,h_fr,h_de)>=2 AND greatest(h_es,h_pt,h_fr,h_de)>h_en) AS english
    FROM (SELECT doc_id, w, {_HITS} FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents))""",
)(lambda v: v.spread(v.table("documents")).select("doc_id", X.language_flag("text").alias("english")))
query(
    "PR21_parse_label_reply",
    "SELECT rater, item_id, CASE WHEN u<=3 THEN label END AS label, CASE WHEN u<=3 THEN 'because' END AS reason FROM replies",
)(lambda v: v.replies.withColumn("p", X.parse_label_reply("raw")).select("rater", "item_id", "p.label", "p.reason"))
_POS = " OR ".join(f"contains(t,'{w}')" for w in X.POSITIVE_CUES)
_NEG = " OR ".join(f"contains(t,'{w}')" for w in X.NEGATIVE_CUES)
query(
    "PR22_keyword_annotator",
    f"""SELECT item_key, CASE WHEN p AND n THEN 'MIXED' WHEN p THEN 'POSITIVE' WHEN n THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label
    FROM (SELECT item_key, ({_POS}) AS p, ({_NEG}) AS n FROM (SELECT item_key, lower(COALESCE(text,'')) AS t FROM reviews))""",
)(lambda v: v.reviews.select("item_key", X.keyword_annotator("text").alias("label")))
query(
    "PR23_aspect_gold",
    """SELECT sentence_id, CASE WHEN list_contains(polarities,'conflict') OR list_contains(polarities,'positive') AND list_contains(polarities,'negative') THEN 'MIXED'
      WHEN len(list_distinct(polarities))=1 AND list_contains(polarities,'neutral') THEN 'NEUTRAL'
      WHEN list_contains(polarities,'positive') THEN 'POSITIVE' ELSE 'NEGATIVE' END AS gold FROM aspects WHERE len(polarities)>0""",
)(lambda v: v.aspects.select("sentence_id", L.aspect_gold("polarities").alias("gold")).filter("gold IS NOT NULL"))
query(
    "PR25_tokenize_words",
    r"""SELECT doc_id, len(w) AS n_unigrams, greatest(len(w)-1,0) AS n_bigrams, md5(array_to_string(w,' ')) AS unigrams,
      md5(array_to_string(list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1]),'|')) AS bigrams
      FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), lambda x: length(x)>=2) AS w FROM documents)""",
)(
    lambda v: v.spread(v.table("documents")).select("doc_id", X.word_tokens("text").alias("w"), X.tokenize_words("text", (2,)).alias("b")).select(
        "doc_id", F.size("w").cast("long").alias("n_unigrams"), F.size("b").cast("long").alias("n_bigrams"),
        F.md5(F.array_join("w", " ")).alias("unigrams"), F.md5(F.array_join("b", "|")).alias("bigrams"),
    )
)

# ---- profiles ------------------------------------------------------------------------------

query(
    "AG1_basic_profile",
    """SELECT count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, count(DISTINCT asin) AS n_asin, count(DISTINCT parent_asin) AS n_parent_asin,
      avg(verified_purchase::INT) AS verified_ratio, min(yr) AS year_min, max(yr) AS year_max, count(*) FILTER (text_len=0) AS n_empty_text,
      count(*) FILTER (text_len<50) AS n_short_text FROM reviews""",
)(lambda v: P.basic_profile(v.records))
query(
    "AG2_rating_distribution",
    "SELECT c.rating, c.n, c.n*100.0::DOUBLE/t.n AS pct FROM (SELECT rating, count(*) AS n FROM reviews GROUP BY rating) c, (SELECT count(*) AS n FROM reviews) t",
)(lambda v: P.rating_distribution(v.records))
query(
    "AG3_profile_by_year",
    "SELECT yr, count(*) AS n, avg(rating) AS mean_rating, avg(verified_purchase::INT) AS verified_ratio FROM reviews GROUP BY yr",
)(lambda v: P.profile_by_year(v.records))
query(
    "AG4_length_by_rating",
    """SELECT rating, count(*) n, round(quantile_cont(text_len,0.1),8) p10, round(quantile_cont(text_len,0.5),8) p50, round(quantile_cont(text_len,0.9),8) p90,
      avg(helpful_vote) mean_helpful FROM reviews GROUP BY rating""",
)(lambda v: rounded(P.length_by_rating(v.records), "p10", "p50", "p90"))
query("AG5_top_categories", "SELECT main_category, count(*) n FROM meta GROUP BY 1 ORDER BY n DESC, 1 LIMIT 40")(
    lambda v: P.top_categories(v.meta)
)
query(
    "AG6_duplicate_groups",
    "SELECT text_hash, n_rows, n_users, n_parent, n_asin, mean_rating, round(sd_rating,8) AS sd_rating, len FROM g",
    GROUP_TABLES,
)(lambda v: rounded(D.duplicate_groups(v.records), "sd_rating"))
query(
    "AG7_duplicate_types",
    f"""SELECT {DUP_TYPE} AS dup_type, count(*) n_groups, sum(n_rows)::BIGINT n_rows,
      100.0::DOUBLE*sum(n_rows)::BIGINT/(sum(sum(n_rows)) OVER ())::BIGINT AS pct_rows FROM g GROUP BY 1""",
    GROUP_TABLES,
)(lambda v: D.duplicate_types(D.text_sharing(v.records)))
query(
    "AG8_duplicate_group_sizes",
    f"SELECT group_size, count(*) AS n_groups, sum(n_rows)::BIGINT AS n_rows FROM (SELECT {SIZE} AS group_size, n_rows FROM g) GROUP BY group_size",
    GROUP_TABLES,
)(
    lambda v: D.duplicate_group_sizes(v.records, edges=(1, 5, 20, 50))
)
query(
    "AG9_duplicate_rating_agreement",
    # spread = n * sum of squares - square of the sum, a whole number: a deviation below 1 is a spread below n * n.
    """SELECT CASE WHEN spread=0 THEN 'identical rating' WHEN spread<n_rows::HUGEINT*n_rows THEN 'sd<1' ELSE 'sd>=1' END AS rating_agreement,
      count(*) AS n_groups, sum(n_rows)::BIGINT AS n_rows FROM g WHERE n_rows>1 GROUP BY 1""",
    GROUP_TABLES,
)(lambda v: D.duplicate_rating_agreement(v.records))
query(
    "AG10_variant_shared_groups",
    """SELECT count(*) AS n_groups, COALESCE(sum(k),0)::BIGINT AS n_rows FROM
      (SELECT count(*) AS k FROM reviews WHERE text_len>=50 GROUP BY user_id, ts, text_hash) WHERE k>1""",
)(lambda v: D.variant_shared_groups(v.records))
query(
    "AG11_top_duplicate_groups",
    """SELECT text_hash, n_rows, n_users, n_parent, n_asin, mean_rating, round(sd_rating,8) AS sd_rating,
      (SELECT left(min(r.text),300) FROM reviews r WHERE r.text_hash=g.text_hash AND r.text_len>=50) AS text_preview
      FROM g WHERE n_rows>1 ORDER BY n_rows DESC, text_hash LIMIT 300""",
    GROUP_TABLES,
)(lambda v: rounded(D.top_duplicate_groups(v.reviews), "sd_rating"))
query(
    "AG12_exact_record_duplicates",
    """SELECT count(*) AS n_groups, COALESCE(sum(k),0)::BIGINT AS n_rows_in_groups, COALESCE(sum(k-1),0)::BIGINT AS n_redundant_rows FROM
      (SELECT count(*) AS k FROM reviews GROUP BY user_id, asin, ts, text_hash) WHERE k>1""",
)(lambda v: D.exact_record_duplicates(v.records))
KEYED = f"""SELECT *, {LOOSE} AS loose FROM docs WHERE text_len>=50"""
query(
    "AG13_distinct_match_keys",
    "SELECT count(*) n_rows, count(DISTINCT text_hash) exact, count(DISTINCT loose) loose, count(DISTINCT left(loose,120)) prefix FROM h",
    {"h": KEYED},
)(lambda v: D.distinct_match_keys(D.match_keys(v.docs)))
query(
    "AG14_loose_only_groups",
    """SELECT md5(loose) AS loose, count(*) n_rows, count(DISTINCT text_hash) n_exact_variants, count(DISTINCT user_id) n_users,
      count(DISTINCT parent_asin) n_parent, left(min(text),250) AS example FROM h GROUP BY h.loose HAVING count(DISTINCT text_hash)>1
      ORDER BY n_rows DESC, 1 LIMIT 200""",
    {"h": KEYED},
)(lambda v: D.loose_only_groups(v.docs))
query(
    "AG14_loose_only_totals",
    """SELECT count(*) AS n_groups, COALESCE(sum(n),0)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM h GROUP BY loose HAVING count(DISTINCT text_hash)>1)""",
    {"h": KEYED.replace("docs", "reviews")},
)(lambda v: D.loose_only_totals(D.match_keys(v.reviews)))
query(
    "AG15_label_by_year",
    """SELECT yr, count(*) n, avg((y=0)::INT) neg, avg((y=1)::INT) neu, avg((y=2)::INT) pos, round(quantile_cont(text_len,0.5),8) median_len
      FROM pool GROUP BY yr""",
)(lambda v: rounded(P.label_by_year(v.pool), "median_len"))
query(
    "AG16_balanced_weights",
    "SELECT y, count(*) n, count(*)/sum(count(*)) OVER () AS prior, sum(count(*)) OVER ()/(3*count(*)) AS weight FROM pool GROUP BY y",
)(lambda v: P.balanced_weights(v.items.select("y")))
query(
    "AG17_label_dist_by_sample",
    "SELECT sample, count(*) n, avg((y=0)::INT) neg, avg((y=1)::INT) neu, avg((y=2)::INT) pos FROM samples GROUP BY sample",
)(lambda v: P.class_shares(v.samples, ["sample"]))
query(
    "AG18_key_uniqueness",
    """SELECT count(*) n_keys, sum((k>1)::INT)::BIGINT n_dup_keys, sum(CASE WHEN k>1 THEN k ELSE 0 END)::BIGINT n_rows,
      sum(CASE WHEN k>1 THEN s ELSE 0 END)::BIGINT n_sampled_rows FROM (
      SELECT count(*) k, sum((item_id IN (SELECT item_id FROM samples))::INT) s FROM pool GROUP BY user_id, parent_asin, text_hash)""",
)(lambda v: D.key_uniqueness(v.items, v.samples))
NONUNIQUE = """SELECT item_id, user_id, parent_asin, text_hash, y, n_key, n_key_and_label FROM (SELECT *,
  count(*) OVER (PARTITION BY user_id, parent_asin, text_hash) AS n_key,
  count(*) OVER (PARTITION BY user_id, parent_asin, text_hash, y) AS n_key_and_label FROM pool)
  WHERE n_key>1 AND item_id IN (SELECT item_id FROM samples)"""
query("AG19_nonunique_items", "SELECT item_id, y, n_key, n_key_and_label FROM nu", {"nu": NONUNIQUE})(
    lambda v: D.nonunique_items(v.items, v.samples).select("item_id", "y", "n_key", "n_key_and_label")
)
query(
    "AG19_nonunique_summary",
    """SELECT count(*) n_items, sum((n_key_and_label=1)::INT)::BIGINT unique_with_label, (count(*)-sum((n_key_and_label=1)::INT))::BIGINT still_ambiguous FROM nu""",
    {"nu": NONUNIQUE},
)(lambda v: D.nonunique_summary(D.nonunique_items(v.items, v.samples)))
PC = {
    "pc": "SELECT yr, y, COALESCE(cat_l1,'(none)') AS cat_l1 FROM pool LEFT JOIN cats USING (parent_asin)",
    "top_cats": "SELECT cat_l1 FROM pc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15",
    "pc2": "SELECT yr, y, CASE WHEN cat_l1 IN (SELECT cat_l1 FROM top_cats) THEN cat_l1 ELSE '(other)' END AS cat FROM pc",
}
query("AG20_category_share_by_year", "SELECT yr, cat, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY yr) AS share FROM pc2 GROUP BY yr, cat", PC)(
    lambda v: P.category_share_by_year(v.items, v.meta)
)
query(
    "AG21_class_share_by_category_year",
    "SELECT yr, cat, count(*) AS n, avg((y=1)::INT) AS neu_share, avg((y=0)::INT) AS neg_share FROM pc2 GROUP BY yr, cat",
    PC,
)(lambda v: P.class_share_by_category_year(v.items, v.meta))
query(
    "AG22_membership_summary",
    """SELECT count(*) n, count(DISTINCT sample) n_samples, (SELECT count(*) FROM (SELECT item_id FROM samples WHERE sample LIKE 'train%'
      INTERSECT SELECT item_id FROM samples WHERE sample LIKE 'test%')) AS overlap FROM samples""",
)(lambda v: P.membership_summary(v.samples))
query(
    "AG23_match_rate",
    """SELECT count(*) n, sum((parent_asin IN (SELECT parent_asin FROM meta))::INT)::BIGINT n_matched,
      sum((parent_asin IN (SELECT parent_asin FROM meta))::INT)/count(*) AS rate FROM (SELECT DISTINCT parent_asin FROM reviews)""",
)(lambda v: P.match_rate(v.records, v.meta, "parent_asin"))
LABS = ("POSITIVE", "NEGATIVE", "MIXED", "NEUTRAL", "UNCLEAR", "NO_MAJORITY")
_XT = ", ".join(f"avg((majority='{x}')::INT) AS \"{x}\"" for x in LABS)


def voted(v):
    from tidemark.operators import raters as R

    return v.rated_items.join(R.majority_vote(R.complete_cases(v.raters, 3)), "item_id")


query("AG24_crosstab_by_star", f"SELECT rating_star, count(*) n, {_XT} FROM voted GROUP BY rating_star")(
    lambda v: P.crosstab_normalized(voted(v), "rating_star", "majority", LABS)
)
query("AG24_three_star_by_year", f"SELECT yr, count(*) n, {_XT} FROM voted WHERE rating_star=3 GROUP BY yr")(
    lambda v: P.crosstab_normalized(voted(v).filter("rating_star = 3"), "yr", "majority", LABS)
)
query("AG25_unanimity_by_star", "SELECT rating_star, count(*) n, avg(unanimous::INT) AS unanimity FROM voted GROUP BY 1")(
    lambda v: P.mean_by_group(voted(v), ["rating_star"], F.col("unanimous"), "unanimity")
)
query(
    "AG25_median_length_by_period",
    "SELECT period, round(quantile_cont(text_len,0.5),8) AS median_len FROM rated_items WHERE period IS NOT NULL GROUP BY 1",
)(lambda v: rounded(P.weighted_quantiles(v.rated_items.filter("period IS NOT NULL"), ["period"], "text_len", {"median_len": 0.5}), "median_len"))
query(
    "AG27_dissimilarity",
    """SELECT a.y0, a.y1, round(0.5::DOUBLE*sum(abs(COALESCE(s0,0)-COALESCE(s1,0))),8) AS dissimilarity FROM (
      SELECT y0, y1, cat, max(CASE WHEN yr=y0 THEN share END) AS s0, max(CASE WHEN yr=y1 THEN share END) AS s1
      FROM (SELECT yr, cat, count(*)/sum(count(*)) OVER (PARTITION BY yr) AS share FROM pc2 GROUP BY yr, cat), (VALUES (1995,2000),(1997,2001)) t(y0,y1)
      GROUP BY y0, y1, cat) a GROUP BY 1, 2""",
    PC,
)(lambda v: rounded(P.dissimilarity(P.category_share_by_year(v.items, v.meta), [(1995, 2000), (1997, 2001)]), "dissimilarity"))
query("AG28_margins", "SELECT yr, y, count(*) n FROM samples GROUP BY CUBE (yr, y)")(lambda v: P.margins(v.samples))
query("AG29_majority_class", "SELECT y FROM train_sample GROUP BY y ORDER BY count(*) DESC, y LIMIT 1")(
    lambda v: P.majority_class(v.samples.filter("sample = 'train_seed42'"))
)
query(
    "AG30_keep_last",
    "SELECT user_id, parent_asin, item_id FROM pool QUALIFY row_number() OVER (PARTITION BY user_id, parent_asin ORDER BY ts DESC, item_id DESC)=1",
)(
    lambda v: J.keep_last(v.items.select("user_id", "parent_asin", "item_id", "ts"), ["user_id", "parent_asin"], ["ts", "item_id"]).drop("ts")
)
query("AG30_distinct", "SELECT DISTINCT user_id, parent_asin FROM reviews")(lambda v: v.records.select("user_id", "parent_asin").distinct())

# ---- windows and ordering ------------------------------------------------------------------

query("WN1_dedup_pool", "SELECT item_id, user_id, asin, ts, text_hash, helpful_vote, rating, parent_asin, text_len, yr, y FROM pool")(
    lambda v: D.dedup_pool(v.reviews, 1995, 2001).select(
        "item_id", "user_id", "asin", "ts", "text_hash", "helpful_vote", "rating", "parent_asin", "text_len", "yr", "y"
    )
)
query("WN2_pct_of_total", "SELECT yr, y, count(*) n, 100.0::DOUBLE*count(*)/sum(count(*)) OVER () AS pct FROM pool GROUP BY yr, y")(
    lambda v: P.pct_of_total(v.items.groupBy("yr", "y").agg(F.count(F.lit(1)).alias("n")))
)
query("WN3_share_in_partition", "SELECT yr, y, count(*) n, count(*)/sum(count(*)) OVER (PARTITION BY yr) AS share FROM pool GROUP BY yr, y")(
    lambda v: P.share_in_partition(v.items.groupBy("yr", "y").agg(F.count(F.lit(1)).alias("n")), ["yr"])
)
query("WN4_content_key", "SELECT count(*) n, count(DISTINCT item_id) n_ids, md5(min(item_id)||max(item_id)) AS ends FROM pool")(
    lambda v: v.items.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("n_ids"), F.md5(F.concat(F.min("item_id"), F.max("item_id"))).alias("ends")
    )
)
query(
    "WN5_quantile_bins",
    """SELECT item_id, text_len, CASE WHEN text_len<=q1 THEN 'short' WHEN text_len<=q2 THEN 'medium' ELSE 'long' END AS bin
      FROM rated_items, (SELECT quantile_cont(text_len,1/3) q1, quantile_cont(text_len,2/3) q2 FROM rated_items)""",
)(lambda v: __import__("tidemark.operators.stats", fromlist=["x"]).quantile_bins(v.rated_items.select("item_id", "text_len"), "text_len"))
query("SO1_order_by", "SELECT yr, rating, count(*) n FROM reviews GROUP BY 1, 2")(
    lambda v: v.records.groupBy("yr", "rating").agg(F.count(F.lit(1)).alias("n")).orderBy("yr", "rating")
)
query("SO2_top_k", "SELECT parent_asin, count(*) n FROM reviews GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")(
    lambda v: P.top_categories(v.records, 15, "parent_asin")
)
