"""Joins, set operations, splits, samples and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.profile_queries import NONUNIQUE
from catalog.registry import query, rounded
from catalog.sqlviews import LOOSE
from tidemark.functions import keys as K
from tidemark.functions import text as X
from tidemark.operators import duplicates as D
from tidemark.operators import bootstrap as BS
from tidemark.operators import joins as J
from tidemark.operators import leakage as LK
from tidemark.operators import profile as P
from tidemark.operators import sampling as S
from tidemark.operators import splits as SP
from tidemark.plans import views as V


def tests(v):
    return v.samples.filter(F.col("sample").startswith("test"))


# ---- joins -----------------------------------------------------------------------------------

query("JN1_coverage_join", "SELECT sum((parent_asin IN (SELECT parent_asin FROM meta))::INT)/count(*) AS ratio FROM reviews")(
    lambda v: J.coverage(v.records, v.meta, "parent_asin")
)
query(
    "JN2_detail_join",
    """SELECT text_hash, item_key, user_id, rating FROM reviews WHERE text_len>=50 AND text_hash IN (
      SELECT text_hash FROM reviews WHERE text_len>=50 GROUP BY 1 HAVING count(*)>1 ORDER BY count(*) DESC, text_hash LIMIT 300)""",
)(
    lambda v: v.reviews.filter("text_len >= 50").join(
        F.broadcast(
            v.reviews.filter("text_len >= 50").groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .orderBy(F.desc("n"), "text_hash").limit(300).select("text_hash")
        ),
        "text_hash", "left_semi",
    ).select("text_hash", "item_key", "user_id", "rating")
)
_SEEN = """SELECT count(*) n_test, sum((text_hash IN (SELECT text_hash FROM s WHERE tr))::INT)::BIGINT n_leak,
  100.0::DOUBLE*sum((text_hash IN (SELECT text_hash FROM s WHERE tr))::INT)::BIGINT/count(*) AS leak_pct FROM s WHERE NOT tr"""
query("JN3_seen_in_train", _SEEN, {"s": "SELECT text_hash, ph(user_id)%10<8 AS tr FROM docs"})(
    lambda v: LK.seen_in_train(v.docs, K.in_tenths("user_id"), "text_hash")
)
query(
    "JN4_computed_key_join",
    """SELECT a.doc_id, b.doc_id AS copy_id FROM h a JOIN h b ON a.loose=b.loose AND a.doc_id%2=0 AND b.doc_id=a.doc_id+1""",
    {"h": f"SELECT doc_id, {LOOSE} AS loose FROM docs"},
)(
    lambda v: (
        lambda h: h.filter("doc_id % 2 = 0").alias("a").join(
            h.filter("doc_id % 2 = 1").alias("b"),
            (F.col("a.loose") == F.col("b.loose")) & (F.col("b.doc_id") == F.col("a.doc_id") + 1),
        ).select(F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("copy_id"))
    )(v.docs.select("doc_id", X.loose_norm("text").alias("loose")))
)
query("JN5_semi_join", "SELECT item_id, yr FROM pool WHERE item_id IN (SELECT item_id FROM samples)")(
    lambda v: J.semi(v.items.select("item_id", "yr"), v.samples, "item_id")
)
query("JN6_anti_join", "SELECT item_id, yr FROM pool WHERE item_id NOT IN (SELECT item_id FROM samples)")(
    lambda v: J.anti(v.items.select("item_id", "yr"), v.samples, "item_id")
)
query(
    "JN7_multi_key_left_join",
    """SELECT a.item_id, a.user_id, a.asin, a.ts::VARCHAR AS ts, a.yr::VARCHAR AS yr, a.rating_star::VARCHAR AS rating_star, r.v.p AS parent_asin,
      r.v.b AS verified_purchase, r.v.h AS helpful_vote, main_category, cat_l1, cat_l2
      FROM annotation a LEFT JOIN (SELECT user_id, asin, ts, min({'p':parent_asin,'b':verified_purchase,'h':helpful_vote}) AS v FROM reviews GROUP BY 1,2,3) r
      ON a.user_id=r.user_id AND a.asin=r.asin AND a.ts=r.ts LEFT JOIN cats c ON c.parent_asin=r.v.p""",
)(lambda v: J.annotate_key(v.annotation_key, v.records, v.meta))
query(
    "JN8_samples_to_category",
    """SELECT s.sample, s.item_id, p.parent_asin, COALESCE(c.cat_l1,'(none)') AS cat_l1 FROM samples s JOIN pool p USING (item_id)
      LEFT JOIN cats c ON c.parent_asin=p.parent_asin""",
)(
    lambda v: P.with_category(v.samples.select("sample", "item_id").join(v.items.select("item_id", "parent_asin"), "item_id"), v.meta).select(
        "sample", "item_id", "parent_asin", "cat_l1"
    )
)
query(
    "JN9_recover_timestamp",
    """SELECT p.item_id, min(r.ts) AS ts, CAST(month(epoch_ms(min(r.ts))) AS INT) AS month FROM pool p JOIN reviews r
      ON r.user_id=p.user_id AND r.parent_asin=p.parent_asin AND r.text_hash=p.text_hash AND r.yr=p.yr
      WHERE p.item_id IN (SELECT item_id FROM test_samples) GROUP BY 1""",
)(lambda v: J.recover_timestamp(J.semi(v.items, tests(v), "item_id"), v.records))
query(
    "JN10_candidate_rows",
    "SELECT nu.item_id, c.asin, c.ts, c.rating FROM nu JOIN c USING (user_id, parent_asin, text_hash)",
    {
        "nu": NONUNIQUE,
        "c": """SELECT user_id, parent_asin, text_hash, asin, ts, rating FROM reviews WHERE rating>=1 AND rating<=5
          AND text_hash IN (SELECT text_hash FROM nu)""",
    },
)(lambda v: J.candidate_rows(D.nonunique_items(v.items, v.samples), v.records))
query(
    "JN10_candidate_lists",
    """SELECT k.key_id, n_items, n_rows, n_different FROM (SELECT md5(concat_ws('|', user_id, parent_asin, text_hash)) AS key_id, count(*) AS n_items FROM nu GROUP BY ALL) k
      JOIN (SELECT md5(concat_ws('|', user_id, parent_asin, text_hash)) AS key_id, count(*) AS n_rows, count(DISTINCT (asin, ts, rating)) AS n_different
        FROM reviews WHERE rating BETWEEN 1 AND 5 GROUP BY ALL) USING (key_id)""",
    {"nu": NONUNIQUE},
)(
    lambda v: (lambda keys, lists: lists.groupBy("key_id").agg(F.sum("n").alias("n_rows"), F.sum(F.size("candidates")).alias("n_different"))
    .join(keys.groupBy("key_id").agg(F.count(F.lit(1)).alias("n_items")), "key_id"))(*J.candidate_lists(D.nonunique_items(v.items, v.samples), v.records, 2))
)
query(
    "JN11_chained_using",
    """SELECT item_id, count(*) OVER (PARTITION BY user_id, parent_asin) AS n_pair, count(*) OVER (PARTITION BY user_id, parent_asin, y) AS n_pair_label
      FROM pool""",
)(
    lambda v: J.pair_counts(v.items, ["user_id", "parent_asin"], "y").select("item_id", "n_pair", "n_pair_label")
)
query("JN15_lookup_weights", "SELECT item_id, y, CASE y WHEN 0 THEN 2.0 WHEN 1 THEN 4.0 ELSE 0.5 END::DOUBLE AS w FROM pool")(
    lambda v: J.lookup(v.items.select("item_id", "y"), {0: 2.0, 1: 4.0, 2: 0.5}, "y", "w")
)
query("JN16_scalar_subquery", "SELECT count(*) AS n_a, (SELECT count(*) FROM reviews) AS n_b, count(*)/(SELECT count(*) FROM reviews) AS ratio FROM pool")(
    lambda v: J.ratio_of_counts(v.items, v.records)
)
query("JN14_attach_attributes", "SELECT r.item_id, r.rater, r.label, i.yr, i.cat_l1, i.rating_star FROM raters r JOIN rated_items i USING (item_id)")(
    lambda v: J.attach(v.raters, v.rated_items, ["item_id"], ["yr", "cat_l1", "rating_star"], "inner")
)

# ---- set operations ----------------------------------------------------------------------------

query("SO3_hash_shuffle", "SELECT item_id, ph('7:'||item_id) AS h FROM pool ORDER BY h, item_id")(
    lambda v: S.hash_shuffle(v.items.select("item_id"), 7).select("item_id", K.seeded_ph(7, "item_id").alias("h"))
)
query("SO4_head_n", "SELECT doc_id, lang FROM documents ORDER BY ph('5:'||doc_id), doc_id LIMIT 200")(
    lambda v: S.head_n(v.table("documents").select("doc_id", "lang"), 200, 5, "doc_id")
)
query("SO5_union_all", "SELECT 'pool' AS src, item_id FROM pool UNION ALL SELECT sample, item_id FROM samples")(
    lambda v: v.items.select(F.lit("pool").alias("src"), "item_id").unionByName(v.samples.select(F.col("sample").alias("src"), "item_id"))
)
query("SO6_union_distinct", "SELECT DISTINCT item_id FROM test_samples")(
    lambda v: J.union_distinct(
        tests(v).filter("sample LIKE '%natural'").select("item_id"), tests(v).filter("sample NOT LIKE '%natural'").select("item_id")
    )
)
query("SO7_same_set", "SELECT count(*)=0 AS same FROM (SELECT item_id FROM pool EXCEPT SELECT item_id FROM samples)")(
    lambda v: J.same_set(v.items, v.samples)
)

# ---- sampling and splits ------------------------------------------------------------------------

query("SP1_sample_n", "SELECT item_key, rating, ts FROM reviews ORDER BY ph('42:'||item_key), item_key LIMIT 5000")(
    lambda v: S.sample_n(v.reviews.select("item_key", "rating", "ts"), 5000, 42, "item_key")
)
query(
    "SP2_split_by_key",
    "SELECT item_id, ph(item_id)%10<8 AS by_row, ph(parent_asin)%10<8 AS by_product, ph(user_id)%10<8 AS by_user FROM pool",
)(
    lambda v: SP.split_by_key(SP.split_by_key(SP.split_by_key(v.items, "item_id", 8, "by_row"), "parent_asin", 8, "by_product"), "user_id", 8, "by_user")
    .select("item_id", "by_row", "by_product", "by_user")
)
query("SP3_split_temporal", "SELECT item_id, CASE WHEN yr<=1998 THEN 'train' ELSE 'test' END AS set FROM pool WHERE yr<=1998 OR yr>=2000")(
    lambda v: SP.split_temporal(v.items, (1995, 1998), (2000, 2001)).select("item_id", "set")
)
query("SP4_period_tests", "SELECT sample, item_id, yr, y FROM natural_tests")(
    lambda v: SP.period_tests(v.items.select("item_id", "yr", "y"), V.N_TEST, V.TRAIN_YEARS, V.TEST_YEARS, 7).select("sample", "item_id", "yr", "y")
)
query("SP5_matched_tests", "SELECT sample, item_id, yr, y FROM matched_tests")(
    lambda v: SP.matched_tests(
        v.items.select("item_id", "yr", "y"), SP.class_prior(SP.train_rows(v.items.select("item_id", "yr", "y"), V.TRAIN_YEARS)),
        V.N_TEST, V.TEST_YEARS, 7,
    ).select("sample", "item_id", "yr", "y")
)
query("SP6_train_excluding", "SELECT item_id, yr, y FROM recent_train")(
    lambda v: SP.train_excluding(v.items.select("item_id", "yr", "y"), tests(v), V.RECENT_YEARS, V.N_TRAIN, 42)
)
query(
    "SP6_overlap_audit",
    "SELECT count(*) n, sum((item_id IN (SELECT item_id FROM test_samples))::INT)::BIGINT AS overlap FROM recent_train",
)(lambda v: SP.overlap_count(v.samples.filter("sample = 'train_1999_2000'"), tests(v)))
query("SP7_stratified_sample", "SELECT item_id, item_key, user_id, asin, ts, yr, rating_star FROM annotation")(
    lambda v: v.annotation_sample.select("item_id", "item_key", "user_id", "asin", "ts", "yr", "rating_star")
)
query("SP8_blind_split_text", "SELECT item_id, text FROM annotation")(
    lambda v: S.blind_split(v.annotation_sample, ["item_id", "text"], ["item_id", "user_id"])[0]
)
query("SP8_blind_split_key", "SELECT item_id, user_id, asin, ts, yr, rating_star FROM annotation")(
    lambda v: S.blind_split(v.annotation_sample, ["item_id", "text"], ["item_id", "user_id", "asin", "ts", "yr", "rating_star"])[1]
)
query(
    "SP9_seed_subsamples",
    """SELECT seed, item_id FROM pool_train, (VALUES (42),(43),(44)) t(seed)
      QUALIFY row_number() OVER (PARTITION BY seed ORDER BY ph(seed||':'||item_id), item_id)<=800""",
)(lambda v: S.seed_subsamples(SP.train_rows(v.items, V.TRAIN_YEARS), 800, V.SEEDS))
query(
    "SP10_paired_subset_sample",
    "SELECT sample, item_id FROM test_samples QUALIFY row_number() OVER (PARTITION BY sample ORDER BY ph('2026:'||item_id), item_id)<=200",
)(lambda v: S.paired_subset_sample(tests(v).select("sample", "item_id"), 200, 2026, n_samples=11))
def drawn_twice(v):
    """Every sample's drawn items, their number and whether a draw from rows that lie elsewhere, in another order, is the same."""
    here = S.paired_subset_sample(tests(v).select("sample", "item_id"), 200, 2026)
    there = S.paired_subset_sample(tests(v).select("item_id", "sample").repartition(7, "item_id").sortWithinPartitions(F.desc("item_id")), 200, 2026)
    return here.join(J.same_sets(here, there, "item_id", ["sample"]), "sample").select("sample", "item_id", "n", "same")


query(
    "SP10_paired_subset_same",
    """SELECT sample, item_id, count(*) OVER (PARTITION BY sample) AS n, true AS same FROM
      (SELECT sample, item_id FROM test_samples QUALIFY row_number() OVER (PARTITION BY sample ORDER BY ph('2026:'||item_id), item_id)<=200)""",
)(drawn_twice)
query("PR24_surrogate_ids", "SELECT item_id, 'T'||printf('%07d', row_number() OVER (ORDER BY ph('9:'||item_id), item_id)-1) AS short_id FROM pool")(
    lambda v: S.surrogate_ids(v.items.select("item_id"), "item_id", 9, "T%07d", "short_id")
)
# Every replicate is drawn item by item; the table of all weights would be B samples long, so it is summed by item.
_B = 1000
query(
    "SP11_resample_with_replacement",
    f"""SELECT item_id, sum(n)::BIGINT AS drawn, count(*) AS n_reps, max(n) AS most FROM (SELECT b, ph('3:'||b||':'||j)%(SELECT count(*) FROM pool_train) AS pos, count(*) AS n
      FROM (SELECT unnest(range({_B})) AS b), (SELECT unnest(range((SELECT count(*) FROM pool_train))) AS j) GROUP BY ALL) d
      JOIN (SELECT item_id, row_number() OVER (ORDER BY ph('3:'||item_id), item_id)-1 AS pos FROM pool_train) USING (pos) GROUP BY ALL""",
)(
    lambda v: BS.resample_totals(SP.train_rows(v.items, V.TRAIN_YEARS).select("item_id"), _B, 3)
)

# ---- keys, membership, leakage -----------------------------------------------------------------

query("SK6_membership", "SELECT sample, item_id FROM samples ORDER BY sample, item_id")(
    lambda v: v.samples.select("sample", "item_id").orderBy("sample", "item_id")
)
query(
    "SK6_public_keys",
    """SELECT item_id, user_id, parent_asin, text_hash, yr, CASE y WHEN 0 THEN 'neg' WHEN 1 THEN 'neu' ELSE 'pos' END AS label
      FROM pool WHERE item_id IN (SELECT item_id FROM samples)""",
)(lambda v: D.public_keys(v.items, v.samples))


def leak_sql(source: str, row_key: str, matches: dict[str, str]) -> tuple[str, dict[str, str]]:
    splits = {"random_row": row_key, "group_parent_asin": "parent_asin", "group_user": "user_id"}
    parts = [
        f"""SELECT '{s}' AS split, '{m}' AS match, count(*) n_test, sum((k IN (SELECT k FROM lk_{s}_{m} WHERE tr))::INT)::BIGINT n_leak
        FROM lk_{s}_{m} WHERE NOT tr"""
        for s in splits
        for m in matches
    ]
    extra = {f"lk_{s}_{m}": f"SELECT {mx} AS k, ph({sk})%10<8 AS tr FROM {source} WHERE text_len>=50" for s, sk in splits.items() for m, mx in matches.items()}
    return f"SELECT *, 100.0::DOUBLE*n_leak/n_test AS leak_pct FROM ({' UNION ALL '.join(parts)})", extra


_sql, _extra = leak_sql("reviews", "user_id||'|'||ts||'|'||asin", {"exact": "text_hash"})
query("LK1_leakage_exact", f"SELECT split, n_test, n_leak, leak_pct FROM ({_sql})", _extra)(lambda v: LK.leakage_exact(v.records))
_LEVELS = {"exact": "text_hash", "loose": LOOSE, "prefix": f"left({LOOSE},120)"}
for _src, _key in (("docs", "doc_id"), ("reviews", "item_key")):
    _sql, _extra = leak_sql(_src, f"{_key}::VARCHAR", _LEVELS)

    def _matrix(v, src=_src, key=_key):
        keys = D.match_keys(getattr(v, src), keep=[key, "user_id", "parent_asin"])
        return LK.leakage_matrix(keys, LK.standard_splits(F.col(key)), ["exact", "loose", "prefix"])

    query(f"LK2_leakage_matrix_{_src}", _sql, _extra)(_matrix)
query(
    "LK3_sampled_leakage",
    """SELECT count(*) n_test, avg((text_hash IN (SELECT text_hash FROM train_sample))::INT) AS text_leak,
      avg((user_id IN (SELECT user_id FROM train_sample))::INT) AS user_seen FROM pool WHERE item_id IN (SELECT item_id FROM test_samples)""",
)(
    lambda v: LK.sampled_leakage(
        J.semi(v.items, v.samples.filter("sample = 'train_seed42'"), "item_id"), J.semi(v.items, tests(v), "item_id")
    )
)
query(
    "LK4_item_overlap_flags",
    """SELECT item_id, item_id IN (SELECT item_id FROM train_sample) AS in_train, item_id IN (SELECT item_id FROM test_samples) AS in_any_test,
      item_id IN (SELECT item_id FROM recent_train) AS in_recent FROM pool""",
)(
    lambda v: LK.item_overlap_flags(
        v.items.select("item_id"),
        {
            "in_train": v.samples.filter("sample = 'train_seed42'"),
            "in_any_test": tests(v),
            "in_recent": v.samples.filter("sample = 'train_1999_2000'"),
        },
    )
)
