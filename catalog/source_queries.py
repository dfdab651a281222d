"""Sources and sinks: data Spark derives from the given tables is written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqlviews import TEXT_HASH
from tidemark.functions import text as X
from tidemark.operators import duplicates as D
from tidemark.operators import profile as P
from tidemark.sources import readers as RD
from tidemark.sources import schemas
from tidemark.sources import writers as WR
from tidemark.streaming import incremental as INC
from tidemark.session import shared_folder


def folder(v, name: str) -> str:
    """A new folder for every call."""
    return f"{shared_folder(v.spark)}/tidemark/{v.spark.sparkContext.applicationId}/io/{name}-{uuid.uuid4().hex[:10]}"


def through(v, name: str, write, read):
    path = folder(v, name)
    write(path)
    return read(path)


query(
    "SC1_read_reviews_jsonl",
    """SELECT rating, title, text, asin, parent_asin, user_id, ts, helpful_vote, verified_purchase, n_images, text_hash, text_len, yr FROM reviews""",
)(
    lambda v: through(
        v, "reviews_jsonl",
        lambda p: v.raw_source().drop("item_key").write.option("compression", "gzip").json(p),
        lambda p: D.normalise_reviews(RD.read_reviews_jsonl(v.spark, p)),
    )
)
query("SC2_read_meta_jsonl", "SELECT parent_asin, main_category, array_to_string(categories,'>') AS path, average_rating, rating_number FROM meta")(
    lambda v: through(
        v, "meta_jsonl",
        lambda p: v.meta.write.option("compression", "gzip").json(p),
        lambda p: RD.read_meta_jsonl(v.spark, p).select(
            "parent_asin", "main_category", F.array_join("categories", ">").alias("path"), "average_rating", "rating_number"
        ),
    )
)
query("SC3_read_parquet", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")(
    lambda v: RD.read_parquet(v.spark, f"{v.dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])
)
query("SC4_read_named_samples", "SELECT sample, item_id, yr, y FROM samples")(
    lambda v: through(
        v, "samples",
        lambda p: WR.save_samples(v.samples, p),
        lambda p: RD.read_named_samples(v.spark, f"{p}/set=*", r"^set=(.+)$", "name", folders=True).select(
            F.col("name").alias("sample"), "item_id", "yr", "y"
        ),
    )
)
query("SC5_read_csv_text", "SELECT item_id, user_id, asin, ts::VARCHAR AS ts, yr::VARCHAR AS yr, rating_star::VARCHAR AS rating_star FROM annotation")(
    lambda v: through(v, "key_csv", lambda p: WR.write_csv(v.annotation_key, p), lambda p: RD.read_csv_text(v.spark, p))
)
query("SC6_read_csv_typed", "SELECT item_id, y, pred, p_neg, p_neu, p_pos FROM preds")(
    lambda v: through(
        v, "preds_csv",
        lambda p: WR.write_csv(
            v.preds.select("item_id", "y", "pred", "p_neg", "p_neu", "p_pos"), p, compression="gzip"
        ),
        lambda p: RD.read_csv_typed(v.spark, p, schemas.PREDS),
    )
)
query(
    "SC7_read_annotation_log",
    """SELECT source, model, item_id, label FROM rater_log WHERE label IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY source, model, item_id ORDER BY utc DESC, label DESC)=1""",
)(
    lambda v: through(
        v, "log_jsonl",
        lambda p: v.rater_log.select(F.concat_ws("__", "source", "model").alias("run"), "item_id", "label", "error", "utc")
        .write.partitionBy("run").json(p),
        lambda p: RD.read_annotation_log(v.spark, f"{p}/run=*"),
    )
)
def write_sentences(v, path: str) -> None:
    """Two files of sentences with the whole texts of the documents in words; every fifth sentence is there twice."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " ")).alias("text")
    texts = v.table("documents").select(F.col("doc_id").alias("sentence_id"), words)
    terms = F.struct(F.transform("polarities", lambda x: F.struct(F.lit("x").alias("_term"), x.alias("_polarity"))).alias("aspectTerm"))
    rows = v.aspects.join(texts, "sentence_id").select(F.col("sentence_id").alias("_id"), "text", terms.alias("aspectTerms"))
    rows = rows.unionByName(rows.filter("_id % 5 = 0"))
    for name, rest in (("restaurants", 0), ("laptops", 1)):
        rows.filter(F.col("_id") % 2 == rest).write.format("xml").option("rootTag", "sentences").option("rowTag", "sentence").save(f"{path}/{name}.xml")


query(
    "SC8_read_aspect_xml",
    """SELECT 'S'||CASE WHEN a.sentence_id%2=0 THEN 'res' ELSE 'lap' END||'_'||a.sentence_id AS sentence_id, trim(regexp_replace(COALESCE(d.text,''), '[^A-Za-z0-9]+', ' ', 'g')) AS text,
      array_to_string(polarities,',') AS polarities FROM aspects a JOIN documents d ON d.doc_id=a.sentence_id""",
)(
    lambda v: through(
        v, "aspects_xml", lambda p: write_sentences(v, p),
        lambda p: RD.read_aspect_xml(v.spark, f"{p}/*").select("sentence_id", "text", F.array_join("polarities", ",").alias("polarities")),
    )
)
query("SK1_write_parquet_zstd", f"SELECT doc_id, lang, yr, {TEXT_HASH} AS text_hash FROM docs")(
    lambda v: through(
        v, "docs_parquet",
        lambda p: WR.write_parquet_zstd(v.docs.select("doc_id", "lang", "yr", "text_hash"), p, ["lang"]),
        lambda p: RD.read_parquet(v.spark, p, ["doc_id", "lang", "yr", "text_hash"]),
    )
)
query("SK2_write_csv", "SELECT yr, count(*) n, avg((y=0)::INT) neg, avg((y=1)::INT) neu, avg((y=2)::INT) pos FROM pool GROUP BY yr")(
    lambda v: through(
        v, "label_csv",
        lambda p: WR.write_csv(P.class_shares(v.items, ["yr"]), p),
        lambda p: RD.read_csv_typed(v.spark, p, "yr int, n bigint, neg double, neu double, pos double"),
    )
)
query(
    "SK3_write_summary",
    """SELECT count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, (SELECT count(*) FROM (SELECT 1 FROM reviews GROUP BY user_id, asin, ts, text_hash HAVING count(*)>1)) AS n_dup_groups FROM reviews""",
)(
    lambda v: through(
        v, "summary",
        lambda p: WR.write_summary(WR.summary_struct(basic=P.basic_profile(v.records), duplicates=D.exact_record_duplicates(v.reviews)), p),
        lambda p: v.spark.read.schema(
            "basic struct<n_reviews: bigint, n_users: bigint>, duplicates struct<n_groups: bigint>"
        ).json(p).select("basic.n_reviews", "basic.n_users", F.col("duplicates.n_groups").alias("n_dup_groups")),
    )
)
query(
    "SK4_remaining",
    "SELECT item_id, yr FROM rated_items WHERE item_id NOT IN (SELECT item_id FROM rater_log WHERE model='rater_c' AND label IS NOT NULL)",
)(lambda v: INC.remaining(v.rated_items.select("item_id", "yr"), v.rater_log.filter("model = 'rater_c'")))
query("SK6_save_membership", "SELECT sample, item_id FROM samples")(
    lambda v: through(
        v, "membership",
        lambda p: WR.save_membership(v.samples, p),
        lambda p: RD.read_csv_typed(v.spark, p, "sample string, item_id string"),
    )
)
_POS = " OR ".join(f"contains(t,'{w}')" for w in X.POSITIVE_CUES)
_NEG = " OR ".join(f"contains(t,'{w}')" for w in X.NEGATIVE_CUES)


def _resume(v):
    """First run labels the English items and fails on the rest; the second picks up what is left."""
    docs = v.table("documents").select(F.col("doc_id").alias("item_id"), "lang", "text")
    path = folder(v, "label_log")
    label = X.keyword_annotator("text")
    INC.append_resume(docs, path, lambda d: d.select("item_id", F.when(F.col("lang") == "en", label).alias("label")))
    log = INC.append_resume(docs, path, lambda d: d.select("item_id", label.alias("label")))
    return log.filter("label IS NOT NULL")


query(
    "SK4_append_resume",
    f"""SELECT item_id, CASE WHEN p AND n THEN 'MIXED' WHEN p THEN 'POSITIVE' WHEN n THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label
    FROM (SELECT item_id, ({_POS}) AS p, ({_NEG}) AS n FROM (SELECT doc_id AS item_id, lower(text) AS t FROM documents))""",
)(_resume)


def _once(v):
    """The second call must read what the first one built."""
    path = folder(v, "once")
    INC.build_once(v.spark, path, lambda: v.items.groupBy("yr").agg(F.count(F.lit(1)).alias("n")))
    return INC.build_once(v.spark, path, lambda: v.items.groupBy("yr").agg(F.lit(0).alias("n")))


query("SK5_build_once", "SELECT yr, count(*) AS n FROM pool GROUP BY yr")(_once)
query(
    "UD1_score_with_function",
    "SELECT doc_id AS item_id, CASE WHEN length(text)>2000 THEN 'LONG' ELSE 'SHORT' END AS label FROM documents",
)(
    lambda v: INC.score_with(
        v.table("documents").select(F.col("doc_id").alias("item_id"), "text"), lambda t: "LONG" if len(t or "") > 2000 else "SHORT"
    )
)
