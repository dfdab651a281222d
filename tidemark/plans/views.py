"""Analysis tables derived from a folder of Parquet tables, staged once and reused.

``Views`` builds each table on first use, writes it as Parquet under the shared folder and hands
out scans of it, so later plans prune columns and push filters down instead of repeating joins.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions.hashes import ph_prefixed
from tidemark.functions.keys import composite_key, ph
from tidemark.functions.text import LABELS
from tidemark.functions.time import epoch_month, epoch_year
from tidemark.operators import duplicates, sampling, splits
from tidemark.session import configure, shared_folder
from tidemark.streaming.incremental import build_once, exists

# Parameters of the derived tables.
FIRST_YEAR, LAST_YEAR = 1995, 2001
TRAIN_YEARS, TEST_YEARS, RECENT_YEARS = (1995, 1996), (1997, 2001), (1999, 2000)
N_TRAIN, N_TEST = 2000, 500
#: Rows of the part table that are sent to every task (about 20 MB); larger tables are joined by a shuffle.
BROADCAST_PARTS = 200_000
#: Columns of a record that are no free text and no running key.
RECORD_COLUMNS = (
    "rating", "asin", "parent_asin", "user_id", "ts", "helpful_vote", "verified_purchase", "n_images", "text_hash", "text_len", "yr",
)
MODELS = ("big", "small")
SEEDS = (42, 43, 44)
# (model, train_set, start accuracy per mille, change per year per mille)
RUNS = (("big", "early", 820, -25), ("small", "early", 760, -15), ("big", "recent", 840, -10), ("small", "recent", 800, -5))
RATERS = (("rater_a", 75), ("rater_b", 80), ("rater_c", 85))
OTHER_LABELS = ("POSITIVE", "MIXED", "NEUTRAL", "UNCLEAR")
PHRASES = (
    "terrible, it broke at once",
    "bad and it stopped working",
    "okay, not much to add",
    "good value for the money",
    "great, I love it",
)


def pick(values, i: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[i]


def mod(key: Column, n: int) -> Column:
    return F.pmod(ph(key), F.lit(n))


def pre(tag: str, k: Column) -> Column:
    return F.concat(F.lit(tag), k)


#: What a record's key decides: name, tag of the hash, number of outcomes.
MODS = (
    ("d", "d", 50), ("v", "v", 50), ("c", "c", 100), ("s", "s", 10), ("q", "q", 5), ("t", "t", 10), ("w", "w", 7), ("m", "m", 200),
    ("n", "n", 400), ("b", "b", 11), ("x", "x", 13), ("e", "e", 8), ("e30", "e", 30), ("z", "z", 500),
)


@F.arrow_udf(StructType([StructField(name, IntegerType()) for name, _, _ in MODS]))
def key_mods(keys: pa.Array) -> pa.Array:
    """``mod(pre(tag, k), n)`` for all of ``MODS``, hashed together."""
    tags = sorted({tag for _, tag, _ in MODS})
    found = dict(zip(tags, ph_prefixed(tags, keys)))
    return pa.StructArray.from_arrays([pa.array((found[tag] % n).astype(np.int32)) for _, tag, n in MODS], [name for name, _, _ in MODS])


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """A table in one small file scans as one task; give its rows to all cores. Larger tables stay as they are."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 8) else df

    def stage(self, name: str, make) -> DataFrame:
        return build_once(self.spark, self.stage_path(name), make)

    def stage_path(self, name: str) -> str:
        app = self.spark.sparkContext.applicationId
        tag = hashlib.md5(self.dir.encode()).hexdigest()[:8]
        return f"{shared_folder(self.spark)}/tidemark/{app}/{tag}/{name}"

    def staged(self, name: str) -> bool:
        return exists(self.spark, self.stage_path(name))

    # ---- records -------------------------------------------------------------------------

    def raw_source(self) -> DataFrame:
        """Records in the raw input layout, with injected copies and odd rows."""
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
        part = F.broadcast(part) if part.count() <= BROADCAST_PARTS else part.hint("shuffle_hash")
        # Hashed, not sorted: lines are several times as many as orders, and sorting them twice is half of this plan's time.
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority").hint("shuffle_hash")
        line = self.spread(self.table("lineitem"))
        j = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
        day = F.col("l_shipdate").cast("date")
        k = composite_key(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day, F.col("l_quantity").cast("bigint")
        )
        j = j.withColumn("k", k).withColumn("r0", F.lit(1) + F.floor((F.col("l_quantity") - 1) / 10).cast("int"))
        j = j.withColumn("u", key_mods(F.col("k")))
        k, u = F.col("k"), lambda name: F.col("u")[name]
        copies = F.array_compact(
            F.array(
                F.lit(0),
                F.when(u("d") == 0, 1),
                F.when(u("v") == 0, 2),
                F.when(u("c") == 0, 3),
            )
        )
        j = j.withColumn("copy", F.explode(copies))
        copy = F.col("copy")
        tone = F.when(u("s") < 8, F.col("r0") - 1).otherwise(u("q").cast("int"))
        order = F.when(
            u("t") < 8, F.concat(F.lit(" under order "), F.col("l_orderkey").cast("string"))
        ).otherwise(F.lit(""))
        words = F.concat(
            F.lit("The "), "p_name", F.lit(" by "), "p_brand", F.lit(" in the "), "p_type", F.lit(" line came as "),
            "o_orderpriority", order, F.lit(": "), pick(PHRASES, tone),
        )
        # Its own column: used several times below, evaluated once per row.
        j = j.withColumn("words", words)
        look, stock, odd, words = u("w"), u("m"), u("n"), F.col("words")
        shaped = (
            F.when(look == 0, F.concat(F.replace(words, F.lit(" "), F.lit("  ")), F.lit("\n")))
            .when(u("b") == 0, F.concat(F.lit("<b>"), words, F.lit("</b> !!")))
            .when(u("x") == 0, F.upper(words))
            .otherwise(words)
        )
        stocked = F.when(
            stock == 0,
            F.concat(F.lit("Thank you for this purchase, stock sentence of the seller number "), u("e").cast("string")),
        ).when(
            stock == 1,
            F.concat(F.lit("I was asked to leave these words, stock sentence of the brand number "), u("e30").cast("string")),
        ).otherwise(shaped)
        text = (
            F.when(odd == 0, F.lit(""))
            .when(odd == 1, F.lit(None).cast("string"))
            .when(odd == 2, F.substring(words, 1, 50))
            .otherwise(stocked)
        )
        shelf = F.pmod(F.col("l_suppkey"), F.lit(4))
        partkey = F.when(copy == 3, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
        parent = F.concat(F.lit("P"), partkey.cast("string"))
        variant = F.when(copy == 2, F.pmod(shelf + 1, F.lit(4))).otherwise(shelf)
        rating = F.when(u("z") == 0, 0).when(copy == 3, 6 - F.col("r0")).otherwise(F.col("r0"))
        stamp = (
            F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000
            + F.col("l_linenumber").cast("bigint") * 3_600_000
        )
        return j.select(
            F.concat(k, F.lit("#"), copy.cast("string")).alias("item_key"),
            rating.cast("double").alias("rating"),
            F.col("p_name").alias("title"),
            text.alias("text"),
            F.when(F.pmod(F.col("l_suppkey"), F.lit(3)) > 0, F.array_repeat(F.lit("img"), F.pmod(F.col("l_suppkey"), F.lit(3)).cast("int"))).alias("images"),
            F.concat(parent, F.lit("-"), variant.cast("string")).alias("asin"),
            parent.alias("parent_asin"),
            F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("user_id"),
            stamp.alias("timestamp"),
            (F.col("l_linenumber") + F.when(copy == 1, 1).otherwise(0)).cast("bigint").alias("helpful_vote"),
            (F.col("l_linestatus") == "F").alias("verified_purchase"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        return self.stage("reviews", lambda: duplicates.normalise_reviews(self.raw_source()))

    @cached_property
    def records(self) -> DataFrame:
        """``reviews`` without item_key, title and text, which most queries never read: their table is a third as large."""
        if self.staged("reviews"):
            return self.reviews.select(*RECORD_COLUMNS)
        return self.stage("records", lambda: duplicates.normalise_reviews(self.raw_source()).select(*RECORD_COLUMNS))

    @cached_property
    def meta(self) -> DataFrame:
        part = self.table("part")
        key = F.col("p_partkey").cast("string")
        cut = mod(pre("a", key), 20)
        path = (
            F.when(cut == 0, F.array(F.lit("Catalog")))
            .when(cut == 1, F.array(F.lit("Catalog"), F.lit(""), F.col("p_name")))
            .otherwise(F.array(F.lit("Catalog"), F.col("p_brand"), F.col("p_name")))
        )
        copies = F.when(mod(pre("2", key), 50) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return (
            part.filter(mod(pre("l", key), 20) != 0)
            .withColumn("copy", F.explode(copies))
            .select(
                F.concat(F.lit("P"), key).alias("parent_asin"),
                F.col("p_type").alias("main_category"),
                path.alias("categories"),
                (F.lit(1) + F.pmod(F.col("p_size"), F.lit(5))).cast("double").alias("average_rating"),
                (F.col("p_size") + F.col("copy")).cast("bigint").alias("rating_number"),
            )
        )

    @cached_property
    def pool(self) -> DataFrame:
        return self.stage("pool", lambda: duplicates.dedup_pool(self.reviews, FIRST_YEAR, LAST_YEAR))

    @cached_property
    def items(self) -> DataFrame:
        """``pool`` without text, text_len and verified_purchase, made from ``records``."""
        if self.staged("pool"):
            return self.pool.drop("text", "text_len", "verified_purchase")
        return self.stage("items", lambda: duplicates.dedup_pool(self.records, FIRST_YEAR, LAST_YEAR, texts=False))

    @cached_property
    def samples(self) -> DataFrame:
        return self.stage("samples", self._samples)

    def _samples(self) -> DataFrame:
        """Tests are staged before the retraining sample that must avoid them is drawn."""
        base = self.items.select("item_id", "yr", "y")
        fixed = self.stage("samples_fixed", lambda: splits.temporal_samples(base, TRAIN_YEARS, TEST_YEARS, N_TRAIN, N_TEST))
        tests = fixed.filter(F.col("sample").startswith("test"))
        recent = splits.train_excluding(base, tests, RECENT_YEARS, N_TRAIN, 42)
        name = F.lit(f"train_{RECENT_YEARS[0]}_{RECENT_YEARS[1]}")
        return fixed.unionByName(recent.withColumn("sample", name))

    # ---- predictions -----------------------------------------------------------------------

    members = tuple((m, t, s) for m, t, _, _ in RUNS for s in SEEDS)
    early = tuple((m, t, s) for m, t, _, _ in RUNS if t == "early" for s in SEEDS)

    #: Column of each run in ``preds_by_item``.
    run_columns = {member: f"pred_{i}" for i, member in enumerate(members)}

    @cached_property
    def preds_by_item(self) -> DataFrame:
        """``preds`` with one row per item and a column of classes per run."""
        return self.stage("preds", self._preds)

    @cached_property
    def preds(self) -> DataFrame:
        """One row per item and run. Staged with one row per item: a run adds a small number to it, not a copy of its keys."""
        wide = self.preds_by_item
        runs = [
            F.struct(F.lit(m).alias("model"), F.lit(t).alias("train_set"), F.lit(s).alias("seed"), F.col(c).alias("pred"))
            for (m, t, s), c in self.run_columns.items()
        ]
        j = wide.withColumn("run", F.explode(F.array(*runs))).select("*", "run.*")
        p = lambda c: pick((0.6, 0.1, 0.3), F.pmod(F.col("pred") - c, F.lit(3)).cast("int"))
        return j.select(
            "model", "train_set", "seed", F.concat(F.col("yr").cast("string"), F.lit("_natural")).alias("test_set"),
            "item_id", "yr", "month", "y", "pred", p(0).alias("p_neg"), p(1).alias("p_neu"), p(2).alias("p_pos"),
            "user_id", "parent_asin",
        )

    def _preds(self) -> DataFrame:
        items = self.spread(
            self.items.filter(F.col("yr").between(*TEST_YEARS)).select("item_id", "yr", "month", "y", "user_id", "parent_asin")
        )
        runs, first = [(f"{m}|{t}|{s}|", a, d) for m, t, a, d in RUNS for s in SEEDS], TEST_YEARS[0]

        def predict(batches):
            for batch in batches:
                y, since = batch["y"].to_numpy(), batch["yr"].to_numpy() - first
                keys, columns = batch["item_id"], batch.columns
                hashes = ph_prefixed([r[0] for r in runs], keys)
                for h, e, (_, a, d) in zip(hashes, ph_prefixed([f"e{r[0]}" for r in runs], keys), runs):
                    pred = np.where(h % 1000 < a + d * since, y, (y + 1 + e % 2) % 3)
                    columns.append(pa.array(pred.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names)

        preds = list(self.run_columns.values())
        names = [*items.columns, *preds]
        schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in items.schema), *(f"{c} int" for c in preds)])
        return items.mapInArrow(predict, schema)

    @cached_property
    def zero_shot(self) -> DataFrame:
        """A label-only run over a fixed number of items per year."""
        items = self.items.filter(F.col("yr").between(*TEST_YEARS)).select("item_id", "yr", "y")
        picked = sampling.bottom_n(items, "item_id", 400, 2026, ["yr"], 5)
        right = mod(pre("zs", F.col("item_id")), 100) < 66
        pred = F.when(right, F.col("y")).otherwise(F.pmod(F.col("y") + 1, F.lit(3)))
        return picked.select("item_id", "yr", pick(("NEGATIVE", "NEUTRAL", "POSITIVE"), pred.cast("int")).alias("label"))

    # ---- documents and raters ------------------------------------------------------------

    @cached_property
    def docs(self) -> DataFrame:
        return self.stage("docs", self._docs)

    def _docs(self) -> DataFrame:
        from tidemark.functions.text import text_hash, text_len

        d = self.spread(self.table("documents"))
        copies = F.when(F.pmod(F.col("doc_id"), F.lit(10)) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        d = d.withColumn("copy", F.explode(copies))
        text = F.when(F.col("copy") == 1, F.concat(F.lit("<b>"), "text", F.lit("</b> 123"))).otherwise(F.col("text"))
        return d.select(
            (F.col("doc_id") * 2 + F.col("copy")).alias("doc_id"),
            text.alias("text"),
            "lang",
            "source",
            (F.lit(2013) + F.pmod(F.col("doc_id"), F.lit(11))).cast("int").alias("yr"),
            F.when(F.col("lang") == "en", 2).when(F.col("lang") == "es", 1).otherwise(0).alias("y"),
            F.concat(F.lit("U"), F.pmod(F.col("doc_id"), F.lit(211)).cast("string")).alias("user_id"),
            F.col("source").alias("parent_asin"),
        ).withColumn("text_hash", text_hash("text")).withColumn("text_len", text_len("text"))

    def doc_samples(self, train_years: tuple[int, int] = (2013, 2016)) -> tuple[DataFrame, DataFrame]:
        """Documents of the early years as train, later ones as tests named by year."""
        d = self.docs
        train = d.filter(F.col("yr").between(*train_years))
        tests = d.filter(F.col("yr") > train_years[1]).withColumn("test_set", F.concat(F.col("yr").cast("string"), F.lit("_natural")))
        return train, tests

    @cached_property
    def rated_items(self) -> DataFrame:
        """One row per rated document: star, year, period, category, length, true label and side facts."""
        d = self.table("documents")
        k = F.col("doc_id").cast("string")
        yr = (F.lit(2013) + F.pmod(F.col("doc_id"), F.lit(11))).cast("int")
        base = F.when(mod(pre("b", k), 100) < 30 + 4 * (yr - 2013), F.lit("NEGATIVE")).otherwise(
            pick(OTHER_LABELS, mod(pre("o", k), 4).cast("int"))
        )
        return d.select(
            F.col("doc_id").alias("item_id"),
            base.alias("base"),
            (F.lit(2) + mod(pre("s", k), 3)).cast("int").alias("rating_star"),
            yr.alias("yr"),
            F.when(yr <= 2016, "early").when(yr.between(2019, 2022), "late").alias("period"),
            F.col("source").alias("cat_l1"),
            F.length("text").alias("text_len"),
            F.when(base == "UNCLEAR", "NEUTRAL").otherwise(base).alias("gold"),
            F.when(F.pmod(F.col("doc_id"), F.lit(3)) == 0, "True").otherwise("False").alias("verified"),
            mod(pre("h", k), 20).cast("int").alias("helpful_vote"),
        )

    @cached_property
    def raters(self) -> DataFrame:
        """(item_id, rater, label): three raters who mostly agree; one label in fifty is missing."""
        items = self.rated_items
        who = F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.lit(a).alias("acc")) for r, a in RATERS]))
        j = items.select("item_id", "base", who.alias("w")).select("item_id", "base", "w.*")
        k = F.concat("rater", F.lit(":"), F.col("item_id").cast("string"))
        label = F.when(mod(pre("k", k), 100) < F.col("acc"), F.col("base")).otherwise(pick(LABELS, mod(pre("r", k), 5).cast("int")))
        return j.filter(mod(pre("miss", k), 50) != 0).select("item_id", "rater", label.alias("label"))

    @cached_property
    def rater_log(self) -> DataFrame:
        """The raters as an append-only log with failed and repeated attempts."""
        k = F.concat("rater", F.lit(":"), F.col("item_id").cast("string"))
        u = mod(pre("log", k), 20)
        tries = F.when(u < 2, F.array(F.lit(0), F.lit(2))).when(u == 2, F.array(F.lit(1), F.lit(2))).when(
            u == 3, F.array(F.lit(0))
        ).otherwise(F.array(F.lit(2)))
        j = self.raters.withColumn("try", F.explode(tries))
        t = F.col("try")
        return j.select(
            F.lit("items").alias("source"),
            F.col("rater").alias("model"),
            "item_id",
            F.when(t == 2, F.col("label")).when(t == 1, F.lit("UNCLEAR")).alias("label"),
            F.when(t == 0, F.lit("unparseable")).alias("error"),
            F.concat(F.lit("2024-01-01T00:00:0"), t.cast("string")).alias("utc"),
        )

    @cached_property
    def replies(self) -> DataFrame:
        """Raw annotator replies in every shape the parser must handle."""
        r = self.raters
        u = mod(pre("raw", F.col("item_id").cast("string")), 6)
        obj = lambda lab: F.concat(F.lit('{"label": "'), lab, F.lit('", "reason": "because"}'))
        lab = F.col("label")
        raw = (
            F.when(u == 0, obj(lab))
            .when(u == 1, F.concat(F.lit("<think>{\"label\": \"MIXED\"}\n so</think> "), obj(lab)))
            .when(u == 2, F.concat(obj(F.lit("MIXED")), F.lit(" then "), obj(lab)))
            .when(u == 3, obj(F.concat(F.lit(" "), F.lower(lab), F.lit(" "))))
            .when(u == 4, F.concat(F.lit("{label: broken "), lab))
            .otherwise(obj(F.lit("FINE")))
        )
        return r.select("rater", "item_id", raw.alias("raw"))

    @cached_property
    def aspects(self) -> DataFrame:
        d = self.table("documents")
        k = F.col("doc_id").cast("string")
        names = ("positive", "negative", "neutral", "conflict")
        pols = F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < mod(pre("cnt", k), 4)),
            lambda i: pick(names, F.least(mod(F.concat(F.lit("pol"), i.cast("string"), F.lit(":"), k), 7), F.lit(6)).cast("int") % 4),
        )
        return d.select(F.col("doc_id").alias("sentence_id"), pols.alias("polarities"))

    @cached_property
    def annotation_sample(self) -> DataFrame:
        rows = self.reviews.filter(F.col("text_len").between(20, 2000)).withColumn("rating_star", F.col("rating").cast("int"))
        return sampling.stratified_sample(rows, {3: 200, 2: 100, 4: 100}, (FIRST_YEAR, LAST_YEAR), 99)

    @cached_property
    def annotation_key(self) -> DataFrame:
        cols = ["item_id", "user_id", "asin", "ts", "yr", "rating_star"]
        return self.annotation_sample.select(*[F.col(c).cast("string").alias(c) for c in cols])


def ts_parts(ts: Column) -> tuple[Column, Column]:
    return epoch_year(ts), epoch_month(ts)
