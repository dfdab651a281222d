"""Tables without texts, draws by hex digits and counts of touched keys give what the wider forms give."""

from pyspark.sql import functions as F

from tidemark.functions.keys import seeded_ph
from tidemark.operators import duplicates, joins, sampling
from tidemark.plans.views import RECORD_COLUMNS, Views


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_pool_without_texts_chooses_the_same_copies(spark):
    ts = 1_400_000_000_000
    row = lambda votes, rating, text, parent="P1", user="U1": (rating, text, "A", parent, user, ts, votes, True, "h", len(text), 2014)
    columns = "rating double, text string, asin string, parent_asin string, user_id string, ts long, helpful_vote long, verified_purchase boolean, text_hash string, text_len int, yr int"
    reviews = spark.createDataFrame(
        [row(1, 5.0, "a  b"), row(2, 4.0, "A b"), row(2, 4.0, "a b", "P2"), row(None, 5.0, "a b"), row(3, 1.0, "x", None, "U2"), row(3, 1.0, " x", None, "U2"), row(9, 2.0, "", user="U3")],
        columns,
    )
    lean = duplicates.dedup_pool(reviews.drop("text", "verified_purchase"), texts=False)
    assert rows_of(lean) == rows_of(duplicates.dedup_pool(reviews).select(lean.columns)) and lean.count() == 2


def test_records_and_items_are_made_without_texts(spark, tmp_path):
    own = Views(spark, "/root/testdata/sf0.001/")
    own.stage_path = lambda name: f"{tmp_path}/{name}"
    assert own.items.count() > 0 and own.records.columns == list(RECORD_COLUMNS)
    assert own.staged("records") and not own.staged("reviews") and not own.staged("pool")
    assert rows_of(own.items) == rows_of(own.pool.select(own.items.columns))
    assert rows_of(own.records) == rows_of(own.reviews.select(own.records.columns))


def test_hex_buckets_draw_as_numbers_do(spark):
    df = spark.range(500).select(F.when(F.col("id") % 50 != 0, F.col("id").cast("string")).alias("id"), (F.col("id") % 3).alias("g"))
    for bits in (3, 4, 12):
        got = sampling.bottom_n(df.filter("id IS NOT NULL"), "id", 7, 5, ["g"], 3, bits)
        want = df.filter("id IS NOT NULL").selectExpr("*").withColumn("h", seeded_ph(5, "id"))
        want = want.collect()
        assert {(r.g, r.id) for r in got.collect()} == {(g, r.id) for g in range(3) for r in sorted((r for r in want if r.g == g), key=lambda r: r.h)[:7]}
        assert sampling.bottom_n(df, "id", 500, 5, bits=bits).filter("id IS NULL").count() == 0


def shuffled(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_rows_of_sampled_keys_are_counted(spark):
    pool = spark.createDataFrame([(f"i{i}", "u", "p", f"h{i // 2 % 500}", i % 3) for i in range(2000)] + [("n", None, "p", "h0", 1)], "item_id string, user_id string, parent_asin string, text_hash string, y int")
    sample = spark.createDataFrame([("i0",), ("i1",), ("i1",), ("n",)], "item_id string")
    got = duplicates.nonunique_items(pool, sample)
    want = [r for r in pool.collect() if r.item_id in ("i0", "i1")]
    alike = [r for r in pool.collect() if r.user_id == "u" and r.text_hash == "h0"]
    assert {(r.item_id, r.n_key, r.n_key_and_label) for r in got.collect()} == {(w.item_id, len(alike), sum(r.y == w.y for r in alike)) for w in want}
    assert got.count() == 2 and shuffled(got).count("LeftSemi") >= 2  # by the touched keys before and after the count


def test_candidates_are_picked_before_they_are_folded(spark):
    reviews = spark.createDataFrame([("u", "p", f"h{i % 400}", "A", i // 800, 3.0) for i in range(1600)], "user_id string, parent_asin string, text_hash string, asin string, ts long, rating double")
    items = spark.createDataFrame([("i", "u", "p", "h7"), ("j", "u", "p", "h7"), ("k", None, "p", "h7")], "item_id string, user_id string, parent_asin string, text_hash string")
    rows = joins.candidate_rows(items, reviews).collect()
    assert sorted((r.item_id, r.ts) for r in rows) == sorted((i, t) for i in "ij" for t in (0, 0, 1, 1))
