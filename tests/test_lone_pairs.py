"""Counts of pairs move only items whose pair repeats; prediction files are written compressed and read back whole."""

from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.sources import readers, schemas, writers


def test_pair_counts_with_repeats_nulls_and_lone_pairs(spark):
    rows = [(f"i{i}", f"u{i}", "p", i % 3) for i in range(50)] + [(f"j{i}", "u", f"p{i % 2}", i % 3) for i in range(20)]
    rows += [("j0", "u", "p0", 0), ("a", None, "p0", 0), ("b", "u", None, 0), ("c", "u", "p1", None), ("d", "lone", "p", None)]
    items = spark.createDataFrame(rows, "item_id string, user_id string, parent_asin string, y int")
    got = J.pair_counts(items, ["user_id", "parent_asin"], "y")
    known = [r for r in rows if r[1] and r[2]]
    want = sorted((r[0], sum(q[1:3] == r[1:3] for q in known), sum(q[1:] == r[1:] for q in known)) for r in known if r[3] is not None)
    assert sorted((r.item_id, r.n_pair, r.n_pair_label) for r in got.collect()) == want
    branches = got._jdf.queryExecution().optimizedPlan().children()
    assert branches.size() == 2 and "Join Inner" not in branches.apply(0).toString()  # lone items are neither joined nor shuffled


def test_prediction_files_are_compressed(spark, views, tmp_path, monkeypatch):
    from catalog import registry, source_queries

    monkeypatch.setattr(source_queries, "folder", lambda v, name: f"{tmp_path}/{name}")
    read = registry.QUERIES["SC6_read_csv_typed"](views)
    files = [f.name for f in (tmp_path / "preds_csv").glob("part-*")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert read.count() == views.preds.count() and read.columns == ["item_id", "y", "pred", "p_neg", "p_neu", "p_pos"]
    plain = f"{tmp_path}/plain"
    writers.write_csv(views.preds.select(read.columns).limit(50), plain)
    assert readers.read_csv_typed(spark, plain, schemas.PREDS).filter(F.col("p_neg").isNotNull()).count() == 50
