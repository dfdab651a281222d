"""Predictions with a column per run are counted as the long table is, and meet a category once per item."""

from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators import profile as P


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def tables(spark, n_runs):
    runs = {("m", f"t{i % 2}", i): f"pred_{i}" for i in range(n_runs)}
    n = [(i, f"P{i % 7}" if i % 11 else "P0", 1997 + i % 3, i % 3) for i in range(300)] + [(300, None, 1998, 1), (301, "P99", 1999, 0)]
    wide = spark.createDataFrame([(*r, *[None if (r[0] + k) % 50 == 0 else (r[3] + (r[0] * (k + 1)) % 4 // 3) % 3 for k in range(n_runs)]) for r in n], ", ".join(["item_id long, parent_asin string, yr int, y int", *[f"{c} int" for c in runs.values()]]))
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("train_set"), F.lit(s).alias("seed"), F.col(c).alias("pred")) for (m, t, s), c in runs.items()]))
    long = wide.withColumn("r", one).select("item_id", "parent_asin", "yr", "y", "r.*")
    meta = spark.createDataFrame([(f"P{i}", ["Catalog", f"c{i % 3}"]) for i in range(6)], "parent_asin string, categories array<string>")
    return wide, long, meta, runs


def test_runs_are_reweighted_as_in_the_long_table(spark):
    for n_runs in (2, 33):
        wide, long, meta, runs = tables(spark, n_runs)
        items = wide.filter("yr < 1999 OR item_id % 2 = 0")
        want = rows_of(D.mix_reweighted_f1(long, items, meta, 1997))
        assert want and rows_of(D.mix_reweighted_f1(wide, items, meta, 1997, runs)) == want


def test_large_product_tables_count_the_same_and_open_runs_after_the_join(spark, monkeypatch):
    wide, long, meta, runs = tables(spark, 3)
    small = P.count_by_category
    monkeypatch.setattr(D, "count_by_category", lambda *a, **k: small(*a, **{**k, "max_rows": 0}))
    cells = D._cells_of_runs(wide, runs, meta)
    keys = ["model", "train_set", "seed", "yr", "y", "pred"]
    assert rows_of(cells.select(*keys, "cat_l1", "n")) == rows_of(small(long, keys, meta).select(*keys, "cat_l1", "n"))
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftOuter")  # the tree is printed from its last step down


def test_the_mix_queries_read_a_row_per_item(views):
    from catalog import drift_queries, registry  # noqa: F401

    views.preds.limit(1).count()
    plan = registry.QUERIES["DR6_mix_reweighted_f1"](views)._jdf.queryExecution().optimizedPlan().toString()
    assert "_run" in plan and plan.index("Generate explode") < plan.index("pred_11")
