"""Queries whose results carry the whole job, not a summary that any draw would give."""

import hashlib

from catalog import registry, sample_queries  # noqa: F401


def test_the_paired_subset_is_listed_item_by_item(views):
    rows = registry.QUERIES["SP10_paired_subset_same"](views).collect()
    order = lambda i: (hashlib.md5(f"2026:{i}".encode()).hexdigest()[:15], i)
    by_sample = {}
    for r in sample_queries.tests(views).select("sample", "item_id").collect():
        by_sample.setdefault(r.sample, []).append(r.item_id)
    expected = {(s, i) for s, items in by_sample.items() for i in sorted(items, key=order)[:200]}
    assert {(r.sample, r.item_id) for r in rows} == expected and all(r.same for r in rows)
    assert all(r.n == min(200, len(by_sample[r.sample])) for r in rows)
