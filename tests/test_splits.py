"""Split plans against the rows they cut; Spark SQL stands in for the database."""

import random

import pytest

from pressferry.sources.splits import Split, plan_splits


def plan(spark, keys, parts, cells=16):
    spark.createDataFrame([(k,) for k in keys], "id long").createOrReplaceTempView("rows_to_split")
    asked = []

    def fetch(query):
        found = [tuple(r) for r in spark.sql(query).collect()]
        asked.append(len(found))
        return found

    splits = plan_splits(fetch, "rows_to_split", "id", parts, cells)
    for s in splits:
        assert spark.sql(f"SELECT count(*) FROM rows_to_split WHERE {s.predicate('id')}").first()[0] == s.rows
    assert sum(s.rows for s in splits) == len(keys) and max(asked) <= cells
    keyed = [s for s in splits if s.low is not None]
    assert all(a.high + 1 == b.low for a, b in zip(keyed[:-1], keyed[1:]))
    return splits


@pytest.mark.parametrize("seed", range(3))
def test_skewed_keys(spark, seed):
    rng = random.Random(seed)
    keys = [int(rng.paretovariate(0.5)) for _ in range(1500)] + [10 ** 12 + i for i in range(200)] + [None] * 30
    splits = plan(spark, keys, 8)
    mean = 1700 / 8
    for s in splits:
        assert s.rows <= 2 * mean or s.low == s.high or len({k for k in keys if k is not None and s.low <= k <= s.high}) == 1
    assert len(splits) <= 18


def test_even_hot_single_and_empty(spark):
    even = plan(spark, list(range(-500, 500)), 10)
    assert len(even) <= 20 and max(s.rows for s in even) <= 100
    hot = plan(spark, [7] * 900 + list(range(100)), 10)
    assert [s.rows for s in hot if s.low is not None and s.low <= 7 <= s.high][0] >= 901 - 100
    assert plan(spark, [5], 4) == [Split(5, 5, 1)]
    assert plan(spark, [], 4) == [Split(None, None, 0)] and plan(spark, [None, None], 4) == [Split(None, None, 2)]
