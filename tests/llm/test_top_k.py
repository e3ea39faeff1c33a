"""Operator 12 against brute force: ties, nulls, hot vectors, large numbers."""

import math
import random

import pytest

from pressferry.llm import top_k

SCHEMA = "vec_id long, embedding array<double>, label int, n long, block string"


def brute(rows, k=10, every=100, scale=1024):
    def fits(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if i is not None and fits(v)]
    out = []
    for q, a in kept:
        if q % every == 0:
            scored = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in kept if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = top_k.top_k(df, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_random_with_ties_and_hot_vectors(spark, seed):
    rng = random.Random(seed)
    hot = [rng.choice((-0.5, 0.0, 0.25)) for _ in range(6)]
    rows = [(i, hot if i % 3 == 0 else [rng.choice((-0.5, 0.0, 0.25, rng.gauss(0, 1))) for _ in range(6)], i, 7, "x") for i in range(420)]
    assert run(spark, rows, max_vectors=64, max_queries=2) == brute(rows)
    assert run(spark, rows, k=3, every=50, max_vectors=1000) == brute(rows, 3, 50)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], None, None, None), (1, [1.0, 2.0], 1, 1, "a"), (1, [1.0, 2.0], 1, 1, "a"), (2, None, 1, 1, "a"), (3, [nan, 1.0], 1, 1, "a"),
            (4, [inf, 1.0], 1, 1, "a"), (5, [None, 1.0], 1, 1, "a"), (None, [9.0, 9.0], 1, 1, "a"), (6, [1.0], 1, 1, "a"), (7, [], 1, 1, "a"),
            (100, [0.0, 0.0], 1, 1, "a"), (200, [], 1, 1, "a"), (300, [5.0], 1, 1, "a"), (-100, [-1.0, 0.5], 1, 1, "a"), (400, [1.0, 2.0], 1, 1, "a"), (400, [1.0, 2.0], 1, 1, "a")]
    assert run(spark, rows) == brute(rows)


def test_beyond_exact_doubles(spark):
    rows = [(i, [float(2 ** 40 + i), float(-(2 ** 38) - 3 * i), 1e30 if i % 7 == 0 else 1.0], i, i, "x") for i in range(0, 400, 4)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_search_stops_early():
    import numpy as np

    vectors = np.zeros((1000, 2))
    vectors[:, 0] = np.arange(1000)
    lists = top_k.SortedLists(np.arange(1000), vectors)
    scored = []
    inner = lists._scores
    lists._scores = lambda rows, query: scored.append(len(rows)) or inner(rows, query)
    ids, scores = lists.best(-1, np.array([1.0, 0.0]), 5)
    assert ids.tolist() == [999, 998, 997, 996, 995] and scores.tolist() == ids.tolist() and sum(scored) < 20
