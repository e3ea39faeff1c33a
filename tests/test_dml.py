"""Write-semantics kernel edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from pressferry.operators import dml

SCHEMA = "id bigint, slug string, v string, o bigint"


def df(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows(d, *cols):
    cols = cols or d.columns
    return sorted((tuple(r[c] for c in cols) for r in d.collect()), key=repr)


# K1 ------------------------------------------------------------------------

def simulate_replace(existing, incoming, keys):
    """Row-by-row REPLACE: delete every row equal on any key, then insert."""
    table = list(existing)
    for row in sorted(incoming, key=lambda r: r[3]):
        table = [t for t in table
                 if not any(t[k] is not None and t[k] == row[k] for k in keys)]
        table.append(row)
    return sorted(table, key=repr)


def test_replace_into_matches_sequential_simulation(spark):
    rng = random.Random(7)
    for _ in range(12):
        existing, used_id, used_slug = [], set(), set()
        for i in range(rng.randint(0, 6)):
            rid, slug = rng.randint(1, 8), rng.choice("abcdefg")
            if rid in used_id or slug in used_slug:
                continue
            used_id.add(rid)
            used_slug.add(slug)
            existing.append((rid, slug, f"e{i}", None))
        incoming = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), rng.choice([None, "a", "b", "c", "d", "e"]),
                     f"n{i}", i) for i in range(rng.randint(1, 10))]
        got = dml.replace_into(df(spark, existing), df(spark, incoming), ["id", "slug"], order=["o"])
        assert rows(got) == simulate_replace(existing, incoming, [0, 1])


def test_replace_into_single_key_later_row_wins(spark):
    existing = df(spark, [(1, "a", "old", None)])
    incoming = df(spark, [(1, "x", "first", 1), (1, "y", "second", 2), (2, "z", "new", 3)])
    got = dml.replace_into(existing, incoming, ["id"], order=["o"])
    assert rows(got, "id", "v") == [(1, "second"), (2, "new")]


def test_replace_into_defaults_and_extra_order(spark):
    existing = spark.createDataFrame([], "id bigint, v string, n bigint")
    incoming = spark.createDataFrame([(1, "a", 5), (1, "b", 9)], "id bigint, v string, tb bigint")
    got = dml.replace_into(existing, incoming, ["id"], order=["tb"], defaults={"n": 0})
    assert got.columns == ["id", "v", "n"]
    assert rows(got) == [(1, "b", 0)]


# K2 ------------------------------------------------------------------------

def test_insert_ignore_keeps_existing_and_first(spark):
    existing = df(spark, [(1, "a", "old", None)])
    incoming = df(spark, [(1, "b", "ignored", 1), (2, "c", "first", 2), (2, "d", "second", 3),
                          (None, "e", "null key", 4), (None, "f", "null key 2", 5)])
    got = dml.insert_ignore(existing, incoming, "id", order=["o"])
    assert rows(got, "id", "v") == sorted([(1, "old"), (2, "first"), (None, "null key"), (None, "null key 2")],
                                          key=repr)
    plain = dml.insert_ignore(existing, incoming)
    assert plain.count() == 6


# K3 ------------------------------------------------------------------------

def test_insert_duplicate_key_is_an_error(spark):
    existing = df(spark, [(1, "a", "x", None)])
    ok = dml.insert(existing, df(spark, [(2, "b", "y", None)]), "id")
    assert ok.count() == 2
    bad = dml.insert(existing, df(spark, [(1, "b", "y", None)]), "id")
    with pytest.raises(Exception, match="duplicate key"):
        bad.collect()


# K4 ------------------------------------------------------------------------

def test_insert_auto_id_is_dense_and_ordered(spark):
    existing = spark.createDataFrame([(5, "e"), (9, "i")], "term_id bigint, name string")
    incoming = spark.range(0, 500).select(F.format_string("n%04d", "id").alias("name")).repartition(7)
    got = dml.insert_auto_id(existing, incoming, "term_id", order=["name"])
    new = got.where(F.col("term_id") > 9).orderBy("term_id").collect()
    assert [r["term_id"] for r in new] == list(range(10, 510))
    assert [r["name"] for r in new] == sorted(r["name"] for r in new)


# K5 / K9 ---------------------------------------------------------------------

def test_update_where_null_predicate_changes_nothing(spark):
    d = df(spark, [(1, "a", "x", None), (2, None, "y", None)])
    got = dml.update_where(d, F.col("slug") == "a", {"v": F.lit("z")})
    assert rows(got, "id", "v") == [(1, "z"), (2, "y")]


def test_update_where_assignments_apply_left_to_right(spark):
    d = df(spark, [(1, "a", "x", 1)])
    got = dml.update_where(d, None, {"o": F.col("o") + 1, "v": F.col("o").cast("string")})
    assert rows(got, "o", "v") == [(2, "2")]


def test_delete_where_keeps_null_predicate_rows(spark):
    d = df(spark, [(1, "a", "x", None), (None, "b", "y", None), (5, "c", "z", None)])
    assert rows(dml.delete_where(d, F.col("id") > 1), "slug") == [("a",), ("b",)]


# K6 ------------------------------------------------------------------------

def test_update_from_join_sets_null_values_when_matched(spark):
    target = df(spark, [(1, "a", "x", None), (2, "b", "y", None)])
    source = spark.createDataFrame([(1, None), (3, "w")], "k bigint, nv string")
    got = dml.update_from_join(target, source, {"id": "k"}, {"v": "nv"})
    assert rows(got, "id", "v") == [(1, None), (2, "y")]


def test_update_from_join_picks_one_source_row(spark):
    target = df(spark, [(1, "a", "x", None)])
    source = spark.createDataFrame([(1, "q"), (1, "p")], "k bigint, nv string")
    got = dml.update_from_join(target, source, {"id": "k"}, {"v": "nv"})
    assert rows(got, "id", "v") == [(1, "p")]


# K7 / K8 ---------------------------------------------------------------------

def test_update_with_count_zero_and_null_key(spark):
    target = spark.createDataFrame([(1, 9), (2, 9), (None, 9)], "k bigint, c bigint")
    counted = spark.createDataFrame([(1, 10), (1, None), (1, 11), (5, 1)], "k bigint, x bigint")
    got = dml.update_with_count(target, "k", counted, "k", "c", count_col="x")
    assert rows(got) == sorted([(1, 2), (2, 0), (None, 0)], key=repr)


def test_scalar_lookup_null_when_missing_error_when_many(spark):
    target = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    empty = spark.createDataFrame([], "v string")
    got = dml.update_scalar_lookup(target, F.col("k") == "a", "v", empty)
    assert rows(got) == [("a", None), ("b", "2")]
    many = spark.createDataFrame([("x",), ("y",)], "v string")
    with pytest.raises(Exception):
        dml.update_scalar_lookup(target, F.col("k") == "a", "v", many).collect()


# K10 ---------------------------------------------------------------------------

def test_not_in_three_valued(spark):
    probe = spark.createDataFrame([(1,), (2,), (None,)], "p bigint")
    values = spark.createDataFrame([(1,), (3,)], "v bigint")
    got = dict(rows(dml.not_in_flag(probe, "p", values, "v", out="f")))
    assert got == {1: False, 2: True, None: None}
    with_null = spark.createDataFrame([(1,), (None,)], "v bigint")
    got = dict(rows(dml.not_in_flag(probe, "p", with_null, "v", out="f")))
    assert got == {1: False, 2: None, None: None}
    empty = spark.createDataFrame([], "v bigint")
    got = dict(rows(dml.not_in_flag(probe, "p", empty, "v", out="f")))
    assert got == {1: True, 2: True, None: True}


def test_update_where_not_in(spark):
    posts = spark.createDataFrame([(10, 1), (11, 7), (12, None)], "id bigint, post_author bigint")
    users = spark.createDataFrame([(1,), (2,)], "ID bigint")
    got = dml.update_where_not_in(posts, "post_author", users, "ID", {"post_author": F.lit(1)})
    assert rows(got) == [(10, 1), (11, 1), (12, None)]


def test_pick_one_spreads_a_hot_key(spark):
    """One key holding most rows still yields exactly one survivor."""
    hot = spark.range(0, 20000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    cold = spark.range(0, 100).select((F.col("id") + 2).alias("k"), F.col("id").alias("o"))
    got = dml.pick_one(hot.unionByName(cold), ["k"], ["o"], largest=True)
    assert got.count() == 101
    assert got.where("k = 1").first()["o"] == 19999


def simulate_insert_ignore(existing, incoming, key):
    """Row-by-row INSERT IGNORE: skip a row whose key is already present."""
    table = list(existing)
    for row in sorted(incoming, key=lambda r: r[3]):
        if row[key] is not None and any(t[key] == row[key] for t in table):
            continue
        table.append(row)
    return sorted(table, key=repr)


def test_insert_ignore_matches_sequential_simulation(spark):
    rng = random.Random(11)
    for _ in range(10):
        ids = rng.sample(range(1, 9), rng.randint(0, 5))
        existing = [(i, "e", f"e{i}", None) for i in ids]
        incoming = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), "n", f"n{i}", i) for i in range(rng.randint(1, 10))]
        got = dml.insert_ignore(df(spark, existing), df(spark, incoming), "id", order=["o"])
        assert rows(got) == simulate_insert_ignore(existing, incoming, 0)
