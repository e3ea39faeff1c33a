"""INSERT IGNORE with several keys, UPDATE IGNORE in row order, names without
collisions: against row-by-row simulations."""

import random

import pytest
from pyspark.sql import functions as F

from pressferry.operators import audit, dml, repair, terms

KEYS = ["a", "b", ("c", "d")]
SCHEMA = "a long, b string, c long, d string, o long"


def key_values(row):
    a, b, c, d = row[:4]
    return [("a", a)] * (a is not None) + [("b", b)] * (b is not None) + [("cd", c, d)] * (c is not None and d is not None)


def simulate_keys(existing, incoming):
    taken = {v for row in existing for v in key_values(row)}
    out = list(existing)
    for row in sorted(incoming, key=lambda r: r[4]):
        if not taken & set(key_values(row)):
            taken |= set(key_values(row))
            out.append(row)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_insert_ignore_keys_equals_the_rows_one_by_one(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *range(n)])
    text = lambda n: None if (v := pick(n)) is None else f"t{v}"
    row = lambda o: (pick(30 + 20 * seed), text(40), pick(6), text(8), o)
    existing = [(100 + i, f"e{i}" if i % 2 else f"t{i}", i, f"t{i}", None) for i in range(4)]
    incoming = [row(i) for i in rng.sample(range(1000), 160)]
    rounds = []
    got = dml.insert_ignore_keys(spark.createDataFrame(existing, SCHEMA), spark.createDataFrame(incoming, SCHEMA).repartition(3), KEYS, ["o"], rounds=rounds)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == simulate_keys(existing, incoming)
    assert len(rounds) <= 10 and rounds[0]["accepted"] > 0


def test_a_chain_of_conflicts_takes_one_round(spark):
    n = 10_000  # row i shares b with row i - 1 or c, d with it, in turn
    incoming = spark.range(n).select(
        F.col("id").alias("a"), F.format_string("b%d", F.floor((F.col("id") + 1) / 2)).alias("b"), F.floor(F.col("id") / 2).alias("c"),
        F.lit("x").alias("d"), F.col("id").alias("o"))
    rounds = []
    got = dml.insert_ignore_keys(spark.createDataFrame([], SCHEMA), incoming, KEYS, ["o"], rounds=rounds)
    assert sorted(r["a"] for r in got.collect()) == list(range(0, n, 2))
    assert len(rounds) == 1 and rounds[0]["chain_steps"] <= 15


def test_insert_ignore_keys_hot_group_and_empty(spark):
    hot = spark.range(3000).select(F.col("id").alias("a"), F.lit("same").alias("b"), F.lit(None).cast("long").alias("c"), F.lit("x").alias("d"), (3000 - F.col("id")).alias("o"))
    rounds = []
    got = dml.insert_ignore_keys(spark.createDataFrame([], SCHEMA), hot, KEYS, ["o"], rounds=rounds)
    assert [r["a"] for r in got.collect()] == [2999] and len(rounds) == 1
    assert dml.insert_ignore_keys(spark.createDataFrame([], SCHEMA), hot.limit(0), KEYS, ["o"]).count() == 0


def simulate_moves(rows, to):
    held = set(rows)
    for obj, old in sorted(rows):
        new = to.get(old, old)
        if new != old and (obj, new) not in held:
            held.remove((obj, old))
            held.add((obj, new))
    return sorted(held)


@pytest.mark.parametrize("seed", range(4))
def test_update_ignore_equals_the_rows_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(rng.randrange(6), rng.randrange(25)) for _ in range(90)})
    to = {i: rng.randrange(25) for i in range(25) if rng.random() < 0.8}
    rel = spark.createDataFrame(rows, "object_id long, term_taxonomy_id long").repartition(3)
    tax = spark.createDataFrame(list(to.items()), "term_id long, term_taxonomy_id long")
    steps = []
    got = sorted(tuple(r) for r in terms.fix_taxonomy_ids(rel, tax, steps).collect())
    assert got == simulate_moves(rows, to) and len(got) == len(rows)


def test_update_ignore_follows_long_chains(spark):
    n = 100_000  # a hot object: every row waits for the one before
    rel = spark.range(1, n + 1).select(F.lit(7).cast("long").alias("object_id"), F.col("id").alias("term_taxonomy_id"))
    shift = spark.range(1, n + 1).select(F.col("id").alias("term_id"), (F.col("id") - 1).alias("term_taxonomy_id"))
    steps = []
    got = terms.fix_taxonomy_ids(rel, shift, steps)
    low, high, count = got.agg(F.min("term_taxonomy_id"), F.max("term_taxonomy_id"), F.count_distinct("term_taxonomy_id")).first()
    assert (low, high, count) == (0, n - 1, n) and steps[0] <= 18
    held = rel.unionByName(spark.createDataFrame([(7, 0)], rel.schema))  # the first finds 0 held: nobody moves
    got = terms.fix_taxonomy_ids(held, shift, steps)
    assert got.exceptAll(held).count() == 0 and steps[1] <= 18
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "term_id long, term_taxonomy_id long")
    rows = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    got = sorted(tuple(r) for r in terms.fix_taxonomy_ids(spark.createDataFrame(rows, rel.schema), cycle).collect())
    assert got == simulate_moves(rows, {1: 2, 2: 3, 3: 1})


def test_update_ignore_runs_in_small_tasks(spark, monkeypatch):
    key, seen = "spark.sql.adaptive.advisoryPartitionSizeInBytes", []
    before = spark.conf.get(key)
    monkeypatch.setattr(terms, "settled", lambda df: (seen.append(spark.conf.get(key)), dml.settled(df))[1])
    rows = [(1, 4), (1, 5), (1, 9), (2, 5), (None, 4), (None, 5), (None, 8), (3, None), (3, 6)]
    rel = spark.createDataFrame(rows, "object_id long, term_taxonomy_id long")
    tax = spark.createDataFrame([(5, 4), (4, 3), (9, 4), (8, 8), (8, 7), (8, 7), (6, None), (None, 1)], "term_id long, term_taxonomy_id long")
    got = [tuple(r) for r in terms.fix_taxonomy_ids(rel, tax).collect()]
    want = [(1, 3), (1, 4), (1, 9), (2, 4), (None, 3), (None, 4), (None, 7), (3, None), (3, 6)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert seen and set(seen) == {"8m"} and spark.conf.get(key) == before
    with dml.small_tasks(spark, 1 << 20):  # the session's size is less: it stays
        assert spark.conf.get(key) == before


def names(df):
    return {r["tid"]: r["name"] for r in df.collect()}


TERM = "tid long, vid long, name string, description string"


def test_safe_repair_reserves_names(spark):
    given = spark.createDataFrame([(5, 1, "a", None), (6, 1, "a", None), (9, 1, "a_5", None)], TERM)
    rounds = []
    fixed = repair.fix_term_names(given, safe=True, rounds=rounds)
    assert names(fixed) == {5: "a_5_2", 6: "a_6", 9: "a_5"} and rounds == [2, 1]
    assert repair.residual_collisions(fixed).count() == 0
    assert names(repair.uniquify_terms(given, safe=True)) == {5: "a_5_2", 6: "a_6"}
    assert names(repair.fix_term_names(given)) == {5: "a_5", 6: "a_6", 9: "a_5"}  # as the original does


def test_safe_repair_chains_limit_and_nulls(spark):
    long = "x" * 210
    rows = [(5, "a"), (6, "a"), (9, "a_5"), (10, "a_5_2"), (11, "a_5_3"), (12, "b"), (20, long), (21, long + "y"), (22, long[:200]), (23, "x" * 197 + "_20"), (30, None), (31, None), (40, "a_6"), (41, "a_6")]
    given = spark.createDataFrame([(t, 1, n, None) for t, n in rows], TERM)
    rounds = []
    got = names(repair.fix_term_names(given, safe=True, rounds=rounds))
    kept = {9: "a_5", 10: "a_5_2", 11: "a_5_3", 12: "b", 22: long[:200], 23: "x" * 197 + "_20", 30: None, 31: None}
    assert {t: got[t] for t in kept} == kept
    full = [n for n in got.values() if n is not None]
    assert len(set(full)) == len(full) and max(map(len, full)) <= 200 and got[5] == "a_5_4"
    assert len(rounds) == 4 and len(got) == len(rows)
    stemmed = names(repair.fix_term_names(given, safe=True, null_name_stem="term"))
    assert (stemmed[30], stemmed[31]) == ("term_30", "term_31")


@pytest.mark.parametrize("collation, equal", [
    ("ci", [("ΟΔΟΣ", "οδοσ"), ("Foo", "foo  "), ("Å", "å")]),
    ("ci_ai", [("Étage", "etage"), ("ΟΔΟΣ", "οδός"), ("Foo ", "fOO"), ("naïve", "NAIVE")]),
])
def test_audit_repair_and_upsert_agree_on_a_collation(spark, collation, equal):
    rows = [(2 * i + k + 1, 1, n, None) for i, pair in enumerate(equal) for k, n in enumerate(pair)] + [(100, 1, "alone", None), (101, 1, "Straße", None), (102, 1, None, None)]
    given = spark.createDataFrame(rows, TERM)
    members = {t for t, _, n, _ in rows if t < 100}
    assert {r["tid"] for r in audit.dup_term_names(given, collation=collation).where("name IS NOT NULL").collect()} == {t for t in members if t % 2}
    assert {r["tid"] for r in audit.dup_term_members(given, collation=collation).collect()} == members
    assert set(names(repair.uniquify_terms(given, collation=collation))) == members
    fixed = repair.fix_term_names(given, safe=True, collation=collation)
    assert audit.dup_term_names(fixed, collation=collation).where("c > 1 AND name IS NOT NULL").count() == 0
    alias = given.selectExpr("tid AS pid", "name AS src", "'d' AS dst")
    assert {r["pid"] for r in audit.dup_aliases(alias.where("src IS NOT NULL"), collation=collation).collect()} == {t for t in members if t % 2}
    assert {r["pid"] for r in repair.uniquify_aliases(alias, collation=collation).collect()} == {t for t in members if t % 2} | {100, 101, 102}

    # Upserts take the key's own collation.
    table = audit.collate_columns(given.select("tid", "name"), collation, ["name"])
    first, second = table.where("tid % 2 = 1 OR tid >= 100"), table.where("tid % 2 = 0 AND tid < 100")
    assert {r["tid"] for r in dml.replace_into(first, second, ["name"], order=["tid"]).collect()} == {t for t in members if t % 2 == 0} | {100, 101, 102}
    assert {r["tid"] for r in dml.insert_ignore(first, second, "name", order=["tid"]).collect()} == {t for t in members if t % 2} | {100, 101, 102}
    assert {r["tid"] for r in dml.insert_ignore_keys(first.limit(0), table, ["tid", "name"], ["tid"]).collect()} == {t for t in members if t % 2} | {100, 101, 102}
    with pytest.raises(Exception, match="duplicate key"):
        dml.insert(first, second, "name").collect()
    probe = dml.not_in_flag(second, "name", first.where("name IS NOT NULL"), "name", out="f")
    assert [r["f"] for r in probe.collect()] == [False] * len(equal)
