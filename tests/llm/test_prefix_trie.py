"""Operator 13 against brute force over whole prefixes."""

import collections
import hashlib
import random
import re
import zlib

import pytest
import xxhash

from pressferry.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, a string, d int, rn long"


def spark_hash(*texts):
    seed = 42
    for t in texts:
        seed = xxhash.xxh64_intdigest(t.encode(), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, spark_hash(role, text), spark_hash("second lane", text, role), text))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        take = lambda x: [(t[2], t[5]) for t in sorted(own.get(x, []))]
        rebuilt[c] = tuple(take(first)[:h] + take(c)[h:])
    members, ends, children = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, way in rebuilt.items():
        for d in range(len(way) + 1):
            members[way[:d]].append(c)
            if d:
                children[way[:d - 1]].add(way[:d])
        ends[way].append(c)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, ids in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(ids) - 1) * words
    return sorted(((min(ids), len(n), min(members[n[:-1]]) if n else None, len(ids), len(children[n]), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, ids in members.items()), key=str)


def run(spark, rows, **options):
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def talk(rng, c, n, kinds=2):
    return [(c, t, rng.choice(("user", "assistant")), f"w{rng.randrange(kinds)} x  y{rng.randrange(kinds)}", "k", 3, 9) for t in range(n)]


@pytest.mark.parametrize("height, scan", [(2, 4), (3, 1024), (16, 8)])
def test_random_depths(spark, height, scan):
    rng = random.Random(height)
    rows = [r for c in range(0, 90) for r in talk(rng, c, rng.randrange(0, 9))]
    rows += talk(rng, 100, 70) + talk(rng, 117, 45)
    deep = talk(rng, 200, 50, kinds=9)
    rows += deep + [(c, *r[1:]) for c in (201, 202, 260, 261) for r in deep[:rng.randrange(20, 50)]]  # copies and prefixes of one another
    assert run(spark, rows, height=height, scan=scan) == brute(rows)


def test_a_third_under_one_id_and_copies(spark):
    rng = random.Random(5)
    rows = talk(rng, 40, 300, kinds=1) + [(c, t, "user", "the same words", None, None, None) for c in range(1000, 1150) for t in range(2)]
    rows += [(c, 0, "user", f"text {c}", None, None, None) for c in range(2000, 2060)]
    assert run(spark, rows, height=8, scan=32) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no id", "k", 1, 1), (20, None, "user", "null turn", None, None, None), (20, 0, None, "x y", "k", 1, 1), (20, 0, None, "x y", "k", 1, 1),
            (20, 0, "user", "tie one", "k", 1, 1), (20, 0, "user", "tie two", "k", 1, 1), (21, 3, "user", None, "k", 1, 1), (22, 1, None, None, "k", 1, 1),
            (23, 0, "user", "", "k", 1, 1), (24, 0, "us", "erx", "k", 1, 1), (24, 1, "user", "x", "k", 1, 1), (-20, 1, "user", "minus", "k", 1, 1), (-21, 1, "user", "minus too", "k", 1, 1),
            (-3, 1, "user", "run of zero", "k", 1, 1), (5, 2, "user", "z " * 50_000, "k", 1, 1), (6, 0, "user", "\x85   two", "k", 1, 1)]
    rows += [(c, 0, "user", "gone", "k", 1, 1) for c in range(300, 340, 1) if c % 20]  # without a first conversation: some are turnless
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_member_digests_stream_over_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ends = spark.range(500).selectExpr("id % 3 AS a", "id % 2 AS b", "id * 7919 % 1000 AS c")
        found = {(r["a"], r["b"]): r["sha256"] for r in prefix_trie.member_digests(ends).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    groups = collections.defaultdict(list)
    for i in range(500):
        groups[i % 3, i % 2].append(i * 7919 % 1000)
    assert found == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in groups.items()}
