"""The pipeline, stage by stage, against brute force."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_contracts import (CLASHES, SCHEMA, labelled, odd_rows, plain_components, plain_line_dedup, plain_matches,  # noqa: F401
                            public_ranks, words)


@pytest.fixture(scope="module")
def world(spark, odd_rows, tmp_path_factory):  # noqa: F811
    import random

    rng = random.Random(11)
    rows, labels = labelled(spark)
    rows = rows[:150]
    item = " ".join(words(rng, 30, 9000).split())
    rows += [(2000 + r[0], *r[1:]) if r[0] is not None else r for r in odd_rows if r[0] != 120]
    text = words(rng, 60, 9000).split()
    for k in range(5):
        rows.append((3000 + k, " ".join(text), "en", "good.org", 1))
        text = list(text)
        text[rng.randrange(60)] = f"edit{k}"
    rows += [(4000, f"{words(rng, 20, 9000)} {item} {words(rng, 9, 9000)}", "en", "good.org", 5), (4001, item, "en", "good.org", 5),
             (4002, words(rng, 50, 9000), "en", "good.org", 5)]
    at = str(tmp_path_factory.mktemp("world"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, [(1, item)]


def test_every_stage(spark, world, tmp_path):
    at, rows, items = world
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        result = stage(spark, docs, at)
        if k < 4:
            assert result.columns == docs.columns, name
        result.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r) for r in docs.collect()]
        ids = {r[0] for r in after}
        if k == 0:
            own = {r[0] for r in rows if r[0] is not None and r[0] < 150}
            assert ids & own == {i for i in own if i % 5 and i % 7}
            docs = spark.read.parquet(f"{at}/documents.parquet")  # its model is small: the odd rows go on to the other stages
        elif k == 1:
            plain = plain_line_dedup(before)
            kept = [(r[0], plain[r[0], r[1]]) for r in before]
            kept = [(i, t) for (i, t), r in zip(kept, before) if not (t != r[1] and not (t or "").strip(" "))]
            assert collections.Counter((r[0], r[1]) for r in after) == collections.Counter(kept)
            changed = {r[0]: r for r in before}
            assert all(r[4] == len(r[1]) for r in after if r[0] is not None and changed[r[0]][1] != r[1])
        elif k == 2:
            groups = {c[0]: c[2] for c in plain_components([(r[0], r[1]) for r in before], 5, 80)}
            assert ids == {r[0] for r in before if r[0] is None or groups[r[0]] == r[0]}
            assert {3000} == {i for i in ids if i is not None and 3000 <= i < 3010}
            counts = collections.Counter(r[0] for r in after if r[0] is not None)
            assert max(counts.values()) == 1
        elif k == 3:
            hit = {i for i, _ in plain_matches({(r[0], r[1]) for r in before}, items)}
            assert hit and ids == {r[0] for r in before} - hit
        else:
            import tiktoken

            ranks, pattern = public_ranks()
            library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect()) == collections.Counter(
                (r[0], tuple(library.encode_ordinary(r[1] or ""))) for r in before)


def test_run_is_the_stages_in_order(spark, world):
    at, _, _ = world
    got = corpus_pipeline.run(spark, at)
    assert 0 < got.count() and {"doc_id", "n_tokens", "ids_sha256"} <= set(got.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]


def test_stages_with_clashing_and_empty_tables(spark, world):
    at, _, _ = world
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(40)
    odd_columns = docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    none = docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        plain, clash = stage(spark, docs, at), stage(spark, odd_columns, at)
        assert plain.count() == clash.count(), name
        if k < 4:
            assert set(clash.columns) == set(odd_columns.columns)
        assert stage(spark, none, at).count() == 0


def test_decontamination_is_by_id_and_text(spark, tmp_path):
    import random

    rng = random.Random(31)
    item = " ".join(words(rng, 30, 9000).split())
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty, clean = f"before it {item} after it", words(rng, 40, 9000)
    rows = [(None, dirty, "en", "s", 1), (None, clean, "en", "s", 1), (None, None, "en", "s", 1), (7, dirty, "en", "s", 1), (7, clean, "en", "s", 1),
            (8, dirty, "en", "s", 1), (8, dirty, "en", "s", 1), (9, clean, "en", "s", 1)]
    got = corpus_pipeline.benchmark_decontamination(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path))
    assert sorted((r[0] or 0, r[1] or "") for r in got.collect()) == sorted([(0, clean), (0, ""), (7, clean), (9, clean)])


def test_near_duplicates_are_judged_by_row(spark):
    import random

    rng = random.Random(37)
    a, b, c, d, e, f, g = (words(rng, 60, 9000) for _ in range(7))
    rows = [(7, a), (9, a), (3, b), (7, b), (5, c), (5, d), (4, d), (None, e), (None, e), (None, f), (6, f + " more"), (None, g), (None, g + " more"),
            (None, None), (1, ""), (2, "")]
    kept = [(7, a), (3, b), (5, c), (4, d), (None, e), (6, f + " more"), (None, None), (1, ""), (2, "")]
    for further in ([], [(8, "on its own"), (8, "on its own")]):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows + further], SCHEMA).repartition(3)
        got = collections.Counter((r[0], r[1]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
        assert got[None, g] + got[None, g + " more"] == 1
        assert got - collections.Counter([(None, g), (None, g + " more")]) == collections.Counter(kept + further[:1])
