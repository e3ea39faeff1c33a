"""Hot and null ids: bounded samples, defined picks, no quadratic joins."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pressferry.llm import byte_bpe, jaccard_join, language_id, quality, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n=30, prefix="w"):
    return " ".join(f"{prefix}{rng.randrange(300)}" for _ in range(n))


@pytest.mark.parametrize("hot", [7, None])
def test_language_sample_is_bounded(spark, hot, monkeypatch):
    rng = random.Random(1)
    rows = [(hot if i % 3 == 0 else i + 100, sentence(rng, 12, "ab" if i % 2 else "cd"), "en" if i % 2 else "de") for i in range(3000)]
    rows += [(hot, "abab abba baba the same row", "en")] * 3000
    sizes = []
    real = language_id.Identifier.calibrate
    monkeypatch.setattr(language_id.Identifier, "calibrate", lambda self, best, *a: (sizes.append(len(best)), real(self, best, *a))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = language_id.train(docs, max_calibration=200)
    assert 100 < sizes[0] + 100 and 40 < sizes[0] < 320, sizes
    got = language_id.identify(docs, found).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"] for r in got} >= {"en", "de"}


@pytest.mark.parametrize("hot", [7, 8])
def test_quality_sample_is_bounded(spark, hot, monkeypatch):
    rng = random.Random(2)
    rows, labels = [], [(7, 1, 0), (8, 0, 1)]
    for i in range(2400):
        own = hot if i % 3 == 0 else 100 + i
        bad = own == 8 or own % 5 == 0
        rows.append((own, sentence(rng) + (" awful" if bad else ""), "en", "site", 1))
        if own != hot:
            labels.append((own, int(not bad), int(bad)))
    rows += [(hot, "one row again and again", "en", "site", 1)] * 2400
    sizes = []
    real = quality.Classifier.fit
    monkeypatch.setattr(quality.Classifier, "fit", lambda self, places, marks: (sizes.append(len(places)), real(self, places, marks))[1])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("source"), F.col("lang"), max_fit=300)
    assert got.count() == len(rows)
    assert 60 < sizes[0] < 420, sizes


def test_fit_follows_few_labels():
    import numpy as np

    # 14 toxic documents show sign 0, eleven of them sign 1; of 86 clean ones 69 show sign 2.
    doc, place, y = [], [], np.zeros(100)
    for i in range(100):
        y[i] = i < 14
        shown = ([0] + [1] * (i < 11)) if i < 14 else [2] * (i < 83)
        doc += [i] * len(shown)
        place += shown
    w, start = quality.fit_weights(np.array(doc), np.array(place), y, -1.7)
    assert w[0] + w[2] + start > 0 and w[0] + start > 0 > w[2] + start
    # Plain gradient descent on the same loss, run long, comes to the same place.
    v = np.zeros(4)
    x = np.zeros((100, 4))
    x[doc, place] = 1
    x[:, 3] = 1
    penalty = np.array([1e-4, 1e-4, 1e-4, 0])
    loss = lambda v: (np.logaddexp(0, x @ v) - y * (x @ v)).sum() + (penalty * v * v).sum() / 2
    for _ in range(20_000):
        v -= 0.05 * (x.T @ (1 / (1 + np.exp(-x @ v)) - y) + penalty * v)
    assert loss(np.append(w[:3], start)) <= loss(v) + 1e-3


def test_near_duplicates_keep_a_defined_row(spark):
    rng = random.Random(3)
    text = sentence(rng)
    rows = [(1, text, "en", "b", 3), (1, text, "de", "a", 2), (1, text, None, None, None), (1, text, "en", "b", 3), (2, sentence(rng), "en", "x", 1),
            (2, None, "en", "x", 1), (2, None, "fr", "x", 1), (None, "", "en", "x", 1), (None, "", "en", "x", 1)]
    extra = ["*", "map('k', source) AS m"]
    results = set()
    for seed in range(3):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, SCHEMA).selectExpr(*extra).repartition(1 + seed)
        got = corpus_pipeline.near_duplicates(spark, docs, "")
        assert got.columns == [*docs.columns]
        results.add(tuple(sorted((str(r) for r in got.collect()))))
    assert len(results) == 1 and len(results.pop()) == 4


def test_null_ids_are_joined_by_text(spark):
    """Sets are fetched by id and text hash: the join's output is linear."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        text = sentence(rng, 40)
        rows += [(None, text), (None, text + " and more")]
    rows += [(None, rows[0][1])] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter(r["component_id"] for r in jaccard_join.near_components(docs, width=3, percent=90).collect())
    assert got == {None: 900}
    gone = jaccard_join.near_others(docs, width=3, percent=80)
    assert gone.count() == 300


def test_coder_with_few_kept_words_and_long_runs():
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeéß😀 1!") for _ in range(rng.randrange(1, 12))) for _ in range(50)) for _ in range(60)]
    texts += ["", "x" * 3000, "!" * 100_000, "12" * 50_000, "longwordsgoaway" * 9, "again longwordsgoaway" * 4]
    coder = byte_bpe.TextCoder(ranks, P.PATTERN, max_words=40)
    for _ in range(2):
        for i in range(0, len(texts), 4):
            ids, cuts = coder.encode(texts[i:i + 4])
            for k, t in enumerate(texts[i:i + 4]):
                assert ids[cuts[k]:cuts[k + 1]].tolist() == library.encode_ordinary(t)
    assert len(coder.known) < 2000
    encode = token_files.rank_encoder(ranks, P.PATTERN, block_bytes=100)()
    assert [x.tolist() for x in encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_coder_replays_a_word_in_use_once():
    import public_tokenizers as P

    coder = byte_bpe.TextCoder(byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    replayed = []
    coder.replay.encode = lambda words: replayed.extend(words) or [tuple(w) for w in words]
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(f"w{i * 40 + k}".translate(letters) for k in range(40)) for i in range(5000)]
    for _ in range(2):  # 200,000 words, all of them met again
        for i in range(0, len(texts), 1000):
            ids, cuts = coder.encode(texts[i:i + 1000])
            assert bytes(ids[cuts[7]:cuts[8]].tolist()).decode() == texts[i + 7]
    assert len(replayed) == len(set(replayed)) and len(coder.known) <= coder.max_words + 40_000
