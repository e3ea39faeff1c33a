"""Operator 11 against brute force: tokens by the libraries, overlaps by
comparing all intervals, counts over the corpus."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from pressferry.llm import alignment

SCHEMA = "doc_id long, text string, ids string, block long, pair long, n int"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    return alignment.load(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)


def spans(ids, tokens):
    ends = np.cumsum([len(tokens[i]) for i in ids]).tolist()
    return list(zip([0, *ends[:-1]], ends, ids, strict=True)) if ids else []


def tokens_of(files, text):
    x = alignment.aligner_for(files)
    if not text:
        return [], []
    a = x.sides[0].tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = x.sides[1].model.encode(text)
    whole = (" " + text).encode()
    if b"".join(x.sides[0].bytes[i] for i in a) != whole or b"".join(x.sides[1].bytes[i] for i in b) != whole:
        return [], []
    return spans(a, x.sides[0].bytes), spans(b, x.sides[1].bytes)


def brute(files, rows):
    every = [tokens_of(files, r[1]) for r in rows]
    links = [[(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] for a, b in every]
    count = collections.Counter(p for doc in links for p in doc)
    most = collections.Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for (a, b), own, row in zip(every, links, rows, strict=True):
        cuts, groups, at = sorted({x[1] for x in a} & {x[1] for x in b}), [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x[2]) for x in side if at <= x[0] < cut) for side in (a, b)))
            at = cut
        out.append((row[0], len(a), len(b), len(groups), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_contract(spark, files):
    rng = random.Random(3)
    words = ["the", "there", "Étion", "naïve", "unbelievable", "x1y2", "don't", "日本語", "😀", "ﬁne", " ", "\t", "  ", "\n\n", "...", "<|endoftext|>", "</s>", "<0x41>"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))), "x", 1, 2, 3) for i in range(60)]
    rows += [(100, None, None, None, None, None), (101, "", "x", 1, 2, 3), (102, "a ▁ b", "x", 1, 2, 3), (103, "  leading and trailing  ", "x", 1, 2, 3), (103, "  leading and trailing  ", "x", 1, 2, 3),
             (None, "no id here", "x", 1, 2, 3), (104, "ab" * 700, "x", 1, 2, 3), (105, "\x00\x01", "x", 1, 2, 3), (106, " ", "x", 1, 2, 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for sizes in ({}, {"slice_bytes": 200, "block_bytes": 500}):
        found = alignment.alignment_counts(df, files, **sizes)
        assert found.columns == COLUMNS
        assert sorted(map(tuple, found.collect()), key=str) == brute(files, rows)


def test_empty(spark, files):
    assert alignment.alignment_counts(spark.createDataFrame([], SCHEMA), files).collect() == []
    nothing = spark.createDataFrame([(1, None, "", 1, 1, 1), (2, "", "", 1, 1, 1)], SCHEMA)
    assert sorted(map(tuple, alignment.alignment_counts(nothing, files).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_of_tokens(spark, files):
    texts = [(1, "Étion unbelievable words"), (2, None), (3, "a b")]
    x = alignment.aligner_for(files)
    for row in alignment.token_groups(spark.createDataFrame(texts, "doc_id long, text string"), files).collect():
        text = dict(texts)[row["doc_id"]]
        assert sum(row["a_sizes"]) == len(row["a_ids"]) and sum(row["b_sizes"]) == len(row["b_ids"])
        a = b = 0
        for na, nb in zip(row["a_sizes"], row["b_sizes"], strict=True):
            assert b"".join(x.sides[0].bytes[i] for i in row["a_ids"][a:a + na]) == b"".join(x.sides[1].bytes[i] for i in row["b_ids"][b:b + nb])
            a, b = a + na, b + nb
        assert b"".join(x.sides[0].bytes[i] for i in row["a_ids"]).decode() == (" " + text if text else "")


def test_long_text(files):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeé ") for _ in range(9)) for _ in range(60_000)) + "z" * 20_000
    x = alignment.aligner_for(files).align([text])
    n = [int(v[0]) for v in x.per_text()]
    assert n[3] == n[0] + n[1] - n[2] and n[0] > 100_000


def test_rank_coder_gives_the_ids_of_the_file(files):
    """Every token by itself, and every character below U+0800 between letters
    and spaces."""
    left = alignment.aligner_for(files).sides[0]
    assert left.ranks is not None
    model = left.tokenizer.model
    shown = {v: k for k, v in left.tokenizer.get_vocab(with_added_tokens=False).items()}
    for i in range(50_256):
        assert [t.id for t in model.tokenize(shown[i])] == [i]
    marks = [chr(c) for c in range(0x800)]
    texts = ["".join(f"a{c}b {c} {c}{c}1{c}\n" for c in marks[k:k + 64]) for k in range(0, 0x800, 64)]
    assert [x.tolist() for x in left.encode(texts)] == [e.ids for e in left.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_coalesce():
    starts, ends = np.array([0, 3, 6, 0, 2, 6]), np.array([3, 6, 9, 2, 6, 9])
    order, group = alignment.coalesce(starts, ends)
    assert order.tolist() == [0, 3, 4, 1, 2, 5] and group.tolist() == [0, 0, 0, 0, 1, 1]
