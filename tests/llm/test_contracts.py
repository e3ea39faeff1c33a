"""Each operator over odd, clashing and empty tables, against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pressferry.llm import (byte_bpe, decontaminate, fingerprints, jaccard_join, language_id, line_dedup, pitman_yor, quality, sharding,
                            token_files)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(7)
    long = "\n".join(words(rng, 12, 3000) for _ in range(2500))
    base = "\n".join(words(rng, 15, 5000) for _ in range(6))
    rows = [(i, "\n".join(words(rng, 10, 5000) for _ in range(5)), "en", f"src{i % 3}", 1) for i in range(40)]
    rows += [
        (100, base, "en", "src0", 1), (101, base, "fr", "src1", 2), (102, base + "\nlast words here", None, None, None),
        (100, base, "en", "src0", 1),  # a repeated row
        (110, None, "en", "src0", None), (111, "", "en", "src0", 0), (112, "   \n\n \t ", None, "src1", 7),
        (None, "text without an id, twice over and more words to come", "de", "src2", 3),
        (None, None, None, None, None), (120, long, "en", "src0", len(long)), (121, "one", "en", "src0", 3), (122, "two words", "en", "src0", 9),
        (123, "Ünïcödé \U0001F600 text here 123 !!", "de", "src1", 20), (124, "same same same same same same\n" * 9, "en", "src1", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHES = ("id", "tie", "h", "n", "token", "part", "row", "shard", "kind", "_id", "_tie", "_pos", "_covered", "host", "path", "block", "held",
           "score", "fingerprint", "label_id", "text_hash", "component_id", "item", "length", "size", "value", "count")


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with further columns named like working columns."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, width):
    w = lowered(text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_words_of_slices():
    import pyarrow as pa

    from pressferry.llm.common import shingle_hashes, slices, word_codes

    texts = [f"The w{i} Quick  brown\tfox é{i % 3} " * (i % 4) if i % 5 else None for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(slices(iter([batch]), "text", 300))
    assert len(parts) > 20 and sum(p.num_rows for p in parts) == 200
    found, runs, shown = [], [], []
    for part in parts:
        offsets, codes, distinct = word_codes(part.column("text"))
        names = np.array(distinct.to_pylist(), dtype=object)
        found += [names[codes[a:b]].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
        cuts, hashes = shingle_hashes(part.column("text"), 3)
        runs += [hashes[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        doc, place = quality.signs(part.column("text"))
        shown += [sorted(place[doc == i].tolist()) for i in range(part.num_rows)]
    assert found == [lowered(t) for t in texts]
    cuts, hashes = shingle_hashes(batch.column("text"), 3)
    assert runs == [hashes[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
    doc, place = quality.signs(batch.column("text"))
    assert shown == [sorted(place[doc == i].tolist()) for i in range(200)]


# --- 1 ----------------------------------------------------------------------

def test_language_id(spark, odd, clashing, empty):
    texts = {"aa": "banana papaya cabana ", "bb": "mississippi tiffin wimpish ", "cc": "oolong voodoo moonroot "}
    rows = [(i, " ".join([texts[x]] * (1 + i % 4)), x, "s", 1) for i in range(90) for x in texts]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    got = language_id.held_out_prediction(spark.createDataFrame(rows, odd.schema)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    a, b = language_id.held_out_prediction(odd), language_id.held_out_prediction(clashing)
    assert rows_of(a) == rows_of(b) and a.count() == odd.count()
    by_id = {r["doc_id"]: r for r in a.collect()}
    assert [by_id[i]["lang_pred"] for i in (110, 111, 112)] == ["und"] * 3 and by_id[110]["score"] == 0
    assert language_id.held_out_prediction(empty).count() == 0


def test_kneser_ney_sums_to_one():
    counts = {}
    for lang, text in (("x", "abracadabra " * 3), ("y", "banana bandana ")):
        counts[lang] = np.unique(language_id.grams(*language_id.text_units([text])), return_counts=True)
    model = language_id.KneserNey(counts)
    symbols = np.unique(np.concatenate([k for k, _ in counts.values()]) & np.uint64(0xFFFF))
    for history in ("  a", "abr", "zzz", "nan"):
        head = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(history))
        seen = np.exp(model.log_p(symbols + np.uint64(head))).sum(axis=0)
        unseen = np.exp(model.log_p(np.array([head + ord("q")], dtype=np.uint64)))[0]
        assert np.allclose(seen + unseen, 1, atol=1e-4)


def test_language_shards_lose_nothing(spark):
    rng = random.Random(23)
    alphabets = {"aa": "abcdefghij", "bb": "efghijklmn", "cc": "ijklmnopqr"}
    rows = [(k, " ".join("".join(rng.choices(alphabets[x], k=5)) for _ in range(12)), x) for k, x in enumerate(sorted(alphabets) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts = {x: np.unique(language_id.grams(*language_id.text_units([r[1] for r in rows if r[2] == x])), return_counts=True) for x in alphabets}
    plain = language_id.KneserNey(counts)
    most = max(sum(len(np.unique(k & np.uint64(2 ** (16 * order) - 1))) for order in (2, 3, 4)) for k, _ in counts.values())
    entropy, _ = plain.cross_entropy([r[1] for r in rows])
    for max_cells, least in ((1 << 24, 1), (4 * most, 3), (most, 12)):  # all at once, by language, by language and unit
        identifier = language_id.train(docs, max_cells=max_cells, max_calibration=0)
        assert identifier.languages == sorted(alphabets) and (len(identifier.shards) == 1 if least == 1 else len(identifier.shards) >= least)
        got = {r["doc_id"]: r for r in language_id.identify(docs, identifier).collect()}
        assert len(got) == len(rows)
        for (i, _, _), own in zip(rows, entropy):
            assert got[i]["lang_pred"] == plain.languages[own.argmin()] and math.isclose(got[i]["cross_entropy"], own.min(), rel_tol=1e-5)


def test_hash_array():
    keys = np.random.default_rng(3).integers(0, 1 << 62, 5000).astype(np.uint64)
    keys = np.unique(keys)
    array = language_id.HashArray(keys)
    assert (keys[array.order][array.find(keys)] == keys).all()
    assert (array.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def test_und_without_learning(odd):
    got = language_id.identify(odd, None).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


# --- 2 ----------------------------------------------------------------------

def plain_line_dedup(rows):
    """(id, text) -> kept text, by walking all windows in order."""
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for id_, text in docs:
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if all(not x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[id_, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
    return out


def test_line_dedup(odd, odd_rows, clashing, empty):
    want = plain_line_dedup(odd_rows)
    got = line_dedup.line_dedup(odd).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((r[0], want[r[0], r[1]]) for r in odd_rows)
    clash = line_dedup.line_dedup(clashing)
    assert set(clashing.columns) <= set(clash.columns)
    assert collections.Counter((r["doc_id"], r["text"]) for r in clash.collect()) == collections.Counter((r["doc_id"], r["text"]) for r in got)
    assert line_dedup.line_dedup(empty).count() == 0
    kept = {r["doc_id"]: r["text"] for r in got}
    assert kept[101] == "" and kept[102] == "last words here" and kept[124].split("\n")[0]


# --- 3 ----------------------------------------------------------------------

@pytest.mark.parametrize("block_tokens", [1, 3, 64, 1 << 20])
def test_separator_scan_of_files(spark, tmp_path, block_tokens):
    eod, kind = 50256, np.dtype(">u2")
    rng = np.random.default_rng(block_tokens)
    files = {"a": [0, 0, 3, 17, 0, 150], "b": [5], "c": [], "d": [1] * 40}
    for name, sizes in files.items():
        data = np.concatenate([np.append(rng.integers(0, 50000, n), eod) for n in sizes]) if sizes else np.zeros(0)
        if name == "d":
            data = np.append(data, [7, 8])
        (tmp_path / name).write_bytes(data.astype(kind).tobytes())
    got = token_files.scan_token_files(spark, str(tmp_path), kind, eod, block_tokens).collect()
    by_file = {n: [(r["n_tokens"], r["ended"]) for r in sorted((r for r in got if r["file"].endswith("/" + n)), key=lambda r: r["ordinal"])] for n in files}
    assert by_file == {"a": [(n, True) for n in files["a"]], "b": [(5, True)], "c": [], "d": [(1, True)] * 40 + [(2, False)]}


def test_separator_scan_of_torn_file(spark, tmp_path):
    (tmp_path / "t").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number of tokens"):
        token_files.scan_token_files(spark, str(tmp_path), np.dtype(">u2"), 5).collect()


def test_token_counts_of_documents(spark, tmp_path, clashing, odd_rows, empty):
    def char_encoder():
        return lambda texts: [[ord(c) % 50000 for c in t] for t in texts]

    clashing.write.parquet(str(tmp_path / "docs"))
    got = token_files.token_counts(spark.read.parquet(str(tmp_path / "docs")), char_encoder, 50256, 50257, block_tokens=997)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter((r[0], len(r[1] or "")) for r in odd_rows)
    empty.write.parquet(str(tmp_path / "none"))
    assert token_files.token_counts(spark.read.parquet(str(tmp_path / "none")), char_encoder, 50256, 50257).count() == 0


def test_layouts():
    assert token_files.layout(50256, 50257) == np.dtype(">u2") and token_files.layout(0x01FF, 600) == np.dtype("<u2")
    assert token_files.layout(100257, 100277).itemsize == 4


# --- 4 ----------------------------------------------------------------------

def test_pitman_yor_base_columns(odd, odd_rows, clashing, empty):
    got = pitman_yor.score_documents(odd).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*lowered(t), None]
    count = collections.Counter(w for r in odd_rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = collections.Counter((r[0], held(r[0]), len(tokens(r[1])), sum(count[w] > 0 for w in tokens(r[1])), n,
                                round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 4)) for r in odd_rows)
    assert collections.Counter((*r[:5], round(r[5], 4)) for r in got) == want
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert collections.Counter((r["doc_id"], round(r["score"], 6)) for r in got) == collections.Counter(
        (r["doc_id"], round(r["score"], 6)) for r in pitman_yor.score_documents(clashing).collect())
    assert pitman_yor.score_documents(empty).count() == 0


def test_pitman_yor_probabilities(spark):
    """One learned text of distinct words: every pair has one customer and one
    table, so all probabilities follow from the formulas."""
    from pyspark.sql import functions as F

    probes = ["a b c", "a zzz", "", "b"]
    docs = spark.createDataFrame([(0, "a b c", 0)] + [(1 + i, t, 1) for i, t in enumerate(probes)], "doc_id long, text string, probe int")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, F.col("probe") == 1, block_bytes=4).collect()}
    known, unknown = (1 - 0.75 + 4 / 5) / 5, (4 / 5) / 5  # in the parent
    assert math.isclose(4 * known + unknown, 1)
    seen, other, new = (0.05 + 1.95 * known) / 2, 1.95 * known / 2, 1.95 * unknown / 2
    assert math.isclose(seen + 3 * other + new, 1)
    want = [4 * math.log10(seen), math.log10(seen) + math.log10(new) + math.log10(known), math.log10(other), 2 * math.log10(other)]
    assert all(math.isclose(got[1 + i], w, rel_tol=1e-9) for i, w in enumerate(want)) and math.isclose(got[0], want[0])


def test_pitman_yor_learns_contexts(spark):
    from pyspark.sql import functions as F

    train = [(i, f"the {w} ran", 0) for i, w in enumerate(["cat", "dog", "cat", "cow", "cat", "dog"] * 5)]
    words = ["cat", "dog", "cow", "the"]
    docs = spark.createDataFrame(train + [(1000 + i, f"the {w} ran", 1) for i, w in enumerate(words)], "doc_id long, text string, probe int")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, F.col("probe") == 1, block_bytes=200).collect()}
    scores = [got[1000 + i] for i in range(len(words))]
    assert scores == sorted(scores, reverse=True)
    # The cut into blocks doesn't change counts or seatings.
    whole = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs.coalesce(1), F.col("probe") == 1).collect()}
    assert all(math.isclose(got[i], whole[i], rel_tol=1e-9) for i in got)


def test_seating_matches_the_restaurant():
    """Means of the drawn tables against an exact recursion over customers."""
    c, w, d = 30, 0.7, 0.6
    p = np.zeros(c + 1)
    p[1] = 1.0
    for seated in range(1, c):
        new = np.zeros(c + 1)
        for t in range(1, seated + 1):
            q = w / (w + seated - d * t)
            new[t + 1] += p[t] * q
            new[t] += p[t] * (1 - q)
        p = new
    mean = (p * np.arange(c + 1)).sum()
    keys = np.arange(1, 20001).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tables = pitman_yor.seat(np.full(20000, c), np.full(20000, w), d, keys, 1)
    assert abs(tables.mean() - mean) < 0.05 and tables.min() >= 1 and tables.max() <= c
    again = pitman_yor.seat(np.array([1, 0, c, 5]), np.full(4, w), d, keys[:4], 1)
    assert again[0] == 1 and again[1] == 0 and again[2] == pitman_yor.seat(np.array([c]), np.full(1, w), d, keys[2:3], 1)[0]


def test_packed_vectors():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (pitman_yor.unpack_sorted(pitman_yor.pack_sorted(x), 1000) == x).all()
    assert len(pitman_yor.unpack(pitman_yor.pack(np.zeros(0, dtype=np.uint32)), 0, "u4")) == 0
    cuts = pitman_yor.spread(x, 7)
    assert cuts[0] == 0 and cuts[-1] == 1000 and (np.diff(cuts) >= 0).all()
    for a, b in zip(cuts[:-1], cuts[1:]):
        assert (np.diff(pitman_yor.inside(x, 7)[a:b].astype(np.int64)) >= 0).all()


# --- 5 ----------------------------------------------------------------------

def plain_matches(docs, items, width=5, percent=80):
    out = {}
    for i, t in docs:
        w = lowered(t)
        for item, text in items:
            own = lowered(text)
            k = min(width, len(own))
            if not own:
                continue
            runs = lambda x, k=k: collections.Counter(tuple(x[j:j + k]) for j in range(len(x) - k + 1))
            b, m = runs(own), min(len(own), len(w))
            for s in range(len(w) - m + 1):
                a = runs(w[s:s + m])
                common, union = sum((a & b).values()), sum((a | b).values())
                if common and 100 * common >= percent * union and (common / union, -s) > out.get((i, item), (0, 0)):
                    out[i, item] = (common / union, -s)
    return {k: (round(v[0], 9), -v[1]) for k, v in out.items()}


def test_decontamination(spark, odd, odd_rows, clashing, empty):
    body = odd_rows[5][1].split()
    items = [(1, " ".join(body[10:40])), (2, " ".join([*body[2:20], "changed", *body[20:35]])), (3, "two words"), (4, None), (5, ""), (6, "ONE"),
             (None, " ".join(body[5:30])), (7, "same same same same same same same same"), (8, "never seen words in any of these documents at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_matches({(r[0], r[1]) for r in odd_rows if r[0] is not None and r[0] != 120}, items)
    got = decontaminate.matches(odd.filter("doc_id <> 120"), bench).collect()
    assert {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"]) for r in got} == want
    assert (5, 1) in want and (122, 3) in want and (121, 6) in want and (124, 7) in want
    clash = decontaminate.matches(clashing.filter("doc_id <> 120"), bench.selectExpr("*", "1 AS length", "2 AS own")).collect()
    assert len(clash) == len(got) == len(want)
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(odd, bench.limit(0)).count() == 0


def test_multi_index_finds_all_within_radius(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    prints = rng.integers(-(1 << 63), 1 << 63, 60)
    rows = []
    for i, p in enumerate(prints):
        flips = rng.choice(64, int(rng.integers(0, 24)), replace=False)
        q = int(p) & (1 << 64) - 1
        for f in flips:
            q ^= 1 << int(f)
        rows.append((i, int(p), q - (1 << 64) if q >= 1 << 63 else q, len(flips)))
    df = spark.createDataFrame(rows, "i int, a long, b long, d int")
    one = df.select("i", "a", F.inline(decontaminate.block_values(F.col("a"))))
    two = df.select("i", "b", "d", F.inline(decontaminate.block_probes(F.col("b"))))
    met = {r[0] for r in one.join(two, ["i", "block", "value"]).select("i").distinct().collect()}
    assert {r[0] for r in rows if r[3] <= decontaminate.RADIUS} <= met


def test_simhash_against_python(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    rows = [(i, [int(x) for x in rng.integers(-(1 << 63), 1 << 63, n)]) for i, n in enumerate((1, 2, 7, 40, 300))]
    got = {r["i"]: r["f"] for r in decontaminate.with_simhash(spark.createDataFrame(rows, "i int, v array<bigint>"), "v", "f").collect()}
    for i, values in rows:
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in values) > len(values))
        assert got[i] & (1 << 64) - 1 == bits


# --- 6 ----------------------------------------------------------------------

def test_fingerprints(odd, odd_rows, clashing, empty):
    got = fingerprints.fingerprints(odd).collect()
    prints = lambda t: fingerprints.as_string(fingerprints.sums([fingerprints.pieces(t)])[0])
    assert len(got) == len(odd_rows)
    assert collections.Counter((r["doc_id"], r["n_chars"], r["fingerprint"]) for r in got) == collections.Counter(
        (r[0], len(r[1] or ""), prints(r[1] or "")) for r in odd_rows)
    order = sorted({r[0]: r[1] or "" for r in odd_rows if r[0] is not None}.items())
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for (i, text), (_, after) in zip(order, order[1:]):
        if i == 100:
            continue
        n = len(text)
        edited = text[:n - n // 4] + after[:n // 4]
        assert by_id[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_id[i]["edited_fingerprint"] == prints(edited)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert rows_of(fingerprints.fingerprints(clashing)) == rows_of(fingerprints.fingerprints(odd))
    assert fingerprints.fingerprints(empty).count() == 0


def test_single_document_is_its_own_next(spark):
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    row = fingerprints.fingerprints(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1


def test_fingerprints_of_repetitive_texts(spark):
    n = 10_000
    rows = [(1, "a line of the log\n" * n), (2, "another line here\n" * n)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    exact = {i: sum(k * fingerprints.vectors([p]).astype(np.int64)[0] for p, k in collections.Counter(fingerprints.pieces(t)).items()) for i, t in rows}
    for i, other in ((1, 2), (2, 1)):
        assert (fingerprints.from_string(got[i]["fingerprint"]) == exact[i]).all()
        text, following = dict(rows)[i], dict(rows)[other]
        edited = fingerprints.edit(text, following)[0]
        after = sum(k * fingerprints.vectors([p]).astype(np.int64)[0] for p, k in collections.Counter(fingerprints.pieces(edited)).items())
        assert (fingerprints.from_string(got[i]["edited_fingerprint"]) == after).all()
        for name, b in (("near_edited", after), ("near_next", exact[other])):
            a = exact[i]
            assert math.isclose(got[i][name], max(0.0, 1 - ((a - b) ** 2).sum() / ((a ** 2).sum() + (b ** 2).sum())), abs_tol=1e-9)


def test_fingerprints_add_up():
    a, b = ["x. ", "y\n", "z"], ["z", "x. ", "y\n"]
    assert (fingerprints.sums([a]) == fingerprints.sums([b])).all()
    assert (fingerprints.sums([a]) - fingerprints.sums([["y\n"]]) == fingerprints.sums([["x. ", "z"]])).all()
    assert (fingerprints.from_string(fingerprints.as_string(fingerprints.sums([a])[0])) == fingerprints.sums([a])[0]).all()
    for text in ("", "a", "..!\n\n", "x" * 1000, "One. Two!\nThree"):
        assert "".join(fingerprints.pieces(text)) == text


# --- 7 ----------------------------------------------------------------------

def plain_components(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(i)] = min(least.get(find(i), id_), id_)
    return collections.Counter((rows[i][0], len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join(spark, odd, odd_rows, width, percent):
    import random

    rng = random.Random(width)
    rows = [(r[0], r[1]) for r in odd_rows]
    for g in range(6):  # chains of near copies, hot words
        text = [f"g{g}w{rng.randrange(60)}" for _ in range(60)]
        for k in range(14):
            rows.append((1000 + 100 * g + k, " ".join(text)))
            text = list(text)
            text[rng.randrange(60)] = f"new{rng.randrange(10 ** 6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter(tuple(r) for r in jaccard_join.near_components(df, width, percent).collect())
    assert got == plain_components(rows, width, percent)


def test_jaccard_join_odd_tables(odd, clashing, empty):
    assert rows_of(jaccard_join.near_components(clashing)) == rows_of(jaccard_join.near_components(odd))
    assert jaccard_join.near_components(empty).count() == 0


def test_components(spark):
    from pressferry.llm.common import connected_components

    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(139, 30), (200, 201), (201, 201)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(31), *range(100, 140)]}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8 ----------------------------------------------------------------------

def test_sharding(odd, odd_rows, clashing, empty):
    got = sharding.shard(odd, shards=8).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    n = len(got)
    for r in got:
        assert sharding.place(r["global_row"], n, 8, 20240229) == (r["shard"], r["slot"])
        assert sharding.row_at(r["shard"], r["slot"], n, 8, 20240229) == r["global_row"]
    assert rows_of(sharding.shard(clashing)) == rows_of(sharding.shard(odd)) and sharding.shard(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 5)
    assert sorted(p) == list(range(n)) and (sharding.permute(p, n, 5, back=True) == np.arange(n)).all()


# --- 9 ----------------------------------------------------------------------

def public_ranks():
    tokenizers = pytest.importorskip("public_tokenizers")
    return byte_bpe.load_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN


def test_bpe_equals_the_library(odd, odd_rows, clashing, empty):
    import tiktoken

    ranks, pattern = public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(odd, ranks, pattern, with_ids=True).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == collections.Counter((r[0], tuple(library.encode_ordinary(r[1] or ""))) for r in odd_rows)
    for r in got:
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
    assert byte_bpe.encode(clashing, ranks, pattern).count() == len(odd_rows) and byte_bpe.encode(empty, ranks, pattern).count() == 0


def test_replay_with_late_pairs():
    """A rank table in which a merge makes a pair of a lower rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 300, b"ab": 257, b"abcd": 258, b"cd": 259, b"aa": 260, b"aaa": 261}
    replay = byte_bpe.MergeReplay(ranks)
    words = [b"", b"a", b"abc", b"xabcd", b"abab", b"aaaaaaa", b"cdcdabcdx", b"zzabz" * 50, b"abcabcab"]
    assert [list(x) for x in replay.encode(words)] == [replay.plain(w) if w else [] for w in words]


def test_rank_file(tmp_path):
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)))
    assert byte_bpe.load_ranks(str(tmp_path / "r"))[b"\x07"] == 7


# --- 10 ---------------------------------------------------------------------

def labelled(spark):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = " ".join(f"w{rng.randrange(300)}" for _ in range(30))
        if bad:
            text = text.upper().replace(" ", "!! ")
        if toxic:
            text += " horrid"
        rows.append((i, text, "en", "good.org" if i % 2 else None, len(text)))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels + [(5, None, None), (None, 1, 0), (1, 1, 0)]


def test_quality(spark, odd, clashing, empty):
    rows, labels = labelled(spark)
    docs, marks = spark.createDataFrame(rows, odd.schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify_documents(docs, marks).collect()}
    assert len(got) == 600
    assert all(got[i]["keep"] == (i % 5 != 0 and i % 7 != 0) for i in got)
    a, b = quality.classify_documents(odd, marks), quality.classify_documents(clashing, marks.selectExpr("*", "1 AS host", "2 AS n"))
    assert a.count() == odd.count() == b.count()
    assert quality.classify_documents(empty, marks).count() == 0
    none = quality.classify_documents(docs, marks.limit(0)).collect()
    assert len(none) == 600 and all(r["keep"] for r in none)


def test_sparse_sites_shrink(spark, odd):
    rows, labels = labelled(spark)
    rows = [(i, t, "en", "tiny.org" if i in (1, 2) else f"big{i % 4}.org", n) for i, t, _, _, n in rows]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify_documents(spark.createDataFrame(rows, odd.schema), marks).collect()
    hosts = {r["host"]: r["host_quality"] for r in got}
    assert 0.7 < hosts["tiny.org"] < 0.95
