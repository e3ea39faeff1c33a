"""Operator 7: n-gram Jaccard join with several global token orders.

A document's set is its distinct word shingles.  Documents with equal sets form
a class; only classes are compared.  If two sets of sizes a and b reach the
threshold, then under any order of all shingles the first a - ceil(t a) + 1
shingles of one and the first b - ceil(t b) + 1 of the other share one.  Every
order here puts shingles of frequent sketch cells last (one count sketch over
the whole corpus) and shuffles equals by a hash of its own.
Candidates come from the shared prefix shingles of the first order, must share
prefix shingles under every other order too, and are then verified exactly.
What stands before the first shared shingle isn't shared, so its places in both
prefixes bound the intersection; a posting pair beyond that bound is no
candidate.

Links are needed up to connection, not pair by pair.  A first round compares
every class of a posting list with one centre, the class in which the shingle
comes first (near copies have shingles of their own before it, their original
has not); a second compares the members that are still in different
components, so lists of near copies cost their length and not its square, and
no link between components is lost.

Defined results: null or empty text has the empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; repeated rows are
in the same class; rows with a null id get their component's smallest id (null
if there is none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressferry.llm.common import connected_components, mix, shingle_hashes, slices, written
from pressferry.llm.pitman_yor import pack, unpack

#: Cells of the frequency sketch: about one for eight shingles, 2 ** 20 to 2 ** 26.
SKETCH_BITS = (20, 26)
CHUNK = 1 << 16
#: Candidate ids up to which they are sent to every executor.
SMALL_IDS = 1_000_000


def sketch_bits(shingles: float) -> int:
    low, high = SKETCH_BITS
    return int(min(high, max(low, np.ceil(np.log2(max(shingles, 1) / 8)))))


def _cell(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(64 - bits)).astype(np.int64)


def frequency_levels(docs: DataFrame, width: int) -> np.ndarray:
    """The level of each sketch cell: 0 up to twice the mean count, one more
    for each doubling.  The sketch counts the shingles of all documents; it has
    a cell for about eight of them, 64 MB of levels at most.  Orders need no
    exact counts, only the same levels everywhere."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(size / 7)  # a word and a blank

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(1 << bits, dtype=np.uint32), False
        for batch in slices(batches, "text", 1 << 20):
            some = True
            cells, times = np.unique(_cell(shingle_hashes(batch.column("text"), width)[1], bits), return_counts=True)
            total[cells] += times.astype(np.uint32)
        for at in range(0, len(total) if some else 0, CHUNK):
            packed = pack(total[at:at + CHUNK])
            yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK], pa.int32()), pa.array([packed], pa.binary())], ["chunk", "counts"])

    def add(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in chunks:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + unpack(packed, min(CHUNK, 1 << bits), "u4").astype(np.int64)
        if total:
            eighths = [np.round(8 * np.log2(v + 1)).astype(np.uint8).tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(eighths, pa.binary()), pa.array([int(v.sum()) for v in total.values()])],
                                             ["chunk", "eighths", "total"])

    chunks = (1 << bits) // CHUNK
    parts = docs.mapInArrow(count, "chunk int, counts binary")
    summed = parts.repartition(chunks, "chunk").mapInArrow(add, "chunk int, eighths binary, total bigint").collect()  # a byte for each cell
    eighths = np.zeros(1 << bits, dtype=np.uint8)
    for row in summed:
        eighths[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] = np.frombuffer(row["eighths"], dtype=np.uint8)
    usual = max(1.0, sum(row["total"] for row in summed) / len(eighths))
    level = np.floor(np.maximum(np.arange(256) / 8 - np.log2(usual), 0)).astype(np.uint8)
    return level[eighths]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set under one of the orders, in that order (as
    their order keys, which stand for them)."""
    key = mix(tokens + np.uint64((order + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(8)
    key |= levels[_cell(tokens, len(levels).bit_length() - 1)].astype(np.uint64) << np.uint64(56)
    p = prefix_length(len(tokens), percent)
    return np.sort(np.partition(key, p - 1)[:p] if p < len(key) else key)


def document_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Sorted distinct shingles and their signature, text by text."""
    cuts, hashes = shingle_hashes(batch.column("text"), width)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        tokens = np.unique(hashes[a:b])
        yield tokens, hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, orders: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row: rows link when 100 times the
    intersection of their sets is at least ``percent`` times the union."""
    marks, roots = _linked(docs, width, percent, orders, id_col, text_col)
    classes = marks.filter("n > 0").groupBy("signature").agg(F.min("id").alias("least"))
    classes = classes.join(roots, classes["signature"] == roots["node"], "left").select(
        "signature", "least", F.coalesce("root", "signature").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    component = classes.join(named, "root").select("signature", "component_id")
    rows = marks.select("id", "n", "signature").join(component, "signature", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                       F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def text_key(text: Column) -> Column:
    """The hash that tells texts under one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_others(docs: DataFrame, width: int = 5, percent: int = 80, orders: int = 3, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """id, key (``text_key``) of the texts that don't stand for their component:
    the one with the smallest id (null last), then the smallest key, does."""
    marks, roots = _linked(docs, width, percent, orders, id_col, text_col)
    filled = marks.filter("n > 0")
    classes = filled.groupBy("signature").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    classes = classes.join(roots, classes["signature"] == roots["node"], "left").select(F.coalesce("root", "signature").alias("root"), "first")
    stay = classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("stay_id"), F.col("first.key").alias("stay_key"))
    every = filled.select("id", "key").distinct()
    return every.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("key") == F.col("stay_key")), "left_anti")


def _linked(docs: DataFrame, width: int, percent: int, orders: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id, key, n, signature of every row (and its prefix), and the root of each
    signature that is linked with another."""
    if not 1 <= percent <= 100 or orders < 2:
        raise ValueError("percent must be from 1 to 100, and there must be two orders at least")
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(texts.select("text"), width))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.uint64)
        for batch in slices(batches, "text", 1 << 20):
            sizes, signatures, prefixes = [], [], []
            for tokens, signature in document_sets(batch, width):
                sizes.append(len(tokens))
                signatures.append(signature)
                prefixes.append(prefix(tokens, levels.value, 0, percent) if len(tokens) else none)
            class_key = np.frombuffer(b"".join(signatures), dtype=np.int64)[::2]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(class_key), _lists(prefixes)],
                                             ["id", "key", "n", "signature", "h", "tokens"])

    marks = written(texts.mapInArrow(mark, f"id {id_type}, key bigint, n bigint, signature binary, h bigint, tokens array<bigint>"), "marks")
    filled = marks.filter("n > 0")
    postings = filled.select("h", "n", F.posexplode("tokens").alias("place", "token"))
    shared = postings.groupBy("token").agg(F.min("h").alias("_low"), F.max("h").alias("_high"), F.min("place").alias("least")).filter("_low < _high").drop("_low", "_high")
    listed = postings.join(shared, "token").groupBy("token", "h").agg(*[F.first(c).alias(c) for c in ("n", "place", "least")])
    centres = listed.groupBy("token").agg(F.min(F.when(F.col("place") == F.col("least"), F.struct("h", "n", "place"))).alias("c"), F.count(F.lit(1)).alias("members"))
    members = written(listed.join(centres, "token").select("token", "h", "n", "place", "members", F.col("c.h").alias("centre"), F.col("c.n").alias("cn"),
                                                           F.col("c.place").alias("cplace")).filter("h <> centre"), "members")  # pairs with the centre come first

    def within(na: str, pa_: str, nb: str, pb: str):
        """Whether the places of a shared shingle (and the sizes: the smaller
        set can't hold more) allow the threshold."""
        room = F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
        return (100 + percent) * room >= percent * (F.col(na) + F.col(nb))

    def asked_of(pairs: DataFrame) -> DataFrame:
        """The classes of the pairs (ha, hb), for a join that sends few of them to
        every executor."""
        asked = written(pairs.select(F.explode(F.array("ha", "hb")).alias("h")).distinct(), "asked")
        return F.broadcast(asked) if asked.count() <= SMALL_IDS else asked

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs whose prefixes under the first order leave room: up to the end of
        the prefix that ends first all common shingles are counted, and what
        follows can't hold more than the smaller rest."""
        known = written(filled.select("h", "n", "tokens").join(asked_of(pairs), "h").dropDuplicates(["h"]), "prefixes")
        side = lambda s: known.select(*[F.col(c).alias(f"{c}{s}") for c in known.columns])
        both = pairs.join(side("a"), "ha").join(side("b"), "hb")
        end = F.least(F.element_at("tokensa", -1), F.element_at("tokensb", -1))
        rest = lambda s: F.col(f"n{s}") - F.size(F.filter(f"tokens{s}", lambda x: x <= end))
        most = F.size(F.array_intersect("tokensa", "tokensb")) + F.least(rest("a"), rest("b"))
        return written(both.filter((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("ha", "hb"), "plausible")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            every = list(document_sets(batch, width))
            sets = [tokens for tokens, _ in every]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), pa.array([s for _, s in every], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets),
                 *(_lists([prefix(s, levels.value, k, percent) for s in sets]) for k in range(1, orders))],
                ["h", "signature", "n", "tokens", *(f"p{k}" for k in range(1, orders))])

    schema = "h bigint, signature binary, n bigint, tokens array<bigint>" + "".join(f", p{k} array<bigint>" for k in range(1, orders))

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The whole set and the prefixes under the other orders of each class of
        the pairs, from the text of one of its rows, found by id and text hash."""
        owners = written(filled.select("h", "id", "key").join(asked_of(pairs), "h").groupBy("h").agg(F.min(F.struct("id", "key")).alias("row"))
                         .select("h", F.col("row.id").alias("owner"), F.col("row.key").alias("owner_key")), "owners")
        wanted = F.broadcast(owners) if owners.count() <= SMALL_IDS else owners
        found = texts.join(wanted, F.col("id").eqNullSafe(F.col("owner")) & (F.col("key") == F.col("owner_key")))
        sets = written(found.select("h", "text").mapInArrow(full, schema), "sets")
        return sets.dropDuplicates(["h"])  # equal rows give a set each

    def verified(pairs: DataFrame) -> DataFrame:
        """Edges (a, b) between the signatures of linked pairs (ha, hb)."""
        pairs = plausible(pairs)
        sets = sets_of(pairs)
        side = lambda s: sets.select(*[F.col(c).alias(f"{c}{s}") for c in sets.columns])
        both = pairs.join(side("a"), "ha").join(side("b"), "hb")
        for k in range(1, orders):
            both = both.filter(F.arrays_overlap(f"p{k}a", f"p{k}b"))
        common = F.size(F.array_intersect("tokensa", "tokensb"))
        linked = both.withColumn("c", common).filter(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c")))
        return linked.select(F.col("signaturea").alias("a"), F.col("signatureb").alias("b"))

    starred = members.filter(within("n", "place", "cn", "cplace"))
    first = written(verified(written(starred.select(F.col("centre").alias("ha"), F.col("h").alias("hb")).distinct(), "starred")), "links")
    roots = connected_components(first)
    root_of = written(filled.select("h", "signature").join(roots, F.col("signature") == F.col("node")).groupBy("h").agg(F.min(F.xxhash64("root")).alias("root")), "roots")
    root_of = F.broadcast(root_of) if root_of.count() <= SMALL_IDS else root_of
    left = members.filter("members > 2").join(root_of, "h", "left").select("token", "h", "n", "place", F.coalesce("root", "h").alias("root"))
    x, y = left.alias("x"), left.alias("y")
    across = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.h") < F.col("y.h")) & (F.col("x.root") != F.col("y.root"))
                     & within("x.n", "x.place", "y.n", "y.place"))
              .select(F.col("x.h").alias("ha"), F.col("y.h").alias("hb")).distinct())
    second = written(verified(written(across, "across")), "links")
    return marks, connected_components(first.unionByName(second))
