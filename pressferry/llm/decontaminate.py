"""Operator 5: benchmark decontamination by SimHash over item-sized windows.

A document's windows for an item length are its runs of that many words (the
whole document if it is shorter).  A window can only be similar to an item if
it holds one of the items' shingles, so windows start around such positions;
each gets a 64-bit SimHash of its shingles.  Fingerprints are compared by a
multi-index: 64 bits are cut into BLOCKS blocks, and two fingerprints within
RADIUS differ by at most one bit in some block, so probing every block with all
values one bit away finds all of them.  Candidates within the radius are
verified by the exact weighted Jaccard similarity of shingles (weights: how
often a shingle occurs).  Only DataFrame functions are used.

At similarity 0.8 a SimHash differs in 9.7 of 64 bits on average (standard
deviation 2.9); RADIUS is more than three deviations above.

Defined results: null or empty texts and items match nothing; an item of fewer
words than a shingle is one shingle; repeated rows report once; equal starts
report the first; null ids are reported as null; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pressferry.llm.common import SPACE_CLASS, written

RADIUS = 19
BLOCKS = 10
#: Item shingles (and index entries) up to which they are sent to every executor.
SMALL = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CUTS = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
_SPREAD, _LANES = 0x0000200040008001, 0x0001000100010001


def word_hashes(text: Column) -> Column:
    words = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SPACE_CLASS, -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(hashes: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words (none of a shorter array)."""
    runs = F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.xxhash64(
        F.lit(width), *[F.element_at(hashes, i + k) for k in range(width)]))
    return F.when(F.size(hashes) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def with_simhash(df: DataFrame, values: str, name: str) -> DataFrame:
    """Adds the SimHash of an array of 64-bit shingle hashes: the counts of set
    bits in sixteen numbers of four 16-bit lanes, then each bit's majority."""
    nibble = lambda x, j: F.shiftrightunsigned(x, 4 * j).bitwiseAND(F.lit(15)) * F.lit(_SPREAD)
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"c{j}") for j in range(16)])
    counts = F.aggregate(F.col(values), zero, lambda acc, x: F.struct(*[
        (acc[f"c{j}"] + nibble(x, j).bitwiseAND(F.lit(_LANES))).alias(f"c{j}") for j in range(16)]))
    bits = []
    for j in range(16):
        for k in range(4):
            lane, b = F.shiftrightunsigned(F.col(f"_counts.c{j}"), 16 * k).bitwiseAND(F.lit(0xFFFF)), 4 * j + k
            bit = F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("bigint")
            bits.append(F.when(2 * lane > F.size(values), bit).otherwise(F.lit(0).cast("bigint")))
    return df.withColumn("_counts", counts).withColumn(name, reduce(lambda x, y: x.bitwiseOR(y), bits)).drop("_counts")


def block_values(fingerprint: Column) -> Column:
    """(block, value) of each block of a fingerprint."""
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, _CUTS[b]).bitwiseAND(
        F.lit((1 << (_CUTS[b + 1] - _CUTS[b])) - 1)).alias("value")) for b in range(BLOCKS)])


def block_probes(fingerprint: Column) -> Column:
    """(block, value) of each block and of all values one bit away from it."""
    out = []
    for b in range(BLOCKS):
        size = _CUTS[b + 1] - _CUTS[b]
        value = F.shiftrightunsigned(fingerprint, _CUTS[b]).bitwiseAND(F.lit((1 << size) - 1))
        out += [F.struct(F.lit(b).alias("block"), value.bitwiseXOR(F.lit(flip).cast("bigint")).alias("value"))
                for flip in (0, *(1 << i for i in range(size)))]
    return F.array(*out)


def weighted_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    times = lambda values, s: F.size(F.filter(values, lambda x: x == s))
    common = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(common)).otherwise(
        F.aggregate(common, F.lit(0), lambda acc, s: acc + F.least(times(a, s), times(b, s))))


def _sized(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """The table, marked for broadcast only where its row count allows it."""
    return F.broadcast(df) if df.count() <= limit else df


def matches(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
            text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, start (0-based word), n_words, distance (bits), similarity:
    the best window of each document and item that reaches ``percent``."""
    passed = _passed(docs, items, width, percent, id_col, text_col, item_col, item_text_col)
    best = passed.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "m", "distance")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.s")).alias("start"), F.col("b.m").alias("n_words"),
                       F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))


def text_tie(text: Column) -> Column:
    """The hash that tells texts under one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, tie (``text_tie``) of the texts with a window that reaches ``percent``."""
    return _passed(docs, items, width, percent, id_col, text_col, item_col, item_text_col).select("id", "tie").distinct()


def _passed(docs: DataFrame, items: DataFrame, width: int, percent: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """id, tie, item, start, m, distance, similarity of every window that
    reaches ``percent`` and was proposed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text_tie(F.col(text_col)).alias("tie"), text.alias("text"))
    listed = items.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text_col)).alias("w")).filter(F.size("w") > 0)
    listed = listed.withColumn("length", F.size("w"))
    short = [r[0] for r in listed.filter(F.col("length") < width).select("length").distinct().collect()]  # below width
    found = [_windows(rows, listed, w, exact, percent) for w, exact in [(width, False), *((w, True) for w in sorted(short))]]
    return reduce(DataFrame.unionByName, found)


def _windows(rows: DataFrame, listed: DataFrame, width: int, exact: bool, percent: int) -> DataFrame:
    wanted = listed.filter(F.col("length") == width if exact else F.col("length") >= width)
    wanted = with_simhash(wanted.select("item", "length", shingles(F.col("w"), width).alias("own")), "own", "item_print")
    wanted = written(wanted.select("item", "length", "own", "item_print"), "items")
    anchors = wanted.select("length", F.explode("own").alias("s")).distinct()

    hashed = rows.select("id", "tie", word_hashes(F.col("text")).alias("w"))
    spots = hashed.select("id", "tie", F.size("w").alias("n"), F.posexplode(shingles(F.col("w"), width)).alias("p", "s"))
    hits = spots.join(_sized(anchors), "s").select("id", "tie", "n", "length", "p")
    # Each start once: those that the hit before doesn't reach.
    before = F.lag("p").over(Window.partitionBy("id", "tie", "length").orderBy("p"))
    size = F.least("length", "n")
    ranges = hits.withColumn("m", size).select(
        "id", "tie", "length", "m", F.greatest(F.lit(0), F.col("p") - (F.col("m") - width), F.coalesce(before + 1, F.lit(0))).alias("lo"),
        F.least(F.col("p"), F.col("n") - F.col("m")).alias("hi")).filter("lo <= hi")
    spans = ranges.groupBy("id", "tie").agg(F.collect_list(F.struct("length", "m", "lo", "hi")).alias("spans"))

    texts = rows.join(spans.withColumnsRenamed({"id": "id2", "tie": "tie2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("tie") == F.col("tie2")))
    # The words are a column of their own: within the shingle function they would be made anew for every shingle.
    arrays = texts.select("id", "tie", "spans", word_hashes(F.col("text")).alias("w"))
    arrays = arrays.select("id", "tie", F.explode("spans").alias("r"), shingles(F.col("w"), width).alias("sh"))
    windows = arrays.select("id", "tie", "sh", "r.length", "r.m", F.explode(F.sequence(F.col("r.lo"), F.col("r.hi"))).alias("start"))
    windows = windows.select("id", "tie", "length", "m", "start", F.slice("sh", F.col("start") + 1, F.col("m") - (width - 1)).alias("own_w"))
    printed = with_simhash(windows, "own_w", "window_print")
    keyed = printed.select("*", F.inline(block_values(F.col("window_print"))))
    index = wanted.select("item", "length", "own", "item_print", F.inline(block_probes(F.col("item_print"))))
    near = keyed.join(_sized(index), ["length", "block", "value"]).withColumn(
        "distance", F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print")))).filter(F.col("distance") <= RADIUS)
    # A pair that meets in several blocks is verified in the first one only.
    first = reduce(lambda x, y: x & y, [
        (F.col("block") <= b) | (F.bit_count(F.shiftrightunsigned(F.col("window_print").bitwiseXOR(F.col("item_print")), _CUTS[b])
                                             .bitwiseAND(F.lit((1 << (_CUTS[b + 1] - _CUTS[b])) - 1))) > 1) for b in range(BLOCKS)])
    checked = near.filter(first).withColumn("common", weighted_overlap(F.col("own_w"), F.col("own")))
    union = F.size("own_w") + F.size("own") - F.col("common")
    passed = checked.filter(100 * F.col("common") >= percent * union).withColumn("similarity", F.col("common") / union)
    return passed.select("id", "tie", "item", "start", "m", "distance", "similarity")
