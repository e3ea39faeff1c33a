"""Operator 13: the prefix trie of conversations, rolled up by depth bands.

A rebuilt conversation begins with turns of the first conversation of its run
of ``run`` ids and goes on with its own.  Every distinct sequence of first
turns is a node; the key of a node is the exclusive or of hashes of its turns
with their places, two lanes of 64 bits, so the keys along a conversation are
prefix sums and the key of a parent is that of its child without the last turn.

Sums over subtrees go by bands of ``height`` depths.  Inside a band each node is
spread to its ancestors in the band only (``height`` rows at most).  The tops of
the bands are a trie of their own, ``height`` times as shallow, whose totals come
from the same roll-up again; each completed total then goes from its band's top
to the ancestors in the band above, once.  So a trie of depth d takes
log(d) / log(``height``) rounds, and no row is spread further than ``height``.

No group is gathered whole: turns are numbered by a global sort of narrow rows,
prefix sums go by blocks of ``scan`` turns with one carry per block, nodes are
counted by partial aggregates, joins match one row on one side, and the member
lists of nodes are hashed as streams of sorted, packed runs.

Defined results: rows of null conv_id take no part; null turns come first, turns
that tie are ordered by role, then by a hash of the text; a null role or text is
empty; equal rows are turns of their own; a conversation whose own turns all
give way, without a first one, is turnless and ends at the root; an empty table
gives no rows; other columns are ignored.  c - c%20 is cut toward zero, so ids
-19 to 19 are one run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pressferry.llm.common import shuffle_partitions, with_row_numbers, written

WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def rebuilt_paths(conversations: DataFrame, run: int = 20, heads: int = 4, scan: int = 1 << 10) -> DataFrame:
    """Each rebuilt conversation's way from the root, one row a depth: c, d, the
    node's key (a, b), its parent's (pa, pb), the words of its last text, and
    whether the conversation ends there."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"), "turn", role.alias("role"), F.xxhash64(role, text).alias("x"),
        F.xxhash64(F.lit("second lane"), text, role).alias("y"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    numbered, _ = with_row_numbers(turns, ["c", "turn", "role", "x", "y"], "rn")
    own = numbered.select("c", "rn", "x", "y", "words")
    sizes = own.groupBy("c").agg(F.min("rn").alias("start"), F.count(F.lit(1)).alias("m"))
    sizes = sizes.withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % heads).withColumn("first", F.col("c") - F.col("c") % run)
    lead = sizes.select(F.col("c").alias("first"), F.col("m").alias("lead"))
    sizes = (sizes.join(lead, "first", "left").withColumn("taken", F.least("h", F.coalesce("lead", F.lit(0))))
             .withColumn("length", F.col("taken") + F.greatest(F.col("m") - F.col("h"), F.lit(0))))
    sizes = written(sizes.select("c", "start", "h", "first", "taken", "length"), "trie-sizes")

    placed = own.join(sizes, "c").withColumn("place", F.col("rn") - F.col("start") + 1)
    later = placed.filter("place > h").select("c", (F.col("place") - F.col("h") + F.col("taken")).alias("d"), "length", "x", "y", "words")
    opening = placed.filter((F.col("place") < heads) & (F.col("c") == F.col("first"))).select("first", "place", "x", "y", "words")
    earlier = (sizes.select("c", "first", "taken", "length").join(opening, "first").filter("place <= taken")
               .select("c", F.col("place").alias("d"), "length", "x", "y", "words"))
    steps = (later.unionByName(earlier).withColumn("ta", F.xxhash64("x", "y", "d")).withColumn("tb", F.xxhash64(F.lit("second lane"), "d", "y", "x"))
             .withColumn("block", F.floor((F.col("d") - 1) / scan)).drop("x", "y"))
    steps = written(steps, "trie-steps")

    along = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (steps.filter(F.col("length") > scan).groupBy("c", "block").agg(F.bit_xor("ta").alias("xa"), F.bit_xor("tb").alias("xb"))
             .select("c", "block", F.bit_xor("xa").over(before).alias("xa"), F.bit_xor("xb").over(before).alias("xb")))
    whole = lambda lane, carried: F.bit_xor(lane).over(along).bitwiseXOR(F.coalesce(carried, F.lit(0).cast("bigint")))
    keyed = (steps.join(carry, ["c", "block"], "left").withColumn("a", whole("ta", "xa")).withColumn("b", whole("tb", "xb")))
    nothing, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    roots = sizes.select("c", nothing.alias("d"), nothing.alias("a"), nothing.alias("b"), none.alias("pa"), none.alias("pb"), nothing.alias("words"),
                         (F.col("length") == 0).alias("ends"))
    paths = keyed.select("c", "d", "a", "b", F.col("a").bitwiseXOR(F.col("ta")).alias("pa"), F.col("b").bitwiseXOR(F.col("tb")).alias("pb"), "words",
                         (F.col("d") == F.col("length")).alias("ends"))
    return written(paths.unionByName(roots), "trie-paths")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """One row a node: key, depth d, its smallest member (rep), n_convs, words,
    n_children and the smallest member of its parent."""
    nodes = written(paths.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("c").alias("rep"), F.count(F.lit(1)).alias("n_convs"),
                                                F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("words").alias("words")), "trie-keys")
    children = nodes.filter("d > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("rep").alias("parent_rep"))
    return written(nodes.join(children, ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
                   .select("a", "b", "d", "rep", "parent_rep", "n_convs", "words", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children")), "trie-nodes")


def band_totals(paths: DataFrame, weights: DataFrame, sums: list[str], deepest: int, height: int) -> DataFrame:
    """a, b and the total of each of ``sums`` over the subtree of every node.
    ``paths``: c, d, a, b, the way of each conversation; ``weights``: a, b, rep
    (a conversation through the node) and the node's own ``sums``."""
    if height < 2:
        raise ValueError("a band has two depths at least")
    own = paths.join(weights.withColumnRenamed("rep", "c").withColumn("is_node", F.lit(True)), ["c", "a", "b"], "left")
    bands = (own.withColumn("band", F.floor(F.col("d") / height)).groupBy("c", "band")
             .agg(F.collect_list(F.struct("d", "a", "b", "is_node", *sums)).alias("way")))  # height rows at most
    spread = bands.withColumn("node", F.explode(F.filter("way", lambda s: s["is_node"])))
    spread = spread.select("node", F.explode(F.filter("way", lambda s: s["d"] <= F.col("node.d"))).alias("above"))
    inside = written(spread.groupBy(F.col("above.a").alias("a"), F.col("above.b").alias("b"))
                     .agg(*[F.sum(f"node.{s}").alias(s) for s in sums]), "trie-band")
    if deepest < height:
        return inside
    tops = paths.filter(F.col("d") % height == 0)
    top_weights = inside.join(weights.select("a", "b", "rep"), ["a", "b"])
    done = band_totals(tops.withColumn("d", F.floor(F.col("d") / height)), top_weights, sums, deepest // height, height)
    completed = (tops.filter("d > 0").join(done.join(weights.select("a", "b", F.col("rep").alias("c")), ["a", "b"]), ["c", "a", "b"])
                 .select("c", (F.floor(F.col("d") / height) - 1).alias("band"), *sums))
    carried = (paths.withColumn("band", F.floor(F.col("d") / height)).join(completed, ["c", "band"])
               .groupBy("a", "b").agg(*[F.sum(s).alias(f"_{s}") for s in sums]))
    return inside.join(carried, ["a", "b"], "left").select("a", "b", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums])


def member_digests(ends: DataFrame) -> DataFrame:
    """a, b and the SHA-256 of the decimal c of each key, ascending, joined by
    commas.  Sorted runs are packed first; the runs of a key are then hashed as
    a stream, so nothing but a batch is held."""
    parts = shuffle_partitions(ends.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
            ids = batch.column("c").to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            runs = [(*keys[i], ids[i], ",".join(map(str, ids[i:j]))) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if i < j]
            if runs:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*runs, strict=True)], ["a", "b", "first", "run"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for a, b, run in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "run")), strict=True):
                if (a, b) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(run.encode())
                else:
                    state.update(b"," + run.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["a", "b", "sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([state.hexdigest()])], ["a", "b", "sha256"])

    runs = (ends.select("a", "b", "c").repartitionByRange(parts, "a", "b", "c").sortWithinPartitions("a", "b", "c")
            .mapInArrow(pack, "a bigint, b bigint, first bigint, run string"))
    return runs.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a bigint, b bigint, sha256 string")


def prefix_trie(conversations: DataFrame, run: int = 20, heads: int = 4, height: int = 16, scan: int = 1 << 10) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = rebuilt_paths(conversations, run, heads, scan)
    nodes = trie_nodes(paths)
    deepest = nodes.agg(F.max("d")).first()[0] or 0
    weights = nodes.select("a", "b", "rep", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = band_totals(paths.select("c", "d", "a", "b"), weights, ["n_leaves", "saved_tokens"], deepest, height)
    digests = member_digests(paths.filter("ends"))
    return nodes.join(totals, ["a", "b"]).join(digests, ["a", "b"], "left").select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent_rep").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(s)::BIGINT FOR s IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda crc, s: list_reduce(list_prepend(xor(crc, s), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda t, u: xor(t >> 1, 3988292384::BIGINT * (t & 1)))))"""

#: The same with whole paths as keys: each node's sums go to all its prefixes.
PREFIX_TRIE_SQL = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC32} % 4 AS h, conv_id - conv_id % 20 AS first FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
    SELECT c.conv_id, 0 AS kind, t.place, t.role, t.text, t.words FROM convs AS c JOIN turns AS t ON t.conv_id = c.first AND t.place <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.place, t.role, t.text, t.words FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND t.place > c.h),
ways AS (
    SELECT conv_id, list(sha256(len(role) || ':' || role || text)) OVER up AS path, row_number() OVER up AS depth, words,
        row_number() OVER up = count(*) OVER (PARTITION BY conv_id) AS ends
    FROM rebuilt WINDOW up AS (PARTITION BY conv_id ORDER BY kind, place)
    UNION ALL
    SELECT conv_id, []::VARCHAR[], 0, 0, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS (
    SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM ways GROUP BY path),
families AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM nodes AS n LEFT JOIN families AS f ON f.path = n.path),
spread AS (SELECT path, depth, saved, n_children, unnest(range(0, depth + 1)) AS up FROM own),
totals AS (SELECT path[1:up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM spread GROUP BY ALL)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, t.n_leaves,
    CAST(t.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own AS o JOIN totals AS t ON t.path = o.path LEFT JOIN nodes AS p ON o.depth > 0 AND p.path = o.path[1:o.depth - 1]
"""
