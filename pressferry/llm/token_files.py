"""Operator 3: token counts of documents in flat, unindexed token files.

A token file is nothing but the ids of its documents, each followed by the
end-of-document id, as numbers of a fixed width.  Files are cut into blocks;
each block is read on its own and searched for the separator as one vector.  A
block reports its first and last separator, their number, and the lengths of
the documents wholly inside; a prefix scan over the blocks (within groups of
blocks, then over groups) gives what stands before each: the number of
documents and the place of the last separator, which completes the document
that crosses the block's beginning.

Defined results: an empty document counts 0; tokens after the last separator
are a document with ``ended`` false; an empty file has no documents; a file
whose size isn't a whole number of tokens is an error; no files give no rows.
For writing: null text is empty; repeated rows are written each; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pressferry.llm.common import new_folder, slices

#: Blocks in a group of the prefix scan.
GROUP = 4096


def layout(eod: int, vocabulary: int) -> np.dtype:
    """The narrowest number format whose last byte of ``eod`` is ASCII (the
    text writer's line end supplies that byte)."""
    for name in (">u2", "<u2", ">u4", "<u4"):
        kind = np.dtype(name)
        if max(eod, vocabulary - 1) < 1 << 8 * kind.itemsize and np.array(eod, dtype=kind).tobytes()[-1] < 0x80:
            return kind
    raise ValueError("no layout for these ids")


def write_token_files(docs: DataFrame, path: str, encoder: Callable[[], Callable[[list[str]], list[list[int]]]],
                      eod: int, vocabulary: int, text_col: str = "text") -> np.dtype:
    """Write one flat file for each stretch of ``docs``: the columns ``source``
    (any name of the row's origin) and ``row`` (ascending by one within it)
    place a row.  A file in folder shard=<source>.<row> starts with that row.
    Spark's text writer commits the files: a row is the bytes of a document but
    for the last, which is the same in every separator and stands as line end.
    """
    kind = layout(eod, vocabulary)
    end = np.array(eod, dtype=kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        shard, last = None, None
        for batch in slices(batches, text_col, 4 << 20):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            sources, rows = batch.column("source").to_pylist(), batch.column("row").to_pylist()
            shards, payloads = [], []
            for source, row, ids in zip(sources, rows, encode(texts), strict=True):
                if last != (source, row - 1):
                    shard = f"{source}.{row}"
                last = (source, row)
                shards.append(shard)
                payloads.append((np.array(ids, dtype=kind).tobytes() + end)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(rows, pa.int64()), pa.array(payloads, pa.binary())], ["shard", "row", "payload"])

    rows = docs.select("source", "row", text_col).mapInArrow(run, "shard string, row bigint, payload binary")
    (rows.sortWithinPartitions("shard", "row").select(F.col("payload").cast("string").alias("value"), "shard")
     .write.partitionBy("shard").option("lineSep", end[-1:].decode("ascii")).text(path))
    return kind


def read_range(uri: str, start: int, size: int) -> bytes:
    """Bytes of a file in any store that Arrow's file systems open."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read_at(size, start)


def scan_block(tokens: np.ndarray, eod: int) -> tuple[int, int, int, np.ndarray]:
    """Number of separators, first and last place (-1: none), and the lengths
    of the documents between them."""
    at = np.flatnonzero(tokens == eod)
    if not len(at):
        return 0, -1, -1, at
    return len(at), int(at[0]), int(at[-1]), np.diff(at) - 1


def scan_token_files(spark: SparkSession, path: str, kind: np.dtype, eod: int, block_tokens: int = 1 << 20) -> DataFrame:
    """file, ordinal (from 0), n_tokens, ended for every document of the files
    below ``path``."""
    width = kind.itemsize
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    blocks = files.filter("length > 0").select(F.col("path").alias("file"), (F.col("length") / width).alias("tokens"), F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / (block_tokens * width)))).alias("block"))
    blocks = blocks.repartition("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, tokens, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tokens != int(tokens):
                    raise ValueError(f"{file} isn't a whole number of tokens")
                start = block * block_tokens
                data = np.frombuffer(read_range(file, start * width, min(block_tokens, int(tokens) - start) * width), dtype=kind)
                n, first, last, inner = scan_block(data, eod)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([int(tokens)]), pa.array([block]), pa.array([n]), pa.array([start + first if n else None], pa.int64()),
                     pa.array([start + last if n else None], pa.int64()), pa.array([inner.astype(np.int64)], pa.list_(pa.int64()))],
                    ["file", "tokens", "block", "separators", "first", "last", "inner"])

    scanned = blocks.mapInArrow(run, "file string, tokens bigint, block bigint, separators bigint, first bigint, last bigint, inner array<bigint>")
    scanned = scanned.withColumn("group", F.floor(F.col("block") / GROUP))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    narrow = scanned.select("file", "group", "block", "separators", "first", "last", "inner", "tokens")
    inside = narrow.withColumn("docs_in", F.coalesce(F.sum("separators").over(before(["file", "group"], "block")), F.lit(0))) \
        .withColumn("last_in", F.max("last").over(before(["file", "group"], "block")))
    groups = scanned.groupBy("file", "group").agg(F.sum("separators").alias("n"), F.max("last").alias("l"))
    groups = groups.select("file", "group", F.coalesce(F.sum("n").over(before(["file"], "group")), F.lit(0)).alias("docs_before"),
                           F.max("l").over(before(["file"], "group")).alias("last_before"))
    placed = inside.join(groups, ["file", "group"]).select(
        "file", "tokens", "block", "separators", "first", "last", "inner", (F.col("docs_in") + F.col("docs_before")).alias("docs"),
        F.coalesce("last_in", "last_before", F.lit(-1)).alias("previous"))
    head = F.when(F.col("separators") > 0, F.array(F.col("first") - F.col("previous") - 1)).otherwise(F.array().cast("array<bigint>"))
    counted = placed.select("file", "docs", F.posexplode(F.concat(head, "inner")).alias("k", "n_tokens")).select(
        "file", (F.col("docs") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    final_block = placed.filter(F.col("block") == F.floor((F.col("tokens") - 1) / block_tokens))
    tail = F.col("tokens") - 1 - F.coalesce("last", "previous")
    rest = final_block.filter(tail > 0).select("file", (F.col("docs") + F.col("separators")).alias("ordinal"), tail.alias("n_tokens"), F.lit(False).alias("ended"))
    return counted.unionByName(rest)


def token_counts(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], eod: int, vocabulary: int,
                 block_tokens: int = 1 << 20) -> DataFrame:
    """Write documents read from files as token files, scan these, and bring
    the counts back: doc_id, n_tokens.  A row's origin is its file and its
    place there, so no order has to be made or remembered."""
    spark = docs.sparkSession
    origin = docs.select("doc_id", "text", F.md5(F.col("_metadata.file_path").cast("binary")).alias("source"),
                         F.col("_metadata.row_index").alias("row"))
    path = new_folder(spark, "tokens")
    kind = write_token_files(origin, path, encoder, eod, vocabulary)
    counts = scan_token_files(spark, path, kind, eod, block_tokens)
    shard = F.regexp_extract("file", r"shard=([0-9a-f]+)\.(\d+)/", 1), F.regexp_extract("file", r"shard=([0-9a-f]+)\.(\d+)/", 2)
    counts = counts.select(shard[0].alias("source"), (shard[1].cast("bigint") + F.col("ordinal")).alias("row"), "n_tokens")
    # These rows shrink so far when compressed that their shuffled size would pass for a small table's.
    return origin.select("doc_id", "source", "row").join(counts.hint("merge"), ["source", "row"]).select("doc_id", "n_tokens")


def rank_encoder(ranks: dict[bytes, int], pattern: str, block_bytes: int = 1 << 20) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """An encoder for the executors from a rank table (operator 9's coder)."""

    def make() -> Callable[[list[str]], list[np.ndarray]]:
        from pressferry.llm.byte_bpe import coder_for

        coder = coder_for(ranks, pattern)

        def encode(texts: list[str]) -> list[np.ndarray]:
            out: list[np.ndarray] = []
            while len(out) < len(texts):
                end, size = len(out), 0
                while end < len(texts) and (end == len(out) or size + len(texts[end]) <= block_bytes):
                    size += len(texts[end])
                    end += 1
                ids, cuts = coder.encode(texts[len(out):end])
                out += np.split(ids, cuts[1:-1])
            return out

        return encode

    return make
