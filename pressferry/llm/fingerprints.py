"""Operator 6: document fingerprints by a homomorphic multiset hash.

A text is cut into paragraph pieces (line ends, sentence ends, 200 characters
at most).  Each piece is hashed to a wide vector of small odd numbers; the
fingerprint is their sum, component by component, modulo 2 ** 32 (a text would
need 143 million equal pieces to wrap).  It doesn't depend on the order of the pieces, and pieces are inserted or deleted by adding
or subtracting their vectors: an edited text's fingerprint is made from the old
one and the changed pieces alone.  The vectors are random with mean zero, so
the squared length of a difference estimates how many pieces differ, which
gives ``likeness``.

Defined results: null text is empty; an empty text has the zero vector; two
empty texts have likeness 1; equal texts have equal fingerprints; rows with
equal ids follow each other by a hash of their text; null ids come first; a
single document is its own next one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pressferry.llm.common import shuffle_partitions, slices, written

WIDTH = 128
_PIECES = re.compile(r"[^.!?\n]{1,200}[.!?]*\n?|[.!?\n]+").findall


def pieces(text: str) -> list[str]:
    """The paragraph pieces; joined they are the text again."""
    return _PIECES(text)


def vectors(parts: list[str]) -> np.ndarray:
    """One row of WIDTH odd numbers from -15 to 15 for each piece."""
    digest = hashlib.blake2b
    raw = np.frombuffer(b"".join(digest(p.encode()).digest() for p in parts), dtype=np.uint8).reshape(-1, WIDTH // 2)
    out = np.empty((len(raw), WIDTH), dtype=np.int16)
    out[:, 0::2] = raw & 15
    out[:, 1::2] = raw >> 4
    return 2 * out - 15


def sums(groups: list[list[str]]) -> np.ndarray:
    """The sum of the piece vectors of each group, modulo 2 ** 32."""
    out = np.zeros((len(groups), WIDTH), dtype=np.int32)
    sizes = np.array([len(g) for g in groups], dtype=np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.cumsum(sizes[full]) - sizes[full]
        out[full] = np.add.reduceat(vectors([p for g in groups for p in g]), starts, axis=0, dtype=np.int32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows: 1 - |a - b|^2 / (|a|^2 + |b|^2)."""
    square = lambda x: (x.astype(np.float64) ** 2).sum(axis=1)
    gap, both = square(a.astype(np.int64) - b), square(a) + square(b)
    return np.where(gap == 0, 1.0, np.clip(1.0 - gap / np.maximum(both, 1.0), 0.0, 1.0))


def as_string(vector: np.ndarray) -> str:
    return base64.b64encode(vector.astype("<i4").tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<i4")


def edit(text: str, following: str) -> tuple[str, list[str], list[str]]:
    """The edited text (its last quarter replaced by as much of the beginning
    of ``following``), and the pieces deleted from and inserted into it."""
    n = len(text)
    keep = n - n // 4
    parts, end, k = pieces(text), 0, 0
    while k < len(parts) and end + len(parts[k]) < keep:
        end += len(parts[k])
        k += 1
    tail = text[end:keep] + following[:n // 4]
    return text[:keep] + following[:n // 4], parts[k:], pieces(tail)


#: The vectors stay bytes until the end: they compress, their text form doesn't.
_RESULT = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _finish(texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    """The result columns of texts whose next documents are known."""
    edits = [edit(a, b) for a, b in zip(texts, following, strict=True)]
    edited = own - sums([e[1] for e in edits]) + sums([e[2] for e in edits])
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e[0].encode()).hexdigest() for e in edits], pa.string()),
        pa.array([v.astype("<i4").tobytes() for v in own], pa.binary()),
        pa.array([v.astype("<i4").tobytes() for v in edited], pa.binary()),
        pa.array(likeness(own, edited), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = 4 << 20) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of every row; the next document is the next one by id.

    One range shuffle by id; each task walks its sorted part once.  The last
    row of a part waits for the first row of the next: these rows, two for each
    part, meet in a join of their own."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    ranged = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
              .withColumn("tie", F.xxhash64("text"))
              .repartitionByRange(shuffle_partitions(spark), "id", "tie").sortWithinPartitions("id", "tie")
              .select("id", "text", F.spark_partition_id().alias("part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "part", "id", "text", *[f.split()[0] for f in _RESULT.split(", ")]]
        held: tuple | None = None  # the last row so far: id, text, vector
        part, id_arrow = 0, None

        def edge(kind: str, row: tuple) -> pa.RecordBatch:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part], pa.int32()), pa.array([row[0]], id_arrow), pa.array([row[1]]), *empty], names)

        for batch in slices(batches, "text", block_bytes):
            id_arrow, part = batch.column("id").type, batch.column("part")[0].as_py()
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            own = sums([pieces(t) for t in texts])
            if held is None:
                yield edge("first", (ids[0], texts[0]))
            else:
                ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], own])
            held = (ids[-1], texts[-1], own[-1])
            n = len(ids) - 1
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["row"] * n), pa.array([part] * n, pa.int32()), pa.array(ids[:-1], id_arrow), pa.nulls(n, pa.string()),
                     *_finish(texts[:-1], texts[1:], own[:-1], own[1:])], names)
        if held is not None:
            yield edge("last", held)

    walked = written(ranged.mapInArrow(run, f"kind string, part int, id {id_type}, text string, {_RESULT}"), "fingerprints", "zstd")
    result = [f.split()[0] for f in _RESULT.split(", ")]
    # One "first" row for each part: as few as there are parts, never as many as documents.
    firsts = walked.filter("kind = 'first'").select("part", F.col("text").alias("first_text"))
    order = Window.orderBy("part")
    chain = firsts.select("part", F.lead("part").over(order).alias("next_part"), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("zero"))
    chain = chain.select("part", F.coalesce("next_part", "zero").alias("next_part"))
    following = chain.join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("part", "first_text")
    lasts = walked.filter("kind = 'last'").select("id", "text", "part").join(following, "part").select("id", "text", "first_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", block_bytes):
            texts, after = batch.column("text").to_pylist(), batch.column("first_text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_finish(texts, after, sums([pieces(t) for t in texts]), sums([pieces(t) for t in after]))], ["id", *result])

    closed = lasts.mapInArrow(close, f"id {id_type}, {_RESULT}")
    every = walked.filter("kind = 'row'").select("id", *result).unionByName(closed)
    return every.select(F.col("id").alias(id_col), *[F.translate(F.base64(c), "\r\n", "").alias(c) if c.endswith("fingerprint") else c for c in result])
