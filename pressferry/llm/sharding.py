"""Operator 8: sharding by a Feistel permutation with cycle walking.

Rows get gapless global numbers in a fixed order; a keyed Feistel network over
the smallest even-bit domain that holds n numbers permutes them, walking the
cycle until a number below n comes out.  The permuted number p gives the shard
p mod k and the slot p div k, so shard sizes differ by at most one row, slots
are gapless, and either direction is computed from the number alone:
``place`` and ``row_at`` need no table.

Defined results: null text has no bytes (size 1) and the CRC of the empty
string; rows are numbered by id, CRC, size (nulls first), so equal rows are
interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressferry.llm.common import mix, with_row_numbers

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: int, i: int, bits: int) -> np.ndarray:
    salt = np.uint64((key * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    return mix(half + salt) & np.uint64((1 << bits) - 1)


def _network(x: np.ndarray, key: int, bits: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ _round(left, key, i, bits), left
        else:
            left, right = right, left ^ _round(right, key, i, bits)
    return left << np.uint64(bits) | right


def permute(numbers: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at ``numbers``."""
    bits = _half_bits(n)
    out = _network(numbers.astype(np.uint64), key, bits, back)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = _network(out[outside], key, bits, back)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def place(number: int, n: int, shards: int, key: int) -> tuple[int, int]:
    """(shard, slot) of a global row number."""
    p = int(permute(np.array([number]), n, key)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, key: int) -> int:
    """The global row number at a shard and slot."""
    return int(permute(np.array([slot * shards + shard]), n, key, back=True)[0])


def shard(docs: DataFrame, shards: int = 8, key: int = 20240229, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, global_row, law, shard, slot, grown_shard of every
    row.  The law is ``rows``; ``grown_shard`` is null under it."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = with_row_numbers(narrow, [id_col, "text_crc32", "size"], "global_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permute(batch.column("global_row").to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)],
                [*batch.schema.names, "shard", "slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields)
    placed = numbered.mapInArrow(run, f"{fields}, shard int, slot bigint")
    return placed.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "global_row")
