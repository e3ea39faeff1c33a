"""Operator 12: exact top-k search by the threshold algorithm over sorted
per-dimension lists.

Vectors are dealt evenly into blocks, queries into blocks of their own; a task
gets one block of each.  It sorts the vectors once by every dimension.  For a
query it goes down all lists at the same depth, from the end that its sign in
the dimension makes the best, and scores whatever it meets first.  What was not
met yet can't score more than the query does with the values at the present
depth; as soon as the kth score beats that bound, no other vector of the block
can come in and the search ends.  Depths double, so a round is one array
operation.  The best of every block are merged: each block's own best k hold
all that can be among the best k of all.

A block has at most ``max_vectors`` vectors and ``max_queries`` queries; vectors
are copied once for each block of queries and nothing is broadcast or
collected.

Defined results: rows of null id, null vector, or a vector that holds a null or
non-finite component take no part; a vector is compared with those of its own
length only; an empty vector scores 0; rows of the query's own id are no
candidates; repeated rows of other ids each take a rank, and a query row that
comes twice is answered twice; ties go to the smaller id; products are exact,
and a score beyond 64 bits becomes the nearest 64-bit value; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pressferry.llm.common import shuffle_partitions

EXACT = float(1 << 53)
LONGEST = (1 << 63) - 1


def takes_part(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, whole numbers held as doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * vectors.astype(np.float64)), -2.0 ** 1000, 2.0 ** 1000)


class SortedLists:
    """A block of vectors, sorted by every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        rising = np.argsort(self.vectors, axis=0, kind="stable").T
        self.lists = np.stack((rising, rising[:, ::-1]))  # from the least, from the greatest
        self.values = np.stack([np.take_along_axis(self.vectors.T, x, axis=1) for x in self.lists])
        self.largest = float(np.abs(vectors).max(initial=0.0))
        self.first_depth = 8

    def _scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if float(np.abs(query).sum()) * self.largest < EXACT:
            return (self.vectors[rows] @ query).astype(np.int64)
        whole = [int(x) for x in query]
        exact = (sum(a * int(b) for a, b in zip(whole, v, strict=True)) for v in self.vectors[rows])
        return np.array([max(-LONGEST - 1, min(LONGEST, s)) for s in exact], dtype=np.int64)

    def _bound(self, query: np.ndarray, sides: np.ndarray, dims: np.ndarray, depth: int) -> int:
        """No vector below ``depth`` in every list scores more."""
        edge = self.values[sides, dims, depth]
        if float(np.abs(query).sum()) * self.largest < EXACT:
            return int(query @ edge)
        return min(LONGEST, sum(int(a) * int(b) for a, b in zip(query, edge, strict=True)))

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, in order."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        used, sides = query[dims], (query[dims] > 0).astype(np.int64)
        seen = self.ids == query_id
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        done, depth = 0, min(n, self.first_depth) if len(dims) else n
        while done < n:
            if depth == n:
                new = np.flatnonzero(~seen)
            else:
                met = np.zeros(n, dtype=bool)
                met[self.lists[sides, dims, done:depth]] = True
                new = np.flatnonzero(met & ~seen)
                seen |= met
            if len(new):
                rows, scores = np.concatenate((rows, new)), np.concatenate((scores, self._scores(new, query)))
                if len(rows) > k:  # rows are in the order of the ids: the smaller wins a tie
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    near = np.flatnonzero(scores >= least)
                    near = near[np.lexsort((rows[near], ~scores[near]))][:k]
                    rows, scores = rows[near], scores[near]
            done = depth
            if done < n and len(rows) >= k and int(scores.min()) > self._bound(used, sides, dims, done):
                break
            depth = min(n, 2 * depth)
        order = np.lexsort((rows, ~scores))  # ~ turns the order round without overflow
        return self.ids[rows[order]], scores[order]


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding", max_vectors: int = 1 << 15, max_queries: int = 1 << 13) -> DataFrame:
    """query_id, rank, id, score: for each row whose id is divisible by
    ``every`` the ``k`` rows of other ids of the largest inner product of the
    components floor(``scale`` * x)."""
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
            .filter(F.col("id").isNotNull() & takes_part(F.col("v")))
            .withColumn("width", F.size("v")).withColumn("n", F.monotonically_increasing_id()))
    is_query = F.col("id") % every == 0
    count, queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks = max(1, -(-count // max_vectors), min(shuffle_partitions(spark), -(-count // 32)))
    query_blocks = max(1, -(-queries // max_queries))
    dealt = (rows.withColumn("block", F.col("n") % blocks)
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    asked = (rows.filter(is_query).withColumn("part", (F.col("n") % query_blocks).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))))

    def search(key: tuple, block: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["n", "query_id", "id", "score"]
        if not block.num_rows or not asking.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        lists = SortedLists(block.column("id").to_numpy(), scaled(_matrix(block, "v"), scale))
        found = [lists.best(i, q, k) for i, q in zip(asking.column("id").to_pylist(), scaled(_matrix(asking, "v"), scale), strict=True)]
        sizes = [len(f[0]) for f in found]
        return pa.table([np.repeat(asking.column("n").to_numpy(), sizes), np.repeat(asking.column("id").to_numpy(), sizes),
                         np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], names)

    keys = ["width", "block", "part"]
    found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "n bigint, query_id bigint, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id", "n").orderBy(F.desc("score"), "id"))
    return (found.withColumn("rank", place).filter(F.col("rank") <= k)
            .select(F.col("query_id").cast(id_type), "rank", F.col("id").cast(id_type).alias(id_col), "score"))


#: The same by all pairs of a query and a vector.
TOP_K_SQL = """
WITH v AS (
    SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS c FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
    FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.c) = len(q.c)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 10
"""
