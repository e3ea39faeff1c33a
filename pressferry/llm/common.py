"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: ASCII white space, the only word separator of the word operators.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder is made on local masters only; on a
    cluster an unset folder is an error, because executors could not read each
    other's files."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        configured = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Gapless numbers from 0 in the order of ``order`` (nulls first), and the
    row count, without one task seeing all rows: range partitions, a reliable
    checkpoint, one count per partition, offsets.  Give narrow rows."""
    parts = shuffle_partitions(df.sparkSession)
    ranged = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_p", F.spark_partition_id()))
    fixed = checkpointed(ranged).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = fixed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    numbered = (fixed.join(F.broadcast(offsets), "_p")
                .withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o"))
    return numbered, int(total)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut to at most ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            done = int(total[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(total, done + max_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: a worker that waits for its next
    task shouldn't hold the buffers of the last."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def whole_texts(texts: pa.Array) -> pa.Array:
    """The texts (null: empty) in buffers of their own.  Lower-casing the cast
    of a slice reads the wrong bytes, so slices are copied first."""
    texts = pc.fill_null(texts, "")
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    return texts.cast(pa.large_string())


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased (A-Z) words of each text: (first word of each text and the
    end, code of each word, the distinct words).  Null texts have no words."""
    texts = whole_texts(texts)
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    keep = pc.not_equal(flat, "")
    if not pc.all(keep, min_count=0).as_py():
        kept = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))
        offsets, flat = kept[offsets], flat.filter(keep)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy().astype(np.int64), coded.dictionary


_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()),
                       dtype=np.uint64, count=len(words))


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of ``width`` words of each text, with repeats
    and in order (a shorter text with words is one run), and the first run of
    each text with the end."""
    offsets, codes, words = word_codes(texts)
    size = np.diff(offsets)
    hashed = word_hashes(words)[codes] if len(words) else np.zeros(0, dtype=np.uint64)
    n = len(codes)
    runs = np.where(size >= width, size - width + 1, (size > 0).astype(np.int64))
    cuts = np.concatenate(([0], np.cumsum(runs)))
    out = np.zeros(int(cuts[-1]), dtype=np.uint64)
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    if n >= width:
        rolled = np.full(n - width + 1, width, dtype=np.uint64)
        for k in range(width):
            rolled = mix(rolled * multiplier + hashed[k:n - width + 1 + k])
        long = size >= width
        starts = np.repeat(offsets[:-1][long], runs[long])
        inner = np.arange(len(starts)) - np.repeat(np.cumsum(runs[long]) - runs[long], runs[long])
        out[np.repeat(long, runs)] = rolled[starts + inner]
    for i in np.flatnonzero((size > 0) & (size < width)):
        value = np.array([size[i]], dtype=np.uint64)
        for h in hashed[offsets[i]:offsets[i + 1]]:
            value = mix(value * multiplier + h)
        out[cuts[i]] = value[0]
    return cuts, out


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the edges
    (a, b), by alternating large and small stars; nothing is collected but two
    numbers a round."""

    def stars(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else \
            pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if larger:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return moved.filter("a <> b").distinct()

    def digest(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = digest(now)
    while True:
        now = checkpointed(stars(stars(now, True), False))
        if (state := digest(now)) == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """(intercept, slope) of a logistic curve through (x, y in 0 to 1).  Newton
    steps on the scaled measure, halved until the penalised loss falls: on
    separable data plain steps would run off."""
    scale = float(np.std(x)) or 1.0
    z = np.stack((np.ones(len(x)), x / scale), axis=1)
    mean = float(np.clip(np.mean(y), 1e-4, 1 - 1e-4))
    w = np.array([np.log(mean / (1 - mean)), 0.0])

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float((np.logaddexp(0, m) - y * m).sum() + ridge / 2 * (v @ v))

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) >= now:
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, before):
            break
    return float(w[0]), float(w[1]) / scale
