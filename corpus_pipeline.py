"""Corpus pipeline: quality classifier, line de-duplication, n-gram Jaccard
join, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it as the next stage's
documents.  All stages but the last return the columns of their input.

Rows with a null id: they are judged by their text like all others; where a
decision is keyed by the id, null ids match null ids.  Repeated rows (equal id
and text) share every decision; the near-duplicate stage keeps one of them.
Different texts under one id, or under none, are judged each.
Empty tables pass through every stage; further columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressferry.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality
from pressferry.llm.common import table, written


def _key(text: Column) -> Column:
    return jaccard_join.text_key(text)


def _row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row."""
    plain = lambda f: F.to_json(F.struct(f"`{f.name}`")) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"`{f.name}`")
    return F.xxhash64(*[plain(f) for f in docs.schema.fields])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds bad or toxic go."""
    judged = quality.classify_documents(docs, table(spark, sf_dir, "labels"))
    rejected = judged.filter("NOT keep").select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_id"]) & (_key(docs["text"]) == rejected["text_hash"]), "left_anti")


def line_window_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which nothing is left goes with them.
    n_chars follows the text."""
    cut = line_dedup.line_dedup(docs)
    kept = cut.filter(~((F.col("_n_removed") > 0) & (F.trim(F.col("text")) == "")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 of five-word
    shingles one row stays: the smallest id (null last), then the smallest text
    hash; of rows with the same id and text that with the smallest hash of all its
    columns.  Empty texts are in no group."""
    gone = jaccard_join.near_others(docs, width=5, percent=80).select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (_key(docs["text"]) == gone["_key"]), "left_anti")
    kept = kept.withColumn("__pick_key", _key(F.col("text"))).withColumn("__pick_row", _row_key(docs))
    again = (kept.groupBy(F.col("doc_id").alias("__pick_again"), F.col("__pick_key").alias("__pick_again_key"))  # narrow: no text is shuffled for this
             .agg(F.count(F.lit(1)).alias("__pick_n"), F.min("__pick_row").alias("__pick_least")).filter("__pick_n > 1").drop("__pick_n"))
    same = kept["doc_id"].eqNullSafe(F.col("__pick_again")) & (F.col("__pick_key") == F.col("__pick_again_key"))
    single = kept.join(again, same, "left_anti")
    chosen = kept.join(again, same & (F.col("__pick_row") == F.col("__pick_least"))).drop("__pick_again", "__pick_again_key", "__pick_least").dropDuplicates(["doc_id", "__pick_key"])
    return single.unionByName(chosen).drop("__pick_key", "__pick_row")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage like a benchmark item go; clean texts under
    the same id stay."""
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("id").alias("_id"), F.col("tie").alias("_tie"))
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_id"]) & (decontaminate.text_tie(docs["text"]) == hits["_tie"]), "left_anti")


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests and the round trip."""
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_window_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
