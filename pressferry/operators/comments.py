"""Comment transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressferry.functions.scalars import approved_flag, epoch_to_ts
from pressferry.operators.dml import replace_into

HOMEPAGE_LIMIT = 200


def comment_rows(comments: DataFrame, homepage_limit: int = HOMEPAGE_LIMIT) -> DataFrame:
    return comments.select(
        F.col("cid").alias("comment_ID"),
        F.col("nid").alias("comment_post_ID"),
        epoch_to_ts("timestamp").alias("comment_date"),
        F.col("comment").alias("comment_content"),
        F.col("pid").alias("comment_parent"),
        F.col("name").alias("comment_author"),
        F.col("mail").alias("comment_author_email"),
        F.substring("homepage", 1, homepage_limit).alias("comment_author_url"),
        approved_flag("status").alias("comment_approved"),
    )


def comments(source: DataFrame, wp_comments: DataFrame, *, trust_source_keys: bool = True) -> DataFrame:
    """REPLACE DISTINCT comment rows keyed by comment id.

    cid is the comment table's primary key, so (default) the rows are
    already unique on the target key: DISTINCT and the batch de-duplication
    fold away and the comment bodies are not shuffled.  ``False`` keeps the
    general path (rows equal in every column collapse)."""
    if trust_source_keys:
        return replace_into(wp_comments, comment_rows(source), ["comment_ID"], incoming_unique=True)
    return replace_into(wp_comments, comment_rows(source), ["comment_ID"])
