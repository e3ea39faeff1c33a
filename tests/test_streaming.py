"""Micro-batch upserts give the same table as the batch statement."""

import os

from conftest import SF_SMALL
from pressferry.operators import comments
from pressferry.plans.sinks import Warehouse
from pressferry.schemas import empty_target
from pressferry.sources.fixtures import load_tables
from pressferry.streaming import incremental


def test_stream_of_comments_equals_batch_m17(spark, tmpdir_path):
    t = load_tables(spark, SF_SMALL)
    src = t["comments"]
    inbox = os.path.join(tmpdir_path, "inbox")
    # Two arrivals; the second repeats some ids with changed text (a re-sent batch).
    src.where("cid <= 600").write.parquet(os.path.join(inbox, "a"))
    src.where("cid > 500").write.parquet(os.path.join(inbox, "b"))

    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh"))
    handler = incremental.upsert_batches(
        wh, "wp_comments", comments.comment_rows, ["comment_ID"],
        empty=empty_target(spark, "wp_comments"), incoming_unique=False, order=["comment_ID"])
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(inbox + "/*")
    q = incremental.run(stream, handler, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)

    got = wh.read("wp_comments")
    want = comments.comments(src, empty_target(spark, "wp_comments"))
    assert got.count() == want.count() == 1000
    assert got.exceptAll(want).count() == 0


def test_bucketed_stream_rewrites_only_touched_buckets(spark, tmpdir_path):
    from pyspark.sql import functions as F

    t = load_tables(spark, SF_SMALL)
    src = t["comments"]
    inbox = os.path.join(tmpdir_path, "inbox")
    src.where("cid <= 600").write.parquet(os.path.join(inbox, "a"))
    src.where("cid > 500").write.parquet(os.path.join(inbox, "b"))
    wh = Warehouse(spark, os.path.join(tmpdir_path, "wh"))
    handler = incremental.upsert_bucketed(
        wh, "wp_comments", comments.comment_rows, "comment_ID", order=["comment_ID"], buckets=8,
        empty=empty_target(spark, "wp_comments"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(inbox + "/*")
    q = incremental.run(stream, handler, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    got = wh.read("wp_comments")
    assert set(wh.folders("wp_comments").values()) == set(range(8))
    want = comments.comments(src, empty_target(spark, "wp_comments"))
    assert got.count() == 1000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # A later batch touching one key only rewrites that key's bucket.
    before = wh.folders("wp_comments")
    one = src.where("cid = 7")
    incremental.upsert_bucketed(wh, "wp_comments", comments.comment_rows, "comment_ID",
                                order=["comment_ID"], buckets=8)(one, 99)
    after = wh.folders("wp_comments")
    assert len(set(before) - set(after)) == len(set(after) - set(before)) == 1
    assert wh.read("wp_comments").count() == 1000
    assert wh.read("wp_comments").where(F.col("comment_ID") == 7).count() == 1
