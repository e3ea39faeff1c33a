"""Content transforms: nodes + revisions + aliases -> posts, and the post
housekeeping updates (M10-M12, M18, M26, M27, O12, O13, O15, O16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressferry.functions.scalars import alias_or_id, epoch_to_ts, publish_status, strip_curly_quotes
from pressferry.operators.dml import (
    pick_one,
    replace_into,
    update_from_join,
    update_where,
    update_where_not_in,
    update_with_count,
)
from pressferry.schemas import TARGET_DEFAULTS

# The sample script's content-type lists and the upload path rewrite.
POST_TYPES = ("page", "story")
REDIRECT_TYPES = ("page", "story", "blog", "video1", "forum", "comment")
FILES_PATH = '"/files/'
UPLOADS_PATH = '"/wp-content/uploads/'


def node_with_alias(node: DataFrame, node_revisions: DataFrame, url_alias: DataFrame,
                    types: Sequence[str]) -> DataFrame:
    """node JOIN node_revisions USING (vid) LEFT JOIN url_alias ON src = 'node/' || nid,
    restricted to ``types`` (the filter sits below both joins).

    Join order: the narrow node rows meet the aliases first and the revisions
    (which carry the bodies) last, so the wide rows cross one shuffle only.
    The outer join touches no revision column, so the order is equivalent.
    """
    n = node.where(F.col("type").isin(list(types)))
    a = url_alias.select(F.col("pid").alias("_alias_pid"), F.col("src").alias("_src"), F.col("dst"))
    keyed = n.withColumn("_src_key", F.concat(F.lit("node/"), F.col("nid").cast("string")))
    with_alias = keyed.join(a, F.col("_src_key") == F.col("_src"), "left").drop("_src_key", "_src")
    r = node_revisions.select("vid", "body", "teaser")
    return with_alias.join(r, "vid")


def post_rows(node: DataFrame, node_revisions: DataFrame, url_alias: DataFrame,
              types: Sequence[str] = POST_TYPES) -> DataFrame:
    """The SELECT of M10, with the alias id kept as the batch tie-break."""
    j = node_with_alias(node, node_revisions, url_alias, types)
    return j.select(
        F.col("nid").alias("id"),
        F.col("uid").alias("post_author"),
        epoch_to_ts("created").alias("post_date"),
        F.col("body").alias("post_content"),
        F.col("title").alias("post_title"),
        F.col("teaser").alias("post_excerpt"),
        alias_or_id("dst", "nid").alias("post_name"),
        epoch_to_ts("changed").alias("post_modified"),
        F.col("type").alias("post_type"),
        publish_status("status").alias("post_status"),
        F.lit(" ").alias("to_ping"),
        F.lit(" ").alias("pinged"),
        F.lit(" ").alias("post_content_filtered"),
        F.coalesce(F.col("_alias_pid"), F.lit(-1)).alias("_alias_pid"),
    )


def posts(node: DataFrame, node_revisions: DataFrame, url_alias: DataFrame, wp_posts: DataFrame,
          types: Sequence[str] = POST_TYPES, *, trust_source_keys: bool = True,
          aliases_unique: bool = False) -> DataFrame:
    """M10 (flagship): REPLACE DISTINCT post rows into wp_posts keyed by id.

    The DISTINCT is folded into the keyed REPLACE: rows equal in every
    column are also equal on the key.  Where a node has several aliases the
    row of the largest alias id wins.

    ``trust_source_keys`` (default): nid is the node table's primary key and
    vid the revision table's, so a post id repeats only through aliases.  The
    alias table (narrow) is then reduced to its last alias per path *before*
    the join, which picks the same winner, and no post body is shuffled for
    de-duplication.  ``False`` de-duplicates the joined rows instead.
    ``aliases_unique``: one alias per path already (after R4), nothing to reduce.
    """
    if trust_source_keys:
        last_alias = url_alias if aliases_unique else pick_one(
            url_alias.where(F.col("src").isNotNull()), ["src"], ["pid"], largest=True)
        rows = post_rows(node, node_revisions, last_alias, types)
        # The batch's ids without the alias join (a left join adds no ids).
        ids = (node.where(F.col("type").isin(list(types))).select("nid", "vid")
               .join(node_revisions.select("vid"), "vid").select(F.col("nid").alias("id")))
        return replace_into(wp_posts, rows.drop("_alias_pid"), ["id"],
                            defaults=TARGET_DEFAULTS["wp_posts"], incoming_unique=True, incoming_keys=ids)
    rows = post_rows(node, node_revisions, url_alias, types)
    return replace_into(wp_posts, rows, ["id"], order=["_alias_pid"],
                        defaults=TARGET_DEFAULTS["wp_posts"]).drop("_alias_pid")


def post_type_map(wp_posts: DataFrame, types: Sequence[str] = POST_TYPES,
                  to: str = "post") -> DataFrame:
    """Listed types -> 'post'."""
    return update_where(wp_posts, F.col("post_type").isin(list(types)), {"post_type": F.lit(to)})


def post_type_rest(wp_posts: DataFrame, keep: Sequence[str] = ("post",), to: str = "page") -> DataFrame:
    """Every other type -> 'page' (NULL type stays NULL)."""
    return update_where(wp_posts, ~F.col("post_type").isin(list(keep)), {"post_type": F.lit(to)})


def comment_counts(wp_posts: DataFrame, wp_comments: DataFrame) -> DataFrame:
    """comment_count <- comments per post (approved or not)."""
    return update_with_count(wp_posts, "id", wp_comments, "comment_post_ID", "comment_count",
                             count_col="comment_post_ID")


def reassign_orphans(wp_posts: DataFrame, wp_users: DataFrame, admin_id: int = 1) -> DataFrame:
    """post_author <- admin where post_author NOT IN (SELECT ID FROM wp_users)."""
    return update_where_not_in(wp_posts, "post_author", wp_users, "ID",
                               {"post_author": F.lit(admin_id)})


def rewrite_paths(wp_posts: DataFrame, old: str = FILES_PATH, new: str = UPLOADS_PATH) -> DataFrame:
    """Literal replace in every body."""
    return update_where(wp_posts, None, {"post_content": F.replace(F.col("post_content"), F.lit(old), F.lit(new))})


def clean_slugs(wp_posts: DataFrame) -> DataFrame:
    """Remove the four typographic quotes from post_name."""
    return update_where(wp_posts, None, {"post_name": strip_curly_quotes("post_name")})


def custom_type_merge(node: DataFrame, node_revisions: DataFrame, teaser: DataFrame,
                      press: DataFrame, types: Sequence[str] = POST_TYPES, *,
                      trust_source_keys: bool = True) -> DataFrame:
    """Body || (teaser field || link field) from two field tables joined USING (vid).

    The narrow tables are joined first and the revisions (bodies) last.
    ``trust_source_keys`` (default): vid is the primary key of every joined
    table, so each joined row is unique and the DISTINCT needs no shuffle of
    the bodies; ``False`` applies it."""
    n = node.where(F.col("type").isin(list(types)))
    j = (n.join(teaser, "vid").join(press, "vid")
         .join(node_revisions.select("vid", "body", "teaser"), "vid"))
    out = j.select(
        "nid", "vid", F.col("uid").alias("post_author"), epoch_to_ts("created").alias("post_date"),
        F.concat(F.col("body"), F.concat(F.col("field_teaser_value"), F.col("field_press_link_url"))
                 ).alias("post_content"),
        "field_teaser_value", "field_press_link_url", F.col("title").alias("post_title"),
        F.col("teaser").alias("post_excerpt"), epoch_to_ts("changed").alias("post_modified"),
        F.col("type").alias("post_type"), publish_status("status").alias("post_status"),
    )
    return out if trust_source_keys else out.distinct()


def update_posts_from(wp_posts: DataFrame, merged: DataFrame, key: str = "nid",
                      predicate: Column | None = None) -> DataFrame:
    """post_content <- merged.post_content joined on posts.id = merged.<key>.
    ``key='vid'`` reproduces the sample (which joins post id to revision id).
    vid is unique in ``merged``; several revisions of a node are told apart by
    it (the smallest wins).  No body is ever a key or an aggregate."""
    return update_from_join(wp_posts, merged, {"id": key}, {"post_content": "post_content"},
                            source_order=["vid"], source_unique=key == "vid", predicate=predicate)


def redirects(node: DataFrame, node_revisions: DataFrame, url_alias: DataFrame,
              types: Sequence[str] = REDIRECT_TYPES, site: str = "site_name") -> DataFrame:
    """(old_url, new_url, '301') per node of the listed types."""
    j = node_with_alias(node, node_revisions, url_alias, types)
    old = F.concat(F.lit(site + "/"),
                   F.when(F.col("dst").isNull(), F.concat(F.lit("node/"), F.col("nid").cast("string")))
                   .otherwise(F.col("dst")))
    return j.select(old.alias("old_url"), alias_or_id("dst", "nid").alias("new_url"),
                    F.lit("301").alias("redirect_code"))


def posts_pass(node: DataFrame, node_revisions: DataFrame, url_alias: DataFrame, wp_posts: DataFrame,
               wp_comments: DataFrame, wp_users: DataFrame, *, types: Sequence[str] = POST_TYPES,
               admin_id: int = 1, old: str = FILES_PATH, new: str = UPLOADS_PATH,
               aliases_unique: bool = False) -> DataFrame:
    """M10 -> M11 -> M12 -> M18 -> M26 -> M27 as one plan (same table as the
    statements run in order).

    For the incoming posts every per-row look-up runs on the narrow node
    side, keyed by nid / uid: alias, comment count (M18), orphaned author
    (M26).  The revisions, which carry the bodies, are joined last, so post
    bodies cross exactly one shuffle in the whole pass; the type mapping and
    the path rewrite are projections.  Existing posts that survive the
    REPLACE (none after the usual truncation) take the statements one by one.
    """
    last_alias = url_alias if aliases_unique else pick_one(
        url_alias.where(F.col("src").isNotNull()), ["src"], ["pid"], largest=True)
    n = node.where(F.col("type").isin(list(types)))
    a = last_alias.select(F.col("src").alias("_src"), F.col("dst"))
    narrow = (n.withColumn("_src_key", F.concat(F.lit("node/"), F.col("nid").cast("string")))
              .join(a, F.col("_src_key") == F.col("_src"), "left").drop("_src_key", "_src"))
    counts = (wp_comments.groupBy(F.col("comment_post_ID").alias("_cp"))
              .agg(F.count("comment_post_ID").alias("_cc")))
    narrow = narrow.join(counts, F.col("nid") == F.col("_cp"), "left")
    from pressferry.operators.dml import not_in_flag

    narrow = not_in_flag(narrow, "uid", wp_users, "ID", out="_orphan")
    wide = narrow.join(node_revisions.select("vid", "body", "teaser"), "vid")
    mapped_type = F.when(F.col("type").isin(list(types)), F.lit("post")).otherwise(F.col("type"))
    final_type = F.when(~mapped_type.isin("post"), F.lit("page")).otherwise(mapped_type)
    fresh = wide.select(
        F.col("nid").alias("id"),
        F.when(F.coalesce(F.col("_orphan"), F.lit(False)), F.lit(admin_id).cast("bigint"))
        .otherwise(F.col("uid")).alias("post_author"),
        epoch_to_ts("created").alias("post_date"),
        F.replace(F.col("body"), F.lit(old), F.lit(new)).alias("post_content"),
        F.col("title").alias("post_title"),
        F.col("teaser").alias("post_excerpt"),
        alias_or_id("dst", "nid").alias("post_name"),
        epoch_to_ts("changed").alias("post_modified"),
        final_type.alias("post_type"),
        publish_status("status").alias("post_status"),
        F.lit(" ").alias("to_ping"), F.lit(" ").alias("pinged"), F.lit(" ").alias("post_content_filtered"),
        F.coalesce(F.col("_cc"), F.lit(0)).cast("bigint").alias("comment_count"),
    )
    # Existing rows that no incoming id replaces go through the statements.
    ids = n.select(F.col("nid").alias("_fid"), "vid").join(node_revisions.select("vid"), "vid", "left_semi").select("_fid")
    kept = wp_posts.join(ids, F.col("id") == F.col("_fid"), "left_anti")
    kept = post_type_rest(post_type_map(kept, types))
    kept = rewrite_paths(reassign_orphans(comment_counts(kept, wp_comments), wp_users, admin_id), old, new)
    return kept.unionByName(fresh.select(*wp_posts.columns))
