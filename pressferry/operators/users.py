"""Author and commenter migration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressferry.functions.scalars import epoch_to_ts, slug
from pressferry.operators.dml import delete_where, insert_ignore, not_in_flag, update_where

# The role rows every migrated author receives.
AUTHOR_CAPABILITIES = 'a:1:{s:6:"author";s:1:"1";}'
AUTHOR_LEVEL = "2"


def purge_users(wp_users: DataFrame, keep_up_to: int = 1) -> DataFrame:
    """DELETE users with ID > keep_up_to."""
    return delete_where(wp_users, F.col("ID") > keep_up_to)


def purge_usermeta(wp_usermeta: DataFrame, keep_up_to: int = 1) -> DataFrame:
    """DELETE usermeta with user_id > keep_up_to."""
    return delete_where(wp_usermeta, F.col("user_id") > keep_up_to)


def reset_secret(users: DataFrame, secret: str, uid: int = 1) -> DataFrame:
    """Pass <- md5(secret) for one source user.  No default secret."""
    return update_where(users, F.col("uid") == uid, {"pass": F.md5(F.lit(secret))})


def _per_user_counts(rows: DataFrame, users: DataFrame, out: str, cols: Sequence[str]) -> DataFrame:
    # Count per uid first (map-side combined), then join one row per uid:
    # a prolific user never becomes a hot join key.
    per_uid = rows.where(F.col("uid").isNotNull()).groupBy("uid").agg(F.count("uid").alias(out))
    return users.select(*cols).join(per_uid, "uid").select(*cols, F.col(out).cast("bigint"))


def authors_with_posts(node: DataFrame, users: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """M22 (+O19 with ``types``): (uid, name, mail, node_count) of users owning nodes.
    Row order means nothing for a table; sort on read."""
    n = node if types is None else node.where(F.col("type").isin(list(types)))
    return _per_user_counts(n, users, "node_count", ["uid", "name", "mail"])


def commenters(comments: DataFrame, users: DataFrame) -> DataFrame:
    """(uid, name, comment_count) of known users with comments."""
    return _per_user_counts(comments, users, "comment_count", ["uid", "name"])


def user_rows(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("uid").alias("ID"), slug("name").alias("user_login"), F.col("pass").alias("user_pass"),
        F.col("name").alias("user_nicename"), F.col("mail").alias("user_email"),
        epoch_to_ts("created").alias("user_registered"), F.lit("").alias("user_activation_key"),
        F.lit(0).alias("user_status"), F.col("name").alias("display_name"))


def authors(users: DataFrame, author_list: DataFrame, wp_users: DataFrame, *,
            trust_source_keys: bool = True) -> DataFrame:
    """INSERT IGNORE DISTINCT user rows for uid IN the list.

    uid is the users table's primary key, so (default) the selected rows are
    unique on ID and DISTINCT / the batch pick fold away."""
    chosen = users.join(author_list.select("uid"), "uid", "left_semi")
    return insert_ignore(wp_users, user_rows(chosen), "ID", incoming_unique=trust_source_keys)


def author_meta(users: DataFrame, author_list: DataFrame, wp_usermeta: DataFrame,
                meta_key: str, meta_value: str) -> DataFrame:
    """INSERT IGNORE (uid, key, value) per listed user.  The meta
    table's only unique key is its generated id, so this appends."""
    chosen = users.join(author_list.select("uid"), "uid", "left_semi")
    rows = chosen.select(F.col("uid").alias("user_id"), F.lit(meta_key).alias("meta_key"),
                         F.lit(meta_value).alias("meta_value")).distinct()
    return insert_ignore(wp_usermeta, rows)


def author_capabilities(users, author_list, wp_usermeta, value: str = AUTHOR_CAPABILITIES):
    return author_meta(users, author_list, wp_usermeta, "wp_capabilities", value)


def author_level(users, author_list, wp_usermeta, value: str = AUTHOR_LEVEL):
    return author_meta(users, author_list, wp_usermeta, "wp_user_level", value)


def commenters_to_add(with_comments: DataFrame, wp_users: DataFrame, like: DataFrame, *,
                      keyed_input: bool = True) -> DataFrame:
    """DISTINCT commenter rows whose ID is NOT IN wp_users (SQL NOT IN
    rules), INSERT IGNORE into an empty copy of the users table.
    ``keyed_input``: ``with_comments`` is a table keyed by ID (the output of
    M34), so its rows are already unique on ID."""
    flagged = not_in_flag(with_comments, "ID", wp_users, "ID", out="_nin")
    rows = flagged.where(F.col("_nin")).drop("_nin").withColumn(
        "user_activation_key", F.lit("")).withColumn("user_status", F.lit(0))
    return insert_ignore(like, rows, "ID", incoming_unique=keyed_input)


def merge_users(wp_users: DataFrame, to_add: DataFrame, *, keyed_input: bool = True) -> DataFrame:
    """INSERT IGNORE ... SELECT * (existing rows kept); ``to_add`` is a
    table keyed by ID (M35's output)."""
    return insert_ignore(wp_users, to_add, "ID", incoming_unique=keyed_input)


def users_pass(users: DataFrame, node: DataFrame, comments: DataFrame, wp_users: DataFrame) -> DataFrame:
    """M22, M23, M32-M36 as one plan (same table as the statements run in
    order): the users are read once, flagged as authors and commenters by one
    distinct list of ids each, and inserted once.  NOT IN of M35: with a NULL
    among the ids of ``wp_users`` no commenter is added that isn't an author."""
    ids = lambda rows, flag: rows.where(F.col("uid").isNotNull()).select(F.col("uid").alias(f"{flag}_uid")).distinct().withColumn(flag, F.lit(True))
    flagged = users.join(ids(node, "_wrote"), F.col("uid") == F.col("_wrote_uid"), "left").join(
        ids(comments, "_commented"), F.col("uid") == F.col("_commented_uid"), "left")
    has_null = wp_users.agg(F.coalesce(F.bool_or(F.col("ID").isNull()), F.lit(False))).scalar()
    chosen = flagged.where(F.col("_wrote") | (F.col("_commented") & ~has_null))
    return insert_ignore(wp_users, user_rows(chosen), "ID", incoming_unique=True)
