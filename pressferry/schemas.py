"""Canonical schemas: source CMS versions and the target tables.

Every operator sees one canonical source schema (version-6 names); version-7
tables are renamed on read (:func:`canonical_name`, :data:`V7_COLUMN_RENAMES`).
Target schemas are needed for empty targets and for column defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Required source tables per CMS major version.
REQUIRED_TABLES_V6 = [
    "comments", "node", "node_revisions", "node_type", "system", "term_data",
    "term_node", "url_alias", "users", "users_roles", "variable",
]
REQUIRED_TABLES_V7 = [
    "comment", "node", "node_revision", "node_type", "system", "taxonomy_term_data",
    "taxonomy_index", "url_alias", "users", "users_roles", "variable",
]

# Version-7 table name -> canonical (version-6) name.
V7_TABLE_RENAMES = {
    "taxonomy_term_data": "term_data",
    "taxonomy_index": "term_node",
    "comment": "comments",
    "node_revision": "node_revisions",
}
# Per canonical table, version-7 column -> canonical column.
V7_COLUMN_RENAMES = {
    "url_alias": {"source": "src", "alias": "dst"},
}


def required_tables(version: str | float | None) -> list[str]:
    """The version's required list; below 7.0 (or unknown) the v6 list."""
    try:
        v = float(version) if version is not None else 6.0
    except ValueError:
        v = 6.0
    return REQUIRED_TABLES_V7 if v >= 7.0 else REQUIRED_TABLES_V6


def canonical_name(table: str) -> str:
    return V7_TABLE_RENAMES.get(table, table)


def canonicalize(table: str, df: DataFrame) -> DataFrame:
    """Rename a version-7 table's columns to the canonical names."""
    for old, new in V7_COLUMN_RENAMES.get(canonical_name(table), {}).items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


TARGETS = {
    "wp_terms": "term_id bigint, name string, slug string, term_group bigint",
    "wp_term_taxonomy": ("term_taxonomy_id bigint, term_id bigint, taxonomy string, "
                         "description string, parent bigint, count bigint"),
    "wp_term_relationships": "object_id bigint, term_taxonomy_id bigint",
    "wp_posts": ("id bigint, post_author bigint, post_date timestamp_ntz, post_content string, "
                 "post_title string, post_excerpt string, post_name string, "
                 "post_modified timestamp_ntz, post_type string, post_status string, "
                 "to_ping string, pinged string, post_content_filtered string, comment_count bigint"),
    "wp_comments": ("comment_ID bigint, comment_post_ID bigint, comment_date timestamp_ntz, "
                    "comment_content string, comment_parent bigint, comment_author string, "
                    "comment_author_email string, comment_author_url string, comment_approved string"),
    "wp_users": ("ID bigint, user_login string, user_pass string, user_nicename string, "
                 "user_email string, user_registered timestamp_ntz, user_activation_key string, "
                 "user_status int, display_name string"),
    "wp_usermeta": "user_id bigint, meta_key string, meta_value string",
    "wp_options": "option_name string, option_value string",
    "acc_redirects": "old_url string, new_url string, redirect_code string",
}

# Column defaults of the target tables (columns a statement does not name).
TARGET_DEFAULTS = {
    "wp_term_taxonomy": {"count": 0, "parent": 0},
    "wp_posts": {"comment_count": 0},
    "wp_users": {"user_status": 0, "user_activation_key": ""},
}


def empty_target(spark: SparkSession, name: str) -> DataFrame:
    """An empty target table; the false filter tells the optimizer that it is."""
    return spark.createDataFrame([], TARGETS[name]).where(F.lit(False))
