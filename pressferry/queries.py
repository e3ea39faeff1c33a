"""Registered queries: one per operator of the inventory, each over the
fixture views of one testdata directory.

Transform steps are evaluated in the order of the sample migration script
(each step's input is the state its predecessors leave), with the target
tables' pre-existing rows kept (no truncation first): half of the existing
posts, comments and taxonomy rows hold ids that the pass writes, so every
REPLACE meets real conflicts.  A query is one lazy Spark plan but for those
that say so (rounds, numbering, writes).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressferry.functions.scalars import slug
from pressferry.functions.serialized import decode_array, decode_nested, encode_nested
from pressferry.operators import audit, comments, options, posts, repair, terms, users
from pressferry.operators.dml import (
    insert,
    insert_auto_id,
    insert_ignore,
    insert_ignore_keys,
    not_in_flag,
    replace_into,
    settled,
    update_with_count,
)
from pressferry.plans import sinks
from pressferry.schemas import REQUIRED_TABLES_V6, TARGET_DEFAULTS, empty_target
from pressferry.sources.catalog import read_table
from pressferry.sources.fixtures import load_tables

# Parameters of the registered instances (the sample's literals, or values
# that select something in the fixture data where the literal would not).
MISSING_TABLE = "acc_url_alias_with_dups"
DROP_VOCAB_VIDS = (5, 7, 8, 38, 40)
DROP_TERM_VIDS = (5, 7, 8, 40)
TAG_VID, NEWS_VID = 2, 3
CATEGORY_VIDS = (4, 5)
VOCAB_VIDS = (3, 4, 5)
DEFAULT_CATEGORY = 159
ADMIN_SECRET = "registered-query-secret"
OLD_PREFIX, NEW_PREFIX = "wp_", "newprefix_"


class Run:
    """Lazily built states of one migration pass over one testdata directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = load_tables(spark, sf_dir)

    def empty(self, name: str) -> DataFrame:
        return empty_target(self.spark, name)

    # repair ------------------------------------------------------------------
    @cached_property
    def aliases(self) -> DataFrame:  # R4: the alias table the transforms read
        return repair.uniquify_aliases(self.t["url_alias"])

    @cached_property
    def fixed(self) -> dict[str, DataFrame]:
        return repair.run_fix(self.t)

    # terms -----------------------------------------------------------------
    @cached_property
    def acc_tags(self):
        return terms.tags_work(self.t["term_data"])

    @cached_property
    def acc_categories(self):
        return terms.categories_work(self.t["acc_categories_from_client"])

    @cached_property
    def m3(self):
        return terms.tags_terms(self.t["term_data"], self.acc_tags, self.t["wp_terms"])

    @cached_property
    def m4(self):
        return terms.tags_taxonomy(self.t["term_data"], self.acc_tags, self.t["wp_term_taxonomy"])

    @cached_property
    def m6(self):
        return terms.terms_pass(self.t["term_data"], self.acc_categories, self.t["wp_terms"])

    @cached_property
    def m7(self):
        return terms.taxonomy_pass(self.t["term_data"], self.acc_categories, self.t["wp_term_taxonomy"])

    @cached_property
    def m8(self):
        return terms.uncategorized_term(self.m6)

    @cached_property
    def m9(self):
        return terms.uncategorized_taxonomy(self.m8, self.m7)

    @cached_property
    def m13(self):
        return terms.term_relationships(self.t["term_node"], self.t["wp_term_relationships"])

    @cached_property
    def m14(self):
        # As in a pass: the tables that the next statements read twice are computed once.
        wp_terms, taxonomy = settled(self.m6.where("slug = 'uncategorized'")), settled(self.m7)
        top = settled(self.m6.agg(F.coalesce(F.max("term_id"), F.lit(0)).cast("bigint").alias("top")))
        new = terms.uncategorized_term(wp_terms, after=top.scalar())
        return terms.term_counts(terms.uncategorized_taxonomy(new, taxonomy), self.m13)

    # posts -----------------------------------------------------------------
    @cached_property
    def m10(self):
        t = self.t
        return posts.posts(t["node"], t["node_revisions"], self.aliases, t["wp_posts"], aliases_unique=True)

    @cached_property
    def m12(self):
        return posts.post_type_rest(posts.post_type_map(self.m10))

    @cached_property
    def m17(self):
        return comments.comments(self.t["comments"], self.t["wp_comments"])

    @cached_property
    def m18(self):
        return posts.comment_counts(self.m12, self.m17)

    @cached_property
    def m26(self):
        return posts.reassign_orphans(self.m18, self.m23)

    # users -----------------------------------------------------------------
    @cached_property
    def m22(self):
        return users.authors_with_posts(self.t["node"], self.t["users"])

    @cached_property
    def m23(self):
        return users.authors(self.t["users"], self.m22, self.t["wp_users"])

    @cached_property
    def m24(self):
        return users.author_capabilities(self.t["users"], self.m22, self.t["wp_usermeta"])

    @cached_property
    def m25(self):
        return users.author_level(self.t["users"], self.m22, self.m24)

    @cached_property
    def m32(self):  # acc_wp_users: an empty copy of wp_users filled with its rows
        return sinks.copy_append(sinks.create_like(self.m23), self.m23)

    @cached_property
    def m33(self):
        return users.commenters(self.t["comments"], self.t["users"])

    @cached_property
    def m34(self):
        return users.authors(self.t["users"], self.m33, sinks.create_like(self.m23))

    @cached_property
    def m35(self):
        return users.commenters_to_add(self.m34, self.m32, sinks.create_like(self.m23))

    # options ---------------------------------------------------------------
    @cached_property
    def m15(self):
        return options.default_category_option(self.t["wp_options"], str(DEFAULT_CATEGORY))

    @cached_property
    def m28(self):
        return options.site_name_option(self.m15, self.t["variable"])

    @cached_property
    def m29(self):
        return options.site_slogan_option(self.m28, self.t["variable"])

    @cached_property
    def m30(self):
        return options.site_mail_option(self.m29, self.t["variable"])

    # optional ----------------------------------------------------------------
    @cached_property
    def o8(self):
        return terms.subcategories(self.t["term_data"], CATEGORY_VIDS, self.m7)

    @cached_property
    def o9(self):
        return terms.vocab_terms(self.t["vocabulary"], VOCAB_VIDS, self.m6)

    @cached_property
    def o10(self):
        return terms.vocab_categories(self.t["vocabulary"], VOCAB_VIDS, self.m7)

    @cached_property
    def o12(self):
        t = self.t
        return posts.custom_type_merge(t["node"], t["node_revisions"], t["content_field_teaser"],
                                       t["content_type_press"])


def _q(fn: Callable[[Run], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Run(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _decode_system_info(r: Run) -> DataFrame:
    m = decode_array("info")
    return r.t["system"].select("name", m["name"].alias("module_name"), m["version"].alias("version"))


def _settings(r: Run) -> DataFrame:
    """Settings with nested values, one for each supplier and page: paths in texts
    of several bytes a character, a list, and a serialized value within a text."""
    text = lambda c: F.concat(F.lit("s:"), F.octet_length(c).cast("string"), F.lit(':"'), c, F.lit('";'))
    name = F.concat(F.lit("/files/É "), F.col("s_name"))
    inner = F.concat(F.lit('a:1:{i:0;'), text(F.concat(F.lit("/files/"), F.col("s_suppkey").cast("string"))), F.lit("}"))
    value = F.concat(F.lit('a:3:{s:4:"path";'), text(name), F.lit('s:4:"list";'), inner, F.lit('s:6:"packed";'), text(inner), F.lit("}"))
    return r.t.raw("supplier").select(F.concat(F.lit("setting_"), F.col("s_suppkey").cast("string")).alias("option_name"),
                                      F.when(F.col("s_suppkey") % 5 == 0, name).otherwise(value).alias("option_value"))


def _f15(r: Run) -> DataFrame:
    v = _settings(r).select("option_name", "option_value", decode_nested("option_value").alias("v"))
    return v.select("option_name", F.variant_get("v", "$.path", "string").alias("path"), F.variant_get("v", "$.list[0]", "string").alias("first"),
                    F.col("v").isNotNull().alias("valid"), (F.to_json(decode_nested(encode_nested("v"))) == F.to_json("v")).alias("round_trip"))


def _x1(r: Run) -> DataFrame:
    """Statements as Spark SQL text, run in order, fail-fast."""
    from pressferry.plans import runbook

    book = runbook.Runbook([
        runbook.sql_step("authors.list", "acc_users_post_count", """
            WITH written AS (SELECT uid, count(*) AS node_count FROM node WHERE uid IS NOT NULL GROUP BY uid)
            SELECT uid, name, mail, node_count FROM users JOIN written USING (uid)"""),
        runbook.sql_step("authors.capabilities", "acc_author_meta", """
            SELECT uid AS user_id, 'wp_capabilities' AS meta_key, 'a:1:{s:6:"author";s:1:"1";}' AS meta_value
            FROM acc_users_post_count GROUP BY uid"""),
    ])
    out = book.run({"node": r.t["node"], "users": r.t["users"]})
    if not out.ok:
        raise RuntimeError(f"run failed: {out.stages}")
    return out.tables["acc_author_meta"]


#: M11, M12, M18 and M26 as a user would write them.
POSTS_SCRIPT = [
    "UPDATE wp_posts SET post_type = 'post' WHERE post_type IN ('page', 'story')",
    "UPDATE wp_posts SET post_type = 'page' WHERE post_type NOT IN ('post')",
    "UPDATE wp_posts SET comment_count = (SELECT count(c.comment_post_ID) FROM wp_comments c WHERE c.comment_post_ID = wp_posts.id)",
    "UPDATE wp_posts SET post_author = 1 WHERE post_author NOT IN (SELECT ID FROM wp_users)",
]


def _x1b(r: Run) -> DataFrame:
    """A script of UPDATE statements over M10's posts."""
    from pressferry.plans import runbook, script

    out = runbook.Runbook(script.statement_steps(POSTS_SCRIPT)).run({"wp_posts": r.m10, "wp_comments": r.m17, "wp_users": r.m23})
    if not out.ok:
        raise RuntimeError(out.error)
    return out.tables["wp_posts"]


#: Of each target of a pass: the key, a number and the texts that its digest covers.
X3_DIGESTS = {
    "wp_terms": ("term_id", "term_group", ("name", "slug")),
    "wp_term_taxonomy": ("term_taxonomy_id", "count", ("taxonomy", "description")),
    "wp_term_relationships": ("object_id", "term_taxonomy_id", ()),
    "wp_posts": ("id", "post_author", ("post_name", "post_type", "post_content")),
    "wp_comments": ("comment_ID", "comment_post_ID", ("comment_author", "comment_author_url")),
    "wp_users": ("ID", "user_status", ("user_login", "user_email")),
    "wp_usermeta": ("user_id", "user_id", ("meta_key", "meta_value")),
    "wp_options": (None, None, ("option_name", "option_value")),
    "acc_wp_users": ("ID", "user_status", ("user_login", "user_email")),
}


def _x3(r: Run) -> DataFrame:
    """A full pass, prepare -> gate -> migrate -> outputs; one row for each
    target with its row count, key and number sums and a sum of text hashes."""
    from pressferry.plans import runbook

    done = runbook.migrate(dict(r.t), secret=ADMIN_SECRET, safe_repair=True, null_name_stem="term")
    if not done.ok:
        raise RuntimeError(f"{done.stages[-1][0]} failed: {done.error}")
    rows = []
    for name, (key, number, texts) in X3_DIGESTS.items():
        total = lambda c: (F.sum(c) if c else F.lit(None)).cast("bigint")
        text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in texts]) if texts else F.lit("")
        rows.append(done.tables[name].agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), total(key).alias("key_sum"),
            (F.max(key) if key else F.lit(None)).cast("bigint").alias("key_max"), total(number).alias("number_sum"),
            F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")).alias("text_hash")))
    return reduce(DataFrame.unionByName, rows)


def _k1(r: Run) -> DataFrame:
    """REPLACE with two unique keys (term_id and slug) over every term."""
    rows = terms._term_rows(r.t["term_data"], r.t["term_data"])
    return replace_into(r.t["wp_terms"], rows, ["term_id", "slug"], order=["term_id"])


def _k2(r: Run) -> DataFrame:
    return insert_ignore(r.t["wp_users"], users.user_rows(r.t["users"]), "ID")


def _k3(r: Run) -> DataFrame:
    """Plain INSERT (key checked) of the commenters' user rows into the purged users table."""
    chosen = r.t["users"].join(r.m33.select("uid"), "uid", "left_semi")
    return insert(users.purge_users(r.t["wp_users"]), users.user_rows(chosen), "ID",
                  defaults=TARGET_DEFAULTS["wp_users"])


def _k7(r: Run) -> DataFrame:
    """Correlated COUNT over every node: comments per node, 0 when none."""
    nodes = r.t["node"].select("nid", F.lit(0).cast("bigint").alias("comment_count"))
    return update_with_count(nodes, "nid", r.t["comments"], "nid", "comment_count", count_col="cid")


def _k10(r: Run) -> DataFrame:
    """NOT IN with SQL NULL rules: comments whose author is not a known user."""
    return not_in_flag(r.t["comments"].select("cid", "uid"), "uid", r.t["users"], "uid", out="uid_not_in_users")


def _k4(r: Run) -> DataFrame:
    rows = r.t["term_data"].select("name", F.replace(F.lower("name"), F.lit(" "), F.lit("_")).alias("slug"),
                                   F.col("vid").alias("term_group"), "tid")
    return insert_auto_id(r.t["wp_terms"], rows, "term_id", order=["term_group", "name", "tid"])


ALL_TYPES = ("page", "story", "forum", "blog")


def _m12(r: Run) -> DataFrame:
    """M12 over posts of all content types, of which M11 maps two."""
    every = posts.posts(r.t["node"], r.t["node_revisions"], r.aliases, r.empty("wp_posts"), ALL_TYPES, aliases_unique=True)
    return posts.post_type_rest(posts.post_type_map(every))


def _o14(r: Run) -> DataFrame:
    """O14 with held targets and chains: three of four taxonomy ids are one less,
    so a row waits for the one before it to move.  (Rounds of jobs.)"""
    shifted = F.when(F.col("term_id") % 4 > 0, F.col("term_id") - 1).otherwise(F.col("term_id"))
    return terms.fix_taxonomy_ids(r.m13, r.m7.select("term_id", shifted.alias("term_taxonomy_id")))


def _o15(r: Run) -> DataFrame:
    """O15 over slugs of which a third hold typographic quotes."""
    quoted = F.when(F.col("id") % 3 == 0, F.concat(F.lit("\u2018"), "post_name", F.lit("\u201d"))).otherwise(F.col("post_name"))
    return posts.clean_slugs(r.m10.withColumn("post_name", quoted))


def _s8(r: Run) -> DataFrame:
    """Both tables after the swap, told apart by their role."""
    live, archived = sinks.archive_swap(r.aliases, r.t["url_alias"])
    return live.withColumn("role", F.lit("live")).unionByName(archived.withColumn("role", F.lit("archived")))


def _id_map(r: Run) -> DataFrame:
    return terms.new_vocab_ids(r.t["vocabulary"], VOCAB_VIDS, r.m6)


def _k2b(r: Run) -> DataFrame:
    """INSERT IGNORE with three unique keys, which conflict in chains.  (Rounds of jobs.)"""
    rows = r.t["term_data"].where(F.col("tid").isNotNull()).select(
        F.col("tid").alias("term_id"), "name", slug("name").alias("slug"), F.floor(F.col("tid") / 3).alias("term_group"))
    return insert_ignore_keys(r.t["wp_terms"], rows, ["term_id", "slug", "term_group"], order=["term_id"])


def _warehouse(r: Run) -> sinks.Warehouse:
    """A warehouse of its own in the shared folder."""
    from pressferry.session import ensure_checkpoint_dir

    return sinks.Warehouse(r.spark, f"{ensure_checkpoint_dir(r.spark).rstrip('/')}/warehouse-{uuid.uuid4().hex}")


def _s4(r: Run) -> DataFrame:
    """CREATE TABLE AS SELECT, read back."""
    return _warehouse(r).write("acc_tags", r.acc_tags)


def _s6(r: Run) -> DataFrame:
    """S3, S6 and S7 as the state that they leave: which tables are there and
    how many rows each has, after an append that is retried, a reset of two
    targets and the clean-up of a working table."""
    wh = _warehouse(r)
    first = wh.transaction()
    for name in ("wp_terms", "wp_term_taxonomy"):
        first.write(name, r.t[name])
    first.write("acc_tags", r.acc_tags)
    first.commit()
    for _ in range(2):
        if not wh.append("kept", r.t["wp_users"], commit="load"):
            raise RuntimeError(wh.last_error)
    wh.reset_targets(["wp_terms", "wp_term_taxonomy"], [])
    wh.cleanup_working(["acc_tags", "acc_tags"])
    now = wh.log.snapshot()
    names = ["wp_terms", "wp_term_taxonomy", "acc_tags", "kept"]
    return audit.table_exists(r.spark, {n: now.read(n) for n in now.names()}, names).select(
        "table_name", (F.col("table_count") > 0).alias("present"), "row_count")


QUERIES: dict[str, Callable[[Run], DataFrame]] = {
    # sources / sinks
    "s1_read_table": lambda r: read_table(r.t, "node"),
    "s2_table_exists": lambda r: audit.table_exists(r.spark, r.t, REQUIRED_TABLES_V6 + [MISSING_TABLE]),
    "s1b_read_parquet_root": lambda r: read_table(r.t.sf_dir, "documents", spark=r.spark).select("doc_id", "lang", "n_chars"),
    "s4_ctas": _s4,
    "s6_reset_targets": _s6,
    "s8_archive_swap": _s8,
    "s9_fixed_terms_log": lambda r: sinks.fixed_terms_log(repair.uniquify_terms(r.t["term_data"])),
    "s10_copy_append": lambda r: sinks.copy_append(r.t["wp_users"], users.user_rows(r.t["users"])),
    # audit
    "d1_required_tables": lambda r: audit.required_tables(r.spark, r.t, "6.37"),
    "d2_decode_version": lambda r: audit.decode_version(r.t["system"]),
    "d2b_decode_system_info": _decode_system_info,
    "d3_decode_variable": lambda r: audit.decode_variable(r.t["variable"]),
    "d4_posts_list": lambda r: audit.posts_list(r.t["node"]),
    "d5_terms_list": lambda r: audit.terms_list(r.t["term_data"]),
    "d6_node_types": lambda r: audit.node_types(r.t["node_type"]),
    "d7_count_by_type": lambda r: audit.count_by_type(r.t["node"], r.t["node_type"]),
    "d8_dup_term_names": lambda r: audit.dup_term_names(r.t["term_data"]),
    "d8b_dup_term_names_strict": lambda r: audit.dup_term_names(r.t["term_data"], strict=True),
    "d8c_dup_term_names_ci": lambda r: audit.dup_term_names(r.t["term_data"], collation="ci"),
    "d9_dup_term_members": lambda r: audit.dup_term_members(r.t["term_data"]),
    "d9b_dup_term_members_strict": lambda r: audit.dup_term_members(r.t["term_data"], strict=True),
    "d9c_dup_term_members_ci": lambda r: audit.dup_term_members(r.t["term_data"], collation="ci"),
    "d10_terms_too_long": lambda r: audit.terms_too_long(r.t["term_data"]),
    "d11_dup_aliases": lambda r: audit.dup_aliases(r.t["url_alias"]),
    "d11b_dup_aliases_strict": lambda r: audit.dup_aliases(r.t["url_alias"], strict=True),
    "d11c_dup_aliases_ci": lambda r: audit.dup_aliases(r.t["url_alias"], collation="ci"),
    "d12_audit_summary": lambda r: audit.audit_summary(r.t),
    "x2_gate": lambda r: audit.gate(audit.audit_summary(r.t)),
    # repair
    "r1_uniquify_terms": lambda r: repair.uniquify_terms(r.t["term_data"]),
    "r2_apply_keyed_update": lambda r: repair.apply_keyed_update(
        r.t["term_data"], repair.uniquify_terms(r.t["term_data"])),
    "r3_truncate_terms": lambda r: repair.truncate_terms(r.t["term_data"]),
    "r4_uniquify_aliases": lambda r: r.aliases,
    "r4b_uniquify_aliases_strict": lambda r: repair.uniquify_aliases(r.t["url_alias"], strict=True),
    "r1c_uniquify_terms_ci": lambda r: repair.uniquify_terms(r.t["term_data"], collation="ci"),
    "r4c_uniquify_aliases_ci": lambda r: repair.uniquify_aliases(r.t["url_alias"], collation="ci"),
    "r5_run_fix": lambda r: r.fixed["term_data"],
    "r5b_run_fix_safe": lambda r: repair.run_fix(r.t, safe=True, null_name_stem="term")["term_data"],
    "r6b_residual_collisions_safe": lambda r: repair.residual_collisions(repair.run_fix(r.t, safe=True, null_name_stem="term")["term_data"]),
    "r6_residual_collisions": lambda r: repair.residual_collisions(r.fixed["term_data"]),
    # transform (active)
    "m2_tags_work": lambda r: r.acc_tags,
    "m3_tags_terms": lambda r: r.m3,
    "m4_tags_taxonomy": lambda r: r.m4,
    "m5_categories_work": lambda r: r.acc_categories,
    "m6_category_terms": lambda r: r.m6,
    "m7_category_taxonomy": lambda r: r.m7,
    "m8_uncategorized_term": lambda r: r.m8,
    "m9_uncategorized_taxonomy": lambda r: r.m9,
    "m10_posts": lambda r: r.m10,
    "m11_post_type_map": lambda r: posts.post_type_map(r.m10),
    "m12_post_type_rest": _m12,
    "m13_term_relationships": lambda r: r.m13,
    "m14_term_counts": lambda r: r.m14,
    "m15_default_category_option": lambda r: r.m15,
    "m16_default_category_taxonomy": lambda r: terms.default_category_taxonomy(r.m14, DEFAULT_CATEGORY),
    "m17_comments": lambda r: r.m17,
    "m18_comment_counts": lambda r: r.m18,
    "m19_purge_users": lambda r: users.purge_users(r.t["wp_users"]),
    "m20_purge_usermeta": lambda r: users.purge_usermeta(r.t["wp_usermeta"]),
    "m21_reset_secret": lambda r: users.reset_secret(r.t["users"], ADMIN_SECRET),
    "m22_authors_with_posts": lambda r: r.m22,
    "m23_authors": lambda r: r.m23,
    "m24_author_capabilities": lambda r: r.m24,
    "m25_author_level": lambda r: r.m25,
    "m26_reassign_orphans": lambda r: r.m26,
    "m27_rewrite_paths": lambda r: posts.posts_pass(
        r.t["node"], r.t["node_revisions"], r.aliases, r.t["wp_posts"], settled(r.m17.select("comment_post_ID")), settled(r.m23.select("ID")),
        aliases_unique=True),
    "m28_site_name_option": lambda r: r.m28,
    "m29_site_slogan_option": lambda r: r.m29,
    "m30_site_mail_option": lambda r: r.m30,
    "m31_permalink_option": lambda r: options.permalink_option(r.m30),
    "m32_user_tables_like": lambda r: r.m32,
    "m33_commenters": lambda r: r.m33,
    "m34_commenter_users": lambda r: r.m34,
    "m35_commenters_to_add": lambda r: r.m35,
    "m36_merge_users": lambda r: users.users_pass(r.t["users"], r.t["node"], r.t["comments"], r.t["wp_users"]),
    # transform (optional)
    "o1_drop_vocabularies": lambda r: terms.drop_vocabularies(r.t["vocabulary"], DROP_VOCAB_VIDS),
    "o2_drop_terms_of_vocab": lambda r: terms.drop_terms_of_vocab(r.t["term_data"], DROP_TERM_VIDS),
    "o3_split_by_vocab": lambda r: terms.split_by_vocab(r.t["term_data"], NEWS_VID),
    "o4_cross_vocab_dups": lambda r: terms.cross_vocab_dups(r.t["term_data"], TAG_VID, NEWS_VID),
    "o5_suffix_cross_dups": lambda r: terms.suffix_cross_dups(r.t["term_data"], TAG_VID, NEWS_VID),
    "o6_move_vocabulary": lambda r: terms.move_vocabulary(r.t["term_data"], NEWS_VID, TAG_VID),
    "o7_vocab_as_category": lambda r: terms.vocab_roles(r.t["term_data"], CATEGORY_VIDS),
    "o8_subcategories": lambda r: r.o8,
    "o9_vocab_terms": lambda r: r.o9,
    "o10_vocab_categories": lambda r: r.o10,
    "o11_remap_parents": lambda r: terms.remap_parents(r.o8, _id_map(r)),
    "o11b_remap_term_groups": lambda r: terms.remap_term_groups(r.o9, _id_map(r)),
    "o11c_remap_term_ids": lambda r: terms.remap_term_ids(r.o10, _id_map(r)),
    "o12_custom_type_merge": lambda r: r.o12,
    "o13_update_posts_from": lambda r: posts.update_posts_from(r.m10, r.o12, key="nid"),
    "o14_fix_taxonomy_ids": _o14,
    "o15_clean_slugs": _o15,
    "o16_redirects": lambda r: posts.redirects(r.t["node"], r.t["node_revisions"], r.aliases),
    "o17_rekey_prefix": lambda r: options.rekey_prefix(r.t["wp_options"], "option_name", OLD_PREFIX, NEW_PREFIX),
    "o17b_rekey_usermeta": lambda r: options.rekey_prefix(r.m25, "meta_key", OLD_PREFIX, NEW_PREFIX),
    "o17c_replace_in_settings": lambda r: options.replace_in_values(_settings(r), "option_value", "/files/", "/wp-content/uploads/"),
    "f15_nested_values": _f15,
    "o18b_rename_options": lambda r: options.rename_keys(r.t["wp_options"], "option_name", options.OPTION_NAME_RENAMES),
    "o18_rename_keys": lambda r: options.rename_keys(r.m25, "meta_key", options.META_KEY_RENAMES),
    "o19_authors_of_types": lambda r: users.authors_with_posts(r.t["node"], r.t["users"], posts.POST_TYPES),
    # runs
    "x1_run_steps": _x1,
    "x1b_script": _x1b,
    "x3_migrate": _x3,
    # kernel, stand-alone
    "k1_replace_into": _k1,
    "k2_insert_ignore": _k2,
    "k2b_insert_ignore_keys": _k2b,
    "k3_insert": _k3,
    "k4_insert_auto_id": _k4,
    "k6_update_from_join": lambda r: posts.update_posts_from(r.m10, r.o12, key="vid"),
    "k7_update_with_count": _k7,
    "k10_not_in": _k10,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _q(fn) for name, fn in QUERIES.items()}
