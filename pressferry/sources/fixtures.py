"""Source-shaped views derived from the driver's testdata tables.

The content tables (documents, pages, part, lineitem, events, customer,
supplier, nation, region) are reshaped into the CMS source schema (node,
node_revisions, url_alias, term_data, term_node, comments, users, variable,
...) and the pre-existing target rows (wp_users, wp_terms, wp_options,
wp_usermeta).  Every view is a lazy projection/filter of a parquet scan, so it
grows with the data and keeps predicate pushdown and column pruning.

The same derivation is written as DuckDB SQL in ``pressferry.checks.views``;
the two must stay in step.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressferry.functions.scalars import epoch_to_ts, slug, ts_to_epoch

# Literal rows of the small configuration tables.
NODE_TYPES = [
    ("story", "Story", "A short article."),
    ("page", "Page", "A static page."),
    ("forum", "Forum topic", "A discussion thread."),
    ("poll", "Poll", "A question with answers."),
]
VARIABLE_ROWS = [
    ("site_name", 's:12:"Example Site";'),
    ("site_slogan", 's:16:"Content at scale";'),
    ("site_mail", 's:17:"admin@example.org";'),
    ("anonymous", 's:9:"Anonymous";'),
    ("cron_last", "i:1700000000;"),
    ("site_offline", "b:0;"),
    ("site_frontpage", "N;"),
    ("image_quality", "d:0.75;"),
    ("theme_settings", 'a:1:{s:4:"logo";s:8:"logo.png";}'),
]
SYSTEM_ROW = ("system", 'a:3:{s:4:"name";s:6:"System";s:7:"version";s:4:"6.37";s:4:"core";s:3:"6.x";}')
WP_OPTION_ROWS = [
    ("siteurl", "http://example.org"),
    ("blogname", "My Blog"),
    ("blogdescription", "Just another content site"),
    ("admin_email", "admin@example.com"),
    ("default_category", "1"),
    ("permalink_structure", ""),
    ("wp_user_roles", "a:0:{}"),
]
ADMIN_CAPABILITIES = 'a:1:{s:13:"administrator";s:1:"1";}'


def _lit_df(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


class Tables(Mapping):
    """Lazy name -> DataFrame mapping over one testdata directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self._builders: dict[str, Callable[[], DataFrame]] = {
            name[len("_v_"):]: getattr(self, name) for name in dir(self) if name.startswith("_v_")
        }

    # Mapping protocol -------------------------------------------------
    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name not in self._builders:
                raise KeyError(name)
            self._cache[name] = self._builders[name]()
        return self._cache[name]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._builders))

    def __len__(self) -> int:
        return len(self._builders)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # Source (CMS) views ---------------------------------------------------
    def _v_users(self) -> DataFrame:
        c = self.raw("customer")
        return c.where((F.col("c_custkey") % 3 != 0) | (F.col("c_custkey") == 0)).select(
            (F.col("c_custkey") + 1).cast("bigint").alias("uid"),
            F.col("c_name").alias("name"),
            F.md5(F.col("c_name")).alias("pass"),
            F.concat(F.lower("c_name"), F.lit("@example.org")).alias("mail"),
            (F.lit(86400) * (F.col("c_custkey") + 10)).cast("bigint").alias("created"),
        )

    def _v_node(self) -> DataFrame:
        d = self.raw("documents")
        doc = F.col("doc_id")
        return d.select(
            (doc + 1).cast("bigint").alias("nid"),
            (doc + 100001).cast("bigint").alias("vid"),
            F.when(doc % 11 == 0, doc + 1000000).otherwise(doc % 100 + 1).cast("bigint").alias("uid"),
            F.when(F.col("lang") == "en", "story").when(F.col("lang") == "de", "page")
            .when(F.col("lang") == "fr", "forum").otherwise("blog").alias("type"),
            F.substring("text", 1, 60).alias("title"),
            F.when(doc % 5 == 0, 0).otherwise(1).alias("status"),
            (F.lit(86400) * (doc - 10) + 3600).cast("bigint").alias("created"),
            (F.lit(86400) * doc).cast("bigint").alias("changed"),
        )

    def _v_node_revisions(self) -> DataFrame:
        d = self.raw("documents")
        doc = F.col("doc_id")
        current = d.select(
            (doc + 100001).cast("bigint").alias("vid"),
            (doc + 1).cast("bigint").alias("nid"),
            F.concat(F.col("text"), F.lit(' <img src="/files/'), doc.cast("string"),
                     F.lit('.png">')).alias("body"),
            F.substring("text", 1, 120).alias("teaser"),
        )
        old = d.where(doc % 4 == 0).select(
            (doc + 900001).cast("bigint").alias("vid"),
            (doc + 1).cast("bigint").alias("nid"),
            F.lit("old").alias("body"),
            F.lit("old").alias("teaser"),
        )
        return current.unionByName(old)

    def _v_node_type(self) -> DataFrame:
        places = self.raw("nation").select(
            F.concat(F.lit("place_"), F.lower("n_name")).alias("type"), F.col("n_name").alias("name"),
            F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("description"))
        return _lit_df(self.spark, NODE_TYPES, "type string, name string, description string").unionByName(places)

    def _v_url_alias(self) -> DataFrame:
        p = self.raw("pages")
        pid = F.col("page_id")
        return p.select(
            (pid + 1).cast("bigint").alias("pid"),
            F.concat(F.lit("node/"), F.when(pid % 5 == 1, pid).otherwise(pid + 1).cast("string")).alias("src"),
            F.col("url").alias("dst"),
        )

    def _v_vocabulary(self) -> DataFrame:
        r = self.raw("region")
        return r.select(
            (F.col("r_regionkey") + 1).cast("bigint").alias("vid"),
            F.col("r_name").alias("name"),
            F.concat(F.lit("about "), F.col("r_name")).alias("description"),
        )

    def _v_term_data(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        name = (
            F.when(k % 101 == 7, F.lit(None).cast("string"))
            .when(k % 50 == 0, F.repeat(F.col("p_name"), 30))
            .when(k % 3 == 0, F.upper("p_name"))
            .when(k % 7 == 0, F.concat(F.col("p_name"), F.lit(" "), k.cast("string")))
            .otherwise(F.col("p_name"))
        )
        return p.select(
            (k + 1).cast("bigint").alias("tid"),
            (F.col("p_size") % 5 + 1).cast("bigint").alias("vid"),
            name.alias("name"),
            F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("description"),
        )

    def _v_term_node(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.where(F.col("l_partkey") % 13 != 0).select(
            (F.col("l_orderkey") + 1).cast("bigint").alias("nid"),
            (F.col("l_partkey") + 1).cast("bigint").alias("tid"),
        )

    def _v_comments(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        return e.select(
            (eid + 1).cast("bigint").alias("cid"),
            F.when(eid % 4 == 0, eid).otherwise(F.lit(0)).cast("bigint").alias("pid"),
            (eid % 500 + 1).cast("bigint").alias("nid"),
            (F.col("user_id") * 11).cast("bigint").alias("uid"),
            F.col("props").alias("comment"),
            F.concat(F.col("event_type"), F.col("user_id").cast("string")).alias("name"),
            F.concat(F.col("event_type"), F.lit("@example.org")).alias("mail"),
            F.repeat(F.concat(F.lit("http://h.example/"), F.col("event_type"), F.lit("/")),
                     F.when(eid % 10 == 0, 20).otherwise(1)).alias("homepage"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("status"),
            ts_to_epoch("ts").cast("bigint").alias("timestamp"),
        )

    def _v_variable(self) -> DataFrame:
        n = self.raw("nation")
        derived = n.select(
            F.lower("n_name").alias("name"),
            F.concat(F.lit("s:"), F.octet_length("n_name").cast("string"), F.lit(':"'),
                     F.col("n_name"), F.lit('";')).alias("value"),
        )
        return derived.unionByName(_lit_df(self.spark, VARIABLE_ROWS, "name string, value string"))

    def _v_system(self) -> DataFrame:
        s = self.raw("supplier")
        modules = s.select(
            F.concat(F.lit("module_"), F.col("s_suppkey").cast("string")).alias("name"),
            F.concat(F.lit('a:2:{s:4:"name";s:'), F.octet_length("s_name").cast("string"), F.lit(':"'),
                     F.col("s_name"), F.lit('";s:7:"version";s:7:"6.x-1.0";}')).alias("info"),
        )
        return _lit_df(self.spark, [SYSTEM_ROW], "name string, info string").unionByName(modules)

    def _v_users_roles(self) -> DataFrame:
        return self["users"].select(F.col("uid"), F.lit(2).cast("bigint").alias("rid"))

    def _v_acc_categories_from_client(self) -> DataFrame:
        return self["term_data"].where(F.col("tid") % 9 == 0).select("tid", "vid", "name")

    def _v_content_field_teaser(self) -> DataFrame:
        d = self.raw("documents")
        return d.where(F.col("doc_id") % 2 == 0).select(
            (F.col("doc_id") + 100001).cast("bigint").alias("vid"),
            F.substring("text", 1, 40).alias("field_teaser_value"),
        )

    def _v_content_type_press(self) -> DataFrame:
        d = self.raw("documents")
        return d.where(F.col("doc_id") % 3 == 0).select(
            (F.col("doc_id") + 100001).cast("bigint").alias("vid"),
            F.concat(F.lit("http://press.example/"), F.col("doc_id").cast("string")).alias("field_press_link_url"),
        )

    # Pre-existing target rows --------------------------------------------
    def _v_wp_users(self) -> DataFrame:
        s = self.raw("supplier")
        return s.where(F.col("s_suppkey") % 10 == 0).select(
            (F.col("s_suppkey") + 1).cast("bigint").alias("ID"),
            F.lower("s_name").alias("user_login"),
            F.md5(F.col("s_name")).alias("user_pass"),
            F.col("s_name").alias("user_nicename"),
            F.concat(F.lower("s_name"), F.lit("@example.com")).alias("user_email"),
            epoch_to_ts(F.col("s_suppkey") * 86400).alias("user_registered"),
            F.lit("").alias("user_activation_key"),
            F.lit(0).alias("user_status"),
            F.col("s_name").alias("display_name"),
        )

    def _v_wp_terms(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            (F.col("s_suppkey") * 7 + 1).cast("bigint").alias("term_id"),
            F.col("s_name").alias("name"),
            slug("s_name").alias("slug"),
            F.lit(0).cast("bigint").alias("term_group"),
        )

    # Half of these hold ids that the pass writes, half have ids of their own.
    def _v_wp_posts(self) -> DataFrame:
        d = self.raw("documents")
        doc = F.col("doc_id")
        return d.where(doc % 3 == 0).select(
            F.when(doc % 2 == 0, doc + 1).otherwise(doc + 1_000_000_001).cast("bigint").alias("id"),
            (doc % 100 + 1).cast("bigint").alias("post_author"),
            epoch_to_ts(F.lit(86400) * doc).alias("post_date"),
            F.concat(F.lit('earlier <img src="/files/'), doc.cast("string"), F.lit('.png">')).alias("post_content"),
            F.concat(F.lit("Earlier post "), doc.cast("string")).alias("post_title"),
            F.lit("").alias("post_excerpt"),
            F.concat(F.lit("earlier-"), doc.cast("string")).alias("post_name"),
            epoch_to_ts(F.lit(86400) * (doc + 1)).alias("post_modified"),
            F.when(doc % 4 == 0, "page").when(doc % 4 == 1, "post").otherwise("story").alias("post_type"),
            F.when(doc % 5 == 0, "private").otherwise("publish").alias("post_status"),
            F.lit("").alias("to_ping"), F.lit("").alias("pinged"), F.lit("").alias("post_content_filtered"),
            (doc % 3).cast("bigint").alias("comment_count"),
        )

    def _v_wp_comments(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        return e.where(eid % 20 == 0).select(
            F.when(eid % 40 == 0, eid + 1).otherwise(eid + 1_000_000_001).cast("bigint").alias("comment_ID"),
            (eid % 500 + 1).cast("bigint").alias("comment_post_ID"),
            epoch_to_ts(eid * 60).alias("comment_date"),
            F.concat(F.lit("earlier comment "), eid.cast("string")).alias("comment_content"),
            F.lit(0).cast("bigint").alias("comment_parent"),
            F.lit("earlier").alias("comment_author"),
            F.lit("earlier@example.org").alias("comment_author_email"),
            F.lit("").alias("comment_author_url"),
            F.lit("1").alias("comment_approved"),
        )

    def _v_wp_term_taxonomy(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        return p.where(k % 10 == 0).select(
            F.when(k % 20 == 0, k + 1).otherwise(k + 1_000_000_001).cast("bigint").alias("term_taxonomy_id"),
            (k + 1).cast("bigint").alias("term_id"),
            F.when(k % 30 == 0, "category").otherwise("post_tag").alias("taxonomy"),
            F.concat(F.lit("earlier "), k.cast("string")).alias("description"),
            F.lit(0).cast("bigint").alias("parent"),
            F.lit(7).cast("bigint").alias("count"),
        )

    def _v_wp_term_relationships(self) -> DataFrame:
        o = self.raw("orders")
        return o.where(F.col("o_orderkey") % 10 == 0).select(
            (F.col("o_orderkey") + 1).cast("bigint").alias("object_id"),
            (F.col("o_custkey") + 1_000_000_001).cast("bigint").alias("term_taxonomy_id"),
        )

    def _v_wp_options(self) -> DataFrame:
        s = self.raw("supplier")
        widgets = s.select(
            F.concat(F.lit("wp_widget_"), F.col("s_suppkey").cast("string")).alias("option_name"),
            F.col("s_name").alias("option_value"),
        )
        return _lit_df(self.spark, WP_OPTION_ROWS, "option_name string, option_value string").unionByName(widgets)

    def _v_wp_usermeta(self) -> DataFrame:
        u = self["wp_users"]
        rows = F.array(
            F.struct(F.lit("wp_capabilities").alias("meta_key"), F.lit(ADMIN_CAPABILITIES).alias("meta_value")),
            F.struct(F.lit("wp_user_level").alias("meta_key"), F.lit("10").alias("meta_value")),
            F.struct(F.lit("wp_autosave_draft_ids").alias("meta_key"), F.lit("a:0:{}").alias("meta_value")),
        )
        return u.select(F.col("ID").alias("user_id"), F.inline(rows))


_SESSIONS: "weakref.WeakKeyDictionary[SparkSession, dict[str, Tables]]" = weakref.WeakKeyDictionary()


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The views of one directory, shared by every query of one session.
    Only plans are shared (DataFrames are immutable and lazy); no data is
    cached, so each query still reads the files it needs."""
    per_session = _SESSIONS.setdefault(spark, {})
    key = sf_dir.rstrip("/")
    if key not in per_session:
        per_session[key] = Tables(spark, key)
    return per_session[key]
