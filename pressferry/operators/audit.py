"""Read-only diagnostics of a source database (D1-D12) and the migration gate.

Every check is a lazy DataFrame; the summary (D12) fuses the term checks into
one scan of ``term_data`` and nothing is fetched to the driver to be counted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressferry.functions.scalars import epoch_to_ts, slug
from pressferry.functions.serialized import decode_scalar, extract_version, is_valid_scalar, serialized_kind
from pressferry.schemas import required_tables as _required_list

TERM_NAME_LIMIT = 200
# Default texts of the analysis record.
UNKNOWN_SITENAME = "[Unknown sitename]"
UNKNOWN_VERSION = "Unknown"


# S2 / D1 ---------------------------------------------------------------------

def table_exists(spark: SparkSession, tables: Mapping[str, DataFrame], names: list[str]) -> DataFrame:
    """Per requested table: how many catalog entries carry the name (0 or 1)
    and, when present, its row count (all counted in one job).  Presence comes
    from the mapping: an existing empty table is present with 0 rows."""
    present = [n for n in names if n in tables]
    counts = None
    for n in present:
        # A global aggregate has one row also for an empty table.
        one = tables[n].agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(n).alias("table_name"), F.lit(1).cast("bigint").alias("table_count"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    requested = spark.createDataFrame([(n,) for n in names], "table_name string")
    if counts is None:
        return requested.select("table_name", F.lit(0).cast("bigint").alias("table_count"),
                                F.lit(None).cast("bigint").alias("row_count"))
    # Both sides are bounded by the requested list, a parameter.
    joined = requested.join(F.broadcast(counts), "table_name", "left")
    return joined.select("table_name", F.coalesce("table_count", F.lit(0)).cast("bigint").alias("table_count"),
                         "row_count")


def required_tables(spark: SparkSession, tables: Mapping[str, DataFrame], version="6.37") -> DataFrame:
    """The version's required tables, present or not."""
    out = table_exists(spark, tables, _required_list(version))
    return out.select("table_name", (F.col("table_count") > 0).alias("present"), "row_count")


def all_tables_present(required: DataFrame) -> DataFrame:
    return required.agg(F.coalesce(F.bool_and("present"), F.lit(True)).alias("all_present"))


# D2 / D3 ---------------------------------------------------------------------

def decode_version(system: DataFrame) -> DataFrame:
    """Version of the 'system' row's serialized info."""
    return system.where(F.col("name") == "system").select("name", extract_version("info").alias("version"))


def decode_variable(variable: DataFrame) -> DataFrame:
    """D3 as a batch job over the whole table: kind, decoded scalar, validity."""
    return variable.select(
        "name",
        serialized_kind("value").alias("kind"),
        decode_scalar("value").alias("decoded"),
        is_valid_scalar("value").alias("valid"),
    )


def site_name(variable: DataFrame) -> DataFrame:
    """One-row sitename (default when the variable is missing)."""
    got = decode_variable(variable).where(F.col("name") == "site_name")
    return got.agg(F.coalesce(F.min("decoded"), F.lit(UNKNOWN_SITENAME)).alias("sitename"))


# D4 - D7 -------------------------------------------------------------------

def posts_list(node: DataFrame) -> DataFrame:
    return node.select("nid", epoch_to_ts("created").alias("post_date"), "title", "type").distinct()


def terms_list(term_data: DataFrame) -> DataFrame:
    return term_data.select("tid", "name", slug("name").alias("slug"),
                            F.lit(0).alias("term_group")).distinct()


def node_types(node_type: DataFrame) -> DataFrame:
    return node_type.select("type", "name", "description").distinct()


def count_by_type(node: DataFrame, node_type: DataFrame) -> DataFrame:
    """Nodes per known content type.  Nodes are counted per type first
    (map-side combined) and only then joined to the type names, so a hot
    type never crosses a join."""
    per_type = node.where(F.col("nid").isNotNull()).groupBy("type").agg(F.count("nid").alias("node_count"))
    return (node_type.select("type", "name").join(per_type, "type")
            .groupBy("type", "name").agg(F.sum("node_count").cast("bigint").alias("node_count")))


# D8 - D11 ------------------------------------------------------------------

# The collation of a case-insensitive database: 'Foo', 'foo ' and 'FOO' are equal.
CI_COLLATION = "UTF8_LCASE_RTRIM"
# Case, accents and trailing blanks: also 'Étage' and 'etage'.
CI_AI_COLLATION = "UNICODE_CI_AI_RTRIM"
COLLATIONS = {"ci": CI_COLLATION, "ci_ai": CI_AI_COLLATION}


def collated(column: str, collation: str) -> Column:
    """The column under the rules of the target database: ``'ci'``, ``'ci_ai'`` or
    the name of a Spark collation.  The one key type of audit, repair and
    upsert: group-bys and joins on it agree, whatever the letters."""
    return F.collate(F.col(column), COLLATIONS.get(collation, collation))


def collate_columns(df: DataFrame, collation: str, columns: list[str]) -> DataFrame:
    """Give key columns the collation as their type, so that K1-K3, K6 and K10
    compare them by it."""
    return df.select(*[collated(c, collation).alias(c) if c in columns else F.col(c) for c in df.columns])


def shown(column: Column | str) -> Column:
    """How a group of equal names is reported: one of them (the smallest in
    lower case), without trailing blanks."""
    return F.min(F.lower(F.rtrim(F.collate(column, "UTF8_BINARY"))))


def dup_term_names(term_data: DataFrame, *, strict: bool = False, collation: str | None = None) -> DataFrame:
    """One row per duplicated name (the NULL name counts as a group);
    ``tid`` is the group's smallest.  ``strict`` groups by (name, tid).
    ``collation`` compares names as the target database would (``collated``);
    the name reported is then one of the group's, lower-cased and trimmed."""
    if collation:
        g = term_data.groupBy(collated("name", collation).alias("_k")).agg(
            F.count(F.lit(1)).alias("c"), F.min("tid").alias("tid"), shown("name").alias("name"))
        return g.where(F.col("c") > 1).select("tid", "name", "c")
    keys = ["name", "tid"] if strict else ["name"]
    g = term_data.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("tid").alias("_tid"))
    return g.where(F.col("c") > 1).select(F.col("_tid").alias("tid"), "name", "c")


def dup_term_members(term_data: DataFrame, *, strict: bool = False, collation: str | None = None) -> DataFrame:
    """Every (tid, name) whose name occurs more than once; NULL names
    excluded (COUNT(name) and an equality join).  ``collation`` as in D8."""
    if collation:
        dup = (term_data.where(F.col("name").isNotNull()).groupBy(collated("name", collation).alias("_k"))
               .agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("_k"))
        return term_data.join(dup, collated("name", collation) == F.col("_k"), "left_semi").select("tid", "name")
    keys = ["name", "tid"] if strict else ["name"]
    dup = (term_data.where(F.col("name").isNotNull()).groupBy(*keys)
           .agg(F.count("name").alias("c")).where(F.col("c") > 1).select("name"))
    if strict:
        # Same name may come back per tid: a semi join keeps each term once per match.
        return term_data.join(dup, "name", "inner").select("tid", "name")
    return term_data.join(dup, "name", "left_semi").select("tid", "name")


def terms_too_long(term_data: DataFrame, limit: int = TERM_NAME_LIMIT) -> DataFrame:
    return term_data.where(F.char_length("name") > limit).select("tid", "name")


def dup_aliases(url_alias: DataFrame, *, strict: bool = False, collation: str | None = None) -> DataFrame:
    """One row per path with several aliases; ``collation`` as in D8."""
    if collation:
        g = url_alias.groupBy(collated("src", collation).alias("_k")).agg(F.count(F.lit(1)).alias("c"), F.min("pid").alias("pid"), shown("src").alias("src"))
        return g.where(F.col("c") > 1).select("pid", "src", "c")
    keys = ["src", "pid"] if strict else ["src"]
    g = url_alias.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("pid").alias("_pid"))
    return g.where(F.col("c") > 1).select(F.col("_pid").alias("pid"), "src", "c")


# D12 / X2 ------------------------------------------------------------------

def term_health(term_data: DataFrame, limit: int = TERM_NAME_LIMIT) -> DataFrame:
    """One scan of term_data for three numbers: distinct (tid, name) terms,
    duplicated names (groups, the NULL name included), names over the limit.

    Two plain group-bys (by (name, tid), then by name), both map-side
    combined; no distinct aggregate, so no Expand doubling the rows."""
    long = F.when(F.char_length("name") > limit, 1).otherwise(0)
    per_pair = term_data.groupBy("name", "tid").agg(F.count(F.lit(1)).alias("n"), F.sum(long).alias("long"))
    per_name = per_pair.groupBy("name").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("c"), F.sum("long").alias("long"))
    return per_name.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("terms_count"),
        F.count_if(F.col("c") > 1).cast("bigint").alias("duplicate_terms_count"),
        F.coalesce(F.sum("long"), F.lit(0)).cast("bigint").alias("terms_exceeded_char_count"),
    )


def audit_summary(tables: Mapping[str, DataFrame], limit: int = TERM_NAME_LIMIT, *,
                  lists: bool = False, trust_source_keys: bool = True) -> DataFrame:
    """The analysis record as one row.  The other tables' numbers are
    scalar subqueries, each one aggregate job over its table.
    ``trust_source_keys``: nid is the node table's primary key, so the DISTINCT
    posts are its rows and no title is shuffled.  ``lists`` adds the record's
    two lists, ``node_types`` and ``node_count_by_type``: arrays of structs in
    name order, bounded by the number of content types."""
    version = decode_version(tables["system"]).agg(
        F.coalesce(F.min("version"), F.lit(UNKNOWN_VERSION)).alias("v")).scalar()
    sitename = site_name(tables["variable"]).scalar()
    listed_posts = tables["node"] if trust_source_keys else posts_list(tables["node"])
    posts = listed_posts.agg(F.count(F.lit(1))).scalar()
    types = node_types(tables["node_type"]).agg(F.count(F.lit(1))).scalar()
    aliases = dup_aliases(tables["url_alias"]).agg(F.count(F.lit(1))).scalar()
    listed = []
    if lists:
        kinds = node_types(tables["node_type"]).agg(F.sort_array(F.collect_list(F.struct("type", "name", "description"))))
        per = count_by_type(tables["node"], tables["node_type"]).agg(F.sort_array(F.collect_list(F.struct("type", "name", "node_count"))))
        listed = [kinds.scalar().alias("node_types"), per.scalar().alias("node_count_by_type")]
    # The field names of the analysis record.
    return term_health(tables["term_data"], limit).select(
        sitename.alias("sitename"),
        version.alias("version"),
        posts.cast("bigint").alias("posts_count"),
        "terms_count",
        "duplicate_terms_count",
        types.cast("bigint").alias("node_types_count"),
        "terms_exceeded_char_count",
        aliases.cast("bigint").alias("duplicate_aliases_count"),
        *listed,
    )


GATE_CHECKS = ["duplicate_terms_count", "terms_exceeded_char_count", "duplicate_aliases_count"]


def gate(summary: DataFrame) -> DataFrame:
    """Proceed only if the three problem counts are all zero.  Rows:
    one per check plus ``proceed``, all made from the one summary row."""
    total = sum((F.col(c) for c in GATE_CHECKS[1:]), F.col(GATE_CHECKS[0]))
    checks = [F.struct(F.lit(c).alias("check"), F.col(c).alias("count"), (F.col(c) == 0).alias("ok")) for c in GATE_CHECKS]
    proceed = F.struct(F.lit("proceed").alias("check"), total.alias("count"), (total == 0).alias("ok"))
    return summary.select(F.inline(F.array(*checks, proceed)))
