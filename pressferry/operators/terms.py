"""Taxonomy transforms: vocabularies and terms -> terms, taxonomy rows and
relationships (M2-M9, M13, M14, M16 and the optional O1-O11, O14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressferry.functions.scalars import slug
from pressferry.operators.dml import (
    delete_where,
    insert,
    insert_auto_id,
    replace_into,
    settled,
    small_tasks,
    update_from_join,
    update_where,
    update_with_count,
)
from pressferry.schemas import TARGET_DEFAULTS

# Unique keys of the target tables (parameters of the upserts).  Where the
# target also holds names (or slugs) unique, pass them: ["term_id", "slug"].
# Fixed values of the target below: 'post_tag', 'category', 'uncategorized'.
TERM_KEYS = ["term_id"]
TAXONOMY_KEYS = ["term_taxonomy_id", ("term_id", "taxonomy")]
RELATIONSHIP_KEY = ("object_id", "term_taxonomy_id")
TAX_DEFAULTS = TARGET_DEFAULTS["wp_term_taxonomy"]


# Working tables --------------------------------------------------------------

def tags_work(term_data: DataFrame, exclude_vids: Sequence[int] | None = None) -> DataFrame:
    """M2 (+O7): acc_tags = (tid, vid, name), optionally without some vocabularies."""
    out = term_data.select("tid", "vid", "name")
    if exclude_vids:
        out = out.where(~F.col("vid").isin(list(exclude_vids)))
    return out


def categories_work(categories_from_client: DataFrame) -> DataFrame:
    """M5: acc_categories = (tid, vid, name)."""
    return categories_from_client.select("tid", "vid", "name")


def vocab_roles(term_data: DataFrame, category_vids: Sequence[int]) -> DataFrame:
    """One parameter decides both sides: terms of ``category_vids`` become
    categories, every other term a tag.  A term without a vocabulary is in
    neither list, as in ``tags_work``: NULL NOT IN (...) isn't true."""
    return term_data.where(F.col("vid").isNotNull()).select(
        "tid", "vid", "name",
        F.when(F.col("vid").isin(list(category_vids)), "category").otherwise("tag").alias("role"))


# Terms ---------------------------------------------------------------------

def _term_rows(term_data: DataFrame, selected: DataFrame) -> DataFrame:
    chosen = term_data.join(selected.select("tid"), "tid", "left_semi")
    return chosen.select(F.col("tid").alias("term_id"), "name", slug("name").alias("slug"),
                         F.col("vid").alias("term_group"))


def tags_terms(term_data: DataFrame, tags: DataFrame, wp_terms: DataFrame,
               keys: Sequence = TERM_KEYS, *, trust_source_keys: bool = True) -> DataFrame:
    """M3: REPLACE the tag terms into wp_terms.  ``trust_source_keys``: one
    row per tid (term_data's primary key), so with the default keys the
    batch is unique and needs no de-duplication."""
    return replace_into(wp_terms, _term_rows(term_data, tags), keys, order=["term_id"],
                        incoming_unique=trust_source_keys and list(keys) == TERM_KEYS)


def category_terms(term_data: DataFrame, categories: DataFrame, wp_terms: DataFrame,
                   keys: Sequence = TERM_KEYS, *, trust_source_keys: bool = True) -> DataFrame:
    """M6: REPLACE the category terms (DISTINCT) into wp_terms."""
    return replace_into(wp_terms, _term_rows(term_data, categories), keys, order=["term_id"],
                        incoming_unique=trust_source_keys and list(keys) == TERM_KEYS)


def uncategorized_term(wp_terms: DataFrame, name: str = "Uncategorized",
                       term_slug: str = "uncategorized", *, after: Column | None = None) -> DataFrame:
    """M8: INSERT one literal term; its id is assigned as max + 1.  ``after``:
    the largest id, where ``wp_terms`` is only a part of the table."""
    # One row: its id needs the largest id only, no ranking of a batch.
    top = F.coalesce(F.max("term_id"), F.lit(0)).cast("bigint") if after is None else F.coalesce(F.max("term_id") * 0, F.lit(0)).cast("bigint") + after
    row = wp_terms.agg((top + 1).alias("term_id")).select(
        "term_id", F.lit(name).alias("name"), F.lit(term_slug).alias("slug"), F.lit(0).cast("bigint").alias("term_group"))
    return insert(wp_terms, row, check=False)


# Taxonomy --------------------------------------------------------------------

def _taxonomy_rows(term_data: DataFrame, selected: DataFrame, taxonomy: str,
                   parent=None) -> DataFrame:
    chosen = term_data.join(selected.select("tid"), "tid", "left_semi")
    parent_col = F.lit(0).cast("bigint") if parent is None else F.col(parent)
    return chosen.select(F.col("tid").alias("term_taxonomy_id"), F.col("tid").alias("term_id"),
                         F.lit(taxonomy).alias("taxonomy"), "description", parent_col.alias("parent"))


def tags_taxonomy(term_data: DataFrame, tags: DataFrame, taxonomy: DataFrame,
                  keys: Sequence = TAXONOMY_KEYS, *, trust_source_keys: bool = True) -> DataFrame:
    """M4: REPLACE DISTINCT (tid, tid, 'post_tag', description, 0).  With the
    default keys every key is a function of tid (one row per tid)."""
    return replace_into(taxonomy, _taxonomy_rows(term_data, tags, "post_tag"), keys,
                        order=["term_taxonomy_id"], defaults=TAX_DEFAULTS,
                        incoming_unique=trust_source_keys and list(keys) == TAXONOMY_KEYS)


def category_taxonomy(term_data: DataFrame, categories: DataFrame, taxonomy: DataFrame,
                      keys: Sequence = TAXONOMY_KEYS, *, trust_source_keys: bool = True) -> DataFrame:
    """M7: as M4 with 'category'; a later REPLACE wins on shared ids."""
    return replace_into(taxonomy, _taxonomy_rows(term_data, categories, "category"), keys,
                        order=["term_taxonomy_id"], defaults=TAX_DEFAULTS,
                        incoming_unique=trust_source_keys and list(keys) == TAXONOMY_KEYS)


def subcategories(term_data: DataFrame, vids: Sequence[int], taxonomy: DataFrame,
                  keys: Sequence = TAXONOMY_KEYS) -> DataFrame:
    """Terms of ``vids`` as categories whose parent is their vocabulary."""
    chosen = term_data.where(F.col("vid").isin(list(vids)) & F.col("tid").isNotNull())
    rows = chosen.select(F.col("tid").alias("term_taxonomy_id"), F.col("tid").alias("term_id"),
                         F.lit("category").alias("taxonomy"), "description", F.col("vid").alias("parent"))
    return replace_into(taxonomy, rows, keys, order=["term_taxonomy_id"], defaults=TAX_DEFAULTS,
                        incoming_unique=list(keys) == TAXONOMY_KEYS)


def uncategorized_taxonomy(wp_terms: DataFrame, taxonomy: DataFrame,
                           term_slug: str = "uncategorized") -> DataFrame:
    """M9: INSERT DISTINCT the taxonomy row(s) of the 'uncategorized' term."""
    rows = wp_terms.where(F.col("slug") == term_slug).select(
        F.col("term_id").alias("term_taxonomy_id"), "term_id", F.lit("category").alias("taxonomy"),
        F.col("name").alias("description"), F.lit(0).cast("bigint").alias("parent"),
        F.lit(0).cast("bigint").alias("count")).distinct()
    return insert(taxonomy, rows, TAXONOMY_KEYS, few=True)


# The taxonomy chain as single passes ----------------------------------------------

def _roles(term_data: DataFrame, categories: DataFrame, exclude_vids: Sequence[int] | None) -> DataFrame:
    """The chosen terms with ``_cat`` (a category) and ``_tag`` (not excluded)."""
    cat = categories.where(F.col("tid").isNotNull()).groupBy(F.col("tid").alias("_ct")).agg(F.lit(True).alias("_cat"))
    flagged = term_data.join(cat, F.col("tid") == F.col("_ct"), "left").drop("_ct")
    tag = ~F.col("vid").isin(list(exclude_vids)) if exclude_vids else F.lit(True)
    flagged = flagged.withColumn("_cat", F.coalesce("_cat", F.lit(False))).withColumn("_tag", F.coalesce(tag, F.lit(False)))
    return flagged.where((F.col("_cat") | F.col("_tag")) & F.col("tid").isNotNull())


def terms_pass(term_data: DataFrame, categories: DataFrame, wp_terms: DataFrame,
               exclude_vids: Sequence[int] | None = None) -> DataFrame:
    """M3 then M6 as one REPLACE: tag and category terms are the same rows of
    term_data, so each term is written once.  Without excluded vocabularies
    every term is a tag, and the categories needn't be read."""
    chosen = term_data.where(F.col("tid").isNotNull()) if not exclude_vids else _roles(term_data, categories, exclude_vids)
    rows = chosen.select(F.col("tid").alias("term_id"), "name", slug("name").alias("slug"), F.col("vid").alias("term_group"))
    return replace_into(wp_terms, rows, TERM_KEYS, order=["term_id"], incoming_unique=True)


def taxonomy_pass(term_data: DataFrame, categories: DataFrame, taxonomy: DataFrame,
                  exclude_vids: Sequence[int] | None = None) -> DataFrame:
    """M4 then M7 as one REPLACE: a term that is a category ends as one, all
    other chosen terms as tags; one left join to the category ids."""
    roles = _roles(term_data, categories, exclude_vids)
    rows = roles.select(F.col("tid").alias("term_taxonomy_id"), F.col("tid").alias("term_id"),
                        F.when(F.col("_cat"), "category").otherwise("post_tag").alias("taxonomy"),
                        "description", F.lit(0).cast("bigint").alias("parent"))
    # M4 also removes the (term, 'post_tag') rows of terms that M7 makes categories.
    tagged = roles.where("_cat AND _tag").select(F.col("tid").alias("_t"))
    kept = taxonomy.join(tagged, (F.col("term_id") == F.col("_t")) & (F.col("taxonomy") == "post_tag"), "left_anti")
    return replace_into(kept, rows, TAXONOMY_KEYS, order=["term_taxonomy_id"], defaults=TAX_DEFAULTS, incoming_unique=True)


def default_category_taxonomy(taxonomy: DataFrame, term_id: int = 159) -> DataFrame:
    """Taxonomy <- 'category' where term_id = the default category."""
    return update_where(taxonomy, F.col("term_id") == term_id, {"taxonomy": F.lit("category")})


# Relationships -----------------------------------------------------------------

def term_relationships(term_node: DataFrame, relationships: DataFrame) -> DataFrame:
    """INSERT DISTINCT (nid, tid) as (object_id, term_taxonomy_id)."""
    rows = term_node.select(F.col("nid").alias("object_id"),
                            F.col("tid").alias("term_taxonomy_id")).distinct()
    # DISTINCT on exactly the key: only existing keys can collide.
    return insert(relationships, rows, RELATIONSHIP_KEY, incoming_unique=True)


def term_counts(taxonomy: DataFrame, relationships: DataFrame) -> DataFrame:
    """Count <- relationships per taxonomy row (0 when none)."""
    return update_with_count(taxonomy, "term_taxonomy_id", relationships, "term_taxonomy_id",
                             "count", count_col="object_id")


def fix_taxonomy_ids(relationships: DataFrame, taxonomy: DataFrame, steps: list[int] | None = None) -> DataFrame:
    """UPDATE IGNORE relationship.term_taxonomy_id <- taxonomy.term_taxonomy_id
    where it equals taxonomy.term_id.

    Where several taxonomy rows share a term_id the smallest
    term_taxonomy_id is used.  The rows of an object are updated one after the
    other, ascending by their old id.  IGNORE: a row keeps its old value if a row
    holds its new pair at that moment, one that is still to come or one that has
    moved there.  So no pair can come to stand twice.

    One aggregate over old and target pairs tells of each target whether it is
    held and which row comes first to it.  Of the rows that want a free pair
    the first moves.  Of those that want a held one only the first that comes
    after the holder can move, and does if the holder has moved away: it waits
    for a row with a smaller id, so these waits are chains without cycles (in a
    cycle of wishes the smallest id finds its target held, and stays).  They are
    followed by pointer doubling, log2 of the longest chain in ``steps``.

    So at most one row of each target can move.  It is joined to the rows by its
    old pair, which tells rows apart, so a target that many want meets only the
    aggregate, which is combined map-side.  The rows are computed once for the
    aggregate and the join, and all jobs run in :func:`small_tasks`.
    """
    with small_tasks(relationships.sparkSession):
        return _fixed_taxonomy_ids(relationships, taxonomy, steps)


def _fixed_taxonomy_ids(relationships: DataFrame, taxonomy: DataFrame, steps: list[int] | None) -> DataFrame:
    smallest = taxonomy.where(F.col("term_id").isNotNull()).groupBy("term_id").agg(F.min("term_taxonomy_id").alias("term_taxonomy_id"))
    mapped = update_from_join(
        relationships.withColumn("_old", F.col("term_taxonomy_id")), smallest,
        {"term_taxonomy_id": "term_id"}, {"term_taxonomy_id": "term_taxonomy_id"}, source_unique=True)
    pair = lambda obj, tt: F.struct(F.col(obj).alias("obj"), F.col(tt).alias("tt"))  # noqa: E731  (its NULLs are equal in a join)
    mapped = mapped.select(pair("object_id", "_old").alias("_at"), F.col("term_taxonomy_id").alias("_new")).repartition("_at")
    old, new = F.col("_at.tt"), F.col("_new")
    changed = ~new.eqNullSafe(old)
    none = F.lit(None).cast("bigint")
    pairs = mapped.select(F.explode(F.array(
        F.struct(F.col("_at").alias("t"), F.lit(1).alias("h"), none.alias("o"), none.alias("l")),
        F.struct(pair("_at.obj", "_new").alias("t"), F.lit(0).alias("h"), F.when(changed, old).alias("o"),
                 F.when(changed & (old > new), old).alias("l")))).alias("p"))
    per_target = pairs.groupBy(F.col("p.t.obj").alias("_obj"), F.col("p.t.tt").alias("_tt")).agg(
        F.max("p.h").alias("_held"), F.min("p.o").alias("_first"), F.min("p.l").alias("_first_later"))
    movers = per_target.select("_obj", F.when(F.col("_held") == 0, F.col("_first")).otherwise(F.col("_first_later")).alias("_mover"),
                               F.when(F.col("_held") == 0, F.lit(True)).alias("_may"))  # NULL: it waits for the holder
    movers = movers.where(F.col("_mover").isNotNull()).select(pair("_obj", "_mover").alias("_mover_at"), "_may")
    moves = F.when(F.col("_mover_at").isNull(), F.lit(False)).otherwise(F.col("_may"))
    # Compressed, these rows would pass for a small table's: no broadcast.
    rows = settled(mapped.join(movers.hint("merge"), F.col("_at") == F.col("_mover_at"), "left").select(
        F.col("_at.obj").alias("object_id"), old.alias("_old"), "_new", moves.alias("_moves")))

    waiting = rows.where("_moves IS NULL").select("object_id", "_old", F.col("_new").alias("_for"))
    holders = rows.select("object_id", "_old", "_moves").join(
        waiting.select(F.col("object_id").alias("_w_obj"), F.col("_for").alias("_w_for")), F.col("object_id").eqNullSafe(F.col("_w_obj")) & (F.col("_old") == F.col("_w_for")), "left_semi")
    fixed = holders.where("_moves IS NOT NULL")
    known = None
    count = 0
    waiting = settled(waiting)
    fixed = settled(fixed)
    while not waiting.isEmpty():
        ends = fixed.select(F.col("object_id").alias("_e_obj"), F.col("_old").alias("_e_old"), F.col("_moves").alias("_found"), F.lit(None).cast("bigint").alias("_next")).unionByName(
            waiting.select(F.col("object_id").alias("_e_obj"), F.col("_old").alias("_e_old"), F.lit(None).cast("boolean").alias("_found"), F.col("_for").alias("_next")))
        met = settled(waiting.join(ends, F.col("object_id").eqNullSafe(F.col("_e_obj")) & (F.col("_for") == F.col("_e_old")))
                       .select("object_id", "_old", "_found", "_next"))
        solved = met.where("_found IS NOT NULL").select("object_id", "_old", F.col("_found").alias("_moves"))
        known = solved if known is None else known.unionByName(solved)
        # Rows that others point to may be solved now: they end chains like the fixed ones.
        fixed = fixed.unionByName(solved)
        waiting = met.where("_found IS NULL").select("object_id", "_old", F.col("_next").alias("_for"))
        count += 1
    if steps is not None:
        steps.append(count)
    if known is not None:
        found = known.select(F.col("object_id").alias("_k_obj"), F.col("_old").alias("_k_old"), F.col("_moves").alias("_k_moves"))
        rows = (rows.join(found, F.col("object_id").eqNullSafe(F.col("_k_obj")) & F.col("_old").eqNullSafe(F.col("_k_old")), "left")
                .withColumn("_moves", F.coalesce("_moves", "_k_moves")))
    return rows.select("object_id", F.when(F.col("_moves"), F.col("_new")).otherwise(F.col("_old")).alias("term_taxonomy_id"))


# Optional vocabulary handling ----------------------------------------------------

def drop_vocabularies(vocabulary: DataFrame, vids: Sequence[int]) -> DataFrame:
    """O1: DELETE vocabularies by id."""
    return delete_where(vocabulary, F.col("vid").isin(list(vids)))


def drop_terms_of_vocab(term_data: DataFrame, vids: Sequence[int]) -> DataFrame:
    """O2: DELETE terms of the listed vocabularies."""
    return delete_where(term_data, F.col("vid").isin(list(vids)))


def split_by_vocab(term_data: DataFrame, vid: int) -> DataFrame:
    """O3: working table of one vocabulary's terms."""
    return term_data.where(F.col("vid") == vid).select("tid", "vid", "name")


def cross_vocab_dups(term_data: DataFrame, tag_vid: int, news_vid: int) -> DataFrame:
    """Terms of the second vocabulary whose name also occurs in the first.

    Re-aimed from the all-pairs table: one row per second-vocabulary term with
    the number of same-name terms in the first and the smallest of their ids,
    so a name shared by millions of terms yields no quadratic output.  The
    pairs are only ever used to find these terms (O5).
    """
    tags = (term_data.where((F.col("vid") == tag_vid) & F.col("name").isNotNull())
            .groupBy("name").agg(F.count(F.lit(1)).alias("tag_matches"), F.min("tid").alias("tag_tid")))
    news = split_by_vocab(term_data, news_vid)
    return news.join(tags, "name").select(
        F.col("tid").alias("news_tid"), F.col("vid").alias("news_vid"), "name", "tag_tid",
        F.lit(tag_vid).cast("bigint").alias("tag_vid"), F.col("tag_matches").cast("bigint").alias("tag_matches"))


def suffix_cross_dups(term_data: DataFrame, tag_vid: int, news_vid: int, suffix: str = "_01",
                      use_tid: bool = False) -> DataFrame:
    """Append a suffix (or '_' + tid) to second-vocabulary duplicates."""
    dups = cross_vocab_dups(term_data, tag_vid, news_vid).select(F.col("news_tid").alias("tid"))
    flagged = term_data.join(dups.withColumn("_dup", F.lit(True)), "tid", "left")
    tail = F.concat(F.lit("_"), F.col("tid").cast("string")) if use_tid else F.lit(suffix)
    return update_where(flagged, F.col("_dup"), {"name": F.concat(F.col("name"), tail)}).drop("_dup")


def move_vocabulary(term_data: DataFrame, from_vid: int, to_vid: int) -> DataFrame:
    """Vid <- to_vid where vid = from_vid."""
    return update_where(term_data, F.col("vid") == from_vid, {"vid": F.lit(to_vid)})


def vocab_terms(vocabulary: DataFrame, vids: Sequence[int], wp_terms: DataFrame) -> DataFrame:
    """Vocabularies as terms with generated ids (DISTINCT, ordered by vid, name)."""
    return insert_auto_id(wp_terms, _vocab_rows(vocabulary, vids), "term_id", order=["term_group", "name", "slug"], bounded=True)


def _vocab_rows(vocabulary: DataFrame, vids: Sequence[int]) -> DataFrame:
    return vocabulary.where(F.col("vid").isin(list(vids))).select(
        "name", slug("name").alias("slug"), F.col("vid").alias("term_group")).distinct()


def new_vocab_ids(vocabulary: DataFrame, vids: Sequence[int], wp_terms: DataFrame) -> DataFrame:
    """(vid -> new term id) of the terms that O9 inserts, from its new rows
    alone: of ``wp_terms`` only the largest id is read."""
    new = insert_auto_id(wp_terms, _vocab_rows(vocabulary, vids), "term_id", order=["term_group", "name", "slug"], bounded=True, only_new=True)
    return new.select(F.col("term_group").alias("vid"), F.col("term_id").alias("new_id"))


def vocab_categories(vocabulary: DataFrame, vids: Sequence[int], taxonomy: DataFrame) -> DataFrame:
    """Vocabularies as category taxonomy rows (term_id = parent = vid, count 0),
    term_taxonomy_id generated."""
    rows = vocabulary.where(F.col("vid").isin(list(vids))).select(
        F.col("vid").alias("term_id"), F.lit("category").alias("taxonomy"), "description",
        F.col("vid").alias("parent"), F.lit(0).cast("bigint").alias("count")).distinct()
    return insert_auto_id(taxonomy, rows, "term_taxonomy_id", order=["term_id", "description"], bounded=True)


def vocab_id_map(wp_terms_after_o9: DataFrame, wp_terms_before: DataFrame) -> DataFrame:
    """(vid -> new term id) of the terms O9 inserted: automates the manual look-up."""
    new = wp_terms_after_o9.join(wp_terms_before.select("term_id"), "term_id", "left_anti")
    return new.select(F.col("term_group").alias("vid"), F.col("term_id").alias("new_id"))


def remap_parents(taxonomy: DataFrame, id_map: DataFrame) -> DataFrame:
    """Parent vid -> the vocabulary's new term id (``id_map`` has one row
    for each vid, the vocabulary's primary key)."""
    return update_from_join(taxonomy, id_map, {"parent": "vid"}, {"parent": "new_id"},
                            source_unique=True)


def remap_term_ids(taxonomy: DataFrame, new_ids: DataFrame) -> DataFrame:
    """O11 (ids): term_id <- the vocabulary's new term id where
    term_taxonomy_id is that id."""
    chosen = new_ids.select("new_id").distinct()
    return update_from_join(taxonomy, chosen, {"term_taxonomy_id": "new_id"}, {"term_id": "new_id"}, source_unique=True)


def remap_term_groups(wp_terms: DataFrame, id_map: DataFrame) -> DataFrame:
    """O11 (terms side): term_group vid -> the vocabulary's new term id."""
    return update_from_join(wp_terms, id_map, {"term_group": "vid"}, {"term_group": "new_id"},
                            source_unique=True)
