"""Repairs of source data the target schema would reject."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressferry.operators import audit
from pressferry.operators.dml import pick_one, settled, update_from_join

TERM_NAME_LIMIT = audit.TERM_NAME_LIMIT


def uniquify_terms(term_data: DataFrame, *, safe: bool = False,
                   limit: int = TERM_NAME_LIMIT, collation: str | None = None) -> DataFrame:
    """New (tid, name) for every member of a duplicate-name group, the
    first member included: name + '_' + tid.  With ``safe`` the new names of
    :func:`unique_names`, which fit the limit and equal no other name (the default
    reproduces the original, which can collide again)."""
    if safe:
        fixed = unique_names(term_data, limit=limit, collation=collation).select("tid", "name")
        old = term_data.select(F.col("tid").alias("_tid"), F.col("name").alias("_old"))
        return fixed.join(old, F.col("tid") == F.col("_tid")).where(~F.col("name").eqNullSafe(F.col("_old"))).select("tid", "name")
    members = audit.dup_term_members(term_data, collation=collation)
    return members.select("tid", F.concat("name", F.lit("_"), F.col("tid").cast("string")).alias("name"))


def apply_keyed_update(term_data: DataFrame, updates: DataFrame) -> DataFrame:
    """R2: write changed names back by tid, as one join (not one UPDATE per row)."""
    return update_from_join(term_data, updates, {"tid": "tid"}, {"name": "name"})


def truncate_terms(term_data: DataFrame, limit: int = TERM_NAME_LIMIT) -> DataFrame:
    """Name <- first ``limit`` characters."""
    return term_data.withColumn("name", F.substring("name", 1, limit))


def uniquify_aliases(url_alias: DataFrame, *, strict: bool = False, collation: str | None = None) -> DataFrame:
    """Exactly one alias per source path (the smallest pid).  ``strict``
    groups by (src, pid) and so keeps every row when pid is unique.
    ``collation`` takes paths as equal that the target database holds equal."""
    if collation:
        keyed = url_alias.withColumn("_ci", audit.collated("src", collation))
        return pick_one(keyed, ["_ci"], ["pid"], largest=False).drop("_ci")
    if strict:
        return pick_one(url_alias, ["src", "pid"], ["dst"], largest=False)
    return pick_one(url_alias, ["src"], ["pid"], largest=False)


def fix_term_names(term_data: DataFrame, *, safe: bool = False,
                   limit: int = TERM_NAME_LIMIT, null_name_stem: str | None = None,
                   collation: str | None = None, rounds: list[int] | None = None) -> DataFrame:
    """R1 + R2 + R3 fused: one left join of the terms to the duplicated names
    (one row per name, counted map-side) and a projection that suffixes and
    truncates.  Equal to renaming by tid and writing back, without the second
    shuffle of the terms by tid.

    ``null_name_stem`` names the terms without a name: stem + '_' + tid.
    ``safe`` ends without collisions (:func:`unique_names`); ``collation`` and
    ``rounds`` are for it."""
    if null_name_stem is not None:
        filled = F.coalesce(F.col("name"), F.concat(F.lit(null_name_stem + "_"), F.col("tid").cast("string")))
        term_data = term_data.withColumn("name", filled)
    if safe:
        return unique_names(term_data, limit=limit, collation=collation, rounds=rounds)
    dup = (term_data.where(F.col("name").isNotNull()).groupBy(F.col("name").alias("_dn"))
           .agg(F.count("name").alias("_c")).where(F.col("_c") > 1).select("_dn"))
    flagged = term_data.join(dup, F.col("name") == F.col("_dn"), "left")
    suffix = F.concat(F.lit("_"), F.col("tid").cast("string"))
    renamed = F.when(F.col("_dn").isNotNull(), F.concat("name", suffix)).otherwise(F.col("name"))
    cols = [F.substring(renamed, 1, limit).alias("name") if c == "name" else F.col(c) for c in term_data.columns]
    return flagged.select(*cols)


def unique_names(term_data: DataFrame, *, limit: int = TERM_NAME_LIMIT, collation: str | None = None,
                 rounds: list[int] | None = None) -> DataFrame:
    """A repair after which no two terms share a name and none is over the limit:
    a fixpoint that reserves the names it gives.

    Renamed are the members of duplicate groups and the names over the limit;
    all others keep theirs.  In each round a term asks for its stem, cut so that
    the suffix fits, + '_' + tid (from the second round on also '_' + round).
    It gets the name if none of the old names (also of those that are renamed)
    and none given in an earlier round equals it; within a round two terms can't
    ask for the same, because their tids differ.  Terms whose name is taken ask
    again.  Each further round needs an old or given name of exactly that form
    for every term left, so there are at most as many rounds as such names;
    ``rounds`` gets the terms that asked in each.  Terms without a name stay.

    One join of all terms as in the plain form, then only joins of the terms
    that ask with the taken names."""
    key = lambda c: audit.collated(c, collation) if collation else F.col(c)
    named = term_data.where(F.col("name").isNotNull())
    dup = named.groupBy(key("name").alias("_dn")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_dn")
    flagged = term_data.join(dup, key("name") == F.col("_dn"), "left")
    again = F.col("_dn").isNotNull() | (F.char_length("name") > limit)
    asking = settled(flagged.where(again).select("tid", "name"))
    taken = named.select("name")
    given = None
    count = 0
    while not asking.isEmpty():
        count += 1
        if rounds is not None:
            rounds.append(asking.count())
        suffix = F.concat(F.lit("_"), F.col("tid").cast("string"), F.lit("" if count == 1 else f"_{count}"))
        asked = asking.withColumn("_new", F.concat(F.substring("name", F.lit(1), F.lit(limit) - F.char_length(suffix)), suffix))
        held = taken.select(key("name").alias("_held")).distinct()
        free = settled(asked.join(held, key("_new") == F.col("_held"), "left_anti"))
        asking = settled(asking.join(free.select("tid"), "tid", "left_anti"))
        taken = taken.unionByName(free.select(F.col("_new").alias("name")))
        given = free if given is None else given.unionByName(free)
    if given is None:
        return term_data
    names = given.select(F.col("tid").alias("_g_tid"), F.col("_new").alias("_g_name"))
    cols = [F.coalesce("_g_name", "name").alias("name") if c == "name" else F.col(c) for c in term_data.columns]
    return term_data.join(names, F.col("tid") == F.col("_g_tid"), "left").select(*cols)


def run_fix(tables: Mapping[str, DataFrame], *, safe: bool = False,
            null_name_stem: str | None = None, collation: str | None = None) -> dict[str, DataFrame]:
    """R1 -> R2 -> R3 -> R4 as one composed transformation.  Returns the
    repaired tables and the archived original aliases (S8).  ``collation``: that
    of the target database, for the safe names and the aliases."""
    fixed_terms = fix_term_names(tables["term_data"], safe=safe, null_name_stem=null_name_stem, collation=collation)
    return {
        "term_data": fixed_terms,
        "url_alias": uniquify_aliases(tables["url_alias"], collation=collation),
        "url_alias_with_dups": tables["url_alias"],
    }


def residual_collisions(fixed_term_data: DataFrame, *, collation: str | None = None) -> DataFrame:
    """Names that collide again after the repair (caught by the gate)."""
    return audit.dup_term_names(fixed_term_data, collation=collation)
