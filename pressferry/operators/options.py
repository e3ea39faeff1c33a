"""Settings housekeeping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressferry.functions.serialized import decode_scalar, replace_serialized
from pressferry.operators.dml import update_scalar_lookup, update_where

# Fixed value: the permalink structure of the target.
PERMALINK = "/%postname%/"


def set_option(options: DataFrame, option_name: str, value: str) -> DataFrame:
    """option_value <- constant for one option."""
    return update_where(options, F.col("option_name") == option_name, {"option_value": F.lit(value)})


def default_category_option(options: DataFrame, term_id: str = "159") -> DataFrame:
    return set_option(options, "default_category", term_id)


def permalink_option(options: DataFrame, structure: str = PERMALINK) -> DataFrame:
    return set_option(options, "permalink_structure", structure)


def option_from_variable(options: DataFrame, variable: DataFrame, option_name: str,
                         variable_name: str, decode: bool = True) -> DataFrame:
    """option_value <- (SELECT value FROM variable WHERE name = ...).

    A scalar subquery: NULL when the variable is missing, an error when it is
    duplicated.  ``decode`` stores the plain value; ``False`` reproduces the
    sample, which copies the serialized text."""
    value = decode_scalar("value") if decode else F.col("value")
    lookup = variable.where(F.col("name") == variable_name).select(value.alias("v"))
    return update_scalar_lookup(options, F.col("option_name") == option_name, "option_value", lookup)


def site_name_option(options, variable, option_name: str = "blogname", decode: bool = True):
    return option_from_variable(options, variable, option_name, "site_name", decode)


def site_slogan_option(options, variable, option_name: str = "blogdescription", decode: bool = True):
    return option_from_variable(options, variable, option_name, "site_slogan", decode)


def site_mail_option(options, variable, option_name: str = "admin_email", decode: bool = True):
    return option_from_variable(options, variable, option_name, "site_mail", decode)


def rekey_prefix(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Literal prefix replace in a key column (usermeta.meta_key, options.option_name)."""
    return update_where(df, None, {column: F.replace(F.col(column), F.lit(old), F.lit(new))})


def replace_in_values(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """O17 / M27 on a column of settings: literal replace in plain and in
    serialized values, whose lengths are mended (a plain replace would leave
    values that can't be read back)."""
    return update_where(df, None, {column: replace_serialized(column, old, new)})


# The exact key renames of the sample's second option.
META_KEY_RENAMES = {
    "wp_capabilities": "newprefix_usermeta",
    "wp_user_level": "newprefix_user_level",
    "wp_autosave_draft_ids": "newprefix_autosave_draft_ids",
}
OPTION_NAME_RENAMES = {"wp_user_roles": "newprefix_user_roles"}


def rename_keys(df: DataFrame, column: str, renames: Mapping[str, str]) -> DataFrame:
    """Exact renames through a literal map (bounded by the parameter, no join)."""
    lookup = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.element_at(lookup, F.col(column)), F.col(column)))
