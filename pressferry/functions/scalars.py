"""Column expressions for the scalar functions the migration statements use.

All are built-in Spark expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    # Zone-free epoch: a string literal cast to TIMESTAMP_NTZ never shifts.
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(name: str | Column) -> Column:
    """REPLACE(LOWER(name), ' ', '_')."""
    return F.replace(F.lower(col(name)), F.lit(" "), F.lit("_"))


def last_segment(path: str | Column) -> Column:
    """SUBSTRING_INDEX(path, '/', -1): whole string without '/', '' after a trailing '/'."""
    return F.substring_index(col(path), "/", -1)


def epoch_to_ts(seconds: str | Column) -> Column:
    """FROM_UNIXTIME(n) / DATE_ADD(FROM_UNIXTIME(0), INTERVAL n SECOND) as a
    zone-free timestamp (also right for negative epochs)."""
    return F.timestamp_add("SECOND", col(seconds), _epoch())


def ts_to_epoch(ts: str | Column) -> Column:
    return F.timestamp_diff("SECOND", _epoch(), col(ts))


def as_text(c: str | Column) -> Column:
    """Implicit int -> string of IF()/CONCAT() made explicit."""
    return col(c).cast("string")


def alias_or_id(dst: str | Column, nid: str | Column) -> Column:
    """IF(dst IS NULL, nid, SUBSTRING_INDEX(dst, '/', -1))."""
    return F.when(col(dst).isNull(), as_text(nid)).otherwise(last_segment(dst))


def publish_status(status: str | Column) -> Column:
    """IF(status = 1, 'publish', 'private'); a NULL condition takes the else branch."""
    return F.when(col(status) == 1, F.lit("publish")).otherwise(F.lit("private"))


def approved_flag(status: str | Column) -> Column:
    """((status + 1) % 2) stored into a varchar column."""
    return ((col(status) + 1) % 2).cast("string")


# The four typographic quote characters removed from slugs.
CURLY_QUOTES = "‘’“”"


def strip_curly_quotes(c: str | Column) -> Column:
    return F.translate(col(c), CURLY_QUOTES, "")
