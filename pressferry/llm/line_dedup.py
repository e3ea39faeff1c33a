"""Operator 2: line de-duplication over overlapping three-line windows.

Every run of three consecutive lines is a window, keyed by the hashes of its
lines.  Windows that occur more than once anywhere are found by one grouped
aggregate; all occurrences but the first (by id, then text, then position) are
later ones, and the lines they cover, merged, go.  The first occurrence of any
line stays: the window that would remove it has an earlier occurrence, which
holds the same line earlier.

Defined results: null text is empty; texts of fewer than three lines have no
window and stay; windows of three blank lines are ignored; overlapping later
windows merge; a run of equal lines shrinks to what its first window doesn't
repeat; rows with equal id and text are one document (both get the same
result); a null id sorts first; an empty table gives no rows; other columns
pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each window: _id, _tie, _pos (0-based), its line hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_tie"),
        F.transform(_lines(text), lambda l: F.struct(F.xxhash64(l).alias("h"), (F.trim(l) == "").alias("blank"))).alias("_h"),
    ).filter(F.size("_h") >= WINDOW)
    at = lambda i, k, f: F.element_at(F.col("_h"), (i + F.lit(k + 1)).cast("int"))[f]
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.struct(
        i.alias("_pos"), *[at(i, k, "h").alias(f"_w{k}") for k in range(WINDOW)],
        (at(i, 0, "blank") & at(i, 1, "blank") & at(i, 2, "blank")).alias("_blank")))
    return hashes.select("_id", "_tie", F.inline(windows)).filter("NOT _blank").drop("_blank")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _tie, _covered: the merged positions that later windows cover."""
    windows = line_windows(docs, id_col, text_col)
    keys = [f"_w{k}" for k in range(WINDOW)]
    place = F.struct("_id", "_tie", "_pos")
    repeated = (windows.groupBy(*keys).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
                .filter("_n > 1").drop("_n"))
    later = windows.join(repeated, keys).filter(~place.eqNullSafe(F.col("_first")))
    return (later.select("_id", "_tie", F.explode(F.sequence(F.col("_pos"), F.col("_pos") + (WINDOW - 1))).alias("_line"))
            .groupBy("_id", "_tie").agg(F.collect_set("_line").alias("_covered")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the repeated lines cut out of their text, plus _n_lines
    and _n_removed (input columns of these two names are replaced)."""
    covered = covered_lines(docs, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own_text = F.col("_row")[text_col]
    joined = rows.join(covered, F.col("_row")[id_col].eqNullSafe(F.col("_id"))
                       & (F.xxhash64(F.coalesce(own_text, F.lit(""))) == F.col("_tie")), "left")
    lines = _lines(own_text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_covered"))
    text = F.when(F.col("_covered").isNull(), own_text).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    added = {"_n_lines": F.when(own_text.isNull(), 1).otherwise(F.size(lines)), "_n_removed": F.when(F.col("_covered").isNull(), 0).otherwise(F.size("_covered"))}
    return joined.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns if c not in added],
                         *[v.alias(k) for k, v in added.items()])


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_md5 of every document."""
    text = F.coalesce("text", F.lit(""))
    return line_dedup(docs.select("doc_id", "text")).select(
        "doc_id", F.col("_n_lines").cast("bigint").alias("n_lines"), F.col("_n_removed").cast("bigint").alias("n_removed"),
        F.char_length(text).cast("bigint").alias("kept_chars"), F.md5(text.cast("binary")).alias("kept_md5"))


SUMMARY_SQL = """
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(l) - 1)) AS pos, l FROM lines WHERE len(l) >= 3
), keyed AS (
  SELECT doc_id, pos, l[pos] AS a, l[pos + 1] AS b, l[pos + 2] AS c FROM windows
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS r
  FROM keyed WHERE NOT (trim(a) = '' AND trim(b) = '' AND trim(c) = '')
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS line FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE r > 1
), single AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS txt FROM lines
), kept AS (
  SELECT s.doc_id, string_agg(s.txt, chr(10) ORDER BY s.line) AS txt, count(*) AS n
  FROM single s LEFT JOIN covered c ON s.doc_id = c.doc_id AND s.line = c.line
  WHERE c.line IS NULL GROUP BY s.doc_id
)
SELECT l.doc_id, CAST(len(l.l) AS BIGINT) AS n_lines, CAST(len(l.l) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       CAST(length(coalesce(k.txt, '')) AS BIGINT) AS kept_chars, md5(coalesce(k.txt, '')) AS kept_md5
FROM lines l LEFT JOIN kept k ON l.doc_id = k.doc_id
"""
