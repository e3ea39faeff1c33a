"""Scale guards on the physical plans of every registered query."""

import contextlib
import io
import re

import pytest

from conftest import SF_SMALL
from pressferry.queries import queries

QUERIES = queries()
# Built eagerly with side effects (a run report), not a single plan.
SKIP = {"x3_migrate"}


def plan_text(df) -> str:
    """Physical plan with operator arguments inline (keys, window specs, read schemas)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("simple")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_cartesian_no_nested_loop_no_row_windows(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    # The only window allowed runs over one row per partition (dense ids).
    for line in re.findall(r"Window \[.*", text):
        assert "_part" in line, line


def test_flagship_reads_only_needed_columns(spark):
    text = plan_text(QUERIES["m10_posts"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert schemas
    # The documents scan for keys/attributes reads no text; one scan reads the
    # text (bodies) once per branch that needs it.
    assert any(s == "struct<doc_id:bigint,lang:string>" for s in schemas), schemas
    assert all("html" not in s for s in schemas)


def test_flagship_does_not_deduplicate_bodies(spark):
    """No aggregate groups by post_content: de-duplication happens on the alias table."""
    text = plan_text(QUERIES["m10_posts"](spark, SF_SMALL))
    aggregates = re.findall(r"(?:Hash|Sort|ObjectHash)Aggregate\(keys=\[[^\]]*\]", text)
    assert aggregates
    for keys in aggregates:
        assert "post_content" not in keys and "body" not in keys, keys


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_bodies_are_never_keys(spark, name):
    """No aggregate, sort or join of any query is keyed by a post body."""
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    keyed = re.findall(r"Aggregate\(keys=\[[^\]]*\]|hashpartitioning\([^)]*\)|SortMergeJoin \[[^\]]*\], \[[^\]]*\]|Sort \[[^\]]*\]", text)
    for keys in keyed:
        assert "post_content" not in keys and "body" not in keys, keys


@pytest.mark.parametrize("name", ["m6_category_terms", "m7_category_taxonomy", "m8_uncategorized_term", "o8_subcategories"])
def test_taxonomy_reads_terms_a_few_times(spark, name):
    """The single passes keep the scans of the term source few (the existing
    taxonomy rows and the categories are derived from it as well)."""
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert len(re.findall(r"part\.parquet", text)) <= 13, name


@pytest.mark.parametrize("name, most", [("m14_term_counts", 12), ("m27_rewrite_paths", 24), ("m36_merge_users", 6), ("o11_remap_parents", 17), ("m13_term_relationships", 3)])
def test_passes_scan_few_files(spark, name, most):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert len(re.findall(r"FileScan parquet", text)) <= most, (name, len(re.findall(r"FileScan parquet", text)))
