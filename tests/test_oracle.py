"""Every registered query equals its DuckDB oracle (rows, columns, values).

Runs at sf0.001 by default; PRESSFERRY_ORACLE_SF=/root/testdata/sf0.01 runs
the driver's scale.
"""

import pytest

from conftest import SF_ORACLE
from pressferry.checks.compare import duck_signature, duckdb_conn, spark_signature
from pressferry.checks.oracle import oracle_sql
from pressferry.queries import queries

ORACLE = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return duckdb_conn(SF_ORACLE)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = spark_signature(QUERIES[name](spark, SF_ORACLE))
    want = duck_signature(con, ORACLE[name])
    assert got == want


def test_generic_decode_path(spark):
    rows = QUERIES["d2b_decode_system_info"](spark, SF_ORACLE).collect()
    by_name = {r["name"]: r for r in rows}
    assert by_name["system"]["version"] == "6.37"
    assert by_name["system"]["module_name"] == "System"
    assert all(r["version"] == "6.x-1.0" for n, r in by_name.items() if n != "system")


@pytest.mark.parametrize("name,expected", [
    ("d4_posts_list", 200), ("d8_dup_term_names", 47), ("d9_dup_term_members", 127),
    ("d10_terms_too_long", 4), ("d11_dup_aliases", 10), ("r4_uniquify_aliases", 40),
    ("m10_posts", 200), ("m13_term_relationships", 5623), ("m17_comments", 1025),
    ("m22_authors_with_posts", 67), ("m33_commenters", 9), ("m35_commenters_to_add", 3),
    ("o16_redirects", 200),
])
def test_expected_counts_sf0001(spark, name, expected):
    """Row counts listed for sf0.001 in the fixture notes."""
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == expected


def test_m10_without_alias_repair_has_duplicates(spark):
    from pressferry.operators import posts
    from pressferry.sources.fixtures import load_tables

    t = load_tables(spark, "/root/testdata/sf0.001")
    rows = posts.post_rows(t["node"], t["node_revisions"], t["url_alias"])
    assert rows.count() == 167
    assert rows.select("id").distinct().count() == 158


def test_x3_report_stops_at_gate(spark):
    from pressferry.plans import runbook
    from pressferry.sources.fixtures import load_tables

    out = runbook.migrate(dict(load_tables(spark, SF_ORACLE)), secret="s")
    report = out.report(spark).orderBy("seq").collect()
    assert [(r["stage"], r["ok"]) for r in report] == [("prepare.run_fix", True), ("gate", False)]
