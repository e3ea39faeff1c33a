"""Scripts of statements give the tables of the functions they stand for."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pressferry.operators import options, posts, terms, users
from pressferry.plans import runbook, script
from pressferry.queries import Run


def same(got, want):
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.fixture(scope="module")
def run(spark):
    return Run(spark, SF_SMALL)


def test_statements_of_the_pass(spark, run):
    r = run
    cases = [
        ("UPDATE wp_posts SET post_type = 'post' WHERE post_type IN ('page', 'story');"[:-1], {"wp_posts": r.m10}, "wp_posts", posts.post_type_map(r.m10)),
        ("UPDATE wp_posts SET post_type = 'page' WHERE post_type NOT IN ('post')", {"wp_posts": r.m10}, "wp_posts", posts.post_type_rest(r.m10)),
        ("UPDATE wp_term_taxonomy tt SET count = (SELECT count(tr.object_id) FROM wp_term_relationships tr WHERE tr.term_taxonomy_id = tt.term_taxonomy_id)",
         {"wp_term_taxonomy": r.m7, "wp_term_relationships": r.m13}, "wp_term_taxonomy", terms.term_counts(r.m7, r.m13)),
        ("DELETE FROM wp_users WHERE ID > 1", {"wp_users": r.t["wp_users"]}, "wp_users", users.purge_users(r.t["wp_users"])),
        ("UPDATE wp_posts SET post_author = 1 WHERE post_author NOT IN (SELECT ID FROM wp_users)", {"wp_posts": r.m18, "wp_users": r.m23}, "wp_posts", r.m26),
        ("UPDATE wp_options SET option_value = '/%postname%/' WHERE option_name = 'permalink_structure'", {"wp_options": r.m30}, "wp_options", options.permalink_option(r.m30)),
        ("INSERT INTO wp_term_relationships (object_id, term_taxonomy_id) SELECT DISTINCT nid, tid FROM term_node",
         {"term_node": r.t["term_node"], "wp_term_relationships": r.t["wp_term_relationships"]}, "wp_term_relationships", r.m13),
        ("INSERT INTO wp_terms (term_id, name, slug, term_group) SELECT /*+ REPLACE_INTO(term_id) */ tid, name, replace(lower(name), ' ', '_'), vid FROM term_data WHERE tid IN (SELECT tid FROM acc_tags)",
         {"wp_terms": r.t["wp_terms"], "term_data": r.t["term_data"], "acc_tags": r.acc_tags}, "wp_terms", r.m3),
        ("CREATE TABLE acc_tags AS SELECT tid, vid, name FROM term_data", {"term_data": r.t["term_data"]}, "acc_tags", r.acc_tags),
    ]
    for text, tables, name, want in cases:
        same(script.run_statement(spark, dict(tables), text)[name], want)


def frame(spark, rows, schema="id long, k string, v long"):
    return spark.createDataFrame(rows, schema)


def test_null_rules_and_verbs(spark):
    t = lambda: {"t": frame(spark, [(1, "a", 10), (2, None, 20), (3, "c", None)]), "s": frame(spark, [(1, "x", 1), (None, "y", 2)]), "e": frame(spark, [])}
    rows = lambda text, name="t", **kw: sorted((tuple(r) for r in script.run_statement(spark, t(), text, **kw)[name].collect()), key=repr)
    assert rows("UPDATE t SET v = v + 1, k = 'WHERE; x = 1' WHERE v > 10") == [(1, "a", 10), (2, "WHERE; x = 1", 21), (3, "c", None)]
    assert rows("UPDATE t AS q SET k = concat(q.k, ',') WHERE q.id <> 2") == [(1, "a,", 10), (2, None, 20), (3, "c,", None)]
    assert rows("UPDATE t SET v = 0 WHERE id NOT IN (SELECT id FROM s)") == [(1, "a", 10), (2, None, 20), (3, "c", None)]  # a NULL in the list
    assert rows("UPDATE t SET v = 0 WHERE id NOT IN (SELECT id FROM s WHERE id IS NOT NULL)") == [(1, "a", 10), (2, None, 0), (3, "c", 0)]
    assert rows("DELETE FROM t WHERE v > 10") == [(1, "a", 10), (3, "c", None)]
    assert rows("DELETE FROM t WHERE id NOT IN (SELECT id FROM e)") == [] and rows("DELETE FROM t") == []
    assert rows("TRUNCATE TABLE t") == []
    assert rows("INSERT INTO t (v, id) VALUES (5, 9)") == [(1, "a", 10), (2, None, 20), (3, "c", None), (9, None, 5)]
    assert rows("INSERT INTO t (id, k) SELECT id, k FROM s", defaults={"t": {"v": 7}})[-2:] == [(3, "c", None), (None, "y", 7)]
    assert rows("INSERT INTO t SELECT /*+ INSERT_IGNORE(id) */ * FROM s") == [(1, "a", 10), (2, None, 20), (3, "c", None), (None, "y", 2)]
    assert rows("INSERT INTO t SELECT /*+ REPLACE_INTO */ * FROM s", keys={"t": ["id"]}) == [(1, "x", 1), (2, None, 20), (3, "c", None), (None, "y", 2)]
    assert rows("INSERT INTO t SELECT /*+ INSERT_IGNORE(id, 'k,v') */ 4, 'a', 10") == [(1, "a", 10), (2, None, 20), (3, "c", None)]
    with pytest.raises(Exception, match="duplicate key"):
        rows("INSERT INTO t SELECT * FROM s", keys={"t": ["id"]})
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS|MUST_AGGREGATE"):
        rows("UPDATE t SET v = (SELECT v FROM s)")
    assert "t" not in script.run_statement(spark, t(), "DROP TABLE IF EXISTS t")
    script.run_statement(spark, t(), "DROP TABLE IF EXISTS nothing")


@pytest.mark.parametrize("text", [
    "SELECT * FROM t", "MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = 1", "INSERT OVERWRITE t SELECT * FROM s", "DROP TABLE nothing",
    "UPDATE t SET v = 1 WHERE id IN (SELECT id FROM s)", "UPDATE t SET v = 1 WHERE k = 'a' AND id NOT IN (SELECT id FROM s)", "UPDATE t SET missing = 1",
    "INSERT INTO t SELECT /*+ REPLACE_INTO */ * FROM s", "INSERT INTO t SELECT id FROM s", "UPDATE t SET id = 1, v = id", "CREATE TABLE s AS SELECT 1 AS x",
])
def test_refused_by_name(spark, text):
    tables = {"t": frame(spark, [(1, "a", 10)]), "s": frame(spark, [(1, "x", 1)])}
    with pytest.raises(script.UnsupportedStatement, match=text[:20].replace("*", r"\*")):
        script.run_statement(spark, tables, text)


def test_a_script_stops_at_the_first_failure(spark):
    tables = {"t": frame(spark, [(1, "a; b", 10)])}
    out = runbook.Runbook(script.statement_steps(["UPDATE t SET k = 'x;y'", "DELETE FROM missing", "DELETE FROM t"])).run(tables)
    assert [s for s in out.stages] == [("script.0", True), ("script.1", False)] and "missing" in out.error
    assert out.tables["t"].select(F.first("k")).first()[0] == "x;y"
