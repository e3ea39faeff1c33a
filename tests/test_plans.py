"""Sinks (staged writes, archive swap) and the fail-fast runbook."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pressferry.plans import runbook, sinks
from pressferry.sources.fixtures import load_tables


def test_warehouse_write_append_truncate_drop(spark, tmpdir_path):
    wh = sinks.Warehouse(spark, tmpdir_path)
    a = spark.range(5).withColumnRenamed("id", "x")
    wh.write("t", a)
    assert wh.read("t").count() == 5
    assert wh.append("t", a) is True
    assert wh.read("t").count() == 10
    wh.write("t", wh.read("t").where("x < 2"))  # overwrite from itself is staged
    assert wh.read("t").count() == 4
    wh.truncate("t")
    assert wh.read("t").count() == 0 and wh.read("t").columns == ["x"]
    wh.drop("t")
    assert not wh.exists("t")
    assert wh.names() == []


def test_archive_swap_keeps_original(spark, tmpdir_path):
    wh = sinks.Warehouse(spark, tmpdir_path)
    t = load_tables(spark, SF_SMALL)
    wh.write("url_alias", t["url_alias"])
    from pressferry.operators.repair import uniquify_aliases

    wh.archive_swap("url_alias", uniquify_aliases(wh.read("url_alias")))
    assert wh.read("url_alias").count() == 40
    assert wh.read("url_alias_with_dups").count() == 50
    wh.log_fixed_terms(spark.createDataFrame([(1, "a_1"), (2, "a_1")], "tid bigint, name string"))
    assert wh.read("acc_fixed_term_names").count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        wh.log_fixed_terms(spark.createDataFrame([(1, "a_1"), (1, "b_1")], "tid bigint, name string"))
    wh.reset_targets(truncate=["url_alias"], drop=["url_alias_with_dups", "url_alias_with_dups"])
    assert wh.read("url_alias").count() == 0 and not wh.exists("url_alias_with_dups")


def test_runbook_stops_at_first_failure(spark):
    calls = []

    def ok(t):
        calls.append("ok")
        return t

    steps = [runbook.Step("a", ok), runbook.Step("b", lambda t: False), runbook.Step("c", ok)]
    out = runbook.Runbook(steps).run({"x": spark.range(1)})
    assert out.ok is False
    assert out.stages == [("a", True), ("b", False)]
    assert calls == ["ok"]


def test_sql_step_with_semicolon_in_literal(spark):
    step = runbook.sql_step("cap", "meta", "SELECT 'a:1:{s:6:\"author\";s:1:\"1\";}' AS v FROM x")
    out = runbook.Runbook([step]).run({"x": spark.range(2)})
    assert out.ok and out.tables["meta"].count() == 2


def test_migrate_stops_at_gate_without_safe_repair(spark):
    t = load_tables(spark, SF_SMALL)
    out = runbook.migrate(dict(t), secret="s3cret")
    # sf0.001 leaves the NULL-name group duplicated: the gate refuses.
    assert out.stages[-1] == ("gate", False)


def test_migrate_full_pass_after_clean_terms(spark, tmpdir_path):
    t = dict(load_tables(spark, SF_SMALL))
    t["term_data"] = t["term_data"].where(F.col("name").isNotNull())
    wh = sinks.Warehouse(spark, tmpdir_path)
    out = runbook.migrate(t, secret="s3cret", warehouse=wh)
    assert out.ok, out.stages
    posts = wh.read("wp_posts")
    assert posts.count() == 158
    assert posts.where("post_type <> 'post'").count() == 0
    assert posts.where(F.col("post_content").contains('"/files/')).count() == 0
    assert wh.read("wp_users").count() > 0
    assert wh.read("acc_wp_users").count() >= wh.read("wp_users").count()


def test_fused_posts_pass_equals_statement_chain(spark):
    from pressferry.operators import posts
    from pressferry.queries import Run

    r = Run(spark, SF_SMALL)
    chain = posts.rewrite_paths(r.m26)
    fused = posts.posts_pass(r.t["node"], r.t["node_revisions"], r.aliases, r.t["wp_posts"],
                             r.m17, r.m23)
    assert fused.columns == chain.columns
    assert fused.count() == chain.count() == 200
    assert fused.exceptAll(chain).count() == 0 and chain.exceptAll(fused).count() == 0
    t = r.t
    chain = posts.rewrite_paths(posts.reassign_orphans(posts.comment_counts(posts.post_type_rest(posts.post_type_map(
        posts.posts(t["node"], t["node_revisions"], r.aliases, r.empty("wp_posts")))), r.m17), r.m23))
    # With existing posts (some replaced, one kept) the two agree as well.
    kept_row = (chain.where("id = 2").withColumn("id", F.lit(-5).cast("bigint"))
                .withColumn("post_type", F.lit("story")).withColumn("post_author", F.lit(999999).cast("bigint")))
    existing = chain.where("id % 2 = 0").withColumn("post_title", F.lit("old")).unionByName(kept_row)
    expected = posts.rewrite_paths(posts.reassign_orphans(posts.comment_counts(posts.post_type_rest(
        posts.post_type_map(posts.posts(t["node"], t["node_revisions"], r.aliases, existing))), r.m17), r.m23))
    fused2 = posts.posts_pass(t["node"], t["node_revisions"], r.aliases, existing, r.m17, r.m23)
    assert fused2.count() == expected.count() == 159
    assert fused2.exceptAll(expected).count() == 0 and expected.exceptAll(fused2).count() == 0
    got = fused2.where("id = -5").first()
    assert got["post_type"] == "post" and got["post_author"] == 1 and got["comment_count"] == 0


def test_cleanup_working_drops_each_name_once(spark, tmpdir_path):
    wh = sinks.Warehouse(spark, tmpdir_path)
    for name in ("acc_tags", "acc_categories", "wp_posts"):
        wh.write(name, spark.range(1))
    wh.cleanup_working(["acc_tags", "acc_categories", "acc_tags", "acc_missing"])
    assert wh.names() == ["wp_posts"]


def test_remap_term_groups_and_parents(spark):
    from pressferry.operators import terms
    from pressferry.queries import CATEGORY_VIDS, VOCAB_VIDS, Run

    r = Run(spark, SF_SMALL)
    id_map = terms.vocab_id_map(r.o9, r.m6)
    mapping = {row["vid"]: row["new_id"] for row in id_map.collect()}
    assert sorted(mapping) == sorted(VOCAB_VIDS)
    remapped = terms.remap_term_groups(r.o9, id_map)
    groups = {row["term_group"] for row in remapped.collect()}
    assert not groups & set(VOCAB_VIDS) - set(mapping.values())
    parents = terms.remap_parents(r.o8, id_map)
    sub = parents.where(F.col("parent") != 0).select("parent").distinct().collect()
    assert {row["parent"] for row in sub} <= {mapping[v] for v in CATEGORY_VIDS}


def test_sql_script_runs_in_order_and_fails_fast(spark):
    t = load_tables(spark, SF_SMALL)
    steps = runbook.sql_script([
        ("acc_tags", "SELECT tid, vid, name FROM term_data"),
        ("acc_tag_count", "SELECT vid, count(*) AS n FROM acc_tags GROUP BY vid"),
    ])
    out = runbook.Runbook(steps).run({"term_data": t["term_data"]})
    assert out.ok and out.tables["acc_tag_count"].agg(F.sum("n")).first()[0] == 200
    bad = runbook.sql_script([("x", "SELECT * FROM missing_table"), ("y", "SELECT 1 AS one")])
    out = runbook.Runbook(bad).run({"term_data": t["term_data"]})
    assert not out.ok and [s for s, _ in out.stages] == ["script.0.x"]


def test_migrate_reports_a_statement_that_fails_on_its_data(spark):
    t = dict(load_tables(spark, SF_SMALL))
    again = spark.createDataFrame([("site_name", 's:3:"two";')], "name string, value string")
    t["variable"] = t["variable"].unionByName(again)  # a scalar look-up with two rows
    out = runbook.migrate(t, secret="s3cret", safe_repair=True, null_name_stem="term")
    assert not out.ok and out.stages[-1] == ("output.wp_options", False)
    assert "SCALAR_SUBQUERY_TOO_MANY_ROWS" in out.error
    report = out.report(spark).where("NOT ok").collect()
    assert len(report) == 1 and "SCALAR_SUBQUERY" in report[0]["error"]


def test_migrate_runs_custom_steps_and_resets_all_targets(spark):
    t = dict(load_tables(spark, SF_SMALL))
    t["wp_links"] = spark.createDataFrame([(1,)], "link_id bigint")
    t["acc_news"] = spark.range(3)
    seen = []

    def custom(name):
        def run(tables):
            seen.append((name, "wp_posts" in tables and "acc_tags" in tables, "acc_news" in tables))
            return tables
        return [runbook.Step(name, run)]

    out = runbook.migrate(t, secret="s3cret", safe_repair=True, null_name_stem="term", custom_prepare=custom("p"),
                          custom_migrate=custom("m"), custom_deploy=custom("d"), outputs=["wp_terms"])
    assert out.ok, out.error
    assert seen == [("p", False, True), ("m", True, False), ("d", True, False)]
    assert out.tables["wp_links"].count() == 0


def test_safe_repair_passes_the_gate_and_keeps_every_term(spark):
    from pressferry.operators import audit, repair

    t = load_tables(spark, SF_SMALL)
    fixed = repair.run_fix(t, safe=True, null_name_stem="term")["term_data"]
    assert fixed.count() == t["term_data"].count() and fixed.where("name IS NULL").count() == 0
    assert audit.dup_term_names(fixed).count() == 0 and audit.terms_too_long(fixed).count() == 0


def test_single_passes_equal_the_statement_chain(spark):
    from pressferry.operators import terms
    from pressferry.queries import Run

    r = Run(spark, SF_SMALL)
    data, cats = r.t["term_data"], r.acc_categories
    taken = spark.createDataFrame([(1, 1, "post_tag", "old", 0, 0), (9, 9, "post_tag", "old", 0, 0), (5000, 9, "post_tag", "old", 0, 0),
                                   (5001, 18, "category", "old", 0, 0), (5002, 2, "category", "kept", 0, 0), (5003, 7000, "post_tag", "kept", 0, 0)],
                                  r.empty("wp_term_taxonomy").schema)
    for exclude in (None, [2, 4]):
        tags = terms.tags_work(data, exclude)
        chain = terms.category_terms(data, cats, terms.tags_terms(data, tags, r.t["wp_terms"]))
        assert terms.terms_pass(data, cats, r.t["wp_terms"], exclude).exceptAll(chain).count() == 0
        assert chain.exceptAll(terms.terms_pass(data, cats, r.t["wp_terms"], exclude)).count() == 0
        chain = terms.category_taxonomy(data, cats, terms.tags_taxonomy(data, tags, taken))
        fused = terms.taxonomy_pass(data, cats, taken, exclude)
        assert fused.exceptAll(chain).count() == 0 and chain.exceptAll(fused).count() == 0
        assert chain.where("description = 'kept'").count() == 2


def test_users_pass_equals_the_statement_chain(spark):
    from pressferry.operators import users
    from pressferry.queries import Run

    r = Run(spark, SF_SMALL)
    t = r.t
    chain = users.merge_users(r.m32, r.m35)
    fused = users.users_pass(t["users"], t["node"], t["comments"], t["wp_users"])
    assert fused.columns == chain.columns and fused.count() == chain.count()
    assert fused.exceptAll(chain).count() == 0 and chain.exceptAll(fused).count() == 0
    with_null = t["wp_users"].unionByName(t["wp_users"].limit(1).withColumn("ID", F.lit(None).cast("bigint")))
    known = users.authors(t["users"], r.m22, with_null)
    like = sinks.create_like(known)
    chain = users.merge_users(known, users.commenters_to_add(users.authors(t["users"], r.m33, like), known, like))
    fused = users.users_pass(t["users"], t["node"], t["comments"], with_null)
    assert fused.exceptAll(chain).count() == 0 and chain.exceptAll(fused).count() == 0


def test_new_vocabulary_ids_are_those_inserted(spark):
    from pressferry.operators import terms
    from pressferry.queries import VOCAB_VIDS, Run

    r = Run(spark, SF_SMALL)
    direct = terms.new_vocab_ids(r.t["vocabulary"], VOCAB_VIDS, r.m6)
    looked_up = terms.vocab_id_map(r.o9, r.m6)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, looked_up.collect()))
