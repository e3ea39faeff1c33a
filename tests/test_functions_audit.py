"""Scalars, serialized decoding, audit checks, gate and repair properties."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from pressferry.functions import scalars, serialized
from pressferry.operators import audit, repair
from pressferry.schemas import canonicalize, required_tables
from pressferry.sources.fixtures import VARIABLE_ROWS, load_tables


def test_last_segment_and_alias_or_id(spark):
    d = spark.createDataFrame([("a/b/c", 1), ("abc", 2), ("a/b/", 3), (None, 4)], "dst string, nid bigint")
    got = d.select(scalars.alias_or_id("dst", "nid").alias("x")).collect()
    assert [r["x"] for r in got] == ["c", "abc", "", "4"]


def test_epoch_to_ts_zone_free_and_negative(spark):
    d = spark.createDataFrame([(0,), (-86400,), (90061,)], "s bigint")
    got = [r["t"] for r in d.select(scalars.epoch_to_ts("s").alias("t")).collect()]
    assert got == [dt.datetime(1970, 1, 1), dt.datetime(1969, 12, 31), dt.datetime(1970, 1, 2, 1, 1, 1)]


def test_slug_and_quotes(spark):
    d = spark.createDataFrame([("Big Red Box",), ("‘it’s “x”",)], "n string")
    got = d.select(scalars.slug("n").alias("s"), scalars.strip_curly_quotes("n").alias("q")).collect()
    assert got[0]["s"] == "big_red_box"
    assert got[1]["q"] == "its x"


def test_serialized_literal_rows_are_valid(spark):
    d = spark.createDataFrame(VARIABLE_ROWS, "name string, value string")
    got = {r["name"]: r for r in audit.decode_variable(d).collect()}
    assert got["site_name"]["decoded"] == "Example Site"
    assert got["cron_last"]["decoded"] == "1700000000"
    assert got["site_frontpage"]["decoded"] is None
    assert all(r["valid"] for n, r in got.items() if n != "theme_settings")
    bad = spark.createDataFrame([("x", 's:5:"abc";'), ("y", "s:")], "name string, value string")
    assert [r["valid"] for r in audit.decode_variable(bad).collect()] == [False, False]


def test_unserialize_helper():
    assert serialized.unserialize('a:2:{s:1:"a";i:1;s:1:"b";a:1:{i:0;s:3:"hé";}}') == {"a": "1", "b": {"0": "hé"}}
    assert serialized.unserialize('s:3:"hé";') == "hé"


def test_required_tables_and_missing_table(spark):
    t = dict(load_tables(spark, SF_SMALL))
    assert required_tables("7.2")[0] == "comment"
    full = audit.all_tables_present(audit.required_tables(spark, t)).first()["all_present"]
    assert full is True
    del t["users_roles"]
    got = audit.required_tables(spark, t)
    assert audit.all_tables_present(got).first()["all_present"] is False
    assert got.where("table_name = 'users_roles'").first()["present"] is False


def test_v7_alias_columns_are_renamed(spark):
    d = spark.createDataFrame([(1, "node/1", "a/b")], "pid bigint, source string, alias string")
    assert canonicalize("url_alias", d).columns == ["pid", "src", "dst"]


def test_gate_blocks_then_repair_reduces_problems(spark):
    t = load_tables(spark, SF_SMALL)
    before = {r["check"]: r for r in audit.gate(audit.audit_summary(t)).collect()}
    assert before["proceed"]["ok"] is False
    fixed = dict(t)
    fixed.update(repair.run_fix(t))
    after = {r["check"]: r for r in audit.gate(audit.audit_summary(fixed)).collect()}
    assert after["terms_exceeded_char_count"]["count"] == 0
    assert after["duplicate_aliases_count"]["count"] == 0
    # What remains is exactly what R6 reports (the NULL-name group here).
    residual = repair.residual_collisions(fixed["term_data"]).count()
    assert after["duplicate_terms_count"]["count"] == residual


def test_safe_uniquify_keeps_names_within_limit(spark):
    t = load_tables(spark, SF_SMALL)
    terms = t["term_data"]
    safe = repair.truncate_terms(repair.apply_keyed_update(terms, repair.uniquify_terms(terms, safe=True)))
    assert safe.where(F.char_length("name") > 200).count() == 0
    long_members = repair.uniquify_terms(terms, safe=True).where(F.col("name").endswith("_201"))
    assert long_members.where(F.char_length("name") > 200).count() == 0


def test_read_table_v7_parquet_root(spark, tmpdir_path):
    from pressferry.sources.catalog import read_table

    spark.createDataFrame([(1, "node/1", "a/b")], "pid bigint, source string, alias string") \
        .write.parquet(f"{tmpdir_path}/url_alias")
    spark.createDataFrame([(1, 2, "x", "d")], "tid bigint, vid bigint, name string, description string") \
        .write.parquet(f"{tmpdir_path}/taxonomy_term_data")
    assert read_table(tmpdir_path, "url_alias", version="7.1", spark=spark).columns == ["pid", "src", "dst"]
    assert read_table(tmpdir_path, "term_data", version="7.1", spark=spark).count() == 1


def test_ci_duplicate_names(spark):
    d = spark.createDataFrame([(1, "Foo"), (2, "foo "), (3, "bar")], "tid bigint, name string")
    got = [tuple(r) for r in audit.dup_term_names(d, collation="ci").collect()]
    assert got == [(1, "foo", 2)]


def test_fused_term_fix_equals_r1_r2_r3(spark):
    t = load_tables(spark, SF_SMALL)
    terms = t["term_data"]
    for safe in (False, True):
        staged = repair.truncate_terms(repair.apply_keyed_update(terms, repair.uniquify_terms(terms, safe=safe)))
        fused = repair.fix_term_names(terms, safe=safe)
        assert fused.columns == staged.columns
        assert fused.exceptAll(staged).count() == 0 and staged.exceptAll(fused).count() == 0


def test_an_existing_empty_table_is_present(spark):
    from pressferry.operators import audit

    tables = {"url_alias": spark.createDataFrame([], "pid bigint"), "node": spark.range(3)}
    got = {r["table_name"]: (r["table_count"], r["row_count"]) for r in audit.table_exists(spark, tables, ["url_alias", "node", "users"]).collect()}
    assert got == {"url_alias": (1, 0), "node": (1, 3), "users": (0, None)}


def test_scalars_with_line_breaks_and_malformed_values(spark):
    from pressferry.operators import audit

    rows = [("lines", 's:5:"ab\ncd";'), ("short", 's:99:"ab";'), ("ok", 's:2:"ab";'), ("tail", 's:2:"ab";x'), ("newline", 'i:5;\n'),
            ("int", "i:-5;"), ("huge", 's:99999999999999999999:"ab";'), ("bool", "b:2;"), ("null", "N;"), ("none", None)]
    got = {r["name"]: (r["decoded"], r["valid"]) for r in audit.decode_variable(spark.createDataFrame(rows, "name string, value string")).collect()}
    assert got["lines"] == ("ab\ncd", True) and got["ok"] == ("ab", True) and got["int"] == ("-5", True) and got["null"] == (None, True)
    assert all(got[k][0] is None and not got[k][1] for k in ("short", "tail", "newline", "huge", "bool", "none"))


def test_term_without_vocabulary_has_no_role(spark):
    from pressferry.operators import terms

    data = spark.createDataFrame([(1, 4, "a"), (2, 2, "b"), (3, None, "c")], "tid bigint, vid bigint, name string")
    assert sorted((r["tid"], r["role"]) for r in terms.vocab_roles(data, [4]).collect()) == [(1, "category"), (2, "tag")]
    assert sorted(r["tid"] for r in terms.tags_work(data, [4]).collect()) == [2]


def test_update_ignore_never_leaves_a_pair_twice(spark):
    import random

    from pressferry.operators import terms

    rng = random.Random(3)
    cases = [([(1, 5), (1, 7), (1, 3)], {5: 7, 3: 5})]
    for _ in range(6):
        cases.append(([(o, t) for o in range(4) for t in rng.sample(range(8), 5)], {k: rng.randrange(8) for k in rng.sample(range(8), 5)}))
    for rows, mapping in cases:
        done = set(rows)
        for o, t in sorted(rows, key=lambda r: r[1]):  # one after the other, ascending by the old id
            new = (o, mapping.get(t, t))
            if new not in done:
                done = done - {(o, t)} | {new}
        rel = spark.createDataFrame(rows, "object_id bigint, term_taxonomy_id bigint")
        tax = spark.createDataFrame(list(mapping.items()), "term_id bigint, term_taxonomy_id bigint")
        got = [tuple(r) for r in terms.fix_taxonomy_ids(rel, tax).collect()]
        assert len(got) == len(rows) == len(set(got)) and set(got) == done


def test_summary_lists(spark):
    from conftest import SF_SMALL
    from pressferry.operators import audit
    from pressferry.sources.fixtures import load_tables

    t = load_tables(spark, SF_SMALL)
    row = audit.audit_summary(t, lists=True).first()
    assert len(row["node_types"]) == row["node_types_count"]
    assert [tuple(x) for x in row["node_count_by_type"]] == sorted(tuple(r) for r in audit.count_by_type(t["node"], t["node_type"]).collect())


def test_ci_repair_fixes_what_the_ci_audit_reports(spark):
    from pressferry.operators import audit, repair

    data = spark.createDataFrame([(1, 1, "Foo"), (2, 1, "foo "), (3, 1, "bar"), (4, 1, None)], "tid bigint, vid bigint, name string")
    assert sorted(r["tid"] for r in repair.uniquify_terms(data, collation="ci").collect()) == [1, 2]
    fixed = repair.apply_keyed_update(data, repair.uniquify_terms(data, collation="ci"))
    assert audit.dup_term_members(fixed, collation="ci").count() == 0
    aliases = spark.createDataFrame([(1, "node/1", "a"), (2, "NODE/1 ", "b"), (3, "node/2", "c")], "pid bigint, src string, dst string")
    assert audit.dup_aliases(aliases, collation="ci").count() == 1
    assert sorted(r["pid"] for r in repair.uniquify_aliases(aliases, collation="ci").collect()) == [1, 3]


NESTED = ['a:0:{}', 'i:-5;', 'd:0.75;', 'b:1;', 'N;', 's:0:"";', 's:3:"hé";', 's:9:"a";s:1:"b";', 'a:2:{i:0;s:1:"a";i:1;a:1:{s:1:"k";N;}}',
          'a:2:{i:5;i:1;s:2:"05";b:0;}', 'a:1:{s:3:"a}{";s:4:"};a:";}', 'd:1;', 'd:1.5E+25;', 'a:1:{i:0;a:1:{i:0;a:1:{i:0;s:2:"é";}}}']
BROKEN = ['', 's:4:"hé";', 'a:1:{i:0;}', 'a:2:{i:0;i:1;}', 'i:5', 's:3:"abc"', 'a:1:{i:0;i:1;}x', 'x', 'a:1:{i:0;i:1;', 's:-1:"";', 'O', 'a::{}']


def test_nested_values_round_trip(spark):
    values = NESTED + BROKEN + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"]: (r["back"], r["j"]) for r in df.select(
        "i", serialized.encode_nested(serialized.decode_nested("v")).alias("back"), serialized.decode_nested("v").cast("string").alias("j")).collect()}
    for i, v in enumerate(values):
        assert (got[i][0] is None) == (v not in NESTED), v
        if v in NESTED:  # VARIANT sorts the keys of an array
            assert serialized.to_plain(got[i][0].encode()) == serialized.to_plain(v.encode()), v
            assert v == "d:1;" or sorted(got[i][0]) == sorted(v)
            assert serialized.to_serialized(serialized.to_plain(v.encode())).decode() == v
    paths = spark.createDataFrame([('a:2:{s:4:"logo";a:2:{i:0;s:3:"hé";i:1;i:7;}s:2:"on";b:1;}',)], "v string").select(
        F.variant_get(serialized.decode_nested("v"), "$.logo[1]", "int"), F.variant_get(serialized.decode_nested("v"), "$.on", "boolean"))
    assert tuple(paths.first()) == (7, True)


def test_replaced_texts_have_their_lengths_mended(spark):
    inner = 'a:1:{s:3:"old";s:6:"oldéx";}'
    cases = {'s:6:"oldéx";': 's:9:"neweréx";'.replace("9", "8"), "plain old text": "plain newer text", inner: 'a:1:{s:5:"newer";s:8:"neweréx";}',
             f's:{len(inner.encode())}:"{inner}";': None, 's:9:"old";': 's:9:"newer";', "nothing": "nothing", "": ""}
    fixed = 'a:1:{s:5:"newer";s:8:"neweréx";}'
    cases[f's:{len(inner.encode())}:"{inner}";'] = f's:{len(fixed.encode())}:"{fixed}";'
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string")
    got = {r["v"]: r["w"] for r in df.select("v", serialized.replace_serialized("v", "old", "newer").alias("w")).collect()}
    assert got == cases | {None: None}
