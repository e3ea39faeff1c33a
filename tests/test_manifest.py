"""The table log: several tables change together, whatever fails."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pressferry.plans import manifest, runbook, sinks
from pressferry.plans.manifest import CommitConflict, HadoopFiles, TableLog


class Killed(RuntimeError):
    pass


class FailingFiles(HadoopFiles):
    """Dies before (or after) its nth operation that changes something."""

    def __init__(self, spark, root, at=None, after=False):
        super().__init__(spark, root)
        self.left, self.after = at, after

    def _step(self, act):
        if self.left == 0 and not self.after:
            raise Killed
        found = act()
        if self.left == 0:
            raise Killed
        if self.left is not None:
            self.left -= 1
        return found

    def write(self, name, text):
        return self._step(lambda: super(FailingFiles, self).write(name, text))

    def publish(self, name, target):
        return self._step(lambda: super(FailingFiles, self).publish(name, target))


def ids(df):
    return sorted(r[0] for r in df.collect())


def base(spark, root):
    wh = sinks.Warehouse(spark, root)
    change = wh.transaction("first")
    change.write("a", spark.range(3))
    change.write("b", spark.range(10, 12))
    change.write("gone", spark.range(1))
    change.commit()
    return wh


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("at", range(3))
def test_a_killed_commit_leaves_all_old_or_all_new(spark, tmpdir_path, at, after):
    base(spark, tmpdir_path)

    def statement(files):
        change = sinks.Warehouse(spark, tmpdir_path, files).transaction("second")
        change.append("a", spark.range(3, 5))
        change.write("b", spark.range(2))
        change.drop("gone")
        change.commit()

    try:
        statement(FailingFiles(spark, tmpdir_path, at, after))
    except Killed:
        pass
    old, new = ([0, 1, 2], [10, 11], True), ([0, 1, 2, 3, 4], [0, 1], False)
    wh = sinks.Warehouse(spark, tmpdir_path)
    state = lambda: (ids(wh.read("a")), ids(wh.read("b")), wh.exists("gone"))
    assert state() in (old, new)
    statement(None)  # the writer comes again with the same commit id
    assert state() == new
    statement(None)
    assert state() == new


def test_a_write_that_fails_leaves_everything(spark, tmpdir_path):
    wh = base(spark, tmpdir_path)
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    change = wh.transaction()
    change.write("b", spark.range(1))
    with pytest.raises(Exception, match="bad row"):
        change.write("a", broken)
    assert ids(wh.read("a")) == [0, 1, 2] and ids(wh.read("b")) == [10, 11]
    assert wh.append("a", broken) is False and "bad row" in wh.last_error
    assert ids(wh.read("a")) == [0, 1, 2]


def test_readers_pin_a_version(spark, tmpdir_path):
    wh = base(spark, tmpdir_path)
    pinned = wh.log.snapshot()
    reading = wh.read("a")
    wh.write("a", wh.read("a").where("id > 0"))  # overwrite from itself
    wh.reset_targets(["b"], ["gone", "gone", "missing"])
    assert ids(wh.read("a")) == [1, 2] and wh.read("b").count() == 0 and not wh.exists("gone")
    assert ids(pinned.read("a")) == ids(reading) == [0, 1, 2] and ids(pinned.read("b")) == [10, 11]
    assert ids(wh.log.snapshot(1).read("gone")) == [0]


def test_retried_append_is_not_doubled(spark, tmpdir_path):
    wh = base(spark, tmpdir_path)
    for _ in range(3):
        assert wh.append("a", spark.range(3, 5), commit="load 7")
    assert ids(wh.read("a")) == [0, 1, 2, 3, 4]
    assert wh.append("new", spark.range(2)) and ids(wh.read("new")) == [0, 1]


def test_two_writers(spark, tmpdir_path):
    wh = base(spark, tmpdir_path)
    one, two, three, four = (wh.transaction() for _ in range(4))
    one.append("a", spark.range(3, 4))
    two.append("a", spark.range(4, 5))
    three.write("b", spark.range(1))
    four.write("a", spark.range(1))
    assert [x.commit() for x in (one, two, three)] == [2, 3, 4]
    with pytest.raises(CommitConflict):
        four.commit()
    assert ids(wh.read("a")) == [0, 1, 2, 3, 4] and ids(wh.read("b")) == [0]


def test_publishing_never_replaces(spark, tmpdir_path):
    files = HadoopFiles(spark, tmpdir_path)
    files.write("x", "one")
    files.write("y", "two")
    assert files.publish("x", "target") and not files.publish("y", "target")
    assert files.read("target") == "one"


def test_archive_keeps_the_original_on_a_second_run(spark, tmpdir_path):
    from pressferry.operators.repair import uniquify_aliases

    wh = sinks.Warehouse(spark, tmpdir_path)
    wh.write("url_alias", spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "c")], "pid long, src string, dst string"))
    assert wh.archive_swap("url_alias", uniquify_aliases(wh.read("url_alias"))) == "url_alias_with_dups"
    with pytest.raises(ValueError, match="exists"):
        wh.archive_swap("url_alias", uniquify_aliases(wh.read("url_alias")))
    assert wh.read("url_alias_with_dups").count() == 3 and wh.read("url_alias").count() == 2
    wh.archive_swap("url_alias", wh.read("url_alias"), archive_suffix="_2")
    assert wh.read("url_alias_with_dups").count() == 3 and wh.read("url_alias_2").count() == 2


def test_vacuum_keeps_what_versions_name(spark, tmpdir_path):
    wh = base(spark, tmpdir_path)
    change = wh.transaction()
    change.write("k", spark.range(100).withColumnRenamed("id", "x"), keys=["x"], buckets=4)
    change.commit()
    before = wh.folders("k")
    change = wh.transaction()
    touched = sorted(before.values())[:1]
    change.replace_buckets("k", change.base.read("k", touched).where("x > 50"), touched)
    change.commit()
    assert {p for p, b in wh.folders("k").items() if b not in touched} == {p for p, b in before.items() if b not in touched}
    wh.transaction().write("a", spark.range(1))  # staged, never published
    gone = wh.log.vacuum(keep=1)
    assert len([g for g in gone if g.startswith("data/a/")]) == 1 and [g for g in gone if g.startswith("data/k/")] == [p for p, b in before.items() if b in touched]
    assert wh.log.versions() == [3] and ids(wh.read("a")) == [0, 1, 2]
    want = [x for x in range(100) if x > 50 or x not in ids(spark.range(100).withColumnRenamed("id", "x").where(manifest.bucket_of(["x"], 4).isin(touched)))]
    assert ids(wh.read("k")) == want
    assert wh.log.vacuum(keep=1) == []


def small_run(spark):
    """A run of four steps that count how often they compute."""
    calls = []

    def step(name, target, fn, **kw):
        def run(t):
            calls.append(name)
            t[target] = fn(t)
            return t
        return runbook.Step(name, run, **kw)

    steps = [step("one", "x", lambda t: t["source"].withColumn("v", F.col("id") * 2), cut=("x",)),
             step("plan", "y", lambda t: t["x"].where("v > 2")),
             runbook.Step("gate", lambda t: calls.append("gate") or t["y"].count() > 0, gate=True),
             step("two", "y", lambda t: t["y"].withColumn("w", F.col("v") + 1), cut=("y",)),
             step("three", "z", lambda t: t["y"].groupBy().agg(F.sum("w").alias("total")), cut=("z",))]
    return steps, calls


def test_a_run_goes_on_after_the_last_committed_step(spark, tmpdir_path):
    source = f"{tmpdir_path}/in"
    spark.range(10).write.parquet(source)
    tables = lambda: {"source": spark.read.parquet(source)}
    steps, _ = small_run(spark)
    want = runbook.Runbook(steps).run(tables()).tables["z"].collect()
    for fail_at, computed in (("gate", ["one", "plan"]), ("two", ["one", "plan", "gate"]), ("three", ["one", "plan", "gate", "two"])):
        wh = sinks.Warehouse(spark, f"{tmpdir_path}/wh-{fail_at}")
        steps, calls = small_run(spark)
        broken = [runbook.Step(s.name, lambda t: (_ for _ in ()).throw(Killed("killed")), s.cut, s.gate) if s.name == fail_at else s for s in steps]
        out = runbook.Runbook(broken).run(tables(), ledger=runbook.Ledger(wh, "r1"))
        assert not out.ok and calls == computed
        calls.clear()
        out = runbook.Runbook(steps).run(tables(), ledger=runbook.Ledger(wh, "r1"))
        assert out.ok and out.tables["z"].collect() == want
        assert calls == [s.name for s in steps if s.name == "plan" or s.name not in computed]
        assert out.resumed == [c for c in computed if c != "plan"]
    calls.clear()
    out = runbook.Runbook(steps).run(tables(), ledger=runbook.Ledger(wh, "r1", "other parameters"))
    assert out.ok and calls == ["one", "plan", "gate", "two", "three"] and out.resumed == []


def test_a_changed_input_starts_again(spark, tmpdir_path):
    source = f"{tmpdir_path}/in"
    spark.range(10).write.parquet(source)
    wh = sinks.Warehouse(spark, f"{tmpdir_path}/wh")
    steps, calls = small_run(spark)
    for rows in (10, 20):
        if rows == 20:
            spark.range(10, 20).write.mode("append").parquet(source)
        calls.clear()
        out = runbook.Runbook(steps).run({"source": spark.read.parquet(source)}, ledger=runbook.Ledger(wh, "r1"))
        assert out.ok and len(calls) == 5 and out.tables["x"].count() == rows


def test_full_pass_resumes_and_publishes_at_once(spark, tmpdir_path, monkeypatch):
    from pressferry.sources.fixtures import load_tables

    tables = dict(load_tables(spark, SF_SMALL))
    options = {"secret": "s3cret", "safe_repair": True, "null_name_stem": "term", "outputs": ["wp_terms", "wp_term_taxonomy", "wp_users"]}
    want = runbook.migrate(tables, **options)
    assert want.ok, want.error
    wh = sinks.Warehouse(spark, tmpdir_path)
    wh.write("wp_terms", spark.range(1))
    real, kept = runbook.Ledger.keep, []

    def keep(self, number, step, commit, t):
        if len(kept) == 5:
            raise Killed("killed")
        kept.append(step.name)
        return real(self, number, step, commit, t)

    monkeypatch.setattr(runbook.Ledger, "keep", keep)
    broken = runbook.migrate(tables, warehouse=wh, run_id="pass1", **options)
    assert not broken.ok and wh.names() == ["wp_terms"] and wh.read("wp_terms").columns == ["id"]
    monkeypatch.setattr(runbook.Ledger, "keep", real)
    out = runbook.migrate(tables, warehouse=wh, run_id="pass1", **options)
    assert out.ok, out.error
    assert out.resumed == kept
    assert wh.names() == sorted(options["outputs"]) and not [n for n in wh.log.snapshot().tables if n.startswith("_run")]
    for name in options["outputs"]:
        got = wh.read(name)
        assert got.exceptAll(want.tables[name]).count() == 0 and want.tables[name].exceptAll(got).count() == 0
