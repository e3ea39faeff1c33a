"""Ordered, fail-fast migration runs.

A :class:`Runbook` is a list of named steps; each step maps the current
tables (name -> DataFrame) to updated tables, or returns ``False`` to stop.
Steps are Spark SQL statements or DataFrame functions; nothing is split on
';' (a statement may carry ';' inside a string literal).  Steps only build
plans; the driver acts once per declared output (and once per gate, a
one-row result), never on data-sized results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping, MutableMapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressferry.operators import audit, comments, options, posts, repair, terms, users
from pressferry.plans import sinks
from pressferry.schemas import TARGETS, empty_target
from pressferry.session import ensure_checkpoint_dir

Tables = MutableMapping[str, DataFrame]
StepFn = Callable[[Tables], "Tables | bool | None"]


@dataclass
class Step:
    """``cut``: the tables that the step sets, if their rows are computed and kept
    when it is done (a checkpoint, or a commit of the run's ledger); all other
    steps only build plans.  ``gate``: the step decides, so a ledger keeps its
    answer."""

    name: str
    fn: StepFn
    cut: tuple[str, ...] = ()
    gate: bool = False


def sql_step(name: str, target: str, statement: str) -> Step:
    """A step whose body is one Spark SQL SELECT over the current tables
    (registered as temp views) that becomes table ``target``."""

    def run(tables: Tables) -> Tables:
        spark = next(iter(tables.values())).sparkSession
        # Only the tables the statement names, and only while it is analysed.
        used = [n for n in tables if re.search(rf"\b{re.escape(n)}\b", statement)]
        for n in used:
            tables[n].createOrReplaceTempView(n)
        try:
            tables[target] = spark.sql(statement)
        finally:
            for n in used:
                spark.catalog.dropTempView(n)
        return tables

    return Step(name, run)


def sql_script(statements: list[tuple[str, str]], name: str = "script") -> list[Step]:
    """A user script as steps: ``(target, SELECT ...)`` pairs run in order.
    The script is a list, never text split on ';' (a literal may hold one)."""
    return [sql_step(f"{name}.{i}.{target}", target, sql) for i, (target, sql) in enumerate(statements)]


@dataclass
class Outcome:
    ok: bool
    stages: list[tuple[str, bool]] = field(default_factory=list)
    tables: Tables = field(default_factory=dict)
    error: str | None = None
    resumed: list[str] = field(default_factory=list)  # steps whose rows an earlier run had committed

    def report(self, spark: SparkSession) -> DataFrame:
        rows = [(i, n, ok, None if ok else self.error) for i, (n, ok) in enumerate(self.stages)]
        return spark.createDataFrame(rows, "seq int, stage string, ok boolean, error string")


def input_fingerprint(tables: Mapping[str, DataFrame]) -> str:
    """What a run reads: for each table its schema and its files (path, size,
    time of change); for one without files the number and a sum of hashes of
    its rows."""
    digest = hashlib.sha256()
    for name in sorted(tables):
        df = tables[name]
        spark = df.sparkSession
        files = sorted(df.inputFiles())
        if files:
            conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            for f in files:
                p = path(f)
                status = p.getFileSystem(conf).getFileStatus(p)
                digest.update(f"{f} {status.getLen()} {status.getModificationTime()}\n".encode())
        else:
            row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
            digest.update(f"{row[0]} {row[1]}\n".encode())
        digest.update(f"{name} {df.schema.json()}\n".encode())
    return digest.hexdigest()


class Ledger:
    """What a run has finished, kept in a warehouse: each step that computes
    tables commits them under an id made of the run, the step and a fingerprint
    of all that came before it (inputs, parameters, steps).  A second run of the
    same id takes up those tables and goes on with the first step that isn't
    committed; if an input or a parameter has changed, so has the fingerprint,
    and the steps run again."""

    def __init__(self, warehouse: sinks.Warehouse, run_id: str, parameters: str = ""):
        self.warehouse = warehouse
        self.run_id = run_id
        self.parameters = parameters
        self.mark = ""
        self.kept: dict[str, str] = {}  # where the rows of each table are kept now

    def start(self, tables: Mapping[str, DataFrame]) -> None:
        self.mark = hashlib.sha256(f"{self.run_id} {self.parameters} {input_fingerprint(tables)}".encode()).hexdigest()

    def enter(self, number: int, step: Step) -> str:
        """The commit id of a step."""
        self.mark = hashlib.sha256(f"{self.mark} {number} {step.name} {','.join(step.cut)}".encode()).hexdigest()
        return f"{self.run_id}/{number:03d}-{step.name}/{self.mark[:24]}"

    def _kept(self, number: int, name: str) -> str:
        return f"_run_{self.run_id}_{number:03d}_{name}"

    def find(self, number: int, step: Step, commit: str) -> dict[str, DataFrame] | None:
        """The tables of a step that is committed."""
        now = self.warehouse.log.snapshot()
        if commit not in now.commits:
            return None
        here = {n: self._kept(number, n) for n in step.cut if self._kept(number, n) in now.tables}
        self.kept.update(here)
        return {n: now.read(k) for n, k in here.items()}

    def keep(self, number: int, step: Step, commit: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Compute the step's tables and commit them together."""
        change = self.warehouse.transaction(commit)
        for n in step.cut:
            if n in tables:
                change.write(self._kept(number, n), tables[n])
        change.commit()
        return self.find(number, step, commit) or {}

    def publish(self, names: list[str], commit: str) -> None:
        """The kept tables become the targets and all that was kept for the run
        goes, in one commit; no data move."""
        change = self.warehouse.transaction(commit)
        for n in names:
            change.take(n, self.kept[n])
        for n in change.base.tables:
            if n.startswith(f"_run_{self.run_id}_"):
                change.drop(n)
        change.commit()


class Runbook:
    """Run steps in order, stop at the first failure."""

    def __init__(self, steps: list[Step]):
        self.steps = list(steps)

    def run(self, tables: Mapping[str, DataFrame], outcome: Outcome | None = None, ledger: Ledger | None = None) -> Outcome:
        """With a ``ledger``, steps that it holds aren't computed again."""
        outcome = outcome or Outcome(ok=True)
        state: Tables = dict(tables)
        if ledger is not None:
            ledger.start(state)
        for number, step in enumerate(self.steps):
            commit = ledger.enter(number, step) if ledger is not None else ""
            try:
                found = ledger.find(number, step, commit) if ledger is not None and (step.cut or step.gate) else None
                if found is not None:
                    state.update(found)
                    outcome.stages.append((step.name, True))
                    outcome.resumed.append(step.name)
                    continue
                got = step.fn(state)
                if got is not False and (step.cut or step.gate):
                    kept = got if isinstance(got, MutableMapping) else state
                    if ledger is not None:
                        kept.update(ledger.keep(number, step, commit, kept))
                    else:
                        for n in step.cut:
                            if n in kept:
                                ensure_checkpoint_dir(kept[n].sparkSession)
                                kept[n] = kept[n].checkpoint(eager=True)
            except Exception as error:  # noqa: BLE001 - a failed statement fails the run
                outcome.stages.append((step.name, False))
                outcome.ok = False
                outcome.error = f"{type(error).__name__}: {error}"
                outcome.tables = state
                return outcome
            if got is False:
                outcome.stages.append((step.name, False))
                outcome.ok = False
                outcome.tables = state
                return outcome
            if isinstance(got, MutableMapping):
                state = got
            outcome.stages.append((step.name, True))
        outcome.tables = state
        return outcome


# The standard pass ------------------------------------------------------------

def _set(name: str, fn: Callable[[Tables], DataFrame]) -> StepFn:
    """Step that (re)defines table ``name``."""
    def run(t: Tables) -> Tables:
        t[name] = fn(t)
        return t
    return run


def prepare_steps(*, safe_repair: bool = False, null_name_stem: str | None = None) -> list[Step]:
    """R5 as steps: uniquify and truncate term names, uniquify aliases.  The
    repaired tables are materialised once: the gate and the transforms read them
    again."""

    def fix(t: Tables) -> Tables:
        fixed = repair.run_fix(t, safe=safe_repair, null_name_stem=null_name_stem)
        t["term_data"], t["url_alias"] = fixed["term_data"], fixed["url_alias"]
        return t

    return [Step("prepare.run_fix", fix, cut=("term_data", "url_alias"))]


def gate_step() -> Step:
    """X2 on the repaired tables: one action on a four-row result."""

    def run(t: Tables) -> bool:
        verdict = audit.gate(audit.audit_summary(t)).where(F.col("check") == "proceed")
        row = verdict.select("ok").first()
        return bool(row and row["ok"])

    return Step("gate", run, gate=True)


# The tables a pass empties, and the working tables it drops.
TRUNCATED = ("wp_comments", "wp_links", "wp_postmeta", "wp_posts", "wp_term_relationships", "wp_term_taxonomy", "wp_terms", "wp_users")
WORKING = ("acc_tags", "acc_categories", "acc_users_post_count", "acc_users_comment_count", "acc_users_with_comments",
           "acc_users_add_commenters", "acc_wp_users", "acc_redirects", "acc_duplicates", "acc_news")


def _reset(t: Tables) -> Tables:
    """Empty the targets (those a run has beyond the standard ones keep
    their own schema) and drop the working tables."""
    spark = t["node"].sparkSession
    for name in TRUNCATED:
        if name in TARGETS:
            t[name] = empty_target(spark, name)
        elif name in t:
            t[name] = sinks.create_like(t[name])
    for name in WORKING:
        t.pop(name, None)
    return t


def migrate_steps(secret: str, default_category: int = 159) -> list[Step]:
    """M2-M36 in the sample's order, on the canonical tables."""
    s: list[Step] = []

    def add(name, target, fn, cut=False):
        # ``cut``: after statements whose plan reads its input twice (INSERT IGNORE,
        # INSERT with a key check, generated ids), so a long chain keeps a plan of
        # bounded size and a lost executor recomputes from there, not from the
        # start of the pass.  Chains of single-use updates stay fused.
        s.append(Step(name, _set(target, fn), cut=(target,) if cut else ()))

    s.append(Step("reset", _reset))
    add("acc_tags", "acc_tags", lambda t: terms.tags_work(t["term_data"]))
    add("acc_categories", "acc_categories", lambda t: terms.categories_work(t["acc_categories_from_client"]))
    # M3 + M6 and M4 + M7, each as one pass over the terms.
    add("terms", "wp_terms", lambda t: terms.terms_pass(t["term_data"], t["acc_categories"], t["wp_terms"]))
    add("taxonomy", "wp_term_taxonomy",
        lambda t: terms.taxonomy_pass(t["term_data"], t["acc_categories"], t["wp_term_taxonomy"]), cut=True)
    add("uncategorized.term", "wp_terms", lambda t: terms.uncategorized_term(t["wp_terms"]), cut=True)
    add("uncategorized.taxonomy", "wp_term_taxonomy",
        lambda t: terms.uncategorized_taxonomy(t["wp_terms"], t["wp_term_taxonomy"]), cut=True)
    add("relationships", "wp_term_relationships",
        lambda t: terms.term_relationships(t["term_node"], t["wp_term_relationships"]), cut=True)
    add("term.counts", "wp_term_taxonomy", lambda t: terms.term_counts(t["wp_term_taxonomy"], t["wp_term_relationships"]))
    add("default.category", "wp_options", lambda t: options.default_category_option(t["wp_options"], str(default_category)))
    add("default.taxonomy", "wp_term_taxonomy",
        lambda t: terms.default_category_taxonomy(t["wp_term_taxonomy"], default_category))
    add("comments", "wp_comments", lambda t: comments.comments(t["comments"], t["wp_comments"]))
    add("purge.users", "wp_users", lambda t: users.purge_users(t["wp_users"]))
    add("purge.usermeta", "wp_usermeta", lambda t: users.purge_usermeta(t["wp_usermeta"]))
    add("reset.secret", "users", lambda t: users.reset_secret(t["users"], secret))
    add("authors.list", "acc_users_post_count", lambda t: users.authors_with_posts(t["node"], t["users"]), cut=True)
    add("authors", "wp_users", lambda t: users.authors(t["users"], t["acc_users_post_count"], t["wp_users"]), cut=True)
    add("authors.capabilities", "wp_usermeta",
        lambda t: users.author_capabilities(t["users"], t["acc_users_post_count"], t["wp_usermeta"]))
    add("authors.level", "wp_usermeta",
        lambda t: users.author_level(t["users"], t["acc_users_post_count"], t["wp_usermeta"]))
    # M10, M11, M12, M18, M26, M27 as one plan: no other statement reads
    # wp_posts, so the pass runs once its inputs (comments, users) exist and
    # the post bodies cross one shuffle.
    add("posts", "wp_posts", lambda t: posts.posts_pass(
        t["node"], t["node_revisions"], t["url_alias"], t["wp_posts"], t["wp_comments"], t["wp_users"], aliases_unique=True))
    add("site.name", "wp_options", lambda t: options.site_name_option(t["wp_options"], t["variable"]))
    add("site.slogan", "wp_options", lambda t: options.site_slogan_option(t["wp_options"], t["variable"]))
    add("site.mail", "wp_options", lambda t: options.site_mail_option(t["wp_options"], t["variable"]))
    add("permalinks", "wp_options", lambda t: options.permalink_option(t["wp_options"]))
    add("users.copy", "acc_wp_users", lambda t: sinks.copy_append(sinks.create_like(t["wp_users"]), t["wp_users"]), cut=True)
    add("commenters.list", "acc_users_comment_count", lambda t: users.commenters(t["comments"], t["users"]))
    add("commenters", "acc_users_with_comments",
        lambda t: users.authors(t["users"], t["acc_users_comment_count"], sinks.create_like(t["acc_wp_users"])),
        cut=True)
    add("commenters.new", "acc_users_add_commenters",
        lambda t: users.commenters_to_add(t["acc_users_with_comments"], t["acc_wp_users"],
                                          sinks.create_like(t["acc_wp_users"])))
    add("users.merge", "acc_wp_users", lambda t: users.merge_users(t["acc_wp_users"], t["acc_users_add_commenters"]))
    return s


TARGET_OUTPUTS = [n for n in TARGETS if n != "acc_redirects"] + ["acc_wp_users"]


def migrate(tables: Mapping[str, DataFrame], *, secret: str,
            custom_prepare: list[Step] | None = None, custom_migrate: list[Step] | None = None,
            custom_deploy: list[Step] | None = None, safe_repair: bool = False, null_name_stem: str | None = None,
            warehouse: sinks.Warehouse | None = None, outputs: list[str] | None = None, run_id: str | None = None) -> Outcome:
    """Prepare -> gate -> migrate -> deploy; stops at the first failure
    and keeps its text.

    ``safe_repair`` and ``null_name_stem`` make the repair pass the gate: long
    or repeated names stay apart within the limit, and terms without a name get
    stem + '_' + id (no row is dropped).  Every declared output is computed
    completely, one step each, so a statement that only fails on its data
    fails the run.

    With a ``warehouse`` the outputs are published by one commit at the end: its
    readers see the targets of the pass before or of this one, never a mixture.
    With a ``run_id`` as well, every step that computes rows commits them to the
    run's ledger, and a second run of the same id, inputs and parameters goes on
    after the last such step.  (Custom steps are told apart by their names.)"""
    tables = {**tables, "url_alias_with_dups": tables["url_alias"]}  # the original, as archived
    if run_id is not None and warehouse is None:
        raise ValueError("a run that can be resumed needs a warehouse")
    steps = prepare_steps(safe_repair=safe_repair, null_name_stem=null_name_stem)
    steps += list(custom_prepare or []) + [gate_step()] + migrate_steps(secret)
    steps += list(custom_migrate or []) + list(custom_deploy or [])
    wanted = list(outputs or TARGET_OUTPUTS)
    parameters = hashlib.sha256(repr((secret, safe_repair, null_name_stem, wanted)).encode()).hexdigest()
    ledger = Ledger(warehouse, run_id, parameters) if run_id is not None else None
    change = warehouse.transaction() if warehouse is not None and ledger is None else None

    def compute(name: str) -> StepFn:
        def run(t: Tables) -> Tables:
            if change is not None and name in t:
                change.write(name, t[name])
            return t
        return run

    def publish(t: Tables) -> Tables:
        present = [n for n in wanted if n in t]
        if ledger is not None:
            ledger.publish(present, f"{run_id}/publish/{ledger.mark}")
        elif change is not None:
            change.commit()
        t.update({n: warehouse.read(n) for n in present})
        return t

    steps += [Step(f"output.{name}", compute(name), cut=(name,) if change is None else ()) for name in wanted]
    if warehouse is not None:
        steps.append(Step("publish", publish))
    return Runbook(steps).run(tables, ledger=ledger)
