"""User scripts with the statements they have.

A script is a list of statements (never text split on ';': a literal may hold
one).  Spark's own parser reads each; its plan says which verb it is, and
the verb becomes the kernel function that means it:

* ``UPDATE t SET c = ... WHERE ...``     -> K5 (K10 for a NOT IN, K7 / K8 for
  subqueries, which Catalyst turns into joins)
* ``DELETE FROM t WHERE ...``            -> K9
* ``INSERT INTO t (...) SELECT ...``     -> K3, with the keys given for ``t``
* ``... SELECT /*+ REPLACE_INTO */ ...`` and ``/*+ INSERT_IGNORE */`` as hints on
  the query of an INSERT                  -> K1, K2 (MySQL's verbs aren't Spark's)
* ``CREATE TABLE t AS SELECT``, ``TRUNCATE TABLE t``, ``DROP TABLE IF EXISTS t``

Parts of a statement (a condition, a value, a query) are taken from its text by
the places the parser gives, and parsed again: they must give the same plan as
in the statement, else, as for any other verb, the statement is refused by name.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressferry.operators import dml
from pressferry.plans.runbook import Step, Tables

Keys = Mapping[str, Sequence[dml.Key]]


class UnsupportedStatement(ValueError):
    """A statement, or a part of it, that isn't one of the verbs above."""


def _name(plan) -> str:
    return plan.getClass().getSimpleName()


def _ids_off(plan) -> str:
    return re.sub(r"#\d+L?", "", plan.toString()).strip()


class Statement:
    """One statement, read by Spark's parser."""

    def __init__(self, spark: SparkSession, text: str):
        self.text = text
        self.parser = spark._jsparkSession.sessionState().sqlParser()
        self.plan = self.parser.parsePlan(text)
        self.verb = _name(self.plan)

    def refuse(self, why: str) -> UnsupportedStatement:
        return UnsupportedStatement(f"{why}: {self.text.strip()}")

    def table(self, plan=None) -> tuple[str, str]:
        """Name and alias of the table that the statement changes."""
        plan = plan or self.plan.table()
        alias = None
        if _name(plan) == "SubqueryAlias":
            alias, plan = plan.alias(), plan.child()
        if _name(plan) not in ("UnresolvedRelation", "UnresolvedIdentifier", "UnresolvedTableOrView", "UnresolvedTable"):
            raise self.refuse(f"no plain table ({_name(plan)})")
        parts = plan.nameParts() if _name(plan) == "UnresolvedIdentifier" else plan.multipartIdentifier()
        found = [parts.apply(i) for i in range(parts.size())]
        return found[-1], alias or found[-1]

    def expression(self, text: str, parsed) -> str:
        """``text``, if it is the text of the parsed expression."""
        text = text.strip()
        try:
            same = _ids_off(self.parser.parseExpression(text)) == _ids_off(parsed)
        except Exception:  # noqa: BLE001 - not an expression at all
            same = False
        if not same:
            raise self.refuse("a part can't be told apart")
        return text

    def assignments(self) -> tuple[list[tuple[str, str]], str | None]:
        """(column, value) of an UPDATE, in order, and its condition."""
        found = []
        listed = self.plan.assignments()
        for i in range(listed.size()):
            item = listed.apply(i)
            place = item.value().origin()
            last = place.stopIndex().get() + 1
            found.append((item.key().nameParts().last(), self.expression(self.text[place.startIndex().get():last], item.value())))
        rest = self.text[last:].strip()
        condition = self.plan.condition()
        if not condition.isDefined():
            if rest:
                raise self.refuse("a part can't be told apart")
            return found, None
        return found, self.expression(re.sub(r"(?is)^where\b", "", rest), condition.get())

    def deleted(self) -> str | None:
        """The condition of a DELETE."""
        parts = re.split(r"(?is)\bwhere\b", self.text, maxsplit=1)
        return self.expression(parts[1], self.plan.condition()) if len(parts) == 2 else None

    def query(self) -> tuple[str, str | None, list]:
        """The query of an INSERT or CREATE TABLE, without the hint, and the hint
        with its parameters."""
        plan = self.plan.query()

        def begin(node) -> int:
            start = node.origin().startIndex()
            inner = [begin(node.children().apply(i)) for i in range(node.children().size())]
            return min([start.get() if start.isDefined() else len(self.text), *inner])

        start = begin(plan)
        text = self.text[start:]
        if _ids_off(self.parser.parsePlan(text)) != _ids_off(plan):
            raise self.refuse("the query can't be told apart")
        if _name(plan) != "UnresolvedHint" or plan.name().upper() not in ("REPLACE_INTO", "INSERT_IGNORE"):
            return text, None, []
        given = plan.parameters()
        keys: list[dml.Key] = []
        for i in range(given.size()):
            value = given.apply(i).toString().strip("'`")
            keys.append(tuple(c.strip() for c in value.split(",")) if "," in value else value)
        place = plan.origin()
        hint = slice(place.startIndex().get(), place.stopIndex().get() + 1)
        if self.text[hint].count("(") > 1 or not re.fullmatch(r"(?s)/\*\+\s*\w+\s*(\([^()]*\))?\s*\*/", self.text[hint]):
            raise self.refuse("REPLACE_INTO and INSERT_IGNORE stand alone in their hint")
        return self.text[start:hint.start] + self.text[hint.stop:], plan.name().upper(), keys


def _bound(spark: SparkSession, tables: Tables, text: str, sql: str) -> DataFrame:
    """``sql`` over the tables that the statement's text names."""
    used = [n for n in tables if re.search(rf"\b{re.escape(n)}\b", text)]
    for n in used:
        tables[n].createOrReplaceTempView(n)
    try:
        return spark.sql(sql)
    finally:
        for n in used:
            spark.catalog.dropTempView(n)


def _not_in(statement: Statement, tables: Tables, spark: SparkSession, condition: str) -> tuple[str, DataFrame] | None:
    """Probe column and list of a condition that is one NOT IN (SELECT ...)."""
    plan = statement.plan.condition()
    if statement.verb == "UpdateTable":
        plan = plan.get()
    if "(list" not in _ids_off(plan):
        return None
    found = re.fullmatch(r"(?is)\s*(?:\w+\.)?(\w+)\s+not\s+in\s*\((.*)\)\s*", condition)
    if _name(plan) != "Not" or not found:
        raise statement.refuse("of subqueries in a condition only column NOT IN (SELECT ...) alone is known")
    listed = _bound(spark, tables, statement.text, found[2])
    return found[1], listed.toDF("_listed")


def run_statement(spark: SparkSession, tables: Tables, text: str, keys: Keys | None = None,
                  defaults: Mapping[str, Mapping[str, object]] | None = None) -> Tables:
    """Apply one statement to the tables (names to DataFrames)."""
    statement = Statement(spark, text)
    keys, verb = keys or {}, statement.verb
    if verb == "UpdateTable":
        name, alias = statement.table()
        target = tables[name]
        assignments, condition = statement.assignments()
        flag = None
        if condition is not None and (listed := _not_in(statement, tables, spark, condition)):
            target, flag = dml.not_in_flag(target, listed[0], listed[1], "_listed", out="_where"), "_where"
        # Catalyst fails on a projection with a correlated subquery beside a union (a
        # table before or after an upsert is one): such a statement is computed at once.
        nested = "subquery" in _ids_off(statement.plan)
        target = dml.settled(target) if nested else target
        when = flag or condition or "true"
        new: dict[str, str] = {}
        for column, value in assignments:  # left to right: a later value sees the earlier ones only by K5's rule
            if column in new:
                raise statement.refuse(f"{column} is set twice")
            new[column] = value
        if len(new) > 1 and any(re.search(rf"\b{c}\b", v) for i, (c, _) in enumerate(assignments) for _, v in assignments[i + 1:]):
            raise statement.refuse("a value reads a column that is set before it")
        kinds = dict(target.dtypes)
        columns = [f"CASE WHEN {when} THEN CAST({new[c]} AS {kinds[c]}) ELSE `{alias}`.`{c}` END AS `{c}`" if c in new else f"`{alias}`.`{c}`"
                   for c in tables[name].columns]
        if missing := set(new) - set(kinds):
            raise statement.refuse(f"no column {sorted(missing)[0]}")
        changed = _bound(spark, {**tables, name: target}, text, f"SELECT {', '.join(columns)} FROM `{name}` AS `{alias}`")
        tables[name] = dml.settled(changed) if nested else changed
    elif verb == "DeleteFromTable":
        name, alias = statement.table()
        condition = statement.deleted()
        if condition is None:
            tables[name] = dml.create_empty(tables[name])
        elif listed := _not_in(statement, tables, spark, condition):
            flagged = dml.not_in_flag(tables[name], listed[0], listed[1], "_listed", out="_where")
            tables[name] = dml.delete_where(flagged, F.col("_where")).drop("_where")
        else:
            tables[name] = dml.delete_where(tables[name].alias(alias), F.expr(condition))
    elif verb == "InsertIntoStatement":
        if statement.plan.overwrite():
            raise statement.refuse("OVERWRITE is no statement of a script")
        name, _ = statement.table()
        target = tables[name]
        query, hint, hinted = statement.query()
        named = statement.plan.userSpecifiedCols()
        columns = [named.apply(i) for i in range(named.size())] or target.columns
        rows = _bound(spark, tables, text, query)
        if len(rows.columns) != len(columns):
            raise statement.refuse(f"{len(rows.columns)} values for {len(columns)} columns")
        rows = rows.toDF(*columns)
        unique = hinted or list(keys.get(name, []))
        given = (defaults or {}).get(name)
        if hint and not unique:
            raise statement.refuse(f"no unique key is known of {name}")
        if hint == "REPLACE_INTO":
            tables[name] = dml.replace_into(target, rows, unique, defaults=given)
        elif hint == "INSERT_IGNORE" and len(unique) == 1:
            tables[name] = dml.insert_ignore(target, rows, unique[0], defaults=given)
        elif hint == "INSERT_IGNORE":
            tables[name] = dml.insert_ignore_keys(target, rows.distinct(), unique, columns, defaults=given)
        else:
            tables[name] = dml.insert(target, rows, unique or None, defaults=given)
    elif verb == "CreateTableAsSelect":
        name, _ = statement.table(statement.plan.name())
        if name in tables:
            raise statement.refuse(f"table {name} exists")
        tables[name] = _bound(spark, tables, text, statement.query()[0])
    elif verb == "TruncateTable":
        name, _ = statement.table()
        tables[name] = dml.create_empty(tables[name])
    elif verb == "DropTable":
        name, _ = statement.table(statement.plan.child())
        if tables.pop(name, None) is None and not statement.plan.ifExists():
            raise statement.refuse(f"no table {name}")
    else:
        raise statement.refuse(f"{verb} is no statement of a script")
    return tables


def statement_steps(statements: Sequence[str], name: str = "script", keys: Keys | None = None,
                    defaults: Mapping[str, Mapping[str, object]] | None = None) -> list[Step]:
    """A script as steps of a run, one a statement, in order."""

    def step(i: int, text: str) -> Step:
        def run(tables: Tables) -> Tables:
            return run_statement(next(iter(tables.values())).sparkSession, tables, text, keys, defaults)

        return Step(f"{name}.{i}", run)

    return [step(i, text) for i, text in enumerate(statements)]
