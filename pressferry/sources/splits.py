"""Split a table for a parallel read by where its rows are.

Equal ranges of a key put most rows in one task when the ids are skewed.  Here
the database counts rows in equal cells of the key range (one pushed-down
GROUP BY of at most ``cells`` rows); cells that hold more than a split should are
counted again in finer cells, until each holds few enough or a single key.
Neighbouring cells are then joined to splits of about the same number of rows,
each a predicate on the key.  All splits end at the largest key that was counted,
so rows that come in while the table is read are left to the next pass; rows
without a key are a split of their own.

What comes to the driver is counts: at most ``cells`` rows a query, and at most
as many queries as there are cells with too many rows (fewer than ``parts`` in
each round, one round for each factor ``cells`` of the key range).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Runs a query at the source and gives its rows.
Fetch = Callable[[str], list[tuple]]


@dataclass(frozen=True)
class Split:
    """Keys from ``low`` to ``high`` (both included); None, None: no key."""

    low: int | None
    high: int | None
    rows: int

    def predicate(self, column: str) -> str:
        if self.low is None:
            return f"{column} IS NULL"
        return f"{column} >= {self.low} AND {column} <= {self.high}"


def range_query(table: str, column: str) -> str:
    return f"SELECT min({column}), max({column}), count({column}), count(*) FROM {table}"


def cells_query(table: str, column: str, low: int, high: int, width: int) -> str:
    cell = f"({column} - {low}) DIV {width}"
    return f"SELECT {cell}, count(*) FROM {table} WHERE {column} >= {low} AND {column} <= {high} GROUP BY {cell}"


def plan_splits(fetch: Fetch, table: str, column: str, parts: int, cells: int = 1024) -> list[Split]:
    """At most about twice ``parts`` splits; one with more than twice the mean is a
    single key."""
    low, high, keyed, rows = fetch(range_query(table, column))[0]
    rest = [Split(None, None, int(rows - keyed))] if rows > keyed else []
    if not keyed:
        return rest or [Split(None, None, 0)]
    most = max(1, -(-int(keyed) // parts))
    found: list[tuple[int, int, int]] = []
    todo = [(int(low), int(high))]
    while todo:
        begin, end = todo.pop()
        width = max(1, -(-(end - begin + 1) // cells))
        for cell, count in fetch(cells_query(table, column, begin, end, width)):
            first = begin + int(cell) * width
            last = min(end, first + width - 1)
            if count > most and last > first:
                todo.append((first, last))
            else:
                found.append((first, last, int(count)))
    splits: list[Split] = []
    start, held = int(low), 0
    cells_in_order = sorted(found)
    for i, (first, last, count) in enumerate(cells_in_order):
        if held and held + count > most:
            splits.append(Split(start, first - 1, held))
            start, held = first, 0
        held += count
        if i + 1 == len(cells_in_order):
            splits.append(Split(start, int(high), held))
    return splits + rest


def read_by_splits(spark: SparkSession, url: str, table: str, column: str, parts: int, properties: dict | None = None) -> DataFrame:
    """A JDBC read with one query a split.  (Needs a database; only the plan of
    the splits is tested.)"""
    options = dict(properties or {})

    def fetch(query: str) -> list[tuple]:
        return [tuple(r) for r in spark.read.format("jdbc").options(url=url, query=query, **options).load().collect()]

    predicates = [s.predicate(column) for s in plan_splits(fetch, table, column, parts)]
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)
