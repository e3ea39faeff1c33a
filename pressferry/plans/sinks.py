"""Table-level writes: working tables, replacement, archives.

The tables of a warehouse are versions of a table log (``manifest``): data are
written to folders of their own first and named by one new version file after,
so a failed, killed or retried statement (lost executors included) leaves every
table as it was or as it should be.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from pressferry.operators.dml import create_empty, insert
from pressferry.plans.manifest import HadoopFiles, TableLog, Transaction


def create_like(df: DataFrame) -> DataFrame:
    """CREATE TABLE x LIKE y (an empty table with y's schema, no lineage)."""
    return create_empty(df)


def copy_append(target: DataFrame, source: DataFrame) -> DataFrame:
    """INSERT INTO target SELECT * FROM source."""
    return target.unionByName(source)


def archive_swap(clean: DataFrame, original: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live table, archived original): the cleaned table takes the name,
    the original is kept as '..._with_dups'."""
    return clean, original


def fixed_terms_log(fixes: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """The audit table (tid unique, name) with the repaired names added; a
    tid that is logged already, or comes twice, is an error."""
    rows = fixes.select("tid", "name")
    return insert(rows.sparkSession.createDataFrame([], rows.schema) if log is None else log, rows, "tid")


class Warehouse:
    """Named parquet tables under one root directory (shared storage on a
    cluster), each statement one commit of the table log: readers see the state
    before or after it, of all tables it changes.

    ``commit``: an id under which a statement that is retried isn't done twice."""

    def __init__(self, spark: SparkSession, root: str, files: HadoopFiles | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = TableLog(spark, self.root, files)
        self.last_error: str | None = None

    def exists(self, name: str) -> bool:
        return name in self.log.snapshot().tables

    def names(self) -> list[str]:
        return [n for n in self.log.snapshot().names() if not n.startswith("_")]

    def read(self, name: str) -> DataFrame:
        """The table as of now; later commits don't change what it reads."""
        return self.log.snapshot().read(name)

    def folders(self, name: str) -> dict[str, int | None]:
        """The folders that hold the table, with their buckets."""
        return dict(self.log.snapshot().tables[name].parts)

    def transaction(self, commit: str | None = None) -> Transaction:
        """Several statements as one commit."""
        return self.log.begin(commit)

    # S4 / S3 / overwrite ---------------------------------------------------------
    def write(self, name: str, df: DataFrame, commit: str | None = None) -> DataFrame:
        """CREATE TABLE name AS SELECT / overwrite."""
        change = self.transaction(commit)
        change.write(name, df)
        change.commit()
        return self.read(name)

    def append(self, name: str, df: DataFrame, commit: str | None = None) -> bool:
        """S3: append rows; False (and no change) if the write fails, with the
        reason in ``last_error``.  Two appends at once both hold."""
        self.last_error = None
        try:
            change = self.transaction(commit)
            change.append(name, df)
            change.commit()
            return True
        except Exception as error:  # noqa: BLE001 - the statement's contract is a bool
            self.last_error = str(error)
            return False

    # S6 / S7 ------------------------------------------------------------------
    def truncate(self, name: str) -> None:
        """TRUNCATE TABLE: keep the schema, drop every row."""
        self.reset_targets([name], [])

    def drop(self, name: str) -> None:
        """DROP TABLE IF EXISTS."""
        self.reset_targets([], [name])

    def reset_targets(self, truncate: Iterable[str], drop: Iterable[str], commit: str | None = None) -> None:
        """Empty the target tables and drop the working tables before a
        pass, all in one commit.  Tables that aren't there are passed over."""
        change = self.transaction(commit)
        for name in dict.fromkeys(truncate):
            if name in change.base.tables:
                change.empty(name)
        for name in dict.fromkeys(drop):
            change.drop(name)
        if change.changes:
            change.commit()

    def cleanup_working(self, names: Iterable[str]) -> None:
        """Drop the working tables between passes, in one commit."""
        self.reset_targets([], names)

    # S8 / S9 ------------------------------------------------------------------
    def archive_swap(self, name: str, clean: DataFrame, archive_suffix: str = "_with_dups", commit: str | None = None) -> str:
        """The original moves to name + suffix, the cleaned table takes its
        place, both in one commit; no data of the original move.  An archive
        that is there is an error (as for RENAME): it holds an original.
        Returns the archive's name."""
        change = self.transaction(commit)
        archived = name + archive_suffix
        if not change.done:
            change.rename(name, archived)
            change.write(name, clean)
        change.commit()
        return archived

    def log_fixed_terms(self, fixes: DataFrame, name: str = "acc_fixed_term_names") -> DataFrame:
        """Audit table (tid unique, name) of repaired term names."""
        return self.write(name, fixed_terms_log(fixes))
