"""Read a source table, whatever holds it, under its canonical name.

* a mapping of DataFrames (already loaded views),
* a directory of parquet tables (``<root>/<table>`` or ``<root>/<table>.parquet``),
* a JDBC database, read in parallel by ranges of a numeric key column,
* the session catalog.

Version-7 table and column names are mapped to the canonical (version-6)
names, so every operator sees one schema.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from pressferry.schemas import V7_TABLE_RENAMES, canonical_name, canonicalize

_V6_TO_V7 = {v: k for k, v in V7_TABLE_RENAMES.items()}


def read_table(source, table: str, *, version: str | float = "6", spark: SparkSession | None = None,
               jdbc_url: str | None = None, jdbc_properties: dict | None = None,
               partition_column: str | None = None, lower_bound: int | None = None,
               upper_bound: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Canonical DataFrame of ``table`` (a canonical name; the version picks
    the physical name)."""
    physical = table
    try:
        if float(version) >= 7.0:
            physical = _V6_TO_V7.get(table, table)
    except (TypeError, ValueError):
        pass
    if isinstance(source, Mapping):
        df = source[physical] if physical in source else source[table]
    elif jdbc_url is not None:
        assert spark is not None, "a session is needed for JDBC"
        options = dict(jdbc_properties or {})
        if partition_column is not None:
            # Parallel scan: one query per key range instead of one cursor.
            df = spark.read.jdbc(jdbc_url, physical, column=partition_column, lowerBound=lower_bound,
                                 upperBound=upper_bound, numPartitions=num_partitions or 64,
                                 properties=options)
        else:
            df = spark.read.jdbc(jdbc_url, physical, properties=options)
    elif isinstance(source, str):
        assert spark is not None, "a session is needed for a parquet root"
        path = f"{source.rstrip('/')}/{physical}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        df = spark.read.parquet(path if fs.exists(p) else path + ".parquet")
    elif isinstance(source, SparkSession):
        df = source.table(physical)
    else:
        raise TypeError(f"unsupported source {type(source).__name__}")
    return canonicalize(canonical_name(physical), df)
