"""pressferry: audit, repair and migrate publishing-system content with Spark.

Subpackages: ``functions`` (column expressions), ``sources`` (table readers and
fixture views), ``operators`` (the write-semantics kernel and the audit,
repair and transform statements), ``plans`` (sinks and the runbook),
``streaming`` (micro-batch adapter), ``checks`` (DuckDB oracle).
"""

__version__ = "0.1.0"
