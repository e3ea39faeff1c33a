"""Incremental passes with Structured Streaming.

The reference has no streams; this module only lets the same batch
operators run as new source rows arrive.  Each micro-batch is transformed by
the batch function and upserted (REPLACE, K1) into a warehouse table in one
commit.  REPLACE is idempotent, so a micro-batch replayed after a
failure (Structured Streaming's at-least-once ``foreachBatch``) leaves the same
table; the stream's own checkpoint records the progress.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pressferry.operators.dml import replace_into
from pressferry.plans.manifest import bucket_of
from pressferry.plans.sinks import Warehouse


def upsert_batches(warehouse: Warehouse, table: str, transform: Callable[[DataFrame], DataFrame],
                   keys: Sequence, order: Sequence[str] = (), *, empty: DataFrame | None = None,
                   incoming_unique: bool = False) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: REPLACE ``transform(batch)`` into ``table``."""

    def handle(batch: DataFrame, epoch_id: int) -> None:
        incoming = transform(batch)
        if warehouse.exists(table):
            existing = warehouse.read(table)
        elif empty is not None:
            existing = empty
        else:
            existing = incoming.limit(0)
        result = replace_into(existing, incoming, keys, order, incoming_unique=incoming_unique)
        warehouse.write(table, result)

    return handle


def upsert_bucketed(warehouse: Warehouse, table: str, transform: Callable[[DataFrame], DataFrame],
                    key: str, order: Sequence[str] = (), *, buckets: int = 64,
                    empty: DataFrame | None = None,
                    incoming_unique: bool = False) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that REPLACEs into a table cut into buckets
    by a hash of its single unique key and rewrites only the buckets the
    micro-batch touches (a row can only conflict inside its own bucket), all of
    them in one commit.

    The touched bucket numbers (at most ``buckets`` small integers, a bound
    set by the parameter) are the only values brought to the driver.
    """

    def handle(batch: DataFrame, epoch_id: int) -> None:
        incoming = transform(batch)
        touched = sorted(r[0] for r in incoming.select(bucket_of([key], buckets).alias("b")).distinct().collect())
        if not touched:
            return
        change = warehouse.transaction()
        if table not in change.base.tables:
            existing = empty if empty is not None else incoming.limit(0)
            change.write(table, replace_into(existing, incoming, [key], order, incoming_unique=incoming_unique), keys=[key], buckets=buckets)
        else:
            existing = change.base.read(table, touched)
            change.replace_buckets(table, replace_into(existing, incoming, [key], order, incoming_unique=incoming_unique), touched)
        change.commit()

    return handle


def run(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint_location: str,
        *, available_now: bool = True) -> StreamingQuery:
    """Start the stream (``availableNow`` processes what is there, then stops)."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
