"""Write-semantics kernel: what the MySQL verbs of a migration script mean,
as pure DataFrame -> DataFrame functions (K1-K10).

Parquet tables in open-source Spark accept no UPDATE / MERGE, so every verb
returns the new table state; a sink (``pressferry.plans.sinks``) writes it.

Scale notes
-----------
* "Keep one row per key" never uses a window: a window puts every row of a
  key into one task, and one key may hold a third of the data.  Instead
  :func:`pick_one` computes the winning order value per key with a partial
  (map-side combined) aggregate over narrow columns, then semi-joins the rows
  on ``(key, order)``.  That join is hash-partitioned on the order columns
  too, so a hot key spreads over all partitions.
* Look-ups that could be broadcast are left to AQE, which measures the build
  side at runtime against ``autoBroadcastJoinThreshold`` and keeps a shuffle
  join above it.  Explicit ``broadcast()`` is used only for tables whose size
  is bounded by a parameter (a literal list).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Key = str | Sequence[str]



def _key_cols(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _not_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def _match(cols: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of ``cols`` with their ``prefix``-renamed copies
    (distinct names, so self-joins of one lineage stay unambiguous)."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(cols)])


def _match_eq(cols: Sequence[str], prefix: str) -> Column:
    """Plain equality with the renamed copies: for joins whose right side has
    no NULL keys (same result as null-safe, and the join keys equal the
    right side's hash partitioning, so no second shuffle)."""
    return reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{prefix}{i}") for i, c in enumerate(cols)])


def _renamed(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{i}") for i, c in enumerate(cols)])


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
             largest: bool = True) -> DataFrame:
    """One row per ``keys`` group (NULL keys form one group, as GROUP BY):
    the row with the largest (or smallest) ``order`` tuple.

    ``order`` must be unique within a group.  Skew-safe: see module notes.
    """
    keys, order = list(keys), list(order)
    if not order:
        return df
    winners = _extreme_per_key(df, keys, order, "_pk", largest)
    return df.join(winners, _match(keys + order, "_pk"), "left_semi")


def _extreme_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], prefix: str,
                     largest: bool) -> DataFrame:
    """(key, order) of the largest/smallest-order row per key, one row per key
    value, columns renamed ``prefix0..``.  A single order column aggregates
    with a plain max/min (hash aggregate, map-side combined); several use a
    struct (sort aggregate)."""
    agg = F.max if largest else F.min
    n = len(keys)
    grouped = df.groupBy(*[F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)])
    if len(order) == 1:
        return grouped.agg(agg(order[0]).alias(f"{prefix}{n}"))
    ordc = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    win = grouped.agg(agg(ordc).alias("_win"))
    return win.select(*[F.col(f"{prefix}{i}") for i in range(n)],
                      *[F.col(f"_win._o{i}").alias(f"{prefix}{n + i}") for i in range(len(order))])


def with_defaults(incoming: DataFrame, like: DataFrame,
                  defaults: Mapping[str, object] | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Give ``incoming`` the column list and types of ``like``; columns the
    statement does not name take their default (NULL unless given).  ``keep``
    names extra incoming columns to carry along at the end."""
    defaults = defaults or {}
    cols = []
    for field in like.schema.fields:
        if field.name in incoming.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name))
    return incoming.select(*cols, *[F.col(c) for c in keep])


# K1 ------------------------------------------------------------------------

def replace_into(existing: DataFrame, incoming: DataFrame, keys: Sequence[Key],
                 order: Sequence[str] = (), *, defaults: Mapping[str, object] | None = None,
                 incoming_unique: bool = False, incoming_keys: DataFrame | None = None) -> DataFrame:
    """REPLACE INTO: each new row deletes every row equal to it on *any*
    unique key; within the batch later rows (larger ``order``) win.

    A row survives iff no later row equals it on any key (a later row is
    itself inserted, so it deletes the earlier one whether or not it is later
    deleted).  Hence an existing row survives iff no incoming row shares any
    of its keys, and an incoming row survives iff it is the last incoming row
    of each of its key values.  NULL key values never conflict.  ``order``
    must make incoming rows unique per key (a total tie-break, e.g. the source
    id); MySQL gives no order inside one INSERT ... SELECT.

    ``existing`` appears once in the plan (chains of upserts stay linear) and
    every join is against narrow key columns or one-row-per-key winners.

    ``incoming_unique``: the caller guarantees (e.g. from source primary
    keys) that incoming rows are unique on every key, so the batch needs no
    de-duplication and its wide rows are not shuffled for it.
    ``incoming_keys``: a cheaper plan giving exactly the batch's key values
    (with the key columns' names), used for the anti join of existing rows.
    """
    order = list(order)
    # Tie-break columns that are not target columns ride along and are dropped.
    extra = [c for c in order if c not in existing.columns]
    incoming = with_defaults(incoming, existing, defaults, keep=extra)
    if not order and not incoming_unique:
        # No tie-break given: equal rows collapse, different rows order by value.
        incoming, order = incoming.distinct(), list(incoming.columns)
    kept_old = existing
    kept_new = incoming
    for n, key in enumerate(keys):
        kc = _key_cols(key)
        # Distinct keys: a hot key reaches the anti join once (the aggregate's
        # hash partitioning is the one the join needs, so no extra shuffle).
        key_source = incoming if incoming_keys is None else incoming_keys
        new_keys = _renamed(key_source.where(_not_null(kc)), kc, f"_x{n}k").distinct()
        kept_old = kept_old.join(new_keys, _match_eq(kc, f"_x{n}k"), "left_anti")
        if incoming_unique:
            continue
        winners = _last_per_key(incoming.where(_not_null(kc)), kc, order, f"_w{n}k")
        hit = f"_w{n}hit"
        kept_new = (kept_new.join(winners.withColumn(hit, F.lit(True)), _match(kc + order, f"_w{n}k"), "left")
                    .where(F.col(hit) | ~_not_null(kc))
                    .select(*kept_new.columns))
    return kept_old.unionByName(kept_new.drop(*extra))


def _last_per_key(df: DataFrame, kc: Sequence[str], order: Sequence[str], prefix: str) -> DataFrame:
    return _extreme_per_key(df, kc, order, prefix, largest=True)


# K2 ------------------------------------------------------------------------

def insert_ignore(existing: DataFrame, incoming: DataFrame, key: Key | None = None,
                  order: Sequence[str] = (), *, defaults: Mapping[str, object] | None = None,
                  incoming_unique: bool = False) -> DataFrame:
    """INSERT IGNORE with one unique key: an existing row is kept; inside the
    batch the first row (smallest ``order``) wins; NULL keys never conflict.
    Without a key it is a plain append.  ``incoming_unique``: the caller
    guarantees unique batch keys (source primary key), so the batch needs no
    pick and is read once."""
    incoming = with_defaults(incoming, existing, defaults)
    if key is None:
        return existing.unionByName(incoming)
    kc = _key_cols(key)
    if incoming_unique:
        fresh = incoming.join(_renamed(existing.where(_not_null(kc)), kc, "_ek"), _match_eq(kc, "_ek"), "left_anti")
        return existing.unionByName(fresh)
    keyed = incoming.where(_not_null(kc))
    if not order:
        # No tie-break given: equal rows collapse, different rows order by value.
        keyed, order = keyed.distinct(), [c for c in keyed.columns if c not in kc]
    first = pick_one(keyed, kc, list(order), largest=False)
    fresh = first.join(_renamed(existing.where(_not_null(kc)), kc, "_ek"), _match_eq(kc, "_ek"), "left_anti")
    return existing.unionByName(fresh).unionByName(incoming.where(~_not_null(kc)))


def insert_ignore_keys(existing: DataFrame, incoming: DataFrame, keys: Sequence[Key], order: Sequence[str], *,
                       defaults: Mapping[str, object] | None = None, rounds: list[dict] | None = None) -> DataFrame:
    """INSERT IGNORE with several unique keys: the batch goes in ``order`` (a
    total one), and a row is left out if an existing row, or a row of the batch
    that went in before, equals it on any key.  NULL keys never conflict.

    What goes in is the lexicographically first independent set of the rows, of
    which two are neighbours if they share a key value.  It is found in rounds
    over narrow rows (row number, group numbers), each cut by a reliable
    checkpoint:

    * a row that is first in all its groups goes in;
    * a row with exactly one undecided row before it, in all its groups together,
      does the opposite of that one; such rows form chains, which are followed by
      pointer doubling, so a chain of n rows takes log2(n) steps of one round;
    * rows that share a group with one that went in are left out.

    So only rows behind two or more undecided ones wait for the next round.  The
    number of rounds is at most the number of such rows on one path of conflicts
    (a few in practice, logarithmic for a random order); ``rounds`` gets a record
    of each.
    """
    extra = [c for c in order if c not in existing.columns]
    incoming = with_defaults(incoming, existing, defaults, keep=extra)
    for n, key in enumerate(keys):
        kc = _key_cols(key)
        taken = _renamed(existing.where(_not_null(kc)), kc, f"_t{n}k").distinct()
        incoming = incoming.join(taken, _match_eq(kc, f"_t{n}k"), "left_anti")
    rows = numbered(incoming, order, "_rn")
    narrow = rows.select("_rn", *dict.fromkeys(c for key in keys for c in _key_cols(key)))
    entries = None
    for n, key in enumerate(keys):
        kc = _key_cols(key)
        groups = narrow.where(_not_null(kc)).groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(kc)]).agg(F.min("_rn").alias("g"), F.count(F.lit(1)).alias("_n"))
        shared = groups.where("_n > 1").drop("_n")  # alone in its group: no conflict there
        one = narrow.join(shared, _match_eq(kc, "_g")).select(F.lit(n).alias("k"), "g", "_rn")
        entries = one if entries is None else entries.unionByName(one)
    open_rows = settled(entries)
    left_out = None
    while (undecided := open_rows.select("_rn").distinct().count()):
        accepted, steps = _decided(open_rows)
        held = open_rows.join(accepted, "_rn", "left_semi").select("k", "g").distinct()
        struck = settled(open_rows.join(held, ["k", "g"], "left_semi").select("_rn").distinct().join(accepted, "_rn", "left_anti"))
        open_rows = settled(open_rows.join(struck, "_rn", "left_anti").join(accepted, "_rn", "left_anti"))
        left_out = struck if left_out is None else left_out.unionByName(struck)
        if rounds is not None:
            rounds.append({"undecided": undecided, "accepted": accepted.count(), "left_out": struck.count(), "chain_steps": steps})
    fresh = rows if left_out is None else rows.join(left_out, "_rn", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def _decided(open_rows: DataFrame) -> tuple[DataFrame, int]:
    """_rn of the rows that go in by what is known now, and the number of
    doubling steps."""
    first = open_rows.groupBy("k", "g").agg(F.min("_rn").alias("first"))
    led = open_rows.join(first, ["k", "g"])
    second = led.where("_rn > first").groupBy("k", "g").agg(F.min("_rn").alias("second"))
    before = (led.join(second, ["k", "g"], "left")
              .withColumn("before", F.when(F.col("_rn") > F.col("first"), F.col("first")))
              .withColumn("more", F.col("_rn") > F.coalesce("second", "_rn")))
    waits = settled(before.groupBy("_rn").agg(F.max("more").alias("more"), F.min("before").alias("to"), F.max("before").alias("also")))
    free = waits.where("to IS NULL").select("_rn")
    chain = waits.where("NOT more AND to = also").select("_rn", "to", F.lit(True).alias("odd"))
    steps = 0
    while True:
        onward = chain.select(F.col("_rn").alias("to"), F.col("to").alias("next"), F.col("odd").alias("odd_next"))
        moved = chain.join(onward, "to", "left")
        if moved.where("next IS NOT NULL").isEmpty():
            break
        chain = settled(moved.select("_rn", F.coalesce("next", "to").alias("to"), (F.col("odd") != F.coalesce("odd_next", F.lit(False))).alias("odd")))
        steps += 1
    follows = chain.where("NOT odd").join(free.select(F.col("_rn").alias("to")), "to", "left_semi").select("_rn")
    return settled(free.unionByName(follows)), steps


# K3 ------------------------------------------------------------------------

def insert(existing: DataFrame, incoming: DataFrame, key: Key | Sequence[Key] | None = None, *,
           defaults: Mapping[str, object] | None = None, check: bool = True,
           incoming_unique: bool = False, few: bool = False) -> DataFrame:
    """INSERT: append; a duplicate key is an error (raised when the result is
    computed).  ``key``: one unique key (a column or a tuple of columns), or a
    list of them.

    For each key one aggregate over the narrow keys of both tables (combined
    map-side) finds the values that an incoming row shares with any other row;
    one join brings the finding back to the incoming rows.  The existing rows
    pass through untouched.  ``incoming_unique`` (e.g. a DISTINCT on exactly the
    key) says that the batch doesn't repeat its key: then one join with the
    distinct existing keys is all (an existing key that comes twice is one).
    ``few``: the batch is a few rows; the existing keys are only looked up by a
    semi join with it (broadcast at run time), not shuffled.
    """
    incoming = with_defaults(incoming, existing, defaults)
    if key is None or not check:
        return existing.unionByName(incoming)
    checked = incoming
    for i, one in enumerate(key if isinstance(key, list) else [key]):
        kc = _key_cols(one)
        names = [f"_dk{i}_{j}" for j in range(len(kc))]
        keys = lambda df, new: df.where(_not_null(kc)).select(
            *[F.col(c).alias(n) for c, n in zip(kc, names, strict=True)], F.lit(new).alias("_new"))  # noqa: B023
        if incoming_unique:
            taken = keys(existing, 0).drop("_new").distinct().withColumn(f"_dup{i}", F.lit(True))
        else:
            old = keys(existing, 0)
            if few:
                mine = _renamed(incoming.where(_not_null(kc)), kc, f"_few{i}_").distinct()
                old = old.join(mine, _match_eq(names, f"_few{i}_"), "left_semi")
            taken = (old.unionByName(keys(incoming, 1)).groupBy(*names)
                     .agg(F.sum("_new").alias("_in"), F.count(F.lit(1)).alias("_all"))
                     .where((F.col("_in") > 0) & (F.col("_all") > 1))
                     .select(*names, F.lit(True).alias(f"_dup{i}")))
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(n) for c, n in zip(kc, names, strict=True)])
        guard = F.when(F.col(f"_dup{i}"), F.raise_error(F.lit(f"duplicate key {list(kc)} on INSERT"))).otherwise(F.lit(True))
        checked = checked.join(taken, on, "left").where(guard.cast("boolean")).select(*incoming.columns)
    return existing.unionByName(checked)


# K4 ------------------------------------------------------------------------

def settled(df: DataFrame) -> DataFrame:
    """Computed now and kept in the reliable checkpoint folder."""
    from pressferry.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_tasks(spark: SparkSession, task_mb: int = 8) -> Iterator[None]:
    """For jobs on narrow rows that run within it: adaptive execution merges
    partitions up to ``task_mb`` (or to the session's size, if that is less), not
    up to its usual 64 or 128 MB.  Those are compressed bytes: of rows of two ids
    they hold ten million and more, which a hash aggregate or a sort then keeps in
    one task.  The number of partitions before merging stays the session's."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    number, unit = re.fullmatch(r"(\d+)([a-z]?)b?", (before or "64m").strip().lower()).groups()
    if int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit] > task_mb << 20:
        spark.conf.set(key, f"{task_mb}m")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def numbered(df: DataFrame, order: Sequence[str], name: str, base: Column | int = 0) -> DataFrame:
    """The rows with a dense number base + 1, + 2, ... in ``order``.

    Distributed: the rows are range-sorted and written to the reliable
    checkpoint directory (stable partitions), each partition's row count
    gives its offset (one row per partition, a bounded table), and numbers are
    ``base + offset + index within partition``.  No single-partition window."""
    from pyspark.sql import Window

    ranked = settled(df.orderBy(*order))
    tagged = ranked.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    # monotonically_increasing_id = (partition << 33) + index within partition
    tagged = tagged.withColumn("_idx", F.col("_mono") - F.shiftleft(F.col("_part").cast("bigint"), 33))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the window runs over a table bounded by the
    # partition count, not by the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    base = F.lit(base) if isinstance(base, int) else base
    return (tagged.join(F.broadcast(offsets), "_part").withColumn(name, base + F.col("_off") + F.col("_idx") + 1)
            .drop("_part", "_mono", "_idx", "_off"))


def insert_auto_id(existing: DataFrame, incoming: DataFrame, id_col: str,
                   order: Sequence[str], *, defaults: Mapping[str, object] | None = None,
                   bounded: bool = False, only_new: bool = False) -> DataFrame:
    """INSERT with an AUTO_INCREMENT key: new ids are max(existing)+1, +2, ...
    in ``order`` order (dense, deterministic).

    ``order`` should end with a column that tells rows apart (a source id):
    equal order tuples can't be split over range partitions, so without one a
    name that a third of the rows share would sort in one task.

    ``bounded``: the caller has bounded the batch by a parameter (a list of
    ids), so its rows are numbered as one sorted array, in the same plan and
    without a job of their own; any other batch is numbered by :func:`numbered`.
    ``only_new``: the inserted rows without the existing ones.
    """
    payload = [c for c in incoming.columns if c != id_col]
    base = existing.select(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()
    into = create_empty(existing) if only_new else existing
    if not bounded:
        return insert(into, numbered(incoming.select(*payload), order, id_col, base), id_col, defaults=defaults, check=False)
    row = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in payload])
    listed = incoming.agg(F.sort_array(F.collect_list(row)).alias("rows")).select(F.posexplode("rows").alias("_at", "_row"))
    fresh = listed.select((base + F.col("_at") + 1).alias(id_col), *[F.col(f"_row.{c}").alias(c) for c in payload])
    return insert(into, fresh, id_col, defaults=defaults, check=False)


def create_empty(df: DataFrame) -> DataFrame:
    """No rows, the same schema, no lineage.  The false filter lets the
    optimizer drop all that is joined to it."""
    return df.sparkSession.createDataFrame([], df.schema).where(F.lit(False))


# K5 ------------------------------------------------------------------------

def update_where(df: DataFrame, predicate: Column | None,
                 assignments: Mapping[str, Column | object]) -> DataFrame:
    """UPDATE ... SET col = value WHERE predicate.  The predicate is evaluated
    on the original row; a NULL predicate changes nothing; assignments apply
    left to right (a later one sees the earlier new value), as MySQL does."""
    pred = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    items = list(assignments.items())
    if len(items) == 1:
        # One projection: no helper column, one analysis of the plan.
        name, value = items[0]
        value = value if isinstance(value, Column) else F.lit(value)
        dtype = df.schema[name].dataType
        new = F.when(pred, value.cast(dtype)).otherwise(F.col(name)).alias(name)
        return df.select(*[new if c == name else F.col(c) for c in df.columns])
    out = df.withColumn("_upd", pred)
    for name, value in items:
        value = value if isinstance(value, Column) else F.lit(value)
        dtype = df.schema[name].dataType
        out = out.withColumn(name, F.when(F.col("_upd"), value.cast(dtype)).otherwise(F.col(name)))
    return out.drop("_upd")


# K6 ------------------------------------------------------------------------

def update_from_join(target: DataFrame, source: DataFrame, on: Mapping[str, str],
                     assignments: Mapping[str, str | Column], *,
                     source_order: Sequence[str] | None = None,
                     predicate: Column | None = None, source_unique: bool = False) -> DataFrame:
    """UPDATE target JOIN source ON target.k = source.k SET target.c = source.v.

    ``on`` maps target column -> source column.  Where several source rows
    match, MySQL takes an arbitrary one; here the smallest ``source_order``
    (default: the join key) wins.  A matched row is updated even when the new
    value is NULL (a matched flag, not ``coalesce``).  ``assignments`` maps
    target column -> source column name or an expression over ``_src_*``
    columns.  ``source_unique``: the source holds its join key once (a primary
    key), so nothing is picked; wide values then only pass through the join.
    """
    tkeys, skeys = list(on.keys()), list(on.values())
    src_cols = sorted({v for v in assignments.values() if isinstance(v, str)} | set(skeys)
                      | set(source_order or []))
    one = source.where(_not_null(skeys)).select(*src_cols)
    if not source_unique:
        if not source_order:
            one = one.distinct()
            source_order = [c for c in src_cols if c not in skeys]
        one = pick_one(one, skeys, list(source_order), largest=False)
    renamed = one.select(*[F.col(c).alias(f"_src_{c}") for c in src_cols]).withColumn("_matched", F.lit(True))
    cond = reduce(lambda a, b: a & b, [F.col(t) == F.col(f"_src_{s}") for t, s in on.items()])
    joined = target.join(renamed, cond, "left")
    pred = F.col("_matched").isNotNull()
    if predicate is not None:
        pred = pred & F.coalesce(predicate, F.lit(False))
    out = joined
    for name, value in assignments.items():
        expr = F.col(f"_src_{value}") if isinstance(value, str) else value
        out = out.withColumn(name, F.when(pred, expr.cast(target.schema[name].dataType)).otherwise(F.col(name)))
    return out.select(*target.columns)


# K7 ------------------------------------------------------------------------

def update_with_count(target: DataFrame, target_key: str, counted: DataFrame, counted_key: str,
                      out_col: str, count_col: str | None = None) -> DataFrame:
    """SET out = (SELECT COUNT(c) FROM counted WHERE counted.k = target.k):
    pre-aggregated (map-side combine), then one left join; 0 when none."""
    cnt = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    agg = counted.groupBy(F.col(counted_key).alias("_ck")).agg(cnt.alias("_cnt"))
    joined = target.join(agg, F.col(target_key) == F.col("_ck"), "left")
    value = F.coalesce(F.col("_cnt"), F.lit(0)).cast("bigint")
    cols = [value.alias(out_col) if c == out_col else F.col(c) for c in target.columns]
    if out_col not in target.columns:
        cols.append(value.alias(out_col))
    return joined.select(*cols)


# K8 ------------------------------------------------------------------------

def update_scalar_lookup(target: DataFrame, predicate: Column, column: str,
                         lookup: DataFrame) -> DataFrame:
    """SET column = (SELECT v FROM lookup) WHERE predicate: a scalar subquery
    (NULL when the lookup is empty, an error when it has more than one row)."""
    return update_where(target, predicate, {column: lookup.scalar()})


# K9 ------------------------------------------------------------------------

def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """DELETE WHERE predicate: rows where the predicate is NULL stay."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


# K10 -----------------------------------------------------------------------

def not_in_flag(df: DataFrame, probe: str, values: DataFrame, value_col: str,
                out: str = "_not_in") -> DataFrame:
    """Adds ``probe NOT IN (SELECT value_col FROM values)`` with SQL's
    three-valued result: NULL probe -> NULL (unless the list is empty), any
    NULL in the list -> never TRUE.

    Written as a left join to the distinct values (partial aggregate, then a
    shuffle or AQE-measured broadcast join) plus two EXISTS subqueries, not as
    the null-aware anti join, which needs a broadcast of the whole list.
    """
    ids = values.where(F.col(value_col).isNotNull()).select(
        F.col(value_col).alias("_nin_v")).distinct().withColumn("_nin_hit", F.lit(True))
    joined = df.join(ids, F.col(probe) == F.col("_nin_v"), "left")
    # One narrow aggregate of the list answers both NULL rules (a single
    # scalar subquery, evaluated once).
    stats = values.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                F.count_if(F.col(value_col).isNull()).alias("nulls"))).scalar()
    has_null = stats["nulls"] > 0
    non_empty = stats["n"] > 0
    flag = (F.when(~non_empty, F.lit(True))
            .when(F.col(probe).isNull(), F.lit(None).cast("boolean"))
            .when(F.col("_nin_hit"), F.lit(False))
            .when(has_null, F.lit(None).cast("boolean"))
            .otherwise(F.lit(True)))
    return joined.select(*df.columns, flag.alias(out))


def update_where_not_in(df: DataFrame, probe: str, values: DataFrame, value_col: str,
                        assignments: Mapping[str, Column | object]) -> DataFrame:
    """UPDATE ... WHERE probe NOT IN (SELECT value_col FROM values)."""
    flagged = not_in_flag(df, probe, values, value_col, out="_nin")
    return update_where(flagged, F.col("_nin"), assignments).drop("_nin")
