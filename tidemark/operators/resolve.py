"""From messages to values: one row per key, or the combined message, or everything.

A message has its key columns, ``seq`` (unique per key, newer is larger; any orderable type),
``op`` (INSERT, UPDATE or DELETE) and ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import KeySpec
from tidemark.functions.merge import DELETE, INSERT, UPDATE, MergeSpec

RAW, INTERMEDIATE, FULL = "raw", "intermediate", "full"


def resolve(messages: DataFrame, key: KeySpec, merge: MergeSpec, mode: str = FULL, segment: Column | None = None, hot: bool = False) -> DataFrame:
    """Combine each key's messages, newest over oldest.

    ``raw`` returns every message; ``intermediate`` one message per key, which may still be an
    UPDATE or a DELETE; ``full`` one row per key that is present.  Key columns come from the
    newest message of equal keys.  Columns: key columns, ``sort_key``, ``seq``, ``op``,
    ``value``.

    Last write wins combines before its one exchange, so hot keys cost nothing.  A rule that
    aggregates takes one exchange of all messages, a key in one task; with ``hot`` (which tables
    use) no key ever waits for one task: see :func:`_summed_in_parts`.  Rules that only fold
    combine stretches of ``seq`` first.  ``segment``, an expression that never decreases with
    ``seq`` within a key, sets stretches for any rule.
    """
    rows = key.with_sort_key(messages).select(*key.columns, "sort_key", "seq", "op", "value")
    if mode == RAW:
        return rows
    if segment is None and merge.pair is not None and merge.total is None:
        segment = stretch_of(rows, STRETCH)
    if segment is not None:
        rows = key.with_sort_key(messages).withColumn("__segment", segment)
        rows = _combine(rows, key, merge, ["sort_key", "__segment"])
    out = _combine(rows, key, merge, ["sort_key"], hot)
    return out if mode == INTERMEDIATE else finish(out, merge)


def finish(combined: DataFrame, merge: MergeSpec) -> DataFrame:
    """Turn leftover updates into values, then drop deletions."""
    if merge.pair is not None:
        value = merge.alone(F.col("value"))
        left = F.col("op") == UPDATE
        combined = combined.withColumns({
            "op": F.when(left, merge.insert_or_delete(value, F.lit(True))).otherwise(F.col("op")),
            "value": F.when(left, value).otherwise(F.col("value")),
        })
    return combined.where(F.col("op") != DELETE)


def _combine(rows: DataFrame, key: KeySpec, merge: MergeSpec, by: list[str], hot: bool = False) -> DataFrame:
    columns = [*key.columns, *by, "seq", "op", "value"]
    if merge.pair is None:
        return _latest(rows, key, by).select(*columns)
    combine = _folded if merge.total is None else _summed_in_parts if hot else _summed
    return combine(rows, key, merge, by).select(*columns)


def _above(merge: MergeSpec, op: Column, below: Column, updates: Column) -> Column:
    """The value of updates above an insert or a delete, or of updates that may still meet something below."""
    return F.when(op == INSERT, merge.shape(merge.pair(below, updates))).when(op.isNull(), merge.shape(updates)).otherwise(merge.alone(updates))


def _latest(rows: DataFrame, key: KeySpec, by: list[str]) -> DataFrame:
    """The newest message: partial aggregation, one exchange.  Updates are refused."""
    message = F.struct(*key.columns, "op", "value")
    found = rows.groupBy(*by).agg(F.max_by(message, "seq").alias("m"), F.max("seq").alias("seq"), F.bool_or(F.col("op") == UPDATE).alias("__updates"))
    refused = F.raise_error(F.lit("an UPDATE needs a merge rule"))
    op = F.when(F.col("__updates"), refused).otherwise(F.col("m.op"))
    keys = [F.col(f"m.{c}").alias(c) for c in key.columns if c not in by]
    return found.select(*by, *keys, "seq", op.alias("op"), F.col("m.value").alias("value"))


def _summed(rows: DataFrame, key: KeySpec, merge: MergeSpec, by: list[str]) -> DataFrame:
    """Updates since the last insert or delete, aggregated: a window and an aggregation on one exchange."""
    definite = F.col("op") != UPDATE
    base = F.max(F.when(definite, F.col("seq"))).over(Window.partitionBy(*by))
    kept = rows.withColumn("__base", base).where(F.col("__base").isNull() | (F.col("seq") >= F.col("__base")))
    found = kept.groupBy(*by).agg(
        F.max(F.when(definite, F.col("op"))).alias("__op"),
        F.max(F.when(definite, F.struct("value"))).alias("__v"),
        merge.total(F.when(~definite, F.col("value"))).alias("__u"),
        F.count_if(~definite).alias("__n"),
        F.max_by(F.struct(*key.columns), "seq").alias("__k"),
        F.max("seq").alias("seq"),
    )
    below, op, some = F.col("__v.value"), F.col("__op"), F.col("__n") > 0
    merged = _above(merge, op, below, F.col("__u"))
    value = F.when(some, merged).when(op == INSERT, below)
    new_op = F.when(op.isNull(), UPDATE).when(some, merge.insert_or_delete(merged, F.lit(True))).otherwise(op)
    keys = [F.col(f"__k.{c}").alias(c) for c in key.columns if c not in by]
    return found.select(*by, *keys, "seq", new_op.alias("op"), value.alias("value"))


#: How many parts of a key's updates are summed apart before they meet.
SPREAD = 32


def _equal(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """A join on ``by``, null counting as a value; the right side's columns of that name go."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by]
    met = left.join(right, on, how)
    if how == "full_outer":
        met = met.withColumns({c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in by})
    return met.drop(*[f"__r_{c}" for c in by])


def _summed_in_parts(rows: DataFrame, key: KeySpec, merge: MergeSpec, by: list[str]) -> DataFrame:
    """The same for keys that may hold a third of all messages.

    No window: the last definite message of a key comes from partial aggregation; updates meet
    it in a join (by broadcast if few keys have one), and are summed in parts before the parts
    meet, so that a key that holds a third of all messages never waits for one task.
    """
    names = F.struct(*key.columns)
    is_update = F.col("op") == UPDATE
    definite = rows.where(~is_update).groupBy(*by).agg(
        F.max("seq").alias("__base"), F.max_by(F.struct("op", "value"), "seq").alias("__d"), F.max_by(names, "seq").alias("__dk"),
    )
    updates = _equal(rows.where(is_update), definite.select(*by, "__base"), by, "left")
    updates = updates.where(F.col("__base").isNull() | (F.col("seq") > F.col("__base")))
    part = updates.groupBy(*by, F.pmod(F.xxhash64("seq"), F.lit(SPREAD)).alias("__part")).agg(
        merge.total(F.col("value")).alias("__u"), F.count(F.lit(1)).alias("__n"), F.max("seq").alias("__s"), F.max_by(names, "seq").alias("__uk"),
    )
    whole = part.groupBy(*by).agg(
        merge.total(F.col("__u")).alias("__u"), F.sum("__n").alias("__n"), F.max("__s").alias("__s"), F.max_by("__uk", "__s").alias("__uk"),
    )
    found = _equal(definite, whole, by, "full_outer")
    below, op, some = F.col("__d.value"), F.col("__d.op"), F.col("__n") > 0
    merged = _above(merge, op, below, F.col("__u"))
    value = F.when(some, merged).when(op == INSERT, below)
    new_op = F.when(op.isNull(), UPDATE).when(some, merge.insert_or_delete(merged, F.lit(True))).otherwise(op)
    newest = F.coalesce("__uk", "__dk")
    keys = [newest[c].alias(c) for c in key.columns if c not in by]
    return found.select(*by, *keys, F.coalesce("__s", "__base").alias("seq"), new_op.alias("op"), value.alias("value"))


def _nothing(kind: T.DataType) -> Column:
    """The state of a key without messages."""
    return F.struct(F.lit(None).cast("string").alias("op"), F.lit(None).cast(kind).alias("value"))


def _step(merge: MergeSpec, kind: T.DataType):
    """The state after a message, from the state before it; both have ``op`` and ``value``."""

    def step(old: Column, new: Column) -> Column:
        both = merge.shape(merge.pair(old["value"], new["value"]))
        alone = merge.alone(new["value"])
        op = (
            F.when(new["op"] != UPDATE, new["op"]).when(old["op"].isNull(), F.lit(UPDATE))
            .when(old["op"] == UPDATE, F.lit(UPDATE))
            .when(old["op"] == INSERT, merge.insert_or_delete(both, F.lit(True)))
            .otherwise(merge.insert_or_delete(alone, F.lit(True)))
        )
        value = F.when((new["op"] != UPDATE) | old["op"].isNull() | (old["op"] == DELETE), new["value"]).otherwise(both)
        return F.struct(op.alias("op"), value.cast(kind).alias("value"))

    return step


def _folded(rows: DataFrame, key: KeySpec, merge: MergeSpec, by: list[str]) -> DataFrame:
    """Any associative rule: the messages of a key in order of ``seq``, folded in the JVM.

    A key's messages are held together in memory here; ``segment`` bounds how many.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    listed = F.array_sort(F.collect_list(F.struct("seq", "op", "value")))
    found = rows.groupBy(*by).agg(listed.alias("__m"), F.max_by(F.struct(*key.columns), "seq").alias("__k"), F.max("seq").alias("seq"))
    state = F.aggregate("__m", _nothing(kinds["value"]), _step(merge, kinds["value"]))
    keys = [F.col(f"__k.{c}").alias(c) for c in key.columns if c not in by]
    return found.select(*by, *keys, "seq", state.alias("s")).select(*by, *[c for c in key.columns if c not in by], "seq", "s.op", "s.value")


#: Width of a stretch of ``seq``: how many of a key's messages meet in one group at most; less
#: where every state of the group is kept.
STRETCH, FOLDED = 1 << 16, 1 << 8


def stretch_of(rows: DataFrame, width: int) -> Column | None:
    """An expression that never decreases with ``seq`` and groups ``width`` consecutive values; None if its type has none.

    Numbers are cut by value, structs by their last field within the ones before it.
    """
    kind = rows.schema["seq"].dataType
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col("seq") / width)
    if isinstance(kind, T.StructType) and isinstance(kind.fields[-1].dataType, T.IntegralType):
        names = [f.name for f in kind.fields]
        return F.struct(*[F.col(f"seq.{n}").alias(n) for n in names[:-1]], F.floor(F.col(f"seq.{names[-1]}") / width).alias(names[-1]))
    return None


def old_values(messages: DataFrame, key: KeySpec, merge: MergeSpec, segment: Column | None = None) -> DataFrame:
    """Each message with ``old_found`` and ``old_value``: what a read just before it would have seen.

    A key's history is cut into stretches (``segment``, by default stretches of ``seq``).  Each
    is combined into one message, the state before each of these few is found first, and that
    goes before the stretch's own messages as a message of its own; so no task sees all of a
    hot key's history.
    """
    rows = key.with_sort_key(messages)
    kind = rows.schema["value"].dataType
    folds = merge.pair is not None and merge.total is None
    if segment is None:
        segment = stretch_of(rows, FOLDED if folds else STRETCH)
    rows = rows.withColumn("__segment", F.lit(0) if segment is None else segment)
    by = ["sort_key", "__segment"]
    if folds:
        combined = _states(rows, merge, by, kind)
        carried = _before_folding(combined, merge, kind)
    else:
        combined = _combine(rows, key, merge, by).select("sort_key", F.col("__segment").alias("seq"), "op", "value")
        carried = _before_running(combined.withColumn("__own", F.lit(True)), merge, ["sort_key"])
    found = _with_carried(rows, carried, merge, by, kind)
    found = finish_state(found, merge)
    there = F.coalesce(F.col("__before_op") == INSERT, F.lit(False))
    found = found.withColumns({"old_found": there, "old_value": F.when(there, F.col("__before"))})
    return found.select(*messages.columns, "old_found", "old_value")


def _with_carried(rows: DataFrame, carried: DataFrame, merge: MergeSpec, by: list[str], kind: T.DataType) -> DataFrame:
    """``rows`` with the state before each, given that before each of their stretches (sort_key, seq)."""
    first = carried.where(F.col("__before_op").isNotNull()).select(
        "sort_key", F.col("seq").alias("__segment"), F.col("__before_op").alias("op"), F.col("__before").alias("value")
    )
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in rows.columns if c not in (*by, "op", "value")]
    both = rows.withColumn("__own", F.lit(True)).unionByName(first.select("*", *blank, F.lit(False).alias("__own")))
    if merge.pair is not None and merge.total is None:
        return _folded_states(both, merge, by, kind).where("__own")
    return _before_running(both, merge, by).where("__own")


def finish_state(rows: DataFrame, merge: MergeSpec) -> DataFrame:
    """States that are still updates as a read would finish them."""
    left = F.col("__before_op") == UPDATE
    value = merge.alone(F.col("__before"))
    return rows.withColumns({
        "__before_op": F.when(left, merge.insert_or_delete(value, F.lit(True))).otherwise(F.col("__before_op")),
        "__before": F.when(left, value).otherwise(F.col("__before")),
    })


def _states(rows: DataFrame, merge: MergeSpec, by: list[str], kind: T.DataType) -> DataFrame:
    """(sort_key, seq, op, value): each stretch of a rule that folds as one message, ``seq`` being the stretch."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "op", "value")))
    found = rows.groupBy(*by).agg(listed.alias("__m")).withColumn("__s", F.aggregate("__m", _nothing(kind), _step(merge, kind)))
    return found.select("sort_key", F.col("__segment").alias("seq"), "__s.op", "__s.value")


def _before_folding(rows: DataFrame, merge: MergeSpec, kind: T.DataType, levels: int = 2) -> DataFrame:
    """(sort_key, seq, op, value) with the state before each: stretches of stretches first, ``levels`` times."""
    segment = stretch_of(rows, FOLDED) if levels else None
    rows = rows.withColumn("__segment", F.lit(0) if segment is None else segment)
    by = ["sort_key", "__segment"]
    if segment is None:
        return _folded_states(rows.withColumn("__own", F.lit(True)), merge, by, kind)
    return _with_carried(rows, _before_folding(_states(rows, merge, by, kind), merge, kind, levels - 1), merge, by, kind)


def _after(merge: MergeSpec, op: Column, below: Column, updates: Column, some: Column) -> tuple[Column, Column]:
    """Op and value of a state: its first message's op and value, and the total of the updates from there on."""
    merged, alone = _above(merge, op, below, updates), op == UPDATE
    after_op = F.when(alone, UPDATE).when(some, merge.insert_or_delete(merged, F.lit(True))).otherwise(op)
    return after_op, F.when(alone, merge.shape(updates)).when(some, merged).otherwise(below)


def _before_running(rows: DataFrame, merge: MergeSpec, by: list[str]) -> DataFrame:
    """``rows`` with the op and value before each, within ``by``: running aggregates."""
    order = Window.partitionBy(*by).orderBy("__own", "seq")
    if merge.pair is None:
        after_op, after = F.col("op"), F.col("value")
    else:
        definite = F.col("op") != UPDATE
        rows = rows.withColumn("__g", F.sum(definite.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        group = Window.partitionBy(*by, "__g").orderBy("__own", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({
            "__op": F.first("op").over(group), "__b": F.first("value").over(group),
            "__u": merge.total(F.when(~definite, F.col("value"))).over(group), "__some": F.count_if(~definite).over(group) > 0,
        })
        after_op, after = _after(merge, F.col("__op"), F.col("__b"), F.col("__u"), F.col("__some"))
    rows = rows.withColumns({"__after": after, "__after_op": after_op})
    return rows.withColumns({"__before_op": F.lag("__after_op").over(order), "__before": F.lag("__after").over(order)})


def _folded_states(rows: DataFrame, merge: MergeSpec, by: list[str], kind: T.DataType) -> DataFrame:
    """``rows`` with the op and value before each, within ``by``, for rules that only fold: a group's
    messages, no more than a stretch, are folded one after the other in the JVM."""
    columns = [c for c in rows.columns if c not in by]
    listed = F.array_sort(F.collect_list(F.struct("__own", "seq", *[c for c in columns if c not in ("__own", "seq")])))
    step = _step(merge, kind)
    none = F.array(_nothing(kind))
    states = F.aggregate("__m", none, lambda done, new: F.concat(done, F.array(step(F.element_at(done, -1), new))))
    found = rows.groupBy(*by).agg(listed.alias("__m")).withColumn("__s", states)
    found = found.select(*by, F.explode(F.arrays_zip("__m", F.slice("__s", 1, F.size("__m")).alias("__s"))).alias("__z"))
    return found.select(*by, *[F.col(f"__z.__m.{c}").alias(c) for c in columns], F.col("__z.__s.op").alias("__before_op"), F.col("__z.__s.value").alias("__before"))
