"""Ordered merge-on-read tables: batches of messages in, resolved rows out.

A table is a folder of immutable Parquet runs and manifests.  Appending a batch writes one
run, sorted by key, and commits a manifest; a read pins one manifest, so it sees a snapshot
whatever is written meanwhile.  Compaction rewrites a key range into one run and never
changes what a read returns.
"""

from __future__ import annotations

import time
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import MAX_KEY_BYTES, KeySpec, oversize
from tidemark.functions.merge import DELETE, INSERT, UPDATE, MergeSpec
from tidemark.operators import scan as reads
from tidemark.operators.cursor import Cursor
from tidemark.operators.resolve import FULL, INTERMEDIATE, old_values, resolve
from tidemark.operators.scan import Bounds, Ranges
from tidemark.sources.manifest import Conflict, Files, Manifest, Run, dump, load, plain, save, versions


@dataclass(frozen=True)
class Options:
    """``fanout``: runs beyond which :meth:`Table.maintain` compacts; ``part_rows``: about how many
    messages one step of it rewrites; ``rows_per_file``: a file's most rows; ``delta_rows``: an append that
    leaves more messages than this in uncompacted runs compacts before it returns (None: never);
    ``precombine``: combine a batch's messages of one key before they are written, so that history keeps
    one message a key and batch; ``check_unique``: refuse batches that repeat a key and ``seq``;
    ``max_key_bytes``: larger keys are refused (None: any size); ``bloom``: write Parquet bloom filters on
    the key; ``put_if_absent``: creates a file (path, text) if it isn't there and tells whether it did,
    for stores where nothing else is atomic."""

    fanout: int = 8
    part_rows: int = 50_000_000
    rows_per_file: int = 20_000_000
    delta_rows: int | None = None
    precombine: bool = False
    check_unique: bool = True
    max_key_bytes: int | None = MAX_KEY_BYTES
    bloom: bool = True
    put_if_absent: Callable[[str, str], bool] | None = None


#: Upper limits of the latency histogram's buckets, in milliseconds.
LATENCIES = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10_000, 60_000]
#: How often a commit is tried again on top of what another writer committed.
TRIES = 50


class Notification:
    """Tells when maintenance is done: poll it, wait for it, or block at once."""

    def __init__(self, user_data: Any = None, blocking: bool = False):
        self.user_data, self.blocking, self._future = user_data, blocking, None

    def attach(self, future: Future) -> None:
        self._future = future

    def poll(self) -> bool:
        """Whether the work is done; raises what it raised."""
        if self._future is None or not self._future.done():
            return False
        self._future.result()
        return True

    def wait(self, timeout: float | None = None) -> None:
        if self._future is not None:
            self._future.result(timeout)


class Table:
    """Use :meth:`create` or :meth:`open`."""

    def __init__(self, spark: SparkSession, path: str, key: KeySpec, merge: MergeSpec, options: Options, pinned: Manifest | None = None):
        self.spark, self.path, self.key, self.merge, self.options = spark, path.rstrip("/"), key, merge, options
        self._files, self._pinned = Files(spark, path, options.put_if_absent), pinned
        self._pool = ThreadPoolExecutor(max_workers=2)
        self.counters: Counter[str] = Counter()
        self.latencies: dict[str, Counter[int]] = {}

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, key: KeySpec, value_schema: str, merge: MergeSpec | None = None,
        key_schema: str = "k string", options: Options = Options(),
    ) -> Table:
        """A new, empty table; an older table in its place is erased, anything else refused."""
        merge = merge or MergeSpec.last_write_wins()
        files = Files(spark, path, options.put_if_absent)
        if files.list("") and not versions(files):
            raise ValueError(f"{path} holds something that is no table")
        files.delete("")
        schema = f"{key_schema}, sort_key {cls._sort_type(spark, key, key_schema)}, batch long, seq long, op string, value {value_schema}"
        save(files, Manifest(0, key.name, merge.name, list(key.columns), schema))
        return cls(spark, path, key, merge, options)

    @staticmethod
    def _sort_type(spark: SparkSession, key: KeySpec, key_schema: str) -> str:
        return key.with_sort_key(spark.createDataFrame([], key_schema)).schema["sort_key"].dataType.simpleString()

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: KeySpec, merge: MergeSpec | None = None, options: Options = Options(), version: int | None = None) -> Table:
        """An existing table; the key order and merge rule must be those it was made with.

        With ``version`` the table is pinned there and read-only.
        """
        merge = merge or MergeSpec.last_write_wins()
        found = load(Files(spark, path), version)
        if (found.key, found.merge) != (key.name, merge.name):
            raise ValueError(f"the table has {found.key} and {found.merge}, not {key.name} and {merge.name}")
        return cls(spark, path, key, merge, options, found if version is not None else None)

    def close(self) -> None:
        """Wait for maintenance; committed data needs nothing else."""
        self._pool.shutdown(wait=True)

    def drop(self) -> None:
        """Erase the table; it can't be opened again."""
        self.close()
        self._files.delete("")

    def manifest(self) -> Manifest:
        return self._pinned or load(self._files)

    def versions(self) -> list[int]:
        return versions(self._files)

    def at(self, version: int) -> Table:
        """A read-only handle on an older state."""
        return Table.open(self.spark, self.path, self.key, self.merge, self.options, version)

    # writes

    def insert(self, rows: DataFrame) -> int:
        return self.append(rows.withColumn("op", F.lit(INSERT)))

    def update(self, rows: DataFrame) -> int:
        if self.merge.pair is None:
            raise ValueError("an UPDATE needs a merge rule")
        return self.append(rows.withColumn("op", F.lit(UPDATE)))

    def delete(self, keys: DataFrame) -> int:
        """Tombstones; deleting a key that isn't there is no error."""
        return self.append(keys.withColumns({"op": F.lit(DELETE), "value": F.lit(None)}))

    def append(self, messages: DataFrame, source: str | None = None, epoch: int = 0) -> int:
        """Commit a batch of messages (key columns, ``op``, ``value``, optional ``seq``) atomically; returns the version.

        ``seq`` orders messages of one key within the batch and must be unique there; without
        it a key may occur once.  Later batches are newer.  With ``source``, an ``epoch`` that
        this source has committed already is skipped: the note is part of the same commit.
        """
        if source is not None and epoch <= self._writable().epochs.get(source, -1):
            return self.manifest().version
        with self._timed("append"):
            current = self._writable()
            rows = self._stamped(messages, current)
            if self.options.precombine:
                rows = self._columns(resolve(rows, self.key, self.merge, INTERMEDIATE, hot=True), F.lit(current.next_batch).cast("long"))
            run = self._write(rows, current.next_batch, 0)

            def change(m: Manifest) -> bool:
                if source is not None:
                    if epoch <= m.epochs.get(source, -1):
                        return False
                    m.epochs[source] = epoch
                run.batch = m.next_batch
                if run.rows:
                    m.runs.append(run)
                m.next_batch += 1
                return True

            version = self._commit(change, run)
        if self.options.delta_rows is not None and self._delta_rows() > self.options.delta_rows:
            self.maintain(force=True)
        return version

    def _delta_rows(self) -> int:
        return sum(r.rows for r in self.manifest().runs if r.level == 0)

    def _writable(self) -> Manifest:
        if self._pinned:
            raise ValueError("this handle is pinned to a version")
        return load(self._files).copy()

    def _stamped(self, messages: DataFrame, current: Manifest) -> DataFrame:
        rows = self.key.with_sort_key(messages).withColumn("batch", F.lit(current.next_batch).cast("long"))
        if "seq" not in messages.columns:
            rows = rows.withColumn("seq", F.lit(0).cast("long"))
        wanted = self.spark.createDataFrame([], current.schema).schema
        value = F.when(F.col("op") != DELETE, F.col("value"))
        rows = rows.withColumn("value", value.cast(wanted["value"].dataType))
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted.fields])

    def _columns(self, rows: DataFrame, batch) -> DataFrame:
        """Resolved rows as messages."""
        return rows.select(*self.key.columns, "sort_key", batch.alias("batch"), F.col("seq"), "op", "value")

    def _commit(self, change: Callable[[Manifest], bool], run: Run | None) -> int:
        """Apply ``change`` to the newest manifest and commit it, again on top of other writers' commits
        if they were faster.  A run that isn't committed is deleted."""
        try:
            for _ in range(TRIES):
                current = self._writable()
                if not change(current):
                    self._discard(run)
                    return current.version
                current.version += 1
                try:
                    save(self._files, current)
                except Conflict:
                    continue
                if run is not None and run not in current.runs:
                    self._discard(run)
                return current.version
            raise Conflict(f"{self.path}: lost {TRIES} races")
        except Exception:
            self._discard(run)
            raise

    def _discard(self, run: Run | None) -> None:
        if run is not None:
            self._files.delete(f"runs/{run.id}")

    def _write(self, rows: DataFrame, batch: int, level: int) -> Run:
        """Write a run and describe it.  It is checked once it is written, from its own files,
        so that what feeds it need not be computed again; a bad run is deleted."""
        name = uuid.uuid4().hex
        place = f"{self.path}/runs/{name}"
        out = rows.repartitionByRange("sort_key").sortWithinPartitions("sort_key", "batch", "seq").write
        if self.options.bloom and rows.schema["sort_key"].dataType.typeName() != "struct":
            out = out.option("parquet.bloom.filter.enabled#sort_key", "true")
        out.option("maxRecordsPerFile", self.options.rows_per_file).parquet(place)
        try:
            return self._described(Run(name, 0, {}, batch, level, None, None), rows.schema)
        except Exception:
            self._files.delete(f"runs/{name}")
            raise

    def _described(self, run: Run, schema) -> Run:
        most = self.options.max_key_bytes
        large = F.lit(0) if most is None else F.count_if(oversize(self.key.columns, most))
        seen = self.spark.read.schema(schema).parquet(f"{self.path}/runs/{run.id}")
        key = F.col("sort_key")
        found = seen.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b"), large.alias("large")).collect()
        run.ops = {r["op"]: r["n"] for r in found}
        run.rows = sum(run.ops.values())
        unknown = sum(n for op, n in run.ops.items() if op not in (INSERT, UPDATE, DELETE))
        if unknown:
            raise ValueError(f"{unknown} messages have an unknown op")
        if any(r["large"] for r in found):
            raise ValueError(f"{sum(r['large'] for r in found)} keys have over {most} bytes")
        if UPDATE in run.ops and self.merge.pair is None:
            raise ValueError("an UPDATE needs a merge rule")
        if run.level == 0 and self.options.check_unique and not seen.groupBy("sort_key", "seq").count().where("count > 1").isEmpty():
            raise ValueError("the batch repeats a key and seq")
        low, high = ([_parts(r[c]) for r in found if r[c] is not None] for c in "ab")
        try:
            run.low, run.high = min(low, default=None), max(high, default=None)
        except TypeError:  # parts of composite keys that are null have no order in Python
            run.low = run.high = None
        plain([run.low, run.high])
        return run

    @contextmanager
    def _timed(self, what: str):
        begun = time.perf_counter()
        yield
        spent = (time.perf_counter() - begun) * 1000
        self.latencies.setdefault(what, Counter())[bisect_left(LATENCIES, spent)] += 1

    # reads

    def messages(self, bounds: Bounds = Bounds(), manifest: Manifest | None = None) -> DataFrame:
        """All messages in a key range, with ``seq`` as (batch, seq)."""
        found = self._raw(manifest or self.manifest(), bounds)
        return found.withColumn("seq", F.struct("batch", "seq")).drop("batch")

    def _raw(self, m: Manifest, bounds: Bounds, runs: list[Run] | None = None) -> DataFrame:
        key = F.col("sort_key")
        parts = []
        for run in m.runs if runs is None else runs:
            if _apart(run, bounds):
                continue
            part = self.spark.read.schema(m.schema).parquet(f"{self.path}/runs/{run.id}").where(bounds.where(key))
            if run.level == 0:  # the batch is given when the run is committed
                part = part.withColumn("batch", F.lit(run.batch).cast("long"))
            for low, high in run.holes:
                part = part.where(~F.coalesce(Bounds(low, high).where(key), F.lit(low is None)))
            parts.append(part)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], m.schema)

    def rows(self, bounds: Bounds = Bounds()) -> DataFrame:
        """Present keys in a range; the range reaches the Parquet scans."""
        return resolve(self.messages(bounds), self.key, self.merge, FULL, hot=True)

    def lookup(self, *values: Any) -> DataFrame:
        """The row of a key, or none."""
        k = self.key.sort_value(self.spark, *values)
        found = self.rows(Bounds(k, k, reads.GE, reads.LE))
        return found

    def get(self, *values: Any) -> Any:
        """The value of a key; KeyError if it is absent.  Counts towards the lookup statistics."""
        with self._timed("lookup"):
            row = self.lookup(*values).select("value").head()
        self.counters["lookups"] += 1
        self.counters["found" if row else "not_found"] += 1
        if row is None:
            raise KeyError(values)
        return row["value"]

    def get_async(self, *values: Any) -> Future:
        """As :meth:`get`, in the background."""
        return self._pool.submit(self.get, *values)

    def might_exist(self, *values: Any) -> bool:
        """False only if the key was never written: no value is read, bloom filters and statistics prune files."""
        k = self.key.sort_value(self.spark, *values)
        return not self._raw(self.manifest(), Bounds(k, k, reads.GE, reads.LE)).select("sort_key").limit(1).isEmpty()

    def might_exist_all(self, probes: DataFrame) -> DataFrame:
        """Probes (the key columns) with ``found``: whether the key was ever written.  No value is read."""
        asks = self.key.with_sort_key(probes).withColumnRenamed("sort_key", "__probe")
        return reads.exists(self._raw(self.manifest(), Bounds()).select("sort_key"), asks, probe="__probe").drop("__probe")

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """Probes (the key columns) with ``found`` and ``value``."""
        asks = self.key.with_sort_key(probes).withColumnRenamed("sort_key", "__probe").distinct()
        there = self.messages().join(asks.select("__probe"), F.col("sort_key") == F.col("__probe"), "left_semi")
        found = resolve(there, self.key, self.merge, FULL, hot=True).select("sort_key", "value")
        return reads.multi_get(found, asks, probe="__probe").drop("__probe", "sort_key")

    def scan(self, bounds: Bounds = Bounds(), start_cmp: str = reads.GE, start: Any = None, limit: int | None = None) -> DataFrame:
        return reads.scan(self.rows(bounds), Bounds(), start_cmp, start, limit)

    def cursor(self, bounds: Bounds = Bounds(), start_cmp: str = reads.GE, start: Any = None, page: int = 256) -> Cursor:
        """A cursor on the state as it is now."""
        return Cursor(Table.rows(self.at(self.manifest().version), bounds), Bounds(), start_cmp, start, page)

    def history(self, *values: Any) -> DataFrame:
        """All messages of a key, newest first."""
        return reads.history(self.messages(), self.key.sort_value(self.spark, *values))

    def old_values(self, messages: DataFrame) -> DataFrame:
        """The messages of a batch about to be appended, each with what a read just before it would see."""
        batch = self._stamped(messages, self.manifest())
        seen = self.messages().join(batch.select("sort_key").distinct(), "sort_key", "left_semi")
        # what is there now counts as one older message per key
        now = resolve(seen, self.key, self.merge, FULL, hot=True).select(*self.key.columns, "seq", "op", "value")
        new = batch.withColumn("seq", F.struct("batch", "seq")).select(*self.key.columns, "seq", "op", "value")
        both = now.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
        return old_values(both, self.key, self.merge).where("__new").drop("__new")

    def count_in_range(self, bounds: Bounds = Bounds()) -> DataFrame:
        """Messages and bytes in a range, over all runs: an upper bound of the rows there."""
        size = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
        return reads.count_in_range(self.messages(bounds), bounds, sum((size(c) for c in self.key.columns), F.lit(0)), size("value"))

    def tuple_bound(self, bounds: Bounds = Bounds()) -> int:
        """At least as many as the messages in a range, from the manifest alone: no file is read."""
        return sum(r.rows for r in self.manifest().runs if not _apart(r, bounds))

    def counts_by_run(self, bounds: Bounds = Bounds()) -> DataFrame:
        """(run, n): messages of each run in a range."""
        m = self.manifest()
        parts = [self._raw(m, bounds, [r]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(r.id).alias("run"), "n") for r in m.runs]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "run string, n long")

    def estimate_keys(self, bounds: Bounds = Bounds(), rsd: float = 0.02) -> DataFrame:
        """About how many different keys a range holds."""
        return self.messages(bounds).agg(F.approx_count_distinct("sort_key", rsd).alias("keys"))

    # maintenance

    def optimize(self, low: Any = None, high: Any = None, full: bool = True, notification: Notification | None = None) -> Future | None:
        """Rewrite [low, high) into one run.  ``full`` drops tombstones and finishes updates; otherwise
        they stay.  low > high is an error, low == high does nothing.  With a polling
        notification it returns at once; a blocking one, or none, waits."""
        self._writable()
        if low is not None and high is not None:
            if low > high:
                raise ValueError("the range ends before it begins")
            if low == high:
                return None
        if notification is None or notification.blocking:
            done: Future = Future()
            self._compact(low, high, full)
            done.set_result(None)
        else:
            done = self._pool.submit(self._compact, low, high, full)
        if notification is not None:
            notification.attach(done)
        return done

    def _compact(self, low: Any, high: Any, full: bool) -> None:
        plain([low, high])  # refused before anything is written
        with self._timed("compaction"):
            while not self._compacted(low, high, full):
                pass  # another compaction took some of the runs

    def _compacted(self, low: Any, high: Any, full: bool) -> bool:
        """Compact the newest state; False if another compaction changed it meanwhile.  Batches that
        are appended meanwhile stay as they are, above the new run."""
        current = self._writable()
        taken = {r.id: len(r.holes) for r in current.runs}
        if not taken:
            return True
        bounds = Bounds(low, high)
        # every run takes part, so the oldest message of each key is among them and tombstones may go
        rows = resolve(self.messages(bounds, current), self.key, self.merge, FULL if full else INTERMEDIATE, hot=True)
        rows = self._columns(rows.withColumns({"__b": F.col("seq.batch"), "seq": F.col("seq.seq")}), F.col("__b"))
        run = self._write(rows, current.next_batch - 1, 1 + max(r.level for r in current.runs))
        outcome = True

        def change(m: Manifest) -> bool:
            nonlocal outcome
            now = {r.id: len(r.holes) for r in m.runs}
            outcome = all(now.get(i) == n for i, n in taken.items())
            if not outcome:
                return False
            if low is None and high is None:
                m.runs = [r for r in m.runs if r.id not in taken]
            for old in m.runs:
                if old.id in taken:
                    old.holes.append([low, high])
            m.runs = [r for r in m.runs if r.id not in taken or not self._hollow(m, r)]
            if run.rows:
                m.runs.insert(0, run)
            return True

        self._commit(change, run)
        return outcome

    def _hollow(self, m: Manifest, run: Run) -> bool:
        """Whether nothing of a run is left outside its holes."""
        return self._raw(m, Bounds(), [run]).select("sort_key").limit(1).isEmpty()

    def maintain(self, notification: Notification | None = None, force: bool = False) -> bool:
        """If there are more runs than ``fanout`` (or ``force``), compact the key range of about
        ``part_rows`` messages that has most of them in uncompacted runs; whether it did.

        Ranges are cut at quantiles of these runs' keys.  Calling it again takes the next range;
        a run whose ranges are all taken is dropped.
        """
        m = self.manifest()
        if not m.runs or len(m.runs) <= self.options.fanout and not force:
            return False
        low, high = self._fullest(m)
        self.optimize(low, high, notification=notification)
        return True

    def _fullest(self, m: Manifest) -> tuple[Any, Any]:
        total = sum(r.rows for r in m.runs)
        parts = -(-total // self.options.part_rows)
        if parts == 1:
            return None, None
        fresh = self._raw(m, Bounds(), [r for r in m.runs if r.level == 0] or m.runs).select("sort_key")
        dealt = Ranges(fresh, "sort_key", min(parts, reads.RANGES))
        cuts = [None, *dealt.cuts, None]
        # the range of a key at a cut ends there; [low, high) begins there
        where = F.coalesce(F.aggregate(F.array(*[(F.col("sort_key") >= reads.typed(c, dealt.kind)).cast("int") for c in dealt.cuts]), F.lit(0), lambda a, b: a + b), F.lit(0))
        most = fresh.groupBy(where.alias("part")).count().orderBy(F.desc("count"), "part").first() if dealt.cuts else None
        part = most["part"] if most else 0
        return cuts[part], cuts[part + 1]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete manifests but the last ``keep`` and runs that none of these lists; returns the runs' names."""
        known = versions(self._files)
        kept = {r.id for v in known[-keep:] for r in load(self._files, v).runs}
        gone = [name for name, _ in self._files.list("runs") if name not in kept]
        for name in gone:
            self._files.delete(f"runs/{name}")
        for v in known[:-keep]:
            self._files.delete(f"_manifest/v{v:012d}.json")
        return gone

    def stats(self) -> DataFrame:
        """Per run: rows, counts by op, level, key span, bytes of its files."""
        rows = []
        for r in self.manifest().runs:
            size = sum(n for _, n in self._files.list(f"runs/{r.id}"))
            span = (None if x is None else str(x) for x in (r.low, r.high))
            rows.append((r.id, r.rows, *(r.ops.get(o, 0) for o in (INSERT, UPDATE, DELETE)), r.batch, r.level, *span, size))
        return self.spark.createDataFrame(rows, "run string, rows long, inserts long, updates long, deletes long, batch long, level long, low string, high string, bytes long")

    def latency_histogram(self) -> DataFrame:
        """(what, up_to_ms, n): how long appends, lookups and compactions of this handle took; null: longer than all limits."""
        rows = [(what, (*map(float, LATENCIES), None)[i], n) for what, seen in self.latencies.items() for i, n in sorted(seen.items())]
        return self.spark.createDataFrame(rows, "what string, up_to_ms double, n long")

    def reset_stats(self) -> None:
        self.counters.clear()
        self.latencies.clear()

    def dump(self) -> str:
        """The manifest as text, for people."""
        return dump(self.manifest())

    def show_history(self, *values: Any) -> DataFrame:
        """(seq, op, key, value) of a key's messages, newest first, printed by the specs."""
        return self.history(*values).select("seq", "op", self.key.to_string().alias("key"), self.merge.to_string("value").alias("value"))

    def verify(self) -> DataFrame:
        """(problem, sort_key, n): messages that repeat another's key and sequence, and rows of a file
        that stand before a smaller key.  None in a sound table."""
        m = self.manifest()
        repeats = self._raw(m, Bounds()).groupBy("sort_key", "batch", "seq").count().where("count > 1")
        found = [repeats.select(F.lit("repeated message").alias("problem"), "sort_key", F.col("count").alias("n"))]
        for run in m.runs:
            rows = self.spark.read.schema(m.schema).parquet(f"{self.path}/runs/{run.id}")
            rows = rows.select("sort_key", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            before = F.lag("sort_key").over(Window.partitionBy("file").orderBy("at"))
            wrong = rows.withColumn("before", before).where("before > sort_key")
            found.append(wrong.select(F.lit("out of order").alias("problem"), "sort_key", F.lit(1).cast("long").alias("n")))
        return reduce(DataFrame.unionByName, found)


def _parts(value: Any) -> Any:
    """A composite key as a plain tuple."""
    return tuple(_parts(v) for v in value) if isinstance(value, tuple | list) else value


def _apart(run: Run, bounds: Bounds) -> bool:
    """Whether a run surely has no key within the bounds, by its smallest and largest key."""
    try:
        low, high, first, last = map(_parts, (run.low, run.high, bounds.low, bounds.high))
        if low is None or high is None:
            return False
        return first is not None and high < first or last is not None and low > last
    except TypeError:
        return False
