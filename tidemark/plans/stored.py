"""Queries that go through stored tables: batches are committed and compacted, the table is opened
again and read.  Their SQL knows nothing of that; they add to the catalogue's queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import unique_from_collisions
from tidemark.functions.merge import INSERT
from tidemark.operators import scan as reads
from tidemark.operators.scan import LE, Bounds
from tidemark.plans.catalogue import BEFORE, LWW, PRESENT, SQL, SUM, K, M, query
from tidemark.sources.inputs import driver_table, event_messages, trace
from tidemark.sources.place import shared_dir
from tidemark.sources.table import Table
from tidemark.streaming.ingest import ingest

_MADE: dict[tuple[str, str, str], str] = {}


def _new(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark/tables/{uuid.uuid4().hex}"


def _made(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str, str], None]) -> str:
    """The path of a table that several queries read, made by the first of them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        path = _new(spark)
        build(spark, sf_dir, path)
        _MADE[key] = path
    return _MADE[key]


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The event log in four stretches of its sequence."""
    messages = event_messages(spark, sf_dir)
    quarter = (messages.agg(F.max("seq")).first()[0] or 0) // 4
    seq = F.col("seq")
    cuts = [seq <= quarter, (seq > quarter) & (seq <= 2 * quarter), (seq > 2 * quarter) & (seq <= 3 * quarter), seq > 3 * quarter]
    return [messages.where(c) for c in cuts]


QUARTER = "(SELECT max(event_id) // 4 FROM events)"


def _plain(spark: SparkSession, sf_dir: str, path: str) -> None:
    t = Table.create(spark, path, K, "long", SUM, "k long")
    for batch in _batches(spark, sf_dir):
        t.append(batch)


def _compacted(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Batches with compactions of parts of the range between them, one leaving updates and one finishing them."""
    t = Table.create(spark, path, K, "long", SUM, "k long")
    for i, batch in enumerate(_batches(spark, sf_dir)):
        t.append(batch)
        if i == 1:
            t.optimize(20, 90, full=False)
        elif i == 2:
            t.optimize(50, 120)


#: Versions of that table: after the second batch's compaction, and after the third's.
SECOND, THIRD = 3, 5


def _log(spark: SparkSession, sf_dir: str, version: int | None = None) -> Table:
    return Table.open(spark, _made(spark, sf_dir, "compacted", _compacted), K, SUM, version=version)


def _uncompacted(spark: SparkSession, sf_dir: str) -> Table:
    return Table.open(spark, _made(spark, sf_dir, "plain", _plain), K, SUM)


@query(SQL["merge_update_sum"])
def stored_state(spark, sf_dir):
    return _log(spark, sf_dir).rows().select("k", "value")


@query(SQL["merge_update_sum"])
def optimize_invariance(spark, sf_dir):
    """Reads of a table after its whole range, and then parts of it, were optimized."""
    path = _new(spark)
    _plain(spark, sf_dir, path)
    t = Table.open(spark, path, K, SUM)
    t.optimize(20, 90, full=False)
    t.optimize(None, 40)
    t.optimize()
    return Table.open(spark, path, K, SUM).rows().select("k", "value")


@query(f"WITH {PRESENT} SELECT k, value FROM r WHERE k >= 30 AND k < 80")
def stored_scan_range(spark, sf_dir):
    return _log(spark, sf_dir).rows(Bounds(30, 80)).select("k", "value")


@query(f"WITH {PRESENT} SELECT k, value FROM r WHERE k >= 30 AND k < 80 AND k <= 60 ORDER BY k DESC LIMIT 10")
def stored_scan_backward(spark, sf_dir):
    return _log(spark, sf_dir).scan(Bounds(30, 80), LE, 60, limit=10).select("k", "value")


@query(f"WITH {PRESENT} SELECT c_custkey AS probe, r.k IS NOT NULL AS found, value FROM customer LEFT JOIN r ON r.k = c_custkey")
def stored_multi_get(spark, sf_dir):
    probes = driver_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    return _log(spark, sf_dir).multi_get(probes).select(F.col("k").alias("probe"), "found", "value")


@query("SELECT c_custkey AS probe, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AS found FROM customer")
def stored_might_exist(spark, sf_dir):
    """Keys ever written, deleted or not."""
    probes = driver_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    return _uncompacted(spark, sf_dir).might_exist_all(probes).select(F.col("k").alias("probe"), "found")


@query(f"WITH {BEFORE} SELECT k, seq, old_found, CASE WHEN old_found THEN before END AS old_value FROM d WHERE seq > 3 * {QUARTER}")
def stored_old_values(spark, sf_dir):
    """What reads just before each message of the last batch see, in the table as it was without that batch."""
    t = _log(spark, sf_dir, THIRD)
    return t.old_values(_batches(spark, sf_dir)[3]).select("k", F.col("seq.seq").alias("seq"), "old_found", "old_value")


@query(SQL["merge_update_sum"].replace("FROM events)", f"FROM events WHERE event_id <= 2 * {QUARTER})"))
def stored_time_travel(spark, sf_dir):
    return _log(spark, sf_dir, SECOND).rows().select("k", "value")


@query(SQL["merge_update_sum"])
def stored_compaction(spark, sf_dir):
    """Everything compacted into one run, older versions and runs deleted."""
    path = _new(spark)
    _compacted(spark, sf_dir, path)
    t = Table.open(spark, path, K, SUM)
    t.optimize()
    t.vacuum()
    return Table.open(spark, path, K, SUM).rows().select("k", "value")


@query(f"WITH {M} SELECT CAST(count(*) AS BIGINT) AS messages, {', '.join(f'''CAST(count(*) FILTER (op = '{o.upper()}') AS BIGINT) AS {o}s''' for o in ('insert', 'update', 'delete'))} FROM m")
def stored_stats(spark, sf_dir):
    names = {"rows": "messages", "inserts": "inserts", "updates": "updates", "deletes": "deletes"}
    return _uncompacted(spark, sf_dir).stats().agg(*[F.sum(c).alias(n) for c, n in names.items()])


@query(
    f"""WITH {M} SELECT count(*) AS n, CAST(coalesce(sum(strlen(CAST(k AS VARCHAR))), 0) AS BIGINT) AS key_bytes,
    CAST(coalesce(sum(CASE WHEN op <> 'DELETE' THEN strlen(CAST(value AS VARCHAR)) END), 0) AS BIGINT) AS value_bytes FROM m WHERE k >= 20 AND k < 90"""
)
def stored_count_in_range(spark, sf_dir):
    return _uncompacted(spark, sf_dir).count_in_range(Bounds(20, 90))


@query(f"WITH {M} SELECT seq, op, CASE WHEN op <> 'DELETE' THEN value END AS value FROM m WHERE k = 7")
def stored_history(spark, sf_dir):
    return _uncompacted(spark, sf_dir).history(7).select(F.col("seq.seq").alias("seq"), "op", "value")


@query(SQL["naive_range_delete"])
def stored_range_delete(spark, sf_dir):
    """Scan a range, delete the keys found, read again."""
    path = _new(spark)
    _plain(spark, sf_dir, path)
    t = Table.open(spark, path, K, SUM)
    t.delete(t.rows(Bounds(30, 80)).select("k"))
    return t.rows().select("k", "value")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS k, arg_max(CAST(floor(value) AS BIGINT), event_id) AS value
    FROM events WHERE event_type <> 'view' GROUP BY user_id"""
)
def stored_trace(spark, sf_dir):
    """A benchmark trace: its lines are read, its writes appended, the last one of a key stays."""
    events = driver_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "r").otherwise("u")
    lines = events.select(F.col("event_id").alias("seq"), F.concat_ws(" ", kind, "user_id", F.floor("value").cast("long")).alias("value"))
    writes = trace(lines).where("op IS NOT NULL").select("k", "seq", "op", F.col("length").alias("value"))
    t = Table.create(spark, _new(spark), K, "long", LWW, "k string")
    t.append(writes)
    return t.rows().select("k", "value")


@query(
    """SELECT CAST(o_orderdate AS DATE) AS k, arg_max(o_orderkey, CAST(o_orderkey % 2 AS BIGINT) * 1000000000000 + o_orderkey) AS value
    FROM orders GROUP BY 1"""
)
def stored_date_ranges(spark, sf_dir):
    """A table under dates, of which a range is compacted between two batches: odd order keys come later than even ones."""
    orders = driver_table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderdate").cast("date").alias("k"), F.col("o_orderkey").cast("long").alias("seq"), F.lit(INSERT).alias("op"), F.col("o_orderkey").cast("long").alias("value"))
    low, high = rows.agg(F.min(F.date_add("k", 100)), F.max(F.date_sub("k", 100))).first()
    t = Table.create(spark, _new(spark), K, "long", LWW, "k date")
    t.append(rows.where("seq % 2 = 0"))
    t.optimize(low, high)
    t.append(rows.where("seq % 2 = 1"))
    t.optimize(low, None)
    return Table.open(spark, t.path, K, LWW).rows().select("k", "value")


@query(SQL["merge_update_sum"])
def stored_stream(spark, sf_dir):
    """The log as a stream of files, appended batch by batch, each once."""
    path = _new(spark)
    event_messages(spark, sf_dir).repartitionByRange(3, "seq").write.parquet(f"{path}-in")
    t = Table.create(spark, path, K, "long", SUM, "k long")
    stream = spark.readStream.schema("k long, seq long, op string, value long").option("maxFilesPerTrigger", 100).parquet(f"{path}-in")
    ingest(stream, t, f"{path}-checkpoint", availableNow=True).awaitTermination()
    return t.rows().select("k", "value")


@query("SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS keys, TRUE AS within FROM lineitem")
def unique_keys_estimate_bound(spark, sf_dir):
    """The sketch's estimate is within three standard errors of the exact count.

    Each is an aggregate of its own: together, Spark would keep a sketch for every different key.
    """
    lines = driver_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    sketch = lines.agg(F.approx_count_distinct(F.struct("l_orderkey", "l_linenumber"), 0.02).alias("n"))
    exact = lines.distinct().agg(F.count(F.lit(1)).alias("keys"))
    # a row each
    both = exact.crossJoin(F.broadcast(sketch))
    return both.select("keys", (F.abs(F.col("n") / F.col("keys") - 1) <= 0.06).alias("within"))


@query(SQL["unique_keys_estimate_bound"])
def unique_keys_from_fingerprints_bound(spark, sf_dir):
    """Distinct fingerprints, corrected for collisions, are within one percent of the exact count."""
    lines = driver_table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k"), F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1 << 26)).alias("h"))
    both = lines.agg(F.count_distinct("h").alias("h"), F.count_distinct("k").alias("keys"))
    return both.select("keys", (F.abs(unique_from_collisions(F.col("h")) / F.col("keys") - 1) <= 0.01).alias("within"))


@query("SELECT CAST(part AS INTEGER) AS part, TRUE AS within FROM range(15) t(part)")
def range_split_points_bound(spark, sf_dir):
    """Each of fifteen cuts stands within a hundredth of all rows of its place."""
    orders = driver_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sort_key"))
    cuts = reads.split_points(orders, 16)
    n = orders.count()
    # fifteen rows, whatever the input
    below = orders.join(F.broadcast(cuts), F.col("sort_key") <= F.col("split_key")).groupBy("part").agg(F.count(F.lit(1)).alias("rank"))
    return below.select("part", (F.abs(F.col("rank") / n - (F.col("part") + 1) / 16) <= 0.01).alias("within"))
