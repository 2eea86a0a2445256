"""One query per operator over the driver's tables, each with the same result in DuckDB SQL.

``events`` is the message log (see :func:`tidemark.sources.inputs.event_messages`); bounds
and probes are derived from the data, so that every query is meaningful at every size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import histogram_bucket, unique_from_collisions
from tidemark.functions.keys import KeySpec, to_hex
from tidemark.functions.merge import DELETE, INSERT, UPDATE, MergeSpec, wrap_int8
from tidemark.operators import scan as reads
from tidemark.operators.resolve import FULL, INTERMEDIATE, RAW, old_values, resolve
from tidemark.operators.scan import GE, GT, LE, LT, Bounds
from tidemark.sources.inputs import driver_table, event_messages, puts
from tidemark.sources.place import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K = KeySpec.lex("k")
LWW, SUM, COUNTER = MergeSpec.last_write_wins(), MergeSpec.sum(), MergeSpec.counter_int8()

M = """m AS (SELECT user_id AS k, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS op,
  CAST(floor(value) AS BIGINT) AS value FROM events)"""
#: State of each key under a summing rule: ``op`` and ``s`` of its last definite message, ``u`` and ``n`` of the updates after it.
STATE = f"""{M},
b AS (SELECT *, max(CASE WHEN op <> 'UPDATE' THEN seq END) OVER (PARTITION BY k) AS base FROM m),
s AS (SELECT k, max(CASE WHEN op <> 'UPDATE' THEN op END) AS op, max(CASE WHEN op = 'INSERT' THEN value END) AS s,
  CAST(sum(CASE WHEN op = 'UPDATE' THEN value END) AS BIGINT) AS u, count(*) FILTER (op = 'UPDATE') AS n, max(seq) AS seq
  FROM b WHERE base IS NULL OR seq >= base GROUP BY k)"""
LATEST = "SELECT k, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM m GROUP BY k"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sort_key"), "o_custkey")


@query(f"WITH {M} SELECT k, arg_max(value, seq) AS value FROM m GROUP BY k")
def upsert_last_write_wins(spark, sf_dir):
    return resolve(puts(event_messages(spark, sf_dir)), K, LWW).select("k", "value")


@query(f"WITH {M}, l AS ({LATEST}) SELECT k, value FROM l WHERE op <> 'DELETE'")
def delete_tombstone(spark, sf_dir):
    messages = event_messages(spark, sf_dir).withColumn("op", F.when(F.col("op") == DELETE, DELETE).otherwise(INSERT))
    return resolve(messages, K, LWW).select("k", "value")


@query(f"WITH {STATE} SELECT k, coalesce(s, 0) + coalesce(u, 0) AS value FROM s WHERE op IS NULL OR op = 'INSERT' OR n > 0")
def merge_update_sum(spark, sf_dir):
    return resolve(event_messages(spark, sf_dir), K, SUM).select("k", "value")


@query(SQL["merge_update_sum"])
def merge_update_sum_segmented(spark, sf_dir):
    """The same by segments of the log, as for keys with a long history."""
    return resolve(event_messages(spark, sf_dir), K, SUM, segment=F.floor(F.col("seq") / 2048)).select("k", "value")


@query(SQL["merge_update_sum"])
def merge_update_sum_hot_keys(spark, sf_dir):
    """The same with updates summed in parts before a key's parts meet."""
    return resolve(event_messages(spark, sf_dir), K, SUM, hot=True).select("k", "value")


@query(SQL["merge_update_sum"])
def merge_update_custom_fold(spark, sf_dir):
    """The same with a rule that only knows how to merge two values."""
    rule = MergeSpec.custom("plus", lambda old, new: old + new)
    return resolve(event_messages(spark, sf_dir), K, rule, segment=F.floor(F.col("seq") / 2048)).select("k", "value")


WRAP = "(({0} + 128) % 256 + 256) % 256 - 128"


@query(
    f"""WITH {STATE}, w AS (SELECT *, {WRAP.format('(coalesce(s, 0) + coalesce(u, 0))')} AS v FROM s)
    SELECT k, CASE WHEN n = 0 AND op = 'INSERT' THEN s ELSE v END AS value FROM w WHERE (n = 0 AND op = 'INSERT') OR (n > 0 AND v <> 0)"""
)
def merge_update_counter_int8(spark, sf_dir):
    return resolve(event_messages(spark, sf_dir), K, COUNTER).select("k", "value")


@query(
    f"""WITH {M}, f AS (SELECT * FROM m WHERE op = 'UPDATE')
    SELECT k, CAST(sum(value) AS BIGINT) AS value FROM f GROUP BY k"""
)
def merge_final_orphan_updates(spark, sf_dir):
    """Updates with nothing below them."""
    messages = event_messages(spark, sf_dir).where(F.col("op") == UPDATE)
    return resolve(messages, K, SUM).select("k", "value")


@query(f"WITH {STATE} SELECT k, u AS value FROM s WHERE op = 'DELETE' AND n > 0")
def merge_after_delete(spark, sf_dir):
    """Keys whose last definite message is a deletion, with updates after it."""
    messages = event_messages(spark, sf_dir)
    definite = messages.where(F.col("op") != UPDATE).groupBy("k").agg(F.max_by("op", "seq").alias("last")).where(F.col("last") == DELETE)
    return resolve(messages.join(definite.select("k"), "k", "left_semi"), K, SUM).select("k", "value")


@query(f"WITH {M} SELECT k, seq, op, value FROM m")
def merge_raw(spark, sf_dir):
    return resolve(event_messages(spark, sf_dir), K, SUM, RAW).select("k", "seq", "op", "value")


@query(
    f"""WITH {STATE} SELECT k, seq, CASE WHEN op IS NULL THEN 'UPDATE' WHEN n > 0 THEN 'INSERT' ELSE op END AS op,
    CASE WHEN n > 0 THEN coalesce(s, 0) + u WHEN op = 'INSERT' THEN s END AS value FROM s"""
)
def merge_intermediate(spark, sf_dir):
    return resolve(event_messages(spark, sf_dir), K, SUM, INTERMEDIATE).select("k", "seq", "op", "value")


@query(f"WITH {STATE} SELECT k, seq, coalesce(s, 0) + coalesce(u, 0) AS value FROM s WHERE op IS NULL OR op = 'INSERT' OR n > 0")
def merge_full(spark, sf_dir):
    """Full resolution of intermediate results of two halves of the log."""
    messages = event_messages(spark, sf_dir)
    middle = messages.agg(F.floor(F.max("seq") / 2).alias("mid"))
    halves = messages.join(F.broadcast(middle))  # one row
    old = resolve(halves.where(F.col("seq") <= F.col("mid")), K, SUM, INTERMEDIATE)
    new = resolve(halves.where(F.col("seq") > F.col("mid")), K, SUM, INTERMEDIATE)
    both = old.unionByName(new).select("k", "seq", "op", "value")
    return resolve(both, K, SUM, FULL).select("k", "seq", "value")


PRESENT = f"{STATE}, r AS (SELECT k, coalesce(s, 0) + coalesce(u, 0) AS value FROM s WHERE op IS NULL OR op = 'INSERT' OR n > 0)"


@query(f"WITH {PRESENT} SELECT k, value FROM r WHERE k = (SELECT min(k) FROM r)")
def point_lookup(spark, sf_dir):
    """The smallest key's row: the key is pushed to the scan, below resolution."""
    messages = event_messages(spark, sf_dir)
    rows = resolve(messages, K, SUM)
    k = rows.agg(F.min("sort_key")).first()[0]
    return reads.lookup(rows, k).select("k", "value")


@query(f"WITH {PRESENT}, p AS (SELECT c_custkey * 2 AS probe FROM customer) SELECT probe, r.k IS NOT NULL AS found, value FROM p LEFT JOIN r ON k = probe")
def multi_get(spark, sf_dir):
    probes = driver_table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("probe"))
    rows = resolve(event_messages(spark, sf_dir), K, SUM)
    return reads.multi_get(rows, probes).select("probe", "found", "value")


@query("SELECT o_orderkey + 1000000000 AS probe, FALSE AS found FROM orders")
def lookup_missing(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    return reads.exists(orders, orders.select((F.col("sort_key") + 1_000_000_000).alias("probe")))


@query("SELECT c_custkey AS probe, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS found FROM customer")
def might_exist_exact(spark, sf_dir):
    probes = driver_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("probe"))
    return reads.exists(driver_table(spark, sf_dir, "orders"), probes, key="o_custkey")


@query("SELECT o_orderkey AS sort_key, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders")
def scan_full_forward(spark, sf_dir):
    return reads.positions(_orders(spark, sf_dir).select("sort_key")).select("sort_key", "pos")


@query("SELECT o_orderkey AS sort_key, row_number() OVER (ORDER BY o_orderkey DESC) AS pos FROM orders")
def scan_full_backward(spark, sf_dir):
    return reads.positions(_orders(spark, sf_dir).select("sort_key"), descending=True).select("sort_key", "pos")


def _bounded(name: str, bounds: Bounds, where: str, start_cmp: str = GE, start=None):
    sql = f"SELECT o_orderkey AS sort_key, o_custkey FROM orders WHERE {where}"
    QUERIES[name] = lambda spark, sf_dir: reads.scan(_orders(spark, sf_dir), bounds, start_cmp, start)
    SQL[name] = sql


_bounded("scan_ge_lt", Bounds(100, 600), "o_orderkey >= 100 AND o_orderkey < 600")
_bounded("scan_gt_le", Bounds(100, 600, GT, LE), "o_orderkey > 100 AND o_orderkey <= 600")
_bounded("scan_singleton", Bounds(333, 333, GE, LE), "o_orderkey = 333")
_bounded("scan_reversed_empty", Bounds(600, 100), "FALSE")
_bounded("scan_descending", Bounds(100, 600), "o_orderkey >= 100 AND o_orderkey < 600 AND o_orderkey <= 250", LE, 250)


def _started(name: str, start_cmp: str, start: int, cmp: str, order: str):
    sql = f"""SELECT o_orderkey AS sort_key, row_number() OVER (ORDER BY o_orderkey {order}) AS pos
      FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 600 AND o_orderkey {cmp} {start}"""

    def run(spark, sf_dir):
        rows = reads.scan(_orders(spark, sf_dir).select("sort_key"), Bounds(100, 600), start_cmp, start)
        return reads.positions(rows, descending=order == "DESC").select("sort_key", "pos")

    QUERIES[name], SQL[name] = run, sql


_started("scan_start_clamped_fwd", GE, 1, ">=", "ASC")
_started("scan_start_clamped_bwd", LE, 10_000, "<=", "DESC")


@query("SELECT o_orderkey AS sort_key FROM orders WHERE o_orderkey >= 50 ORDER BY o_orderkey LIMIT 100")
def scan_limit_n(spark, sf_dir):
    return reads.scan(_orders(spark, sf_dir).select("sort_key"), start_cmp=GE, start=50, limit=100)


@query("SELECT o_orderkey AS sort_key FROM orders WHERE o_orderkey <= 1200 ORDER BY o_orderkey DESC LIMIT 700")
def scan_limit_n_backward(spark, sf_dir):
    return reads.scan(_orders(spark, sf_dir).select("sort_key"), start_cmp=LE, start=1200, limit=700)


@query("SELECT o_orderkey AS sort_key, lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey) OVER w AS next_key FROM orders WINDOW w AS (ORDER BY o_orderkey)")
def neighbors_prev_next(spark, sf_dir):
    return reads.neighbours(_orders(spark, sf_dir).select("sort_key")).select("sort_key", "prev_key", "next_key")


def _nearest(name: str, cmp: str, pick: str):
    # ASOF finds the nearest key in order, as a correlated maximum or minimum would
    SQL[name] = f"""WITH keys AS (SELECT DISTINCT o_custkey AS key FROM orders), p AS (SELECT DISTINCT p_partkey * 7 AS probe FROM part)
      SELECT probe, key AS nearest FROM p ASOF LEFT JOIN keys ON probe {pick} key"""

    def run(spark, sf_dir):
        keys = driver_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sort_key")).distinct()
        probes = driver_table(spark, sf_dir, "part").select((F.col("p_partkey") * 7).alias("probe")).distinct()
        return reads.seek_nearest(keys, probes, cmp)

    QUERIES[name] = run


_nearest("seek_nearest_le", LE, ">=")
_nearest("seek_nearest_lt", LT, ">")
_nearest("seek_nearest_ge", GE, "<=")
_nearest("seek_nearest_gt", GT, "<")

BEFORE = f"""{M},
g AS (SELECT *, sum(CASE WHEN op <> 'UPDATE' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY seq) AS grp FROM m),
a AS (SELECT *, first_value(op) OVER w AS bop, first_value(value) OVER w AS bval,
  CAST(sum(CASE WHEN op = 'UPDATE' THEN value END) OVER w AS BIGINT) AS u FROM g WINDOW w AS (PARTITION BY k, grp ORDER BY seq)),
c AS (SELECT *, CASE WHEN u IS NOT NULL THEN 'INSERT' ELSE bop END AS aop,
  CASE WHEN u IS NULL THEN bval WHEN bop = 'INSERT' THEN bval + u ELSE u END AS aval FROM a),
d AS (SELECT *, coalesce(lag(aop) OVER w = 'INSERT', FALSE) AS old_found, lag(aval) OVER w AS before FROM c WINDOW w AS (PARTITION BY k ORDER BY seq))"""


@query(f"WITH {BEFORE} SELECT k, seq, old_found, CASE WHEN old_found THEN before END AS old_value FROM d")
def write_old_value(spark, sf_dir):
    return old_values(event_messages(spark, sf_dir), K, SUM).select("k", "seq", "old_found", "old_value")


@query(SQL["write_old_value"])
def write_old_value_custom_fold(spark, sf_dir):
    """The same with a rule that only knows how to merge two values."""
    rule = MergeSpec.custom("plus", lambda old, new: old + new)
    return old_values(event_messages(spark, sf_dir), K, rule).select("k", "seq", "old_found", "old_value")


@query(f"WITH {BEFORE} SELECT k, seq, old_found FROM d")
def write_old_exists(spark, sf_dir):
    return old_values(event_messages(spark, sf_dir), K, SUM).select("k", "seq", "old_found")


@query(SQL["merge_update_sum"])
def intermediate_invariance(spark, sf_dir):
    """Reads after part of the key range, and the older half of the log there, was combined."""
    messages = event_messages(spark, sf_dir)
    # one row
    middle = F.broadcast(messages.agg(F.floor(F.max("seq") / 2).alias("mid")))
    marked = messages.join(middle).withColumn("__old", (F.col("seq") <= F.col("mid")) & F.col("k").between(20, 90))
    compacted = resolve(marked.where("__old"), K, SUM, INTERMEDIATE).select("k", "seq", "op", "value")
    rest = marked.where("NOT __old").select("k", "seq", "op", "value")
    return resolve(compacted.unionByName(rest), K, SUM).select("k", "value")


@query(
    """SELECT count(*) AS n, CAST(coalesce(sum(8), 0) AS BIGINT) AS key_bytes, CAST(coalesce(sum(strlen(o_orderpriority)), 0) AS BIGINT) AS value_bytes
    FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1000"""
)
def count_in_range(spark, sf_dir):
    rows = driver_table(spark, sf_dir, "orders").withColumn("sort_key", F.col("o_orderkey"))
    return reads.count_in_range(rows, Bounds(100, 1000), F.lit(8), F.octet_length("o_orderpriority"))


@query("SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem")
def unique_keys_exact(spark, sf_dir):
    keys = driver_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return keys.agg(F.count(F.lit(1)).alias("n"))


@query()
def unique_keys_estimate(spark, sf_dir):
    lines = driver_table(spark, sf_dir, "lineitem")
    return lines.agg(F.approx_count_distinct(F.struct("l_orderkey", "l_linenumber"), 0.02).alias("n"))


@query()
def unique_keys_from_fingerprints(spark, sf_dir):
    """Distinct 26-bit hashes, corrected for collisions."""
    lines = driver_table(spark, sf_dir, "lineitem").select(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1 << 26)).alias("h"))
    return lines.distinct().agg(F.count(F.lit(1)).alias("fingerprints")).withColumn("n", F.round(unique_from_collisions(F.col("fingerprints"))).cast("long"))


@query()
def range_split_points(spark, sf_dir):
    return reads.split_points(_orders(spark, sf_dir), 16)


IP = "concat_ws('.', o_orderkey % 224, o_orderkey // 7 % 256, o_orderkey % 251, o_orderkey % 13)"
IP_ORDER = "((o_orderkey % 224) * 256 + o_orderkey // 7 % 256) * 65536 + (o_orderkey % 251) * 256 + o_orderkey % 13"


@query(f"SELECT {IP} AS ip, CAST({IP_ORDER} AS BIGINT) AS sort_key, row_number() OVER (ORDER BY {IP_ORDER}, o_orderkey) AS pos FROM orders")
def custom_order_ipv4_like(spark, sf_dir):
    k = F.col("o_orderkey")
    ip = F.concat_ws(".", k % 224, F.floor(k / 7) % 256, k % 251, k % 13)
    rows = KeySpec.ipv4("ip").with_sort_key(driver_table(spark, sf_dir, "orders").select("o_orderkey", ip.alias("ip")))
    # quads repeat: the order key settles their places
    rows = rows.withColumn("order", F.struct("sort_key", "o_orderkey"))
    return reads.positions(rows, "order").select("ip", "sort_key", "pos")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey >= 40 AND (o_custkey < 60 OR o_custkey = 60 AND o_orderkey < 500)")
def composite_key_scan(spark, sf_dir):
    rows = KeySpec.composite("o_custkey", "o_orderkey").with_sort_key(driver_table(spark, sf_dir, "orders"))
    return reads.scan(rows, Bounds((40, 0), (60, 500))).select("o_custkey", "o_orderkey")


PAIRS = "SELECT l_orderkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY ALL"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under a composite key, one row each; written once, as ordered reads pass over them several times."""
    rows = driver_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return KeySpec.composite("a", "b").with_sort_key(spark.read.schema(rows.schema).parquet(path))


@query(f"WITH p AS ({PAIRS}) SELECT a, b, row_number() OVER (ORDER BY a, b) AS pos FROM p")
def composite_key_positions(spark, sf_dir):
    return reads.positions(_pairs(spark, sf_dir)).select("a", "b", "pos")


@query(
    f"""WITH p AS ({PAIRS}) SELECT a, b, lag(a) OVER w AS prev_a, lag(b) OVER w AS prev_b, lead(a) OVER w AS next_a, lead(b) OVER w AS next_b
    FROM p WINDOW w AS (ORDER BY a, b)"""
)
def composite_key_neighbours(spark, sf_dir):
    found = reads.neighbours(_pairs(spark, sf_dir))
    parts = [F.col(f"{side}_key._{i}").alias(f"{side}_{c}") for side in ("prev", "next") for i, c in enumerate("ab")]
    return found.select("a", "b", *parts)


@query(
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), p AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS probe FROM lineitem)
    SELECT probe, day AS nearest FROM p ASOF LEFT JOIN d ON probe >= day"""
)
def date_key_nearest(spark, sf_dir):
    """The last order date on or before each ship date."""
    days = driver_table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("sort_key"))
    probes = driver_table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("probe")).distinct()
    return reads.seek_nearest(days, probes, LE)


@query(
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT day AS sort_key, row_number() OVER w AS pos, lag(day) OVER w AS prev_key, lead(day) OVER w AS next_key FROM d WINDOW w AS (ORDER BY day)"""
)
def date_key_walk(spark, sf_dir):
    """Every order date with its place and neighbours."""
    days = driver_table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("sort_key")).distinct()
    return reads.positions(reads.neighbours(days)).select("sort_key", "pos", "prev_key", "next_key")


@query("SELECT c_name, hex(encode(c_name)) AS key_hex FROM customer")
def key_hex(spark, sf_dir):
    return driver_table(spark, sf_dir, "customer").select("c_name", to_hex("c_name").alias("key_hex"))


@query("SELECT c_name AS sort_key, row_number() OVER (ORDER BY c_name) AS pos FROM customer WHERE c_name >= 'Customer#000000050'")
def string_key_scan(spark, sf_dir):
    rows = driver_table(spark, sf_dir, "customer").select(F.col("c_name").alias("sort_key"))
    return reads.positions(reads.scan(rows, start="Customer#000000050")).select("sort_key", "pos")


@query("SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) AS pos FROM events")
def log_replay_order(spark, sf_dir):
    return reads.positions(event_messages(spark, sf_dir).select("seq"), "seq").select("seq", "pos")


@query(f"WITH {M} SELECT seq, op, value, row_number() OVER (ORDER BY seq DESC) AS age FROM m WHERE k = 7")
def history_of_key(spark, sf_dir):
    found = reads.history(K.with_sort_key(event_messages(spark, sf_dir)), 7)
    return found.withColumn("age", F.row_number().over(Window.partitionBy("sort_key").orderBy(F.desc("seq"))).cast("long")).select("seq", "op", "value", "age")


@query(f"WITH {M} SELECT op, count(*) AS n FROM m GROUP BY op")
def stats_op_counts(spark, sf_dir):
    return event_messages(spark, sf_dir).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PRESENT} SELECT count(*) AS lookups, count(r.k) AS found, count(*) - count(r.k) AS not_found FROM customer LEFT JOIN r ON k = c_custkey")
def stats_lookups(spark, sf_dir):
    probes = driver_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("probe"))
    got = reads.exists(resolve(event_messages(spark, sf_dir), K, SUM), probes)
    hit = F.count_if("found")
    return got.agg(F.count(F.lit(1)).alias("lookups"), hit.alias("found"), (F.count(F.lit(1)) - hit).alias("not_found"))


LIMITS = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000]
CASE = "CASE " + " ".join(f"WHEN value <= {x} THEN {i}" for i, x in enumerate(LIMITS)) + f" ELSE {len(LIMITS)} END"


@query(f"SELECT {CASE} AS bucket, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def stats_value_histogram(spark, sf_dir):
    events = driver_table(spark, sf_dir, "events")
    bucket = histogram_bucket(F.col("value"), LIMITS).alias("bucket")
    return events.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(f"WITH {PRESENT} SELECT k, value FROM r WHERE NOT (k >= 30 AND k < 80)")
def naive_range_delete(spark, sf_dir):
    """Scan a range, append a deletion for each key found, read again."""
    messages = event_messages(spark, sf_dir)
    doomed = reads.scan(resolve(messages, K, SUM), Bounds(30, 80)).select("k", F.lit(1 << 60).alias("seq"), F.lit(DELETE).alias("op"), F.lit(None).cast("long").alias("value"))
    return resolve(messages.unionByName(doomed), K, SUM).select("k", "value")


@query("SELECT doc_id, strlen(text) AS n_bytes, substr(text, 101, 50) AS part FROM documents")
def large_value_substring(spark, sf_dir):
    return driver_table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.substring("text", 101, 50).alias("part"))


@query("WITH t AS (SELECT user_id AS k, event_id AS seq, value FROM events WHERE event_type NOT IN ('view')) SELECT k, arg_max(value, seq) AS value FROM t GROUP BY k")
def ycsb_mix_final_state(spark, sf_dir):
    """A benchmark trace: views read, everything else writes; the last write of a key stays."""
    events = driver_table(spark, sf_dir, "events").where(F.col("event_type") != "view")
    messages = events.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.lit(INSERT).alias("op"), "value")
    return resolve(messages, K, LWW).select("k", "value")


LINE = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in LINE.split(', '))}) AS r FROM lineitem) WHERE r = 1"""
)
def upsert_composite_key(spark, sf_dir):
    """Order lines by (order, line number): the newest version of each."""
    lines = driver_table(spark, sf_dir, "lineitem")
    messages = lines.select("l_orderkey", "l_linenumber", F.struct(*LINE.split(", ")).alias("seq"), F.lit(INSERT).alias("op"), F.struct("l_partkey", "l_quantity").alias("value"))
    return resolve(messages, KeySpec.composite("l_orderkey", "l_linenumber"), LWW).select("l_orderkey", "l_linenumber", "value.l_partkey", "value.l_quantity")


@query(f"WITH {M} SELECT k, count(*) AS physical, count(DISTINCT op) AS kinds, max({WRAP.format('value')}) AS top FROM m GROUP BY k")
def verify_history_shape(spark, sf_dir):
    """Messages per key and the kinds of them, as a structural check reports."""
    return event_messages(spark, sf_dir).groupBy("k").agg(
        F.count(F.lit(1)).alias("physical"), F.count_distinct("op").alias("kinds"), F.max(wrap_int8(F.col("value"))).alias("top")
    )
