import random

import pytest

from tidemark.functions.columns import histogram_bucket, parse_size, readable_size
from tidemark.functions.keys import KeySpec
from tidemark.functions.merge import MergeSpec
from tidemark.operators.scan import GE, LE, Bounds
from tidemark.sources.manifest import Conflict, Files, load, save
from tidemark.sources.table import Notification, Options, Table
from tidemark.streaming.ingest import ingest

K = KeySpec.lex("k")


def state(table):
    return {r["k"]: r["value"] for r in table.rows().collect()}


def test_random_batches_against_a_dict(spark, tmp_path):
    draw = random.Random(9)
    t = Table.create(spark, str(tmp_path / "t"), K, "long", MergeSpec.sum(), "k long")
    shadow = {}
    for batch in range(6):
        rows, seq = [], 0
        for _ in range(60):
            seq += 1
            k, op = draw.randint(0, 30), draw.choices(["INSERT", "DELETE", "UPDATE"], [8, 1, 3])[0]
            v = None if op == "DELETE" else draw.randint(-9, 9)
            rows.append((k, seq, op, v))
            if op == "INSERT":
                shadow[k] = v
            elif op == "DELETE":
                shadow.pop(k, None)
            else:
                shadow[k] = shadow.get(k, 0) + v
        t.append(spark.createDataFrame(rows, "k long, seq long, op string, value long"))
        if batch in (2, 4):
            before = state(t)
            assert before == shadow
            t.optimize(5, 20, full=batch == 4)
            assert state(t) == before
    assert state(t) == shadow
    t.optimize()
    assert state(t) == shadow and len(t.manifest().runs) == 1 and t.verify().isEmpty()
    low, high = 4, 17
    assert {r["k"]: r["value"] for r in t.rows(Bounds(low, high)).collect()} == {k: v for k, v in shadow.items() if low <= k < high}
    assert [r["k"] for r in t.scan(start_cmp=LE, start=15, limit=4).collect()] == sorted((k for k in shadow if k <= 15), reverse=True)[:4]
    kept = set(t.versions()[-1:])
    assert t.vacuum() and set(t.versions()) == kept and state(t) == shadow
    t.close()


def test_lifecycle_and_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    t = Table.create(spark, path, K, "string")
    t.insert(spark.createDataFrame([("a", "1"), ("b", ""), ("c", "3")], "k string, value string"))
    t.insert(spark.createDataFrame([("a", "2")], "k string, value string"))
    t.delete(spark.createDataFrame([("c",), ("never",)], "k string"))
    assert state(t) == {"a": "2", "b": ""}
    assert t.get("b") == "" and t.might_exist("c") and not t.might_exist("zzz")
    with pytest.raises(KeyError):
        t.get("c")
    assert t.counters == {"lookups": 2, "found": 1, "not_found": 1}
    t.reset_stats()
    assert not t.counters
    asked = t.multi_get(spark.createDataFrame([("a",), ("c",)], "k string")).collect()
    assert {(r["k"], r["found"], r["value"]) for r in asked if r["k"]} >= {("a", True, "2")}
    assert [(r["op"], r["value"]) for r in t.history("a").collect()] == [("INSERT", "2"), ("INSERT", "1")]
    assert t.at(1).rows().count() == 3
    with pytest.raises(ValueError):
        t.at(1).insert(spark.createDataFrame([("x", "1")], "k string, value string"))
    with pytest.raises(ValueError):
        t.update(spark.createDataFrame([("a", "1")], "k string, value string"))
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([("a" * 513, "foo")], "k string, value string"))
    with pytest.raises(ValueError, match="unknown op"):
        t.append(spark.createDataFrame([("a", "UPSERT", "1")], "k string, op string, value string"))
    assert len(t._files.list("runs")) == len(t.manifest().runs) == 3
    with pytest.raises(ValueError):
        Table.open(spark, path, K, MergeSpec.sum())
    again = Table.open(spark, path, K)
    assert state(again) == {"a": "2", "b": ""}
    big = "z" * (3 * 4096 + 123)
    again.insert(spark.createDataFrame([("foo", big)], "k string, value string"))
    assert Table.open(spark, path, K).get("foo") == big
    with again.cursor(Bounds(None, "b", GE, LE)) as c:
        assert c.current()["k"] == "a"
        c.next()
        assert c.current()["k"] == "b"
        c.next()
        assert not c.valid()
    counted = again.count_in_range(Bounds("a", "c")).first()
    assert counted["n"] == 3
    assert again.estimate_keys().first()["keys"] == 5
    assert {r["inserts"] for r in again.stats().collect()} == {3, 1, 0}
    again.drop()
    with pytest.raises(FileNotFoundError):
        Table.open(spark, path, K)
    t.close()


def test_old_values_of_a_batch(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), K, "long", MergeSpec.sum(), "k string")
    t.insert(spark.createDataFrame([("a", 3)], "k string, value long"))
    batch = spark.createDataFrame([("a", 1, "UPDATE", 4), ("a", 2, "UPDATE", 2), ("b", 1, "INSERT", 1), ("b", 2, "DELETE", None), ("b", 3, "UPDATE", 5)], "k string, seq long, op string, value long")
    got = {(r["k"], r["seq"]["seq"]): r["old_value"] for r in t.old_values(batch).collect()}
    assert got == {("a", 1): 3, ("a", 2): 7, ("b", 1): None, ("b", 2): 1, ("b", 3): None}
    t.append(batch)
    assert state(t) == {"a": 9, "b": 5}
    t.close()


def test_maintenance(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), K, "long", MergeSpec.sum(), "k long", Options(fanout=2))
    for i in range(3):
        t.update(spark.createDataFrame([(k, 1) for k in range(5)], "k long, value long"))
    with pytest.raises(ValueError):
        t.optimize(3, 1)
    assert t.optimize(2, 2) is None
    note = Notification(user_data="mine")
    assert t.maintain(note) and note.user_data == "mine"
    note.wait()
    assert note.poll() and len(t.manifest().runs) == 1 and not t.maintain()
    assert state(t) == dict.fromkeys(range(5), 3)
    stale = t.manifest()
    with pytest.raises(Conflict):
        save(t._files, stale)
    t.close()


def test_composite_keys(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), KeySpec.composite("a", "b"), "long", key_schema="a long, b string")
    t.insert(spark.createDataFrame([(1, "x", 10), (1, "y", 11), (2, "a", 12)], "a long, b string, value long"))
    assert [r["value"] for r in t.scan(Bounds((1, "y"), (2, "b"))).collect()] == [11, 12]
    t.optimize((1, "y"), (2, "b"))
    assert sorted(r["value"] for r in t.rows().collect()) == [10, 11, 12]
    t.close()


def test_stream_appends_once(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "INSERT", 1), ("b", "INSERT", 2)], "k string, op string, value long").coalesce(1).write.json(str(source))
    t = Table.create(spark, str(tmp_path / "t"), K, "long")
    for _ in range(2):
        stream = spark.readStream.schema("k string, op string, value long").json(str(source))
        ingest(stream, t, str(tmp_path / "ck"), availableNow=True).awaitTermination()
    assert state(t) == {"a": 1, "b": 2}
    version = t.append(spark.createDataFrame([("a", "DELETE", None)], "k string, op string, value long"), "stream", 0)
    assert version == 1 and state(t) == {"a": 1, "b": 2}
    t.close()


def test_sizes_and_buckets(spark):
    assert parse_size("4 KiB") == 4096 and parse_size("1.5m") == 3 << 19 and parse_size("512") == 512
    with pytest.raises(ValueError):
        parse_size("0.3")
    assert readable_size(4096) == "4.00 KiB" and readable_size(0) == "0.00 B"
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0.5,), (1.0,), (7.0,), (99.0,)], "v double")
    assert [r[0] for r in rows.select(histogram_bucket(F.col("v"), [1, 10])).collect()] == [0, 0, 1, 2]


def test_trace_replay(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.resolve import resolve
    from tidemark.sources.inputs import trace

    lines = spark.createDataFrame([(1, "i a"), (2, "r a"), (3, "u a"), (4, "d b"), (5, "s a 10")], "seq long, value string")
    rows = trace(lines)
    assert {(r["kind"], r["k"], r["length"]) for r in rows.where("op IS NULL").collect()} == {("r", "a", None), ("s", "a", 10)}
    writes = rows.where("op IS NOT NULL").withColumn("value", F.col("seq"))
    assert {r["k"]: r["value"] for r in resolve(writes, K, MergeSpec.last_write_wins()).collect()} == {"a": 3, "b": 4}


def test_filters_have_no_false_negatives(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), K, "long", key_schema="k long")
    t.insert(spark.range(0, 2000, 2).selectExpr("id AS k", "id AS value"))
    assert all(t.might_exist(k) for k in (0, 2, 1000, 1998))
    plan = t.lookup(1000)._jdf.queryExecution().toString()
    assert "EqualTo(sort_key,1000)" in plan or "GreaterThanOrEqual(sort_key,1000)" in plan
    assert t.lookup(1001).isEmpty() and t.lookup(1000).count() == 1
    t.close()


def test_appends_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    """Another writer appends while a compaction runs: the compaction commits on top of it, and nothing is orphaned."""
    path = str(tmp_path / "t")
    t = Table.create(spark, path, K, "long", MergeSpec.sum(), "k long")
    for i in range(3):
        t.update(spark.createDataFrame([(k, 1) for k in range(10)], "k long, value long"))
    other = Table.open(spark, path, K, MergeSpec.sum())
    write = Table._write

    def slow(self, rows, batch, level):
        run = write(self, rows, batch, level)
        if level:
            other.update(spark.createDataFrame([(3, 100), (77, 5)], "k long, value long"))
        return run

    monkeypatch.setattr(Table, "_write", slow)
    t.optimize(2, 6)
    monkeypatch.undo()
    want = dict.fromkeys(range(10), 3) | {3: 103, 77: 5}
    assert state(t) == state(other) == want
    assert {n for n, _ in t._files.list("runs")} == {r.id for r in t.manifest().runs}
    # two appends that began from the same state
    stale = t._writable()
    other.update(spark.createDataFrame([(1, 1)], "k long, value long"))
    monkeypatch.setattr(Table, "_writable", lambda self, first=[stale]: first.pop() if first else load(self._files).copy())
    t.update(spark.createDataFrame([(1, 1)], "k long, value long"))
    monkeypatch.undo()
    assert state(t)[1] == 5 and len({r.batch for r in t.manifest().runs if r.level == 0}) == len([r for r in t.manifest().runs if r.level == 0])
    t.close()


@pytest.mark.parametrize("kind", ["date", "decimal(10,2)", "timestamp", "binary"])
def test_ranges_of_any_key_type(spark, tmp_path, kind):
    from datetime import date, datetime
    from decimal import Decimal

    make = {"date": lambda i: date(2024, 1, 1 + i), "decimal(10,2)": lambda i: Decimal(i) / 4, "timestamp": lambda i: datetime(2024, 1, 1 + i, 5), "binary": lambda i: bytes([i])}[kind]
    t = Table.create(spark, str(tmp_path / "t"), K, "long", MergeSpec.sum(), f"k {kind}")
    for _ in range(2):
        t.update(spark.createDataFrame([(make(i), i) for i in range(20)], f"k {kind}, value long"))
    t.optimize(make(3), make(9))
    again = Table.open(spark, t.path, K, MergeSpec.sum())
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
    assert {plain(r["k"]): r["value"] for r in again.rows().collect()} == {make(i): 2 * i for i in range(20)}
    assert again.rows(Bounds(make(3), make(9))).count() == 6 and again.tuple_bound(Bounds(make(19), None)) == 40
    assert again.tuple_bound(Bounds(None, make(2))) == 40 and again.count_in_range(Bounds(make(3), make(9))).first()["n"] == 6
    t.close()


def test_maintenance_takes_the_fullest_range_first(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), K, "long", MergeSpec.sum(), "k long", Options(fanout=2, part_rows=100))
    t.update(spark.createDataFrame([(k, 1) for k in range(100)], "k long, value long"))
    t.update(spark.createDataFrame([(k, 1) for k in range(70, 100)], "k long, value long"))
    t.update(spark.createDataFrame([(k, 1) for k in range(80, 100)], "k long, value long"))
    want = {k: 1 + (k >= 70) + (k >= 80) for k in range(100)}
    steps = 0
    while t.maintain():
        steps += 1
        assert state(t) == want and t.verify().isEmpty() and steps < 10
    runs = t.manifest().runs
    assert steps > 1 and len(runs) <= 2 and all(r.level for r in runs)
    t.close()


def test_batches_and_delta_size(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), K, "long", MergeSpec.sum(), "k long", Options(delta_rows=15, precombine=True))
    with pytest.raises(ValueError, match="repeats"):
        Table.create(spark, str(tmp_path / "u"), K, "long", MergeSpec.sum(), "k long").update(spark.createDataFrame([(1, 1), (1, 2)], "k long, value long"))
    rows = [(k, i, "UPDATE", 1) for k in range(10) for i in range(4)]
    batch = spark.createDataFrame(rows, "k long, seq long, op string, value long")
    t.append(batch)
    assert t.manifest().runs[0].rows == 10  # one message a key
    t.append(batch)
    assert [r.level for r in t.manifest().runs] == [1] and state(t) == dict.fromkeys(range(10), 8)
    assert t.get_async(4).result(60) == 8
    seen = {r["what"]: r["n"] for r in t.latency_histogram().groupBy("what").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert seen == {"append": 2, "lookup": 1, "compaction": 1} and '"version": 3' in t.dump()
    t.reset_stats()
    assert not t.latencies
    assert {r["found"] for r in t.might_exist_all(spark.createDataFrame([(3,), (99,)], "k long")).collect()} == {True, False}
    assert t.counts_by_run(Bounds(2, 5)).first()["n"] == 3
    t.close()


def test_a_place_that_holds_something_else_is_left_alone(spark, tmp_path):
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "letter.txt").write_text("keep me")
    with pytest.raises(ValueError, match="no table"):
        Table.create(spark, str(tmp_path / "mine"), K, "long")
    assert (tmp_path / "mine" / "letter.txt").read_text() == "keep me"


def test_commits_put_if_absent(spark, tmp_path):
    taken = set()

    def put(path, text):
        name = path.removeprefix("file:")
        if name in taken:
            return False
        taken.add(name)
        with open(name, "w") as f:
            f.write(text)
        return True

    (tmp_path / "t" / "_manifest").mkdir(parents=True)
    files = Files(spark, str(tmp_path / "t"), put)
    files.commit("_manifest/a", "1")
    with pytest.raises(Conflict):
        files.commit("_manifest/a", "2")
    plain = Files(spark, str(tmp_path / "t"))
    plain.commit("_manifest/b", "1")
    with pytest.raises(Conflict):
        plain.commit("_manifest/b", "2")
    assert plain.read("_manifest/b") == "1" and [n for n, _ in plain.list("_manifest") if "tmp" in n] == []


def test_verification_finds_disorder(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), K, "long", key_schema="k long")
    t.insert(spark.createDataFrame([(k, k) for k in range(50)], "k long, value long"))
    assert t.verify().isEmpty()
    run = t.manifest().runs[0].id
    rows = spark.read.parquet(f"{t.path}/runs/{run}")
    mixed = spark.createDataFrame(rows.orderBy("k").collect()[::-1], rows.schema)
    mixed.coalesce(1).write.mode("append").parquet(f"{t.path}/runs/{run}")
    assert {r["problem"] for r in t.verify().collect()} == {"repeated message", "out of order"}
    t.close()


def test_finish_and_printers(spark, tmp_path):
    from pyspark.sql import functions as F

    rule = MergeSpec.custom("longest", lambda old, new: F.greatest(old, new), final=lambda v: v + 1000, printer=lambda v: F.concat(F.lit("#"), v.cast("string")))
    key = KeySpec.custom("upper", ("k",), F.upper, lambda k: F.concat(F.lit("<"), k, F.lit(">")))
    t = Table.create(spark, str(tmp_path / "t"), key, "long", rule)
    t.insert(spark.createDataFrame([("a", 5)], "k string, value long"))
    t.update(spark.createDataFrame([("A", 7), ("b", 3)], "k string, value long"))
    assert state(t) == {"A": 7, "b": 1003}
    assert [tuple(r)[1:] for r in t.show_history("a").collect()] == [("UPDATE", "<A>", "#7"), ("INSERT", "<a>", "#5")]
    t.close()
