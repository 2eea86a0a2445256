"""Histories against a literal fold, message by message."""

import random

import pytest

from tidemark.functions.keys import KeySpec
from tidemark.functions.merge import DELETE, INSERT, UPDATE, MergeSpec
from tidemark.operators.resolve import FULL, INTERMEDIATE, old_values, resolve

K = KeySpec.lex("k")
SCHEMA = "k long, seq long, op string, value long"


def wrap(x):
    return (x + 128) % 256 - 128


class Model:
    """One key, folded from old to new."""

    def __init__(self, zero_deletes):
        self.zero, self.state = zero_deletes, None  # None: nothing; (op, value)

    def shape(self, x):
        return wrap(x) if self.zero else x

    def done(self, value):
        value = self.shape(value)
        return (DELETE, None) if self.zero and value == 0 else (INSERT, value)

    def apply(self, op, value):
        if op != UPDATE:
            self.state = (op, value if op == INSERT else None)
        elif self.state is None:
            self.state = (UPDATE, value)
        elif self.state[0] == UPDATE:
            self.state = (UPDATE, self.shape(self.state[1] + value))
        elif self.state[0] == DELETE:
            self.state = self.done(value)
        else:
            self.state = self.done(self.state[1] + value)

    def read(self):
        if self.state is None or self.state[0] == DELETE:
            return None
        return self.done(self.state[1])[1] if self.state[0] == UPDATE else self.state[1]


def histories(n_keys, seed):
    draw = random.Random(seed)
    rows, seq = [], 0
    for k in range(n_keys):
        for _ in range(draw.randint(1, 9)):
            seq += 1
            op = draw.choice([INSERT, UPDATE, UPDATE, DELETE])
            rows.append((k, seq, op, None if op == DELETE else draw.choice([0, 1, -1, 5, -5, 100, 127, -128])))
    draw.shuffle(rows)
    return rows


def expected(rows, zero_deletes):
    models, before = {}, {}
    for k, seq, op, value in sorted(rows, key=lambda r: r[1]):
        m = models.setdefault(k, Model(zero_deletes))
        before[seq] = m.read()
        m.apply(op, value)
    return {k: m.read() for k, m in models.items() if m.read() is not None}, before


RULES = [
    (MergeSpec.sum(), False),
    (MergeSpec.counter_int8(), True),
    (MergeSpec.custom("plus", lambda a, b: a + b), False),
    (MergeSpec.custom("counter", MergeSpec.counter_int8().pair, True), True),
]


@pytest.mark.parametrize("rule,zero", RULES, ids=lambda x: getattr(x, "name", str(x)))
def test_full_resolution_equals_the_fold(spark, rule, zero):
    from pyspark.sql import functions as F

    rows = histories(400, 11)
    messages = spark.createDataFrame(rows, SCHEMA)
    want, _ = expected(rows, zero)
    for segment in (None, F.floor(F.col("seq") / 4)):
        got = {r["k"]: r["value"] for r in resolve(messages, K, rule, FULL, segment).collect()}
        assert got == want


@pytest.mark.parametrize("rule,zero", RULES[:2], ids=lambda x: getattr(x, "name", str(x)))
def test_compaction_of_any_part_changes_no_read(spark, rule, zero):
    from pyspark.sql import functions as F

    rows = histories(300, 12)
    messages = spark.createDataFrame(rows, SCHEMA)
    want, _ = expected(rows, zero)
    for low, high in ((0, 500), (300, 900), (700, 5000)):
        # a contiguous stretch of each key's history becomes one message
        part = (F.col("seq") >= low) & (F.col("seq") < high)
        made = resolve(messages.where(part), K, rule, INTERMEDIATE).select("k", "seq", "op", "value")
        both = messages.where(~part).unionByName(made)
        assert {r["k"]: r["value"] for r in resolve(both, K, rule).collect()} == want


@pytest.mark.parametrize("rule,zero", RULES[:2], ids=lambda x: getattr(x, "name", str(x)))
def test_old_values(spark, rule, zero):
    rows = histories(300, 13)
    _, before = expected(rows, zero)
    got = old_values(spark.createDataFrame(rows, SCHEMA), K, rule).collect()
    assert {r["seq"]: r["old_value"] for r in got} == before
    assert all(r["old_found"] == (before[r["seq"]] is not None) for r in got)


HAND = [
    ("sum of insert and update", [(INSERT, 1), (UPDATE, 5)], 6),
    ("counter back to zero", [(INSERT, 1), (UPDATE, 5), (UPDATE, -6)], None),
    ("insert after zero", [(INSERT, 1), (UPDATE, 5), (UPDATE, -6), (INSERT, 12)], 12),
    ("updates pile up", [(INSERT, 3), (UPDATE, 4), (UPDATE, 2)], 9),
    ("update alone", [(UPDATE, 9)], 9),
    ("update after delete", [(DELETE, None), (UPDATE, 4)], 4),
    ("a stored zero is present", [(INSERT, 0)], 0),
    ("wrap at eight bits", [(INSERT, 100), (UPDATE, 100)], -56),
]


def test_hand_checked_histories(spark):
    rows = [(i, j, op, v) for i, (_, h, _) in enumerate(HAND) for j, (op, v) in enumerate(h)]
    got = {r["k"]: r["value"] for r in resolve(spark.createDataFrame(rows, SCHEMA), K, MergeSpec.counter_int8()).collect()}
    for i, (name, _, want) in enumerate(HAND):
        assert got.get(i) == want, name


def test_last_write_wins_refuses_updates(spark):
    rows = spark.createDataFrame([(1, 1, INSERT, 1), (1, 2, UPDATE, 1)], SCHEMA)
    with pytest.raises(Exception, match="merge rule"):
        resolve(rows, K, MergeSpec.last_write_wins()).collect()
    rows = spark.createDataFrame([(1, 1, INSERT, 7), (2, 1, INSERT, 8), (2, 2, DELETE, None)], SCHEMA)
    assert [(r["k"], r["value"]) for r in resolve(rows, K, MergeSpec.last_write_wins()).collect()] == [(1, 7)]


def test_empty_value_is_present(spark):
    rows = spark.createDataFrame([("empty", 1, INSERT, ""), ("gone", 1, DELETE, None)], "k string, seq long, op string, value string")
    assert [(r["k"], r["value"]) for r in resolve(rows, K, MergeSpec.last_write_wins()).collect()] == [("empty", "")]
    rows = spark.createDataFrame([("a", 1, INSERT, "x"), ("a", 2, UPDATE, "y"), ("a", 3, UPDATE, "z")], "k string, seq long, op string, value string")
    assert resolve(rows, K, MergeSpec.append("-")).first()["value"] == "x-y-z"


def test_identity_is_the_order(spark):
    rows = spark.createDataFrame([("010.0.0.1", 1, INSERT, 1), ("10.0.0.1", 2, INSERT, 2), ("9.0.0.1", 1, INSERT, 3)], "ip string, seq long, op string, value long")
    got = resolve(rows, KeySpec.ipv4("ip"), MergeSpec.last_write_wins()).orderBy("sort_key").collect()
    assert [(r["ip"], r["value"]) for r in got] == [("9.0.0.1", 3), ("10.0.0.1", 2)]


@pytest.mark.parametrize("rule", [MergeSpec.last_write_wins(), MergeSpec.sum(), MergeSpec.counter_int8()], ids=lambda r: r.name)
def test_resolution_is_one_exchange(spark, tmp_path, rule):
    path = str(tmp_path / "m")
    spark.createDataFrame(histories(50, 1), SCHEMA).withColumn("unused", K.hash()).write.parquet(path)
    plan = resolve(spark.read.parquet(path).where("k < 20"), K, rule)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "LessThan(k,20)" in plan and "unused" not in plan
    if rule.pair is None:
        assert "partial_max_by" in plan


@pytest.mark.parametrize("rule", ["lww", "sum", "counter", "fold", "append"])
def test_old_values_of_a_hot_key(spark, rule):
    """A key with most messages, over many stretches, under every kind of rule."""
    from tidemark.operators import resolve as module

    draw = random.Random(11)
    text = rule == "append"
    merge = {
        "lww": MergeSpec.last_write_wins(), "sum": MergeSpec.sum(), "counter": MergeSpec.counter_int8(),
        "fold": MergeSpec.custom("plus", lambda old, new: old + new), "append": MergeSpec.append("-"),
    }[rule]
    rows = []
    for seq in range(0, 3000, 2):
        k = 7 if seq % 6 else draw.randint(0, 20)
        op = draw.choices([INSERT, DELETE, UPDATE], [2, 1, 0 if rule == "lww" else 30])[0]
        rows.append((k, seq, op, None if op == DELETE else chr(97 + seq % 26) if text else draw.randint(-90, 90)))
    want, state = {}, {}
    for k, seq, op, value in rows:
        s = state.get(k)  # (op, value) of the state; UPDATE for updates over nothing
        seen = s
        if s and s[0] == UPDATE:
            seen = (INSERT, s[1])
            if rule == "counter":
                seen = (DELETE, None) if s[1] == 0 else seen
        want[seq] = (bool(seen and seen[0] == INSERT), seen[1] if seen and seen[0] == INSERT else None)
        if op != UPDATE:
            state[k] = (op, value)
            continue
        below = s[1] if s and s[0] in (INSERT, UPDATE) else None
        merged = value if below is None else f"{below}-{value}" if text else below + value
        if rule == "counter":
            merged = wrap(merged)
        final = s is not None and s[0] != UPDATE
        state[k] = ((DELETE, None) if rule == "counter" and final and merged == 0 else (INSERT if final else UPDATE, merged))
    kind = "string" if text else "long"
    df = spark.createDataFrame(rows, f"k long, seq long, op string, value {kind}").repartition(3)
    wide, folded = module.STRETCH, module.FOLDED
    try:
        for module.STRETCH, module.FOLDED in ((64, 8), (1 << 16, 256)):
            got = {r["seq"]: (r["old_found"], r["old_value"]) for r in old_values(df, K, merge).collect()}
            assert got == want
    finally:
        module.STRETCH, module.FOLDED = wide, folded


def test_no_window_holds_a_hot_key(spark):
    df = spark.createDataFrame([(1, 1, INSERT, 2), (1, 2, UPDATE, 3), (2, 1, UPDATE, 1)], SCHEMA)
    plan = resolve(df, K, MergeSpec.sum(), hot=True)._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_sum" in plan
    assert {(r["k"], r["value"]) for r in resolve(df, K, MergeSpec.sum(), hot=True).collect()} == {(1, 5), (2, 1)}


@pytest.mark.parametrize("rule,zero", RULES, ids=lambda x: getattr(x, "name", str(x)))
@pytest.mark.parametrize("mode", [FULL, INTERMEDIATE])
def test_hot_and_plain_resolution_agree(spark, rule, zero, mode):
    rows = [*histories(200, 17), *[(7, 100_000 + i, UPDATE if i % 97 else INSERT, i % 11 - 5) for i in range(900)], (None, 1, INSERT, 4), (None, 2, UPDATE, 3)]
    messages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plain = {tuple(r) for r in resolve(messages, K, rule, mode).collect()}
    assert {tuple(r) for r in resolve(messages, K, rule, mode, hot=True).collect()} == plain and (None in {r[0] for r in plain})
