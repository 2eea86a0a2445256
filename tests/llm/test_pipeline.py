"""The pipeline's stages against plain Python on a small table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bytebpe

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    odd = spark.createDataFrame([(10_000, "123 !!", None, "s", 6), (10_001, None, "en", None, None)], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", F.lit("x")).withColumn("spans", F.lit(1))
    (_, language), (_, lines), (_, copies), (_, privacy), (_, pack) = corpus_pipeline.STAGES
    told = language(spark, docs, SF)
    assert told.columns == [*columns, "score", "spans"]
    assert {r["doc_id"] for r in told.collect()} == set(before)
    cut = {r["doc_id"]: r for r in lines(spark, told, SF).collect()}
    assert set(cut) == set(before)
    for i, r in cut.items():
        rest = iter(before[i]["text"].split("\n"))
        assert all(x in rest for x in r["text"].split("\n")) or r["text"] == ""
        assert r["n_chars"] == len(r["text"])
    cut_df = spark.createDataFrame(list(cut.values()), told.schema)
    from tests.llm.test_operators import partition

    want = {i for i, c in partition([(i, r["text"]) for i, r in cut.items()]).items() if i == c}
    kept = copies(spark, cut_df, SF)
    assert kept.columns == told.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert set(rows) == want and all(rows[i]["text"] == cut[i]["text"] for i in rows)
    clean = privacy(spark, kept, SF)
    assert clean.columns == told.columns and clean.count() == len(rows)
    assert not clean.where(F.col("text").rlike(r"@mail[0-9]\.example|\+[0-9] \([0-9]{3}\)")).count()
    packed = pack(spark, clean, SF).collect()
    b = bytebpe.load(bytebpe.default_path())
    total = Counter()
    for r in packed:
        total[r["doc_id"]] += r["length"]
    assert total == {r["doc_id"]: b.count(r["text"]) + 1 for r in clean.collect()}


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0


def test_copies_keep_different_texts_of_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("oak", "elm", "ash", "fir", "yew")]
    near = texts[3] + " more"
    rows = [
        (None, texts[0], "en", "b", 1), (None, texts[0], "en", "a", 1), (None, texts[1], "en", "a", 1), (None, near, "en", "a", 1),
        (7, texts[2], "en", "a", 1), (7, texts[2], "en", "a", 1), (7, texts[3], "en", "a", 1), (9, near, "en", "a", 1),
        (8, texts[4], "en", "b", 1), (8, texts[4] + " also", "en", "a", 1), (None, None, "en", "a", None),
    ]
    want = [rows[1], rows[2], rows[4], rows[6], rows[8], rows[10]]
    got = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, spark.createDataFrame(rows, docs.schema), SF)
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_marked_rows_equal_a_semi_join(spark):
    rows = spark.range(100_000).repartition(3).withColumn("__row", F.monotonically_increasing_id()).localCheckpoint()
    for kept in (rows.where("id % 7 IN (0, 3) OR id < 50"), rows.where("false"), rows):
        want = rows.join(kept.select("__row"), "__row", "left_semi").select(*rows.columns)
        got = corpus_pipeline.marked(rows, kept.select("__row"))
        assert got.columns == rows.columns and got.count() == kept.count() and not got.exceptAll(want).count()


def test_copies_choose_rows_without_moving_texts(spark):
    """Whatever the size: no plan may hope that the chosen rows are few enough to be broadcast."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = corpus_pipeline.copies(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
