"""Inputs as message logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.merge import DELETE, INSERT, UPDATE


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as messages: errors delete, signups insert, all else updates by the floor of its value."""
    kind = F.col("event_type")
    op = F.when(kind == "error", DELETE).when(kind == "signup", INSERT).otherwise(UPDATE)
    return driver_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("k"), F.col("event_id").alias("seq"), op.alias("op"), F.floor("value").cast("long").alias("value")
    )


def puts(messages: DataFrame) -> DataFrame:
    """The same messages, all as inserts."""
    return messages.withColumn("op", F.lit(INSERT))


def trace(lines: DataFrame, line: str = "value", number: Column | None = None) -> DataFrame:
    """Benchmark trace lines ``r|d|i|u|s key [length]`` as (seq, kind, op, k, length); writes of all kinds insert."""
    part = F.split(F.trim(line), r"\s+")
    kind = part[0]
    rows = lines.withColumn("seq", F.col("seq") if number is None else number)
    return rows.select(
        "seq", kind.alias("kind"), F.when(kind.isin("d", "i", "u"), INSERT).alias("op"), F.get(part, F.lit(1)).alias("k"),
        F.get(part, F.lit(2)).cast("long").alias("length"),
    )
