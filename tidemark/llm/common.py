"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.place import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: dict[str, list[str]] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, which cuts its lineage.

    What follows survives lost executors without computing ``df`` again, and sees one and
    the same set of rows however often it reads them.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what :func:`materialize` has written in this application; returns how many tables.

    Results are lazy and read these tables, so call it once they are saved.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, as their workers import it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="tidemark-")) / f"{top.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``; it returns one batch or yields several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """The column's strings; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def key128(col: Column) -> list[Column]:
    """Two independent 64-bit hashes of a string column; null and empty hash alike."""
    text = F.coalesce(col, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(0x5DEECE66D), text)]


#: Texts of a sample that one task should count.
TEXTS = 250


def few_texts(rows: DataFrame, n: float, by: str, text: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """About ``n`` different texts of each value of ``by``, those with the smallest hashes, and each value's rows.

    The texts come as (by, h1, h2, text), the same ones whatever the partitions; all if there are
    no more.  Only texts whose hash is below a cutoff leave their partition: it follows from a
    sketch of how many different ones there are, so copies fill nothing and no task sees a
    whole group.  ``by`` needs few different values, as a row of each reaches the driver.
    """
    h1, h2 = key128(F.col(text))
    hashed = rows.select(F.col(by).alias("by"), h1.alias("h1"), h2.alias("h2"), F.col(text).alias("text"))
    sizes = hashed.groupBy("by").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h1").alias("texts")).collect()
    cuts = [(r["by"], int(min(1.0, n / r["texts"]) * ((1 << 64) - 1)) - (1 << 63)) for r in sizes]
    kind = rows.schema[by].dataType.simpleString()
    # broadcast: a row for each value of ``by``
    cut = F.broadcast(rows.sparkSession.createDataFrame([(k, min(c, (1 << 63) - 1)) for k, c in cuts], f"by {kind}, cut long"))
    few = hashed.join(cut, "by").where("h1 <= cut").groupBy("by", "h1", "h2").agg(F.first("text").alias("text"))
    return few.select(F.col("by").alias(by), "h1", "h2", F.col("text").alias(text)), {r["by"]: r["n"] for r in sizes}
