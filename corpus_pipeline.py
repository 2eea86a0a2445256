"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Every stage but the last returns the columns of ``documents``; :func:`run` writes each
stage's rows to the shared folder and reads them again, so a lost executor never sends the
work back beyond the stage it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bytebpe, langid, linededup, minhash, packing, pii, queries
from tidemark.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told (no letter, or no language with half of the
    posterior); a missing ``lang`` is filled in."""
    model = langid.fit(docs.where(~langid.held_out()).select("text", "lang"))
    found = langid.predict(docs, model, prefix="__").where(~langid.rejected("__lang_pred", "__score"))
    return found.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that spread over five sources or more from all documents but the first; keep every document."""
    cut = linededup.remove(docs, min_sites=queries.MIN_SITES)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, that with the smallest id (then the smallest row), of each class of exact and near copies.

    Rows are told apart by numbers of their own: an id may be null or stand for several texts.
    """
    # written, as the numbers differ each time they are drawn
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = minhash.classes(rows, key="__row").select("__row", "class_id")
    ids = rows.select("__row", F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    placed = materialize(found.join(ids, "__row"))
    # written before it is joined, so that a large class's join can be split
    least = materialize(placed.groupBy("class_id").agg(F.min(F.struct("none", "id")).alias("least"), F.count(F.lit(1)).alias("n")))
    first = placed.join(least, "class_id").where((F.col("none") == F.col("least.none")) & F.col("id").eqNullSafe(F.col("least.id")))
    # rows of a class that repeat its smallest id: the smallest row stays
    first = materialize(first.select("__row", "class_id", "n"))
    repeated = materialize(first.where("n > 1").groupBy("class_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    order = F.struct(*[c for c in docs.columns if c != "doc_id"], "__row")
    among = materialize(first.join(repeated, "class_id").select("__row", "class_id"))
    several = materialize(marked(rows, among).join(among, "__row"))
    chosen = several.groupBy("class_id").agg(F.min(order).alias("row")).select(F.col("row.__row").alias("__row"))
    kept = materialize(first.join(repeated, "class_id", "left_anti").select("__row").unionByName(chosen))
    return marked(rows, kept).select(*docs.columns)


def marked(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose number ``__row`` is in ``kept``; texts stay where they are.

    Numbers count up within each partition that wrote them, so a bit a row tells which stay: a
    broadcast of 4 KB for each 32,768 rows, where a join would move every text.
    """
    bits = kept.groupBy(F.bitmap_bucket_number("__row").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__row")).alias("__bits"))
    place = F.bitmap_bit_position("__row")
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__bucket", F.bitmap_bucket_number("__row")).join(F.broadcast(materialize(bits)), "__bucket")
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by the name of its kind; keep every document."""
    found = pii.find(docs, pii.fit(docs.select("text")), prefix="__")
    return found.withColumn("text", F.col("__redacted")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise what is left and pack it into sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, bytebpe.default_path(), capacity=1024, end_id=2), capacity=1024)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", copies),
    ("PII", privacy),
    ("best-fit packing", pack),
]

#: SQL can express neither the trained models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
