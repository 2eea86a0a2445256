"""The driver's queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, bytebpe, html, langid, linededup, media, minhash, packing, pii, tokencount
from tidemark.llm.common import table


#: Sites that make a line boilerplate: a quarter of the sources, so that passages count although a
#: third of all rows may come from one of them.
MIN_SITES = 5


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()).select("text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as telephony audio: stored, read back, measured."""
    return media.features(media.store(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that spread over five sources or more; the text as a digest."""
    kept = linededup.remove(table(spark, sf_dir, "documents"), min_sites=MIN_SITES)
    return kept.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after four edits drawn from its id."""
    docs = table(spark, sf_dir, "documents").withColumn("edits", tokencount.drawn_edits())
    return tokencount.count_listed(docs, bytebpe.default_path())


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    parts = packing.pieces(table(spark, sf_dir, "documents"), bytebpe.default_path(), capacity=1024, end_id=2)
    return packing.pack(parts, capacity=1024)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every vector whose id is divisible by 100."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their decoding, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), bytebpe.default_path())


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document among exact and near copies (five words, similarity 0.8)."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base patterns' counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs.select("doc_id", "text"), pii.fit(docs.select("text")), keep=["doc_id"], redacted=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this package by name."""
    found = [
        op1_language_id, op2_media_columns, op3_line_dedup, op4_token_counts, op5_best_fit_packing,
        op6_nearest_neighbours, op7_bpe, op8_near_duplicates, op9_html_extraction, op10_personal_data,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express."""
    return {"op3_line_dedup": linededup.ORACLE}
