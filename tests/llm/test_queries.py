"""The registered queries at the smallest size: columns, types, and rows."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op3_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, text_md5 string",
    "op4_token_counts": "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_chars_after bigint, n_chars_encoded bigint",
    "op5_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_near_duplicates": "doc_id bigint, class_id bigint, is_first boolean",
    "op9_html_extraction": "page_id bigint, url string, text string, n_chars bigint, n_lines bigint, n_shared bigint, n_structure bigint, n_protected bigint",
    "op10_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == COLUMNS[name]
    table = {"op6": "embeddings", "op9": "pages"}.get(name.split("_")[0], "documents")
    if table == "embeddings":
        asked = spark.read.parquet(f"{SF}/{table}.parquet").where("vec_id % 100 = 0").count()
        assert got.count() == 10 * asked
    else:
        n = spark.read.parquet(f"{SF}/{table}.parquet").count()
        assert (got.count() if name != "op5_best_fit_packing" else got.select("doc_id").distinct().count()) == n


def test_names():
    assert {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()} == set(COLUMNS)
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_held_out_languages(spark):
    got = entry.queries()["op1_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) > 100


def test_articles_are_extracted_whole(spark):
    """Against the article element cut out with a pattern, on pages as they are generated."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in entry.queries()["op9_html_extraction"](spark, "/root/testdata/sf0.01").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = [html.unescape(re.sub(r"</?b>", "", b)) for b in re.split(r"<(?!/?b>)[^>]*>", body)]
        assert r["text"] == " ".join(" ".join(blocks).split()) and r["n_chars"] == len(r["text"])
