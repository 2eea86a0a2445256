"""Cross-site boilerplate: lines that spread over many sites are removed but for one place.

A line's spread is the number of distinct sites (values of the site column) it occurs on.

1. Lines are hashed (128 bits) and counted.  A line on ``min_sites`` sites has at least as
   many occurrences, so all rarer lines leave here, in plain hash aggregation.
2. The rest carry their site into a HyperLogLog sketch per line; sketches of the parts of a
   hot line merge by aggregation, so no task sees all its rows.
3. A sketch whose estimate is clear of the threshold by ``band`` decides; lines nearer than
   that get an exact distinct count.
4. A line found to be boilerplate stays in the document with the smallest key that has it
   and goes from all others, so nothing is lost from the corpus.

Everything is DataFrame operations; no Python runs on the executors.

Defined results: lines are compared without spaces at their ends; lines that are blank then
never count.  Columns named ``n_lines`` or ``n_removed`` give way to the results.  Null text stays null with no lines; empty text is one blank line.  A null site
is a site of its own.  Repeats within one document stay.  Documents keep their other
columns, and stay even if all their lines go (their text is then empty).  Rows that repeat a
key and text are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import key128, materialize

#: Sketches have 2**LG_K registers: a relative standard error of about 1.6 %.
LG_K = 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame, text: str, site: str, key: str) -> DataFrame:
    """(k, th, site, pos, h1, h2): every line that isn't blank."""
    rows = docs.select(
        F.col(key).alias("k"),
        F.xxhash64(text).alias("th"),
        F.coalesce(F.col(site).cast("string"), F.lit("\u0000")).alias("site"),
        F.posexplode(_lines(F.col(text))).alias("pos", "line"),
    )
    h1, h2 = key128(F.col("line"))
    rows = rows.withColumn("line", F.trim("line")).where("line <> ''")
    return rows.select("k", "th", "site", "pos", h1.alias("h1"), h2.alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int, band: float) -> DataFrame:
    """(h1, h2) of lines on at least ``min_sites`` sites: by sketch, and near the threshold exactly."""
    sketched = (
        lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
        .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("spread"))
    )
    near = materialize(sketched.where(F.col("spread") >= min_sites * (1 - band)))
    clear = near.where(F.col("spread") > min_sites * (1 + band)).select("h1", "h2")
    unsure = near.where(F.col("spread") <= min_sites * (1 + band)).select("h1", "h2")
    exact = (
        lines.select("h1", "h2", "site").join(unsure, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2").agg(F.count_distinct("site").alias("spread"))
        .where(F.col("spread") >= min_sites).select("h1", "h2")
    )
    return clear.unionByName(exact)


def remove(
    docs: DataFrame, min_sites: int = 5, band: float = 0.15, text: str = "text", site: str = "source", key: str = "doc_id"
) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, and ``n_lines`` and ``n_removed`` added."""
    found = occurrences(docs, text, site, key)
    # written before it is joined, so that both sides of the join are plain exchanges, which
    # Spark splits where a line is hot
    often = materialize(
        found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("keeper"))
        .where(F.col("n") >= min_sites).drop("n")
    )
    lines = materialize(found.join(often, ["h1", "h2"]))
    gone = (
        lines.join(boilerplate(lines, min_sites, band), ["h1", "h2"], "left_semi")
        .where(~F.col("k").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("k").alias("__k"), F.col("th").alias("__t")).agg(F.collect_set("pos").alias("__gone"))
    )
    # The lines travel instead of the text, and as a column of their own: the places to keep
    # are then looked up in an array that is there, not split again for each.
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    others = [F.col(c) for c in columns if c != text]
    left = docs.select(*others, _lines(F.col(text)).alias("__lines"), F.xxhash64(text).alias("__th"))
    met = left.join(gone, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__th") == F.col("__t")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    cut = F.array_join(F.transform(places, lambda i: F.get(F.col("__lines"), i)), "\n")
    rebuilt = F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(cut)
    return met.select(
        *[rebuilt.alias(text) if c == text else F.col(c) for c in columns],
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


#: The removal in DuckDB SQL over ``documents``, with exact counts throughout.
ORACLE = """
WITH cut AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
boiler AS (
  SELECT trim(line) AS line, min(doc_id) AS keeper
  FROM cut WHERE trim(line) <> ''
  GROUP BY trim(line) HAVING count(DISTINCT coalesce(source, chr(1))) >= 5),
marked AS (
  SELECT cut.doc_id, cut.line, cut.pos, keeper IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS gone
  FROM cut LEFT JOIN boiler ON trim(cut.line) = boiler.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
UNION ALL
SELECT doc_id, 0::BIGINT, 0::BIGINT, NULL FROM documents WHERE text IS NULL
"""
