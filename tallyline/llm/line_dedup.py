"""Site-relative line dedup: lines that a large share of a host's pages carry are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, table, with_bad_lines

RATIO = 0.05
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """64 bits of the line without outer spaces; null for a blank line."""
    return F.when(F.trim(line) != "", F.xxhash64(F.trim(line)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key) of lines on at least min_pages pages of the host and on more than `ratio` of its pages.

    Pages are the distinct ids of a host, for the line and for the total; rows without an id are no page. A host's set has
    at most mean-lines-per-page / ratio lines, however many pages it has. The distinct (host, line, id) are dealt by all
    three, and lines are counted before they meet, so neither a large host nor a common line fills a task.
    """
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _key), lambda k: k.isNotNull()))
    named = pages.where("host IS NOT NULL AND doc_id IS NOT NULL")
    seen = named.select("host", "doc_id", F.explode(keys).alias("key")).distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_pages"))
    total = named.select("host", "doc_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    return seen.where(F.col("n_pages") >= min_pages).join(total, "host").where(F.col("n_pages") > ratio * F.col("n_host")).select("host", "key")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: doc_id, n_lines, n_dropped, text without the boilerplate lines of its host, and the columns in `keep`.

    Null or empty text: no lines, text stays as it is. Null host: no line drops. Blank lines never drop. Rows that repeat
    an id are one page in all counts, and each loses its host's boilerplate; so do rows without an id, which no count
    has. Built-in functions only; pages never shuffle by host unless the boilerplate outgrows a broadcast, and then the
    host's pages are salted.
    """
    pages = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[host_col].alias("host"), *[docs[c].alias(f"keep_{c}") for c in keep])
    joined, is_bad = with_bad_lines(pages, table(boilerplate(pages, ratio, min_pages), "boilerplate"))
    lines = _lines(F.col("text"))
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: _key(x).isNull() | ~is_bad(_key(x))))
    return joined.withColumn("kept", kept).select(
        "doc_id",
        F.when(F.length("text") > 0, F.size(lines)).otherwise(0).cast("long").alias("n_lines"),
        F.when(F.length("text") > 0, F.size(lines) - F.size("kept")).otherwise(0).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
        *[F.col(f"keep_{c}").alias(c) for c in keep],
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))


OP9_SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT source, count(DISTINCT doc_id) AS n_host FROM documents WHERE source IS NOT NULL GROUP BY 1),
c AS (SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS n_pages FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
bad AS (SELECT c.source, c.line FROM c JOIN n USING (source) WHERE n_pages >= {MIN_PAGES} AND n_pages > {RATIO}::DOUBLE * n_host),
k AS (SELECT l.doc_id, l.line, l.pos, bad.line IS NOT NULL AS dropped
      FROM l LEFT JOIN bad ON l.source = bad.source AND trim(l.line) = bad.line),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
             string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS text FROM k GROUP BY 1)
SELECT d.doc_id, CASE WHEN length(d.text) > 0 THEN n_lines ELSE 0 END AS n_lines,
       CASE WHEN length(d.text) > 0 THEN n_dropped ELSE 0 END AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text
FROM documents d LEFT JOIN g USING (doc_id)
"""
