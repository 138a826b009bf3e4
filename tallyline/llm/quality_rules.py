"""Quality rules: counts within a document, and the frequency of its lines across the documents of its host."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, each_batch, table, with_bad_lines

#: A line is removed if more documents of its host have it than MIN_DOCS and than SHARE of the host's documents.
MIN_DOCS = 10
SHARE = 0.05
#: A document is depleted if fewer of its words are left than this share.
LEFT = 0.5


def _counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n = len(words)
    repeat = 0
    if n >= 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        with np.errstate(over="ignore"):
            tri = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
            tri ^= tri >> np.uint64(29)
        order = np.argsort(tri, kind="stable")
        s = tri[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(n, bool)
        hit[:-2] |= twice
        hit[1:-1] |= twice
        hit[2:] |= twice
        repeat = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def base_counts(docs: DataFrame) -> DataFrame:
    """The base columns of each row of (doc_id, text, ...), which pass on every other column."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = docs.drop("text").schema
    passed = kept.names

    def run(batch):
        out = {c: batch.column(c) for c in passed}
        rows = [_counts(t or "") for t in batch.column("text").to_pylist()]
        return out | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + "".join(f", {n} long" for n in names)
    return each_batch(docs, run, schema)


def _keyed(text):
    """(64 bits of the normalised line, its words) for each line with a word; normalised: lower case, one space between words, digits as 0."""
    words = lambda x: F.filter(F.split(x, r"[ \t\x0B\f\r]+"), lambda w: w != "")
    norm = lambda w: F.regexp_replace(F.lower(F.array_join(w, " ")), "[0-9]+", "0")
    rows = F.transform(F.transform(F.split(text, "\n"), words), lambda w: F.struct(F.xxhash64(norm(w)).alias("key"), F.size(w).alias("n")))
    return F.filter(rows, lambda r: r["n"] > 0)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left, kept; a row for each input row.

    Null or empty text: zero counts, so base_failed. Null host: no line is removed. The documents of a host are its distinct
    ids, for a line and for the total; rows without an id are in neither, but lose the host's lines as well. A document of
    which fewer than `left` of the words stay is depleted and not kept.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), docs[host_col].alias("host"))
    named = rows.where("host IS NOT NULL AND doc_id IS NOT NULL")
    keys = F.array_distinct(F.transform(_keyed(F.col("text")), lambda r: r["key"]))
    # dealt by host, line and id, and counted before lines meet: neither a large host nor a common line fills a task
    seen = named.select("host", "doc_id", F.explode(keys).alias("key")).distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    total = named.select("host", "doc_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    bad = table(seen.where(F.col("n") > min_docs).join(total, "host").where(F.col("n") > share * F.col("n_host")).select("host", "key"), "common-lines")
    joined, is_bad = with_bad_lines(rows, bad)
    lost = F.when(F.col("bad").isNull(), 0).otherwise(F.aggregate(_keyed(F.col("text")), F.lit(0), lambda a, r: a + F.when(is_bad(r["key"]), r["n"]).otherwise(0)))
    counted = base_counts(joined.select("doc_id", "text", lost.cast("long").alias("n_lost")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n_left = F.col("n_words") - F.col("n_lost")
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), n_left.alias("n_left"),
        (~failed & (n_left >= left * F.col("n_words"))).alias("kept"),
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
t AS (SELECT doc_id, pos, {{'a': word, 'b': lead(word) OVER p, 'c': lead(word, 2) OVER p}} AS tri,
             lead(word, 2) OVER p IS NOT NULL AS whole FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, tri) > 1 AS twice FROM t WHERE whole),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM r WHERE twice) GROUP BY 1),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY 1),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
ln AS (SELECT *, regexp_replace(lower(array_to_string(ws, ' ')), '[0-9]+', '0', 'g') AS norm FROM lw WHERE len(ws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT doc_id) AS n_host FROM d WHERE source IS NOT NULL GROUP BY 1),
bad AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM ln WHERE source IS NOT NULL GROUP BY 1, 2)
        JOIN hosts USING (source) WHERE n > {MIN_DOCS} AND n > {SHARE}::DOUBLE * n_host),
lost AS (SELECT doc_id, sum(len(ws)) AS n FROM ln SEMI JOIN bad ON ln.source = bad.source AND ln.norm = bad.norm GROUP BY 1),
m AS (SELECT d.doc_id, coalesce(wc.n_words, 0) AS n_words, coalesce(wc.word_chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
             coalesce(h.n, 0) AS n_repeat_words, coalesce(wc.n_words, 0) - coalesce(lost.n, 0)::BIGINT AS n_left
      FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_left,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= {LEFT}::DOUBLE * n_words AS kept
FROM m
"""
