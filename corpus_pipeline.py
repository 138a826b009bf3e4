"""The corpus pipeline: quality, line dedup, near duplicates, personal data, packing. Each stage reads what the last one wrote.

Rows that repeat an id, and rows without one, are documents of their own from the first stage to the last: only their
texts decide whether they stay. Null texts count as empty; the quality stage rejects or keeps them like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import documents, labels, table
from tallyline.llm.jaccard_join import jaccard_join
from tallyline.llm.line_dedup import dedup_lines
from tallyline.llm.packing import pack_documents
from tallyline.llm.pii import find_pii
from tallyline.llm.quality_crf import score_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _documents(score_quality(docs, labels(spark, sf_dir), keep=("text", "lang", "source")).where("predicted = 1"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; documents stay."""
    return _documents(dedup_lines(docs, keep=("lang", "source")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest id, of equal ids the one written first; rows without an id come last.

    Groups are those of the rows, by their place in a written table, so texts of one id that are not alike stay apart.
    """
    rows = table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = jaccard_join(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    placed = rows.select("_row", "doc_id").join(groups, "_row")
    first = placed.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")).select(F.col("first._row").alias("_row"))
    return _documents(rows.join(first, "_row", "left_semi"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans give way to the name of their kind."""
    return _documents(find_pii(docs, keep=("lang", "source")).withColumnRenamed("redacted", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packing)]

#: Trained stages can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
