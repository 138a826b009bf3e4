"""Files in and out: explicit schemas, unknown keys ignored, missing keys null. A path that is read is never written over."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared(spark)}/tallyline-{tag}-{uuid.uuid4().hex}"


def table(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: it is computed once, and a lost executor costs a read."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, as in tests, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank lines are skipped, lines that can't be read have their text in _corrupt."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.select("r.*")


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents (path, document) as lines of archives: the path that each would have as a file of its own, and its text."""
    docs.select("path", "document").write.json(path)


def read_documents(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str], id_pattern: str, archived: bool = False) -> dict[str, DataFrame]:
    """Per-entity JSON documents of several kinds; the entity is the first group of id_pattern in the document's path.

    They are files of their own, each of which is listed and opened, or archived by `write_documents`, where files grow with bytes and not with entities.
    """
    out = {}
    for kind, path in paths.items():
        if archived:
            lines = spark.read.schema("path string, document string").json(path)
            parsed = lines.select(F.from_json("document", schemas[kind]).alias("r"), "path")
            out[kind] = parsed.select("r.*", F.regexp_extract("path", id_pattern, 1).alias("entity"))
        else:
            df = spark.read.schema(schemas[kind]).option("multiLine", True).json(path)
            out[kind] = df.withColumn("entity", F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1))
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all text; a byte order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_version(rows: DataFrame, root: str) -> str:
    """Write a new version beside the old ones and point to it; the earlier versions stay as the archive."""
    version = f"{root}/v={time.time_ns()}"
    rows.write.parquet(version)
    spark = rows.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{root}/current")
    return version


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version that the last pointer names."""
    newest = spark.read.schema("version string").json(f"{root}/current").agg(F.max("version")).head()[0]
    return spark.read.parquet(newest)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Chosen columns with a header."""
    rows.select(*columns).write.csv(path, header=True)


def flat_entries(lists: DataFrame, id_: str, entries: str, inner: str) -> DataFrame:
    """Entries of nested lists, of two levels at most: an entry that has entries of its own gives way to them."""
    one = lists.select(id_, F.posexplode_outer(entries).alias("i", "entry"))
    nested = F.coalesce(F.size(F.col(f"entry.{inner}")), F.lit(0)) > 0
    deep = one.where(nested).select(id_, "i", F.posexplode(F.col(f"entry.{inner}")).alias("j", "leaf"))
    flat = one.where(~nested & F.col("entry").isNotNull()).select(id_, "i", F.lit(0).alias("j"), F.col("entry.title").alias("title"))
    return flat.unionByName(deep.select(id_, "i", "j", F.col("leaf").alias("title")))


def split_by_kind(rows: DataFrame, kind: str, parts: dict[str, list[str]]) -> dict[str, DataFrame]:
    """One table for each kind of a tagged union, with the columns that the kind has."""
    return {k: rows.where(F.col(kind) == k).select(*cols) for k, cols in parts.items()}
