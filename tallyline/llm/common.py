"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The separators of words: space and \t \n \v \f \r, as bytes.split() has them.
SPACES = b" \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). Only a local master, as in tests, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/tallyline-{tag}-{uuid.uuid4().hex}"


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs a read."""
    return written(df, tag)[0]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As `table`, with the path, for `remove` once nothing reads it any more."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def take(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The id as doc_id, the text with null as empty, and named columns; others, whatever their names, stay behind."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
        *[docs[c].alias(c) for c in more],
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: tasks import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="tallyline-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds the texts of few rows at once as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def each_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with one dict of columns for each batch; the types come from the schema."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def crc_mod(col: str, n: int) -> F.Column:
    """crc32 of the id written as text, mod n: the fold of a row."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def in_fold(col: str, n: int, fold: int) -> F.Column:
    """Whether a row is in the fold; a row without an id is in none."""
    return F.coalesce(crc_mod(col, n) == fold, F.lit(False))


def labelled(docs: DataFrame, marks: DataFrame, label: str, folds: int, held_out: int, examples: int, usable: F.Column) -> tuple[DataFrame, float]:
    """((doc_id, label, text) of up to `examples` documents of each class, outside the held-out fold; the share of class 1).

    docs: (doc_id, text); marks: doc_id and a 0/1 label (others: none). Documents that are usable and labelled are found
    first, then those of each class that come first by a hash of the id are taken, so unusable ones take no place. Of rows
    that repeat an id the least usable text stands for it, and label 1 wins. The share is that of all labels outside the fold.
    """
    known = marks.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(~in_fold("doc_id", folds, held_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    here = table(known.join(docs.where(usable).select("doc_id"), "doc_id", "left_semi"), "labelled")
    part = lambda v: here.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    chosen = table(part(0).unionByName(part(1)), "chosen")
    one, n = known.agg(F.sum("label"), F.count(F.lit(1))).head()
    texts = docs.where(usable).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts, ((one or 0) + 1) / (n + 2)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over all batches of a partition: fn takes them and yields dicts of columns."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(small(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: Up to so many lines go to every executor (8 bytes each, and an array for every four or fewer); more are joined by host, with salted rows.
BROADCAST_LINES = 500_000
SALTS = 32


def line_sets(bad: DataFrame) -> DataFrame:
    """(host, bad): each host's keys dealt into buckets by their last bits, as many as that host needs to have eight to a bucket at the mean. All hosts together have at most a bucket for every four lines, and one more each.

    Lines that are on more than a share of a host's pages are at most the mean number of lines of its pages over that share, so a host's row is bounded.
    """
    sized = bad.join(bad.groupBy("host").agg(F.greatest(F.lit(0.0), F.ceil(F.log2(F.count(F.lit(1)) / 8))).alias("bits")), "host").withColumn("buckets", F.pow(F.lit(2.0), F.col("bits")).cast("int"))
    full = sized.groupBy("host", F.pmod("key", F.col("buckets")).cast("int").alias("slot")).agg(F.collect_list("key").alias("keys"))
    empty = sized.select("host", "buckets").distinct().select("host", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("slot"), F.array().cast("array<bigint>").alias("keys"))
    dense = full.unionByName(empty).groupBy("host", "slot").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    return dense.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "keys"))), lambda x: x["keys"]).alias("bad"))


def with_bad_lines(rows: DataFrame, bad: DataFrame, broadcast_lines: int = BROADCAST_LINES) -> tuple[DataFrame, Callable[[F.Column], F.Column]]:
    """(rows with the column bad, a function that says whether a line's key is among those of the row's host).

    rows have a host, bad is a written table (host, key). The sets of `line_sets` are broadcast if their lines, which bound
    their buckets too, are counted few; else rows meet their host's set in a join, salted so that a large host fills no
    task. Looking a line up reads one bucket.
    """
    sets = line_sets(bad)
    if bad.limit(broadcast_lines + 1).count() <= broadcast_lines:
        joined = rows.join(F.broadcast(sets), "host", "left")
    else:
        salted = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", (F.rand(7) * SALTS).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    return joined, lambda key: F.coalesce(F.array_contains(F.get("bad", F.pmod(key, F.size("bad")).cast("int")), key), F.lit(False))
