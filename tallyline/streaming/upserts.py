"""The keyed state of an append-only stream of files; its end state is that of one batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch


def _lift(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Each known field with its own position, so that batches may arrive in any order."""
    fields = [c for c in rows.columns if c not in (key, pos)]
    return rows.select(key, pos, *[F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("at"), F.col(c).alias("v"))).alias(c) for c in fields])


def _fold(lifted: DataFrame, key: str) -> DataFrame:
    return lifted.groupBy(key).agg(*[F.max(c).alias(c) for c in lifted.columns if c != key])


def _plain(state: DataFrame, key: str, pos: str) -> DataFrame:
    return state.select(key, pos, *[F.col(f"{c}.v").alias(c) for c in state.columns if c not in (key, pos)])


def latest_by_key(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key by pos; a null field takes the last value known before it."""
    return _plain(_fold(_lift(rows, key, pos), key), key, pos)


class _Parts:
    """The state of a stream as parts in a folder: batch=n/_kind=.../_bucket=b holds rows of a bucket of keys that batch n wrote.

    A delta is the batch's own rows; a whole one also what the bucket held before it, so older parts of the bucket are dead. Since a field is
    the value of the largest position, parts fold in any order. Files are those of any file system that the session reads.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root = spark, root
        kept = [int(p.getName().removeprefix("buckets=")) for p in self._glob(f"{root}/buckets=*")]
        self.buckets = kept[0] if kept else buckets  # a state keeps the number it began with
        self.folder = f"{root}/buckets={self.buckets}"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _glob(self, pattern: str) -> list:
        return [f.getPath() for f in self._fs().globStatus(self._path(pattern)) or []]

    def found(self, before: int | None = None) -> tuple[dict[int, list[str]], list[str]]:
        """The live parts of each bucket, and the dead ones, of batches that stand whole (and come before one)."""
        number = lambda p: int(p.getName().split("=")[1])
        done = {number(p.getParent()) for p in self._glob(f"{self.folder}/batch=*/_SUCCESS")}
        if before is not None:
            done = {n for n in done if n < before}
        every = {}
        for p in self._glob(f"{self.folder}/batch=*/_kind=*/_bucket=*"):
            kind = p.getParent()
            if (n := number(kind.getParent())) in done:
                every.setdefault(number(p), []).append((n, kind.getName() == "_kind=whole", p.toString()))
        live, dead = {}, []
        for b, parts in every.items():
            start = max((n for n, whole, _ in parts if whole), default=-1)
            live[b] = [path for n, _, path in parts if n >= start]
            dead += [path for n, _, path in parts if n < start]
        return live, dead

    def drop(self, paths: list[str]) -> None:
        for path in paths:
            self._fs().delete(self._path(path), True)


def stream_upserts(spark: SparkSession, path: str, schema: str, key: str, pos: str, files_per_batch: int = 1, state: str | None = None, buckets: int = 32, deltas: int = 8) -> DataFrame:
    """Read JSON files as a stream, fold each batch into the state, and return the state.

    All that lasts is in the state folder: the stream's progress, and the state in `buckets` by a hash of the key. A batch
    writes only its own rows, to the buckets of its keys; a bucket that has `deltas` parts is folded into one by the next batch,
    so a bucket is rewritten once for `deltas` batches that touch it, and a read meets at most that many parts of it.
    Parts that a fold has replaced go when the batch after it starts, as the fold can't run again then. A run after a stop
    goes on where the last one ended, and a batch that runs again writes the same parts over its own: nothing is lost or
    counted twice. Without a new file the state is returned as it is; without any file an empty one. The result reads the
    state's files: use it before the stream runs on.
    """
    root = state or scratch(spark, "stream")
    parts = _Parts(spark, root, buckets)
    empty = spark.createDataFrame([], schema)
    lifted = _lift(empty, key, pos).schema

    def fold(batch: DataFrame, batch_id: int) -> None:
        live, dead = parts.found(before=batch_id)
        parts.drop(dead)
        full = sorted(b for b, p in live.items() if len(p) >= deltas)
        rows = _fold(_lift(batch, key, pos), key)
        if full:
            rows = rows.unionByName(spark.read.schema(lifted).parquet(*[p for b in full for p in live[b]]))
        # a bucket is one file; its rows are folded where they are written
        bucket = F.pmod(F.xxhash64(key), F.lit(parts.buckets)).cast("int")
        placed = rows.withColumn("_bucket", bucket).repartition(parts.buckets, "_bucket")
        whole = F.when(F.col("_bucket").isin(full), "whole").otherwise("delta")
        kept = placed.groupBy("_bucket", key).agg(*[F.max(c).alias(c) for c in rows.columns if c != key])
        kept.withColumn("_kind", whole).write.mode("overwrite").partitionBy("_kind", "_bucket").parquet(f"{parts.folder}/batch={batch_id}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    run = source.writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    live, _ = parts.found()
    if not live:
        return empty
    return _plain(_fold(spark.read.schema(lifted).parquet(*[p for paths in live.values() for p in paths]), key), key, pos)
