"""Seconds of joins of the library and of the same joins as all pairs, at $BENCH_SF_DIR; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import intervals as I
from tallyline.operators import matching as H
from tallyline.operators import similarity as M
from tallyline.plans.base import events, read


def interval(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Overlaps of an entity's intervals."""
    e = events(spark, d).select("video_id", F.col("t").alias("start"), "end", F.col("event_id").alias("id"))
    b = e.select(*[F.col(c).alias(f"b_{c}") for c in e.columns])
    naive = e.crossJoin(b).where("video_id = b_video_id AND id < b_id AND start < b_end AND end > b_start + 0")
    return I.overlaps(e, e, "video_id", 24.0, F.col("a_id") < F.col("b_id")), naive


def hamming(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """64-bit hashes within ten bits."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("ref"), M.sign_bits(F.col("embedding")).alias("h"))
    c = v.select((F.col("ref") + 10**12).alias("cand"), "h")
    naive = c.withColumnRenamed("h", "hc").crossJoin(v).where(F.bit_count(F.col("hc").bitwiseXOR(F.col("h"))) <= 10)
    return M.hamming_join(c, v, "cand", "ref", "h"), naive


def similarity(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of one label with a cosine of 0.3 or more."""
    v = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("x"))
    w = v.select(F.col("vec_id").alias("o"), F.col("label").alias("l"), F.col("x").alias("y"))
    naive = v.crossJoin(w).where("label = l AND vec_id < o").where(M.cosine(F.col("x"), F.col("y")) >= 0.3)
    return M.threshold_graph(v, "vec_id", "label", "x", 0.3), naive


def iou(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rectangles in the same place."""
    k = F.col("event_id")
    boxes = events(spark, d).where("value > 20").select("video_id", k.alias("id"), (k % 9 * 40).cast("double").alias("x"), (k % 5 * 60).cast("double").alias("y"), (60 + k % 7).cast("double").alias("w"), (50 + k % 3).cast("double").alias("h"))
    b = boxes.select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns])
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(F.col(p) + F.col(s), F.col(f"b_{p}") + F.col(f"b_{s}")) - F.greatest(F.col(p), F.col(f"b_{p}")))
    both = side("x", "w") * side("y", "h")
    naive = boxes.crossJoin(b).where("id < b_id").where(both / (F.col("w") * F.col("h") + F.col("b_w") * F.col("b_h") - both) >= 0.5).groupBy("id").count()
    return H.place_groups(boxes, "video_id", "id", 0.5, 2, 0.2), naive


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("naive").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    read(spark, sf_dir, "events").groupBy("event_type").count().collect()
    out = {}
    for make in (interval, hamming, similarity, iou):
        for name, df in zip((make.__name__, f"{make.__name__}_all_pairs"), make(spark, sf_dir), strict=True):
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            out[name] = round(time.time() - began, 2)
    print(json.dumps({"sf": os.path.basename(sf_dir.rstrip("/")), "seconds": out}))


if __name__ == "__main__":
    main()
