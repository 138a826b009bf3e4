"""The test tables in the roles of the data model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timestamp(col: str) -> F.Column:
    return F.col(col).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as entities, hours since an entity's first event as t, a group by user, and intervals from the value."""
    us = F.unix_micros(timestamp("ts"))
    raw = read(spark, sf_dir, "events").withColumn("us", us)
    start = raw.groupBy("user_id").agg(F.min("us").alias("us0"))
    t = (F.col("us") - F.col("us0")) / 3.6e9
    return raw.join(start, "user_id").select(
        F.col("user_id").alias("video_id"), "event_id", t.alias("t"), F.col("event_type").alias("type"), "value", "props",
        F.concat(F.lit("F"), (F.col("user_id") % 3).cast("string")).alias("format_id"), (t + F.col("value") / 20).alias("end"), "us",
    )


#: The same for SQL: put it first in a WITH clause.
E = """e AS (SELECT user_id AS video_id, event_id, t, event_type AS type, value, props, 'F' || (user_id % 3) AS format_id, t + value / 20 AS "end", us
FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS t, epoch_us(ts) AS us FROM events))"""


def dist_sql(source: str, value: str, group: str) -> str:
    """pstats_by_group in SQL; source is a table of the WITH clause."""
    return f"""SELECT grp, n, round(p[1], 6) AS p10, round(p[2], 6) AS p50, round(p[3], 6) AS p90 FROM (
SELECT {group} AS grp, grouping({group}) AS overall, count(*) AS n, quantile_cont({value}::DOUBLE, [0.1, 0.5, 0.9]) AS p
FROM {source} WHERE {value} IS NOT NULL AND NOT isnan({value}::DOUBLE) GROUP BY ROLLUP ({group})) WHERE overall = 1 OR grp IS NOT NULL"""
