"""Ordered analytics within an entity: ranks, runs, repeats, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import small


def rank_known_first(rows: DataFrame, by: str, value: str, recent: str, first_seen: str, id_: str) -> DataFrame:
    """rank within `by`: known values, the largest first, ties to the more recent, then the id. Unknown ones come after, unranked."""
    known = F.col(value).isNotNull()
    w = Window.partitionBy(by).orderBy(known.desc(), F.desc_nulls_last(value), F.desc_nulls_last(recent), F.asc(first_seen), id_)
    place = F.row_number().over(w)
    return rows.withColumn("place", place).withColumn("rank", F.when(known, F.col("place")))


def top_n(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each partition, and for each how many its partition hides."""
    kept = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)
    total = rows.groupBy(by).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("hidden"))
    return kept.join(total, by)


def latest_n(rows: DataFrame, date: str, id_: str, n: int) -> DataFrame:
    """The n latest dated rows, ranked by date and id; undated rows last, without a rank."""
    dated = rows.where(F.col(date).isNotNull()).orderBy(F.desc(date), id_).limit(n)
    ranked = dated.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(date), id_)))
    return ranked.unionByName(rows.where(F.col(date).isNull()).withColumn("rank", F.lit(None).cast("int")))


def runs(rows: DataFrame, entity: str, pos: str, value: str) -> DataFrame:
    """Run-length encoding: (entity, run, value, first, last, n) of maximal runs of equal values."""
    w = Window.partitionBy(entity).orderBy(pos)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    run = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return run.groupBy(entity, "run").agg(F.first(value).alias(value), F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n"))


def without_dropouts(rows: DataFrame, entity: str, pos: str, flag: str) -> DataFrame:
    """A single false between two trues, or a single true between two falses, takes its neighbours' value."""
    w = Window.partitionBy(entity).orderBy(pos)
    before, after = F.lag(flag).over(w), F.lead(flag).over(w)
    return rows.withColumn(flag, F.when((before == after) & (before != F.col(flag)), before).otherwise(F.col(flag)))


def repeats(rows: DataFrame, by: list[str], pos: str, value: Column) -> DataFrame:
    """Rows whose value equals that of the row before them."""
    w = Window.partitionBy(*by).orderBy(pos)
    return rows.withColumn("v", value).withColumn("before", F.lag("v").over(w)).where("v = before").drop("before")


def too_close(rows: DataFrame, by: list[str], t: str, least: float) -> DataFrame:
    """Rows less than `least` after the row before them, with that distance."""
    w = Window.partitionBy(*by).orderBy(t)
    return rows.withColumn("since", F.col(t) - F.lag(t).over(w)).where(F.col("since") < least)


def collapsed_sequence(rows: DataFrame, entity: str, pos: str, value: str) -> DataFrame:
    """The entity's values in order, neighbours that repeat as one, joined by >."""
    w = Window.partitionBy(entity).orderBy(pos)
    kept = rows.withColumn("before", F.lag(value).over(w)).where(~F.col("before").eqNullSafe(F.col(value)))
    return kept.groupBy(entity).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, value))), lambda s: s[value]), ">").alias("sequence"))


def follows_order(rows: DataFrame, entity: str, pos: str, value: str, order: DataFrame) -> DataFrame:
    """Whether an entity's known values never step back in the reference order (value, idx); unknown values are counted."""
    j = rows.join(small(order), value, "left")
    known = j.where("idx IS NOT NULL").withColumn("back", F.lag("idx").over(Window.partitionBy(entity).orderBy(pos)) > F.col("idx"))
    return j.groupBy(entity).agg(F.count(F.when(F.col("idx").isNull(), 1)).alias("n_unknown")).join(known.groupBy(entity).agg(F.bool_or(F.coalesce("back", F.lit(False))).alias("b")), entity, "left").select(entity, "n_unknown", (~F.coalesce("b", F.lit(False))).alias("in_order"))


def latest_valid(rows: DataFrame, entity: str, pos: str, valid: Column, value: str) -> DataFrame:
    """The value of an entity's latest valid row; null if none is valid."""
    good = F.when(valid, F.struct(pos, value))
    return rows.groupBy(entity).agg(F.max(good).alias("r")).select(entity, F.col(f"r.{pos}").alias(pos), F.col(f"r.{value}").alias(value))
