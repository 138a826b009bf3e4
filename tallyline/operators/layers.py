"""Layered values: which of several sources speaks for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rescale
from .stats import small


def manual_first(manual: DataFrame, auto: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, with their origin; an automatic row gives way where a manual one has its keys."""
    return manual.withColumn("origin", F.lit("manual")).unionByName(auto.join(manual.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("auto")))


def layered(rows: DataFrame, keys: list[str], priority: Column, value: str, tombstone: str | None = None, base: Column | None = None) -> DataFrame:
    """The value of each key from its layer of highest priority.

    A row that says `tombstone` has no value of its own, and where its key is in the base layer (rows for which `base` holds)
    it hides all layers below it but that: a key that is unmeasured for a group takes no measured value of a wider one.
    Without a base row for the key the layers below speak. Layers above it speak as before.
    """
    live = rows
    if tombstone:
        gone = F.coalesce(F.col(tombstone), F.lit(False))
        ground = F.coalesce(base, F.lit(False)) if base is not None else F.lit(False)
        w = Window.partitionBy(*keys)
        level = F.max(F.when(gone, priority)).over(w)
        has_base = F.coalesce(F.bool_or(ground & ~gone).over(w), F.lit(False))
        marked = rows.withColumn("_level", level).withColumn("_has", has_base).withColumn("_p", priority).withColumn("_ground", ground).where(~gone)
        live = marked.where(F.col("_level").isNull() | (F.col("_p") > F.col("_level")) | F.col("_ground") | ~F.col("_has")).select(*rows.columns)
    return live.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), priority).alias("r")).select(*keys, f"r.{value}", F.col("r.layer").alias("layer"))


def refused(snapshot: Column, current: str) -> Column:
    """Why an item's file is not used, or null: it names no source snapshot, or another than the current one."""
    return F.when(snapshot.isNull() | (snapshot == ""), "no source snapshot").when(snapshot != current, F.concat(F.lit("source snapshot "), snapshot))


def resolve_items(rows: DataFrame, key: str, status: str, value: str, priority: str, snapshot: str | None = None, current: str | None = None) -> DataFrame:
    """Of several files' items for a key: a measured one beats unmeasured ones; two measured ones are a conflict.

    snapshot, current: items of a file with another source snapshot, or none, are refused; they count as unmeasured.
    """
    if snapshot and current:
        out = refused(F.col(snapshot), current).isNotNull()
        rows = rows.withColumn(status, F.when(out, "unmeasured").otherwise(F.col(status))).withColumn(value, F.when(~out, F.col(value)))
    w = Window.partitionBy(key)
    n = F.sum(F.when(F.col(status) == "measured", 1).otherwise(0)).over(w)
    rank = F.row_number().over(w.orderBy(F.when(F.col(status) == "measured", 0).otherwise(1), priority))
    out = rows.withColumn("n_measured", n).withColumn("rank", rank).where("rank = 1")
    state = F.when(F.col("n_measured") > 1, "conflict").when(F.col("n_measured") == 1, "measured").otherwise("unmeasured")
    return out.select(key, state.alias("status"), F.when(state == "measured", F.col(value)).alias("value"), "n_measured")


def apply_measurements(items: DataFrame, by_group: DataFrame, canvas: tuple[float, float]) -> DataFrame:
    """(layer, key, grp, value, gone, reason): rows for `layered` from resolved items, and those that can't be applied, with a reason and no layer.

    items: (key, status, value, unit, width, height); by_group: (key, grp, value), null where the group is unmeasured. A length in
    px is brought to the canvas, unless its aspect is another (reason). A group's own value is above the common one; an
    unmeasured group (gone) takes no common value.
    """
    px = F.coalesce(F.col("unit") == "px", F.lit(False))
    moved, reason = rescale(F.col("value").cast("double"), F.col("width").cast("double"), F.col("height").cast("double"), *canvas)
    why = F.when((F.col("status") != "measured") | F.col("value").isNull(), "unmeasured").when(px, F.when(F.col("width").isNull() | F.col("height").isNull(), "no resolution").otherwise(reason))
    scale = F.when(px, F.lit(canvas[0]) / F.col("width")).otherwise(1.0)
    judged = items.select("key", F.when(px, moved).otherwise(F.col("value").cast("double")).alias("value"), scale.alias("scale"), why.alias("reason"))
    common = judged.select(F.when(F.col("reason").isNull(), "common").alias("layer"), "key", F.lit(None).cast("string").alias("grp"), F.when(F.col("reason").isNull(), F.col("value")).alias("value"), F.lit(False).alias("gone"), "reason")
    own = by_group.select("key", F.col("grp").cast("string").alias("grp"), F.col("value").cast("double").alias("v")).join(judged.where("reason IS NULL").select("key", "scale"), "key")
    return common.unionByName(own.select(F.lit("group").alias("layer"), "key", "grp", (F.col("v") * F.col("scale")).alias("value"), F.col("v").isNull().alias("gone"), F.lit(None).cast("string").alias("reason")))


def moot(keys: DataFrame, rules: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Whether a key is moot: a rule's pattern matches it, and the key that the rule names ({role} is the pattern's first group) is given. rules: a small table (pattern, given)."""
    hit = keys.join(small(rules), F.expr(f"{key} rlike pattern"), "left")
    wanted = F.expr(f"replace(given, '{{role}}', regexp_extract({key}, pattern, 1))")
    named = hit.withColumn("wanted", wanted).join(given.select(F.col(key).alias("wanted"), F.lit(True).alias("there")), "wanted", "left")
    rest = [c for c in keys.columns if c != key]
    return named.groupBy(*rest, key).agg(F.coalesce(F.bool_or("there"), F.lit(False)).alias("moot"))


def most_specific(keys: DataFrame, rules: DataFrame, id_: str, key: str) -> DataFrame:
    """The text of the most specific pattern (* stands for anything) that a key matches: an exact one, then most literals, then longest. rules: a small table."""
    regex = F.concat(F.lit("^"), F.replace(F.replace("pattern", F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$"))
    r = rules.select("pattern", "text", regex.alias("rx"), F.length(F.regexp_replace("pattern", r"\*", "")).alias("literals"), F.length("pattern").alias("len"))
    hit = keys.join(small(r), F.expr(f"{key} rlike rx"))
    return hit.groupBy(id_).agg(F.max_by("text", F.struct(F.col("pattern") == F.col(key), "literals", "len")).alias("text"))
