"""Distributions over entities: a value that was not measured stays null and is never counted."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import table

#: Leaf names of a distribution, in the order of its percentiles.
LEAVES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def measured(value: str | Column) -> Column:
    """Not null and not NaN, as a condition."""
    c = F.col(value) if isinstance(value, str) else value
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def rounded(value: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def _leaves() -> list[Column]:
    return [rounded(F.get("p", F.lit(k))).alias(name) for k, name in enumerate(LEAVES)]


#: The sketch that brackets a percentile errs by at most n / ACCURACY ranks; a bracket reaches twice as far to either side.
ACCURACY = 10_000
#: Brackets of up to so many groups go to every task; beyond, rows meet them in a join, each group's in SALTS parts.
GROUPS, SALTS = 100_000, 32


def percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, p): the exact percentiles of LEAVES of the measured values of each group, linear interpolation; no row for a group without any.

    A bounded sketch of each group brackets its percentiles. Then values are counted: one that lies in a bracket as itself,
    any other as the bracket's end before it (or, before all, the first one's start), which moves no rank that is asked
    for. So equal values are one row, a task leaves a group's few values within brackets (about 12 / ACCURACY of the distinct ones), and only
    those are put in order, as a stream. A group of up to 10 ACCURACY values is counted whole. The two columns are written once, so the input is computed once.
    """
    flat = table(rows.where(measured(value)).select(*by, F.col(value).cast("double").alias("_v")), "values")
    ends = [min(1.0, max(0.0, p + side * 2 / ACCURACY)) for p in LEAVES.values() for side in (-1, 1)]
    bracket = table(flat.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_e")).where("_n > 0"), "brackets")
    whole = F.col("_n") <= 10 * ACCURACY  # ranks may lie closer than the sketch's steps
    if bracket.limit(GROUPS + 1).count() <= GROUPS:
        met = _meet(flat, F.broadcast(bracket), by)
    else:
        parts = bracket.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = _meet(flat.withColumn("_s", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int")), parts, (*by, "_s"))
    low, high = ([F.get("_e", F.lit(2 * k + side)) for k in range(len(LEAVES))] for side in (0, 1))
    inside = reduce(or_, [F.col("_v").between(a, b) for a, b in zip(low, high, strict=True)], whole)
    before = F.greatest(*[F.when(b < F.col("_v"), b) for b in high])
    # side: 0 in a bracket, 1 after the end it counts as, -1 before the first start
    place = F.when(inside, F.struct(F.col("_v").alias("v"), F.lit(0).alias("side"))).otherwise(F.struct(F.coalesce(before, low[0]).alias("v"), F.when(before.isNull(), -1).otherwise(1).alias("side")))
    counted = met.select(*by, "_n", place.alias("_at")).groupBy(*by, "_n", "_at").agg(F.count(F.lit(1)).alias("_c"))
    upto = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "_n").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rank = [F.lit(p) * (F.col("_n") - 1) for p in LEAVES.values()]
    asked = [k for r in rank for k in (F.floor(r), F.least(F.floor(r) + 1, F.col("_n") - 1))]
    found = upto.groupBy(*by, "_n").agg(*[F.min(F.when(F.col("_upto") > r, F.col("_at"))).alias(f"_{k}") for k, r in enumerate(asked)])
    at = lambda k: F.when(F.col(f"_{k}.side") == 0, F.col(f"_{k}.v")).otherwise(F.raise_error(F.lit("a percentile lies outside the bracket of its sketch")).cast("double"))
    between = [at(2 * k) + (at(2 * k + 1) - at(2 * k)) * (r - F.floor(r)) for k, r in enumerate(rank)]
    return found.select(*by, F.col("_n").alias("n"), F.array(*between).alias("p"))


def _meet(rows: DataFrame, groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows with the columns of their group; null is a group."""
    if not by:
        return rows.crossJoin(groups)
    named = groups.select(*[F.col(b).alias(f"_g{k}") for k, b in enumerate(by)], *[c for c in groups.columns if c not in by])
    return rows.join(named, reduce(and_, [F.col(b).eqNullSafe(F.col(f"_g{k}")) for k, b in enumerate(by)]))


def pstats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, p10, p50, p90 of the measured values of each group; linear interpolation."""
    return percentiles(rows, value, *by).select(*by, "n", *_leaves())


def pstats_by_group(rows: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """pstats overall (grp null) and for each group. Rows without a group count overall only."""
    kind = dict(rows.dtypes)[group]
    sides = F.array(F.struct(F.lit(True).alias("overall"), F.lit(None).cast(kind).alias("grp")), F.struct(F.lit(False).alias("overall"), F.col(group).alias("grp")))
    both = rows.where(measured(value)).select(*by, F.col(value).cast("double").alias("v"), F.explode(F.when(F.col(group).isNull(), F.slice(sides, 1, 1)).otherwise(sides)).alias("g")).select(*by, "g.*", "v")
    return percentiles(both, "v", *by, "overall", "grp").select(*by, "grp", "n", *_leaves())


def categorical(rows: DataFrame, value: str, pos: str, *by: str) -> DataFrame:
    """One row for each group: n, counts (map), mode and its share; of equal counts the value seen first by pos is the mode."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"), F.min(pos).alias("first"))
    out = counted.groupBy(*by).agg(
        F.sum("k").alias("n"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(value).alias("key"), F.col("k").alias("value"))))).alias("counts"),
        F.max_by(value, F.struct("k", -F.col("first"))).alias("mode"),
        F.max("k").alias("top"),
    )
    return out.withColumn("share", rounded(F.col("top") / F.col("n"))).drop("top")


def categorical_by_group(rows: DataFrame, value: str, pos: str, group: str) -> DataFrame:
    """categorical overall (grp null) and for each group: counts are summed once by (group, value)."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("k"), F.min(pos).alias("first"))
    both = counted.select(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("grp"), value, "k", "first").unionByName(
        counted.where(F.col(group).isNotNull()).select(F.lit(False).alias("overall"), F.col(group).cast("string").alias("grp"), value, "k", "first")
    )
    merged = both.groupBy("overall", "grp", value).agg(F.sum("k").alias("k"), F.min("first").alias("first"))
    return (
        merged.groupBy("overall", "grp")
        .agg(F.sum("k").alias("n"), F.max_by(value, F.struct("k", -F.col("first"))).alias("mode"), rounded(F.max("k") / F.sum("k")).alias("share"))
        .drop("overall")
    )


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a hint to broadcast it, if it is counted to have no more rows than that; else as it is, for a join that shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tri_state(flag: Column) -> Column:
    """present if any, absent if all are false, else unmeasured (no flag known)."""
    return F.when(F.bool_or(flag), "present").when(F.bool_or(flag).isNull(), "unmeasured").otherwise("absent")


def presence_summary(rows: DataFrame, state: str, group: str) -> DataFrame:
    """n, n_present, n_absent, n_unmeasured and the share of present among measured ones, overall and for each group."""
    count = lambda s: F.count(F.when(F.col(state) == s, 1)).alias(f"n_{s}")
    out = rows.select(F.col(group).alias("grp"), state).rollup("grp").agg(F.grouping("grp").alias("overall"), F.count(F.lit(1)).alias("n"), count("present"), count("absent"), count("unmeasured"))
    share = rounded(F.col("n_present") / F.nullif(F.col("n_present") + F.col("n_absent"), F.lit(0)))
    return out.where("overall = 1 OR grp IS NOT NULL").drop("overall").withColumn("share", share)


def numeric_item(rows: DataFrame, key: str, value: str, group: str, entity: str, pos: str, rule: str = "p50", basis: int | None = None) -> DataFrame:
    """A measurement item: distribution overall and by group, the value by a rule (p10, p50, p90, min, max, mode), status, blocker, and evidence.

    The mode is the most frequent value, rounded to six digits; of equal ones the first by pos. Evidence are up to five rows of different entities, first by pos. Without a measured value: status unmeasured and a blocker.
    """
    dist = pstats_by_group(rows, value, group)
    good = rows.where(measured(value))
    ends = good.select(F.col(group).alias("grp"), value).rollup("grp").agg(F.grouping("grp").alias("overall"), F.min(value).alias("low"), F.max(value).alias("high")).where("overall = 1 OR grp IS NOT NULL").drop("overall")
    if rule == "mode":
        near = good.withColumn("_v", rounded(F.col(value).cast("double")))
        modes = categorical_by_group(near, "_v", pos, group).select("grp", F.col("mode").alias("top"))
        ends = ends.withColumn("_g", F.col("grp").cast("string")).join(modes.withColumnRenamed("grp", "_m"), F.col("_g").eqNullSafe(F.col("_m")), "left").drop("_g", "_m")
    proof = evidence(good, entity, pos, value)
    spine = rows.select(F.col(group).alias("grp")).where("grp IS NOT NULL").distinct().unionByName(rows.sparkSession.range(1).select(F.lit(None).cast(dict(rows.dtypes)[group]).alias("grp")))
    pick = {"min": F.col("low"), "max": F.col("high"), "mode": F.col("top") if rule == "mode" else None}.get(rule, F.col(rule) if rule in LEAVES else None)
    joined = spine.join(dist, spine["grp"].eqNullSafe(dist["grp"]), "left").drop(dist["grp"]).join(ends, spine["grp"].eqNullSafe(ends["grp"]), "left").drop(ends["grp"])
    return joined.crossJoin(F.broadcast(proof)).select(
        F.lit(key).alias("key"), "grp", F.coalesce("n", F.lit(0)).alias("n"), *LEAVES, pick.cast("double").alias("value"),
        F.when(F.coalesce("n", F.lit(0)) == 0, "unmeasured").otherwise("measured").alias("status"),
        F.when(F.coalesce("n", F.lit(0)) == 0, "no measured value").alias("blocker"), "evidence",
    )


def native_stats(rows: DataFrame, native: str, resolution: str) -> DataFrame:
    """(resolution, n, p10, p50, p90) of lengths in each entity's own pixels, for each resolution they were taken at; rows without either are left out."""
    return pstats(rows.where(F.col(resolution).isNotNull()), native, resolution)


def presence_evidence(rows: DataFrame, entity: str, pos: str, state: str, k: int = 5) -> DataFrame:
    """(entity, state): up to k rows that show presence, or, if none does, absence; those that come first by pos."""
    seen = rows.where(F.col(state).isin("present", "absent"))
    best = seen.agg(F.max(state).alias("best"))  # present comes after absent
    return seen.join(F.broadcast(best), F.col(state) == F.col("best")).orderBy(pos, entity).limit(k).select(entity, state)


def type_examples(rows: DataFrame, kind: str, entity: str, at: str, k: int = 3) -> DataFrame:
    """(kind, entity, at, place): for each kind the first event of each of the first k entities."""
    first = rows.groupBy(kind, entity).agg(F.min(at).alias(at))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(entity))).where(F.col("place") <= k)


def category_column(rows: DataFrame, kind: str, value: str, pos: str) -> DataFrame:
    """(kind, n, mode, share, n_events, n_missing, status): a category of each kind's events; partial if some have none, unmeasured if all do."""
    missing = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n_events"), F.count(F.when(F.col(value).isNull(), 1)).alias("n_missing"))
    out = missing.join(categorical(rows, value, pos, kind).drop("counts"), kind, "left")
    status = F.when(F.col("n_missing") == F.col("n_events"), "unmeasured").when(F.col("n_missing") > 0, "partial").otherwise("measured")
    return out.select(kind, F.coalesce("n", F.lit(0)).alias("n"), "mode", "share", "n_events", "n_missing", status.alias("status"))


def evidence(rows: DataFrame, entity: str, pos: str, value: str, k: int = 5) -> DataFrame:
    """One row: up to k (entity, value) of different entities, those that come first by pos."""
    firsts = rows.groupBy(entity).agg(F.min(F.struct(pos, value)).alias("r")).select(F.col(f"r.{pos}").alias("pos"), entity, F.col(f"r.{value}").alias("value"))
    top = firsts.orderBy("pos", entity).limit(k)
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(entity).cast("string").alias("e")))), lambda s: s["e"]), ",").alias("evidence"))


def entity_mode(rows: DataFrame, entity: str, value: str, pos: str) -> DataFrame:
    """The most frequent value of each entity; of equal ones the first seen."""
    return categorical(rows, value, pos, entity).select(entity, "mode")


def leaf_rows(dist: DataFrame, key: str) -> DataFrame:
    """A distribution as (key, grp, value) rows: key.n, key.p10, key.p50, key.p90."""
    return dist.select(
        "grp",
        F.explode(F.array(*[F.struct(F.lit(f"{key}.{leaf}").alias("key"), F.col(leaf).cast("double").alias("value")) for leaf in ("n", *LEAVES)])).alias("x"),
    ).select("x.key", "grp", "x.value")


def completeness(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """measured, partial or unmeasured, by how many values of a group are there."""
    known, all_ = F.count(value), F.count(F.lit(1))
    return rows.groupBy(*by).agg(all_.alias("n"), known.alias("n_known"), F.when(known == all_, "measured").when(known > 0, "partial").otherwise("unmeasured").alias("column_status"))


def majority(rows: DataFrame, flag: str, group: str) -> DataFrame:
    """Whether more than half of the known flags are set, overall and for each group."""
    known = rows.where(F.col(flag).isNotNull()).select(F.col(group).alias("grp"), F.col(flag).cast("int").alias("f"))
    out = known.rollup("grp").agg(F.grouping("grp").alias("overall"), F.count(F.lit(1)).alias("n"), (F.sum("f") > F.sum(1 - F.col("f"))).alias("majority"))
    return out.where("overall = 1 OR grp IS NOT NULL").drop("overall")


def with_zeros(counts: DataFrame, entities: DataFrame, kinds: DataFrame, entity: str, kind: str, n: str) -> DataFrame:
    """Counts of each kind for every entity, 0 where it has none. kinds: a small closed vocabulary."""
    return entities.select(entity).distinct().crossJoin(small(kinds.select(kind).distinct())).join(counts, [entity, kind], "left").withColumn(n, F.coalesce(n, F.lit(0)))


def longest_run(rows: DataFrame, entity: str, pos: str, flag: str) -> DataFrame:
    """The longest run of consecutive rows of an entity with the flag set; 0 if there is none."""
    w = Window.partitionBy(entity).orderBy(pos)
    f = F.coalesce(F.col(flag), F.lit(False))
    island = rows.withColumn("f", f).withColumn("island", F.sum(F.when(~f, 1).otherwise(0)).over(w))
    return island.groupBy(entity, "island").agg(F.sum(F.col("f").cast("int")).alias("run")).groupBy(entity).agg(F.max("run").alias("longest_run"))
