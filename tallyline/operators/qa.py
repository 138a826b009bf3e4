"""Verdicts: gates, count ranges, reconciliation, comparison on a grid of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gate(rows: DataFrame, rules: dict[str, str], row_id: str, shown: int = 50) -> DataFrame:
    """For each rule (a name and the condition of a failing row): n_failing, passed, and the first `shown` failing ids joined by commas. One pass over the rows."""
    failed = F.filter(F.array(*[F.when(F.expr(cond), name) for name, cond in rules.items()]), lambda r: r.isNotNull())
    each = rows.select(row_id, F.explode(failed).alias("rule"))
    first = each.withColumn("p", F.row_number().over(Window.partitionBy("rule").orderBy(row_id))).where(F.col("p") <= shown)
    ids = first.groupBy("rule").agg(F.array_join(F.transform(F.sort_array(F.collect_list(row_id)), lambda x: x.cast("string")), ",").alias("ids"))
    hits = each.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(ids, "rule")
    names = rows.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return names.join(hits, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n_failing"), F.col("n").isNull().alias("passed"), F.coalesce("ids", F.lit("")).alias("failing"))


#: Ids of checks that have rules of their own.
SOUND, NO_EVENT, OFFSET, STYLE = "audio.", "audio.sfx.no_event", "audio.sfx.offset", "style_vs_reference"


def quality_gate(
    rows: DataFrame,
    production: bool,
    output: tuple[str | None, str | None] = ("", ""),
    files: tuple[str | None, str | None] = (None, None),
    inputs: DataFrame | None = None,
    inputs_measured: bool = True,
    reference_problems: list[str] | None = None,
    approval_problems: list[str] | None = None,
    changed_since_approval: bool = False,
    unmeasured_keys: DataFrame | None = None,
    test_output: bool | None = None,
    categories: tuple[str, ...] = (),
    shown: int = 50,
) -> DataFrame:
    """(rule, severity, n, failing): the rules that do not hold, as fail or warn, with how many rows break them and the first `shown` ids.

    rows: (row_id, check_id, category, kind, status, required, intended_change, covered_by); status is same, different or
    unmeasured. G1 a difference that was not intended; G2 a required row unmeasured; G3 sounds without an event, or sound rows
    without that check; G4 sounds away from their event; G5 the output is missing, changed, or not the file that was measured
    (output: digests when measured and now; files: their names); G6 inputs (name, measured, now) changed, or were not recorded;
    R1 problems of the reference, A1 of the approval, A2 changes after it; P1 unmeasured keys, P2 style rows unmeasured,
    P3 output of a test, P4 other rows unmeasured that no measured row covers; W1 categories without a row, if there are more
    than five rows. P rules and R1 fail in production and warn else. An empty result has passed.
    """
    spark = rows.sparkSession
    r = rows.select("row_id", "check_id", "category", "kind", "status", F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("intended_change", F.lit(False)).alias("intended"), "covered_by")
    open_ = F.col("status") == "unmeasured"
    style = F.coalesce(F.col("kind") == STYLE, F.lit(False))
    other = open_ & ~style & ~F.col("required")
    rules = {
        "G1": (F.col("status") == "different") & ~F.col("intended"),
        "G2": open_ & F.col("required"),
        "G3": (F.col("check_id") == NO_EVENT) & (F.col("status") != "same"),
        "G4": (F.col("check_id") == OFFSET) & (F.col("status") != "same"),
        "P2": open_ & style,
        "P4": other & F.col("covered_by").isNull(),
    }
    # only open rows that name a row look for it: all that name none would meet in one task
    named = r.where(other & F.col("covered_by").isNotNull()).select("row_id", "covered_by")
    measured = r.where(F.col("status") != "unmeasured").select(F.col("row_id").alias("covered_by"))
    bare = named.join(measured, "covered_by", "left_anti").select("row_id", F.lit("P4").alias("rule"))
    hits = first_rows(broken_rows(r, rules, "row_id").unionByName(bare), "row_id", shown)
    whole = r.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("check_id").startswith(SOUND), 1)).alias("sound"), F.count(F.when(F.col("check_id") == NO_EVENT, 1)).alias("no_event"), F.array_sort(F.collect_set("category")).alias("seen"))
    there = whole.select(F.when((F.col("sound") > 0) & (F.col("no_event") == 0), "G3").alias("rule"), F.lit(0).cast("long").alias("n"), F.lit("").alias("failing")).where("rule IS NOT NULL")
    missing = F.array_except(F.array(*map(F.lit, sorted(categories))) if categories else F.array().cast("array<string>"), "seen")
    gaps = whole.where((F.size(missing) > 0) & (F.col("rows") > 5)).select(F.lit("W1").alias("rule"), F.size(missing).cast("long").alias("n"), F.array_join(missing, ",").alias("failing"))
    found = [hits, there, gaps]
    facts = []
    if files[0] and files[1] and files[0] != files[1] or output[1] is None or output[0] and output[0] != output[1]:
        facts.append(("G5", 0, ""))
    if inputs is None or not inputs_measured:
        facts += [("G6", 0, "")] if not inputs_measured else []
    else:
        changed = inputs.where(~F.col("measured").eqNullSafe(F.col("now"))).select(F.lit("x").alias("k"), F.col("name").alias("row_id"))
        found.append(gate_rows(changed, {"G6": F.col("k") == "x"}, "row_id", shown))
    facts += [("R1", len(reference_problems), "; ".join(reference_problems))] if reference_problems else []
    facts += [("A1", len(approval_problems), "; ".join(approval_problems))] if approval_problems else []
    facts += [("A2", 0, "")] if changed_since_approval else []
    facts += [("P3", 0, "")] if (not production if test_output is None else test_output) else []
    if unmeasured_keys is not None:
        found.append(gate_rows(unmeasured_keys.select(F.col(unmeasured_keys.columns[0]).alias("row_id"), F.lit("x").alias("k")), {"P1": F.col("k") == "x"}, "row_id", shown))
    found.append(spark.createDataFrame(facts, "rule string, n long, failing string"))
    both = reduce(lambda a, b: a.unionByName(b), found).groupBy("rule").agg(F.sum("n").alias("n"), F.max("failing").alias("failing"))
    severity = F.when(F.col("rule").isin("A2", "W1"), "warn").when(F.lit(production) | F.col("rule").isin("G1", "G2", "G3", "G4", "G5", "G6", "A1"), "fail").otherwise("warn")
    return both.select("rule", severity.alias("severity"), "n", "failing")


def gate_verdict(gated: DataFrame) -> DataFrame:
    """One row: passed (no rule fails), complete (nor does a P rule warn), and the rules that fail and warn, joined by commas."""
    of = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("severity") == s, F.col("rule")))), ",")
    out = gated.agg(of("fail").alias("failing"), of("warn").alias("warning"), F.count(F.when(F.col("rule").startswith("P"), 1)).alias("p"))
    return out.select((F.col("failing") == "").alias("passed"), ((F.col("failing") == "") & (F.col("p") == 0)).alias("complete"), "failing", "warning")


def broken_rows(rows: DataFrame, rules: dict, row_id: str) -> DataFrame:
    """(row_id, rule): the rules (conditions) that each row breaks."""
    broken = F.filter(F.array(*[F.when(cond, name) for name, cond in rules.items()]), lambda x: x.isNotNull())
    return rows.select(row_id, F.explode(broken).alias("rule"))


def first_rows(each: DataFrame, row_id: str, shown: int) -> DataFrame:
    """(rule, n, failing) of (row_id, rule): how many rows, and the first `shown` ids joined by commas."""
    first = each.withColumn("p", F.row_number().over(Window.partitionBy("rule").orderBy(row_id))).where(F.col("p") <= shown)
    ids = first.groupBy("rule").agg(F.array_join(F.transform(F.sort_array(F.collect_list(row_id)), lambda x: x.cast("string")), ",").alias("failing"))
    return each.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(ids, "rule").select("rule", "n", "failing")


def gate_rows(rows: DataFrame, rules: dict, row_id: str, shown: int) -> DataFrame:
    """(rule, n, failing) of the rules (conditions) that some row breaks: how many, and the first `shown` ids joined by commas."""
    return first_rows(broken_rows(rows, rules, row_id), row_id, shown)


def count_range_verdict(counts: DataFrame, observed: DataFrame, kind: str, n: str, lower_bound: str | None = None) -> DataFrame:
    """in_range (floor p10 to ceil p90 of the observed counts), observed (that very count was seen), outside, or unmeasured.

    lower_bound: a flag of observed counts that are lower bounds only; a count seen only there is lower_bound, a warning.
    """
    exact = ~F.coalesce(F.col(lower_bound), F.lit(False)) if lower_bound else F.lit(True)
    limits = observed.groupBy(kind).agg(
        F.floor(F.percentile(n, 0.1) + 1e-9).alias("low"), F.ceil(F.percentile(n, 0.9) - 1e-9).alias("high"),
        F.collect_set(F.when(exact, F.col(n))).alias("seen"), F.collect_set(n).alias("any"),
    )
    verdict = (
        F.when(F.col("low").isNull(), "unmeasured")
        .when(F.col(n).between(F.col("low"), F.col("high")), "in_range")
        .when(F.array_contains("seen", F.col(n)), "observed")
        .when(F.array_contains("any", F.col(n)), "lower_bound")
        .otherwise("outside")
    )
    return counts.join(limits, kind, "left").withColumn("verdict", verdict).drop("low", "high", "seen", "any")


def reconcile(fresh: DataFrame, stored: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Whether recomputed distributions equal stored ones, for each group."""
    old = stored.select(*[F.col(c).alias(f"old_{c}") for c in stored.columns])
    same = reduce(lambda a, b: a & b, [F.abs(F.col(c) - F.col(f"old_{c}")) <= tolerance for c in ("p10", "p50", "p90")], F.col("n") == F.col("old_n"))
    return fresh.join(old, fresh["grp"].eqNullSafe(old["old_grp"])).select("grp", same.alias("agrees"))


def grid_cells(rows: DataFrame, entity: str, cell: float, start: str, end: str, label: str) -> DataFrame:
    """(entity, cell, labels): the distinct labels of the intervals that touch each cell, sorted."""
    cells = F.sequence(F.floor(F.col(start) / cell + 1e-6), F.floor(F.col(end) / cell - 1e-6))
    safe = F.when(F.floor(F.col(end) / cell - 1e-6) >= F.floor(F.col(start) / cell + 1e-6), cells).otherwise(F.array(F.floor(F.col(start) / cell + 1e-6)))
    return rows.select(entity, label, F.explode(safe).alias("cell")).groupBy(entity, "cell").agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))


def grid_compare(left: DataFrame, right: DataFrame, entity: str, n_cells: DataFrame, blind: DataFrame | None = None) -> DataFrame:
    """(entity, cell, verdict) for cells 0 to n - 1 of each entity: same, different, or unmeasured where a side is blind."""
    spine = n_cells.where("n > 0").select(entity, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("cell"))
    both = spine.join(left.withColumnRenamed("labels", "a"), [entity, "cell"], "left").join(right.withColumnRenamed("labels", "b"), [entity, "cell"], "left")
    if blind is not None:
        both = both.join(blind.select(entity, "cell").distinct().withColumn("blind", F.lit(True)), [entity, "cell"], "left")
    else:
        both = both.withColumn("blind", F.lit(None).cast("boolean"))
    verdict = F.when(F.col("blind"), "unmeasured").when(F.coalesce("a", F.lit("")) == F.coalesce("b", F.lit("")), "same").otherwise("different")
    return both.select(entity, "cell", verdict.alias("verdict"))
