"""Catalogs: tables of recurring groups with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import table
from .colors import color_mode
from .stats import categorical, pstats_by_group, rounded, small


def group_table(members: DataFrame, entity: str, structure: str, variant: str, prefix: str = "F") -> DataFrame:
    """One row for each structure: format_id (by falling size, then name), n, share, variants, a digest of its members.

    The digest is the sum of the first 60 bits of the members' md5, whatever their order, so no group is gathered. The
    structures are a catalog, which is numbered in one task.
    """
    bits = F.conv(F.substring(F.md5(F.col(entity).cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    g = members.groupBy(F.col(structure).alias("structure")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(variant).alias("variants"), F.sum(bits).cast("string").alias("members"))
    total = g.agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "structure"))
    return g.crossJoin(F.broadcast(total)).select(F.concat(F.lit(prefix), rank.cast("string")).alias("format_id"), "structure", "n", rounded(F.col("n") / F.col("total")).alias("share"), "variants", "members")


def listing(rows: DataFrame, equal: dict, where: str, sort: str, modes: dict, limit: int) -> DataFrame:
    """Rows with given values and a condition, in one of several named orders, up to a limit."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.where(where).orderBy(*modes[sort]).limit(limit)


def named_set(parts: list[DataFrame], without: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys of several sets in their order, each once, less those of another set, up to a limit; p is the first set that has the key."""
    both = None
    for p, part in enumerate(parts):
        part = part.select(key, F.lit(p).alias("p"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(key).agg(F.min("p").alias("p")).join(without.select(key), key, "left_anti").orderBy("p", key).limit(limit)


def checked_labels(labels: DataFrame, members: DataFrame, entity: str) -> DataFrame:
    """The labels with a reason: null for one that counts; not signed if it is not watched by someone with a name, outside if its entity is no member. Rows without an entity, and rows without any label, are left out.

    labels: (entity, structure, intro, watched, labeled_by); members: a table of entities.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = labels.where((F.coalesce(F.trim(F.col(entity).cast("string")), F.lit("")) != "") & ((text("structure") != "") | (text("intro") != "")))
    signed = (F.lower(text("watched")) == "yes") & (text("labeled_by") != "") & (text("structure") != "")
    known = members.select(entity).distinct().withColumn("_in", F.lit(True))
    reason = F.when(~signed, "not signed").when(F.col("_in").isNull(), "outside")
    return rows.join(known, entity, "left").withColumn("reason", reason).drop("_in")


def kept_ids(groups: DataFrame, old: DataFrame, structure: str, n: str, prefix: str = "F") -> DataFrame:
    """(structure, format_id): the id that an earlier table gave a structure; new ones, by falling size, then name, take the lowest numbers that are free.

    A catalog of structures: its numbers are given out in one task. old: (structure, format_id).
    """
    named = groups.select(structure, n).join(old.select(structure, "format_id"), structure, "left")
    number = F.regexp_extract("format_id", f"^{prefix}([0-9]+)$", 1).try_cast("long")
    used = old.select(number.alias("k")).where("k IS NOT NULL").distinct()
    fresh = named.where("format_id IS NULL").withColumn("r", F.row_number().over(Window.orderBy(F.desc(n), structure)))
    size = groups.agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(used.agg(F.count(F.lit(1)).alias("u"))))
    numbers = size.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("c") + F.col("u") + 1)).alias("k"))
    free = numbers.join(used, "k", "left_anti").withColumn("r", F.row_number().over(Window.orderBy("k")))
    given = fresh.join(free, "r").select(structure, F.concat(F.lit(prefix), F.col("k").cast("string")).alias("format_id"))
    return named.where("format_id IS NOT NULL").select(structure, "format_id").unionByName(given)


def glob_pattern(glob: Column) -> Column:
    """A regular expression for a pattern of names: * any characters, ? one, [...] one of these, [!...] one of no such."""
    plain = F.regexp_replace(glob, r"[.^$+(){}|\\]", r"\\$0")
    return F.concat(F.lit("^(?s:"), F.replace(F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit(r")\z"))


def named_checks(keys: DataFrame, checks: DataFrame) -> DataFrame:
    """(key, n_checks): how many distinct checks name a key, by itself or by a pattern; keys without one are left out.

    checks: (check, pattern). Checks of equal sets of patterns are counted once, as one. A pattern's letters before its first * or [, and those after its
    last, stand at known places from the beginning and the end; a key lists its own letters at the places of each such form that
    occurs, so only patterns with these letters are tried. Forms are few: a row for each key and form is made.
    """
    sets = checks.where("check IS NOT NULL AND pattern IS NOT NULL").groupBy("check").agg(F.sort_array(F.collect_set("pattern")).alias("patterns"))
    asked = sets.groupBy("patterns").agg(F.min("check").alias("_class"), F.count(F.lit(1)).alias("_n")).withColumn("pattern", F.explode("patterns"))
    plain = ~F.rlike("pattern", F.lit(r"[*?\[]"))
    head = F.when(plain, F.col("pattern")).otherwise(F.regexp_extract("pattern", r"(?s)^([^*\[]*?)\?*(?:[*\[].*)?\z", 1))
    tail = F.when(plain, F.lit("")).otherwise(F.regexp_extract("pattern", r"(?:\A|[*\[\]?])([^*\[\]?][^*\[\]]*)\z", 1))
    form = lambda c: F.regexp_replace(c, r"(?s)[^?]", "L")
    asked = asked.select("_class", "_n", "pattern", glob_pattern(F.col("pattern")).alias("_rx"), plain.alias("_plain"), head.alias("_head"), tail.alias("_tail"))
    asked = table(asked.withColumn("_hf", F.when(~F.col("_plain"), form("_head"))).withColumn("_tf", F.when(~F.col("_plain"), form("_tail"))), "asked")

    def letters(part: Column, mask: Column) -> Column:
        one = lambda i: F.when(F.substr(mask, i, F.lit(1)) == "L", F.substr(part, i, F.lit(1))).otherwise("?")
        return F.when(F.contains(mask, F.lit("?")), F.array_join(F.transform(F.sequence(F.lit(1), F.length(mask)), one), "")).otherwise(part)

    hf, tf, key = F.col("_hf"), F.col("_tf"), F.col("key")
    distinct = keys.select("key").where("key IS NOT NULL").distinct()
    long = F.length(key) >= F.greatest(F.length(hf), F.length(tf))
    tried = distinct.crossJoin(small(asked.where("NOT _plain").select("_hf", "_tf").distinct())).where(long)
    tried = tried.select("key", "_hf", "_tf", letters(F.substr(key, F.lit(1), F.length(hf)), hf).alias("_head"), letters(F.substr(key, F.length(key) - F.length(tf) + 1, F.length(tf)), tf).alias("_tail"))
    some = tried.join(asked.where("NOT _plain"), ["_hf", "_tf", "_head", "_tail"]).where((key == F.col("pattern")) | F.rlike("key", F.col("_rx")))
    same = distinct.join(asked.where("_plain").withColumnRenamed("pattern", "key"), "key")
    met = some.select("key", "_class", "_n").unionByName(same.select("key", "_class", "_n")).distinct()
    return met.groupBy("key").agg(F.sum("_n").alias("n_checks"))


def registry_sync(keys: DataFrame, items: DataFrame, links: DataFrame, checks: DataFrame, old: DataFrame) -> DataFrame:
    """(key, category, status, apply_pending, n_readers, n_checks, evidence, note): the registry of the settings as they stand, one row for each key.

    keys: (key, category, origin, not_given), category null for a key that is to be measured, not_given if other values make it
    idle; items: (key, status, evidence) of measurements; links: (key, reader, current), readers whose code has changed
    since do not count; checks: (check, pattern); old: the registry before, of which evidence stays where a measurement
    has none, and notes always. A change that was asked for goes before a measurement, that before the category. A measured
    key whose value comes from elsewhere is pending. Keys are distinct, and so are those of items and old; those of no key are dropped.
    """
    readers = links.where("current").groupBy("key").agg(F.count_distinct("reader").alias("n_readers"))
    all_ = keys.join(items.select("key", F.col("status").alias("_found"), F.col("evidence").alias("_evidence")), "key", "left").join(readers, "key", "left").join(named_checks(keys, checks), "key", "left")
    all_ = all_.join(old.select("key", F.col("evidence").alias("_before"), "note"), "key", "left")
    origin = F.coalesce("origin", F.lit(""))
    status = (
        F.when(origin == "requested_change", "requested_change").when(F.col("_found") == "measured", "measured").when(F.col("category").isin("meta", "infra"), "not_applicable")
        .when(F.col("category") == "rule", "fixed_by_rule").when(F.col("category").isNull() & F.col("not_given"), "not_applicable_given").otherwise("unmeasured")
    )
    done = all_.withColumn("status", status)
    return done.select("key", F.coalesce("category", F.lit("style")).alias("category"), "status", ((F.col("status") == "measured") & (origin != "measured")).alias("apply_pending"), F.coalesce("n_readers", F.lit(0)).alias("n_readers"), F.coalesce("n_checks", F.lit(0)).alias("n_checks"), F.coalesce(F.nullif("_evidence", F.lit("")), "_before").alias("evidence"), "note")


def registry_audit(entries: DataFrame, production: bool = True) -> DataFrame:
    """One row: ok, and how many keys are unmeasured, without code that reads them, without a check, and not applicable.

    entries: (key, category, status, apply_pending, n_readers, n_checks). Keys of the categories meta and infra are not looked
    at, rules need no check. Unmeasured keys stand in the way in production only.
    """
    e = entries.where(~F.coalesce(F.col("category").isin("meta", "infra"), F.lit(False)))
    count = lambda c: F.count(F.when(c, 1))
    out = e.agg(
        count((F.col("status") == "unmeasured") | F.coalesce("apply_pending", F.lit(False))).alias("unmeasured"), count(F.coalesce("n_readers", F.lit(0)) == 0).alias("no_code"),
        count((F.coalesce("n_checks", F.lit(0)) == 0) & ~F.coalesce(F.col("category") == "rule", F.lit(False))).alias("no_check"), count(F.col("status") == "not_applicable_given").alias("not_applicable"),
    )
    ok = (F.col("no_code") == 0) & (F.col("no_check") == 0) & (F.lit(not production) | (F.col("unmeasured") == 0))
    return out.select(ok.alias("ok"), "unmeasured", "no_code", "no_check", "not_applicable")


def typed_items(rows: DataFrame, entity: str, pos: str) -> DataFrame:
    """(key, type, grp, n, value): items of declared types from observations, overall (grp null) and for each group.

    rows: (key, type, grp, value as text, and the entity and pos). Numbers (px, ratio, hz) are the median of the entities'
    medians, bools and categories the mode of the entities' modes, colours the largest cluster. Texts that are no number are left out.
    """
    r = rows.where("value IS NOT NULL")
    numbers = r.where(F.col("type").isin("px", "ratio", "hz")).withColumn("_value", F.col("value").try_cast("double"))
    per = numbers.groupBy("key", "type", "grp", entity).agg(F.median("_value").alias("_value"))
    numeric = pstats_by_group(per, "_value", "grp", "key", "type").select("key", "type", "grp", "n", rounded("p50").cast("string").alias("value"))
    named = r.where(~F.col("type").isin("px", "ratio", "hz", "color"))
    counted = named.groupBy("key", "type", "grp", entity, "value").agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"))
    both = counted.groupBy("key", "type", "grp", entity).agg(F.max_by("value", F.struct("_n", -F.col("_first"))).alias("value"), F.min("_first").alias("_pos"))
    groups = categorical(both.where("grp IS NOT NULL"), "value", "_pos", "key", "type", "grp").select("key", "type", "grp", "n", F.col("mode").alias("value"))
    whole = categorical(both, "value", "_pos", "key", "type").select("key", "type", F.lit(None).cast(dict(rows.dtypes)["grp"]).alias("grp"), "n", F.col("mode").alias("value"))
    colours = r.where("type = 'color'").withColumn("_k", F.struct("key", "type", "grp"))
    tone = color_mode(colours.where("grp IS NOT NULL"), "_k", "value", pos).select("_k.key", "_k.type", "_k.grp", "n", F.col("color").alias("value"))
    all_ = color_mode(colours.withColumn("_k", F.struct("key", "type", F.lit(None).cast(dict(rows.dtypes)["grp"]).alias("grp"))), "_k", "value", pos).select("_k.key", "_k.type", "_k.grp", "n", F.col("color").alias("value"))
    return numeric.unionByName(groups).unionByName(whole).unionByName(tone).unionByName(all_)
