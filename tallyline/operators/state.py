"""Keyed state in versions: a new version is computed from the old one and what arrived; nothing is changed in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .stats import small


def changed_keys(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and change (added, removed, changed) of rows that differ between two versions."""
    a = old.select(*keys, F.struct(*values).alias("old"), F.lit(1).alias("in_old"))
    b = new.select(*keys, F.struct(*values).alias("new"), F.lit(1).alias("in_new"))
    j = a.join(b, keys, "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.select(*keys, change.alias("change")).where("change IS NOT NULL")


def leaves(value: Column, kind: DataType, path: Column | None = None) -> Column:
    """Array of (section, path, leaf) of a document: fields by name, map values by key, array elements by their id, if they are structs with one, else by place; leaves as text. The section is the name at the top."""
    here = F.lit("") if path is None else path
    below = lambda name: F.concat(here, F.lit(".") if path is not None else F.lit(""), name)
    none = F.array().cast("array<struct<section:string,path:string,leaf:string>>")
    if isinstance(kind, StructType):
        parts = [leaves(value[f.name], f.dataType, below(F.lit(f.name))) for f in kind]
        return F.concat(none, *parts)
    if isinstance(kind, MapType):
        entries = F.coalesce(F.map_entries(value), F.array().cast(f"array<struct<key:{kind.keyType.simpleString()},value:{kind.valueType.simpleString()}>>"))
        return F.flatten(F.transform(entries, lambda e: leaves(e["value"], kind.valueType, below(e["key"].cast("string")))))
    if isinstance(kind, ArrayType):
        items = F.coalesce(value, F.array().cast(kind.simpleString()))
        named = isinstance(kind.elementType, StructType) and "id" in kind.elementType.names
        return F.flatten(F.transform(items, lambda x, i: leaves(x, kind.elementType, below(x["id"].cast("string") if named else i.cast("string")))))
    leaf = F.struct(F.split_part(here, F.lit("."), F.lit(1)).alias("section"), here.alias("path"), value.cast("string").alias("leaf"))
    return F.when(value.isNotNull(), F.array(leaf)).otherwise(none)


def section_diff(old: DataFrame, new: DataFrame, id_: str, document: str) -> DataFrame:
    """(id, section, n_added, n_removed, n_changed): sections at the top of two versions of a document that differ, by their leaves. A null leaf is none."""
    flat = lambda df: df.select(id_, F.explode(leaves(F.col(document), df.schema[document].dataType)).alias("x")).select(id_, "x.*")
    diff = changed_keys(flat(old), flat(new), [id_, "section", "path"], ["leaf"])
    count = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(f"n_{c}")
    return diff.groupBy(id_, "section").agg(count("added"), count("removed"), count("changed"))


def append_new(old: DataFrame, new: DataFrame, key: str, pos: str) -> DataFrame:
    """The old rows and, for keys they lack, the first new row by pos; applying it twice changes nothing."""
    cols = [c for c in old.columns if c not in (key, pos)]
    first = new.join(old.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(pos, *cols)).alias("r"))
    return old.unionByName(first.select(key, F.col(f"r.{pos}").alias(pos), *[F.col(f"r.{c}").alias(c) for c in cols]))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], pos: str, fields: list[str], metric: str) -> DataFrame:
    """The next version of a table of entities.

    Of several new rows of a key the latest by pos counts. A new null or empty string erases nothing; a new metric replaces
    the old one, which joins the history; tags are united; the first sighting stays. `origin` says new, updated or kept.
    old: keys, fields, metric, history array, tags array, first_seen; new: keys, pos, fields, metric, tags, seen.
    """
    latest = new.groupBy(*keys).agg(F.max_by(F.struct(*fields, metric, "seen"), pos).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("n_tags"))
    j = old.withColumn("in_old", F.lit(True)).join(latest.withColumn("in_new", F.lit(True)), keys, "full")
    blank = lambda c: F.when(c.cast("string") == "", None).otherwise(c)
    changed = F.col(f"n.{metric}").isNotNull() & F.col("in_old") & ~F.col(f"n.{metric}").eqNullSafe(F.col(metric)) & F.col(metric).isNotNull()
    none = F.array().cast(dict(old.dtypes)["history"])
    return j.select(
        *keys, *[F.coalesce(blank(F.col(f"n.{f}")), F.col(f)).alias(f) for f in fields], F.coalesce(F.col(f"n.{metric}"), F.col(metric)).alias(metric),
        F.when(changed, F.concat(F.coalesce("history", none), F.array(metric))).otherwise(F.coalesce("history", none)).alias("history"),
        F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("n_tags", F.array().cast("array<string>")))).alias("tags"),
        F.least("first_seen", F.col("n.seen")).alias("first_seen"),
        F.when(F.col("in_old").isNull(), "new").when(F.col("in_new"), "updated").otherwise("kept").alias("origin"),
    )


def lifecycle(state: DataFrame, run: DataFrame, key: str) -> DataFrame:
    """Defects after another run. state: key, status, history; run: key, failing.

    open stays open while it fails; fix_submitted becomes fixed or reopened; open that passes is resolved_without_fix; fixed
    or resolved that fails again is reopened; a defect whose row is gone is superseded; a new failing row is open.
    """
    s, failing = F.col("status"), F.col("failing")
    done = s.isin("fixed", "resolved_without_fix")
    after = (
        F.when(s.isNull() & failing, "open")
        .when(failing.isNull() & s.isNotNull(), "superseded")
        .when((s == "fix_submitted") & ~failing, "fixed")
        .when((s == "fix_submitted") & failing, "reopened")
        .when(s.isin("open", "reopened") & ~failing, "resolved_without_fix")
        .when(done & failing, "reopened")
        .otherwise(s)
    )
    j = state.join(run, key, "full").withColumn("after", after).where("after IS NOT NULL")
    past = F.coalesce("history", F.array().cast("array<string>"))
    return j.select(key, F.col("after").alias("status"), F.when(s.eqNullSafe(F.col("after")), past).otherwise(F.concat(past, F.array("after"))).alias("history"))


def guarded(rows: DataFrame, status: str, wanted: str, allowed: DataFrame, more: list[tuple[Column, str]] = ()) -> DataFrame:
    """Status changes that the table of allowed ones (from, to) has and no further rule forbids; others keep their status, with the reason."""
    j = rows.join(small(allowed.select(F.col("from").alias(status), F.col("to").alias(wanted), F.lit(True).alias("listed"))), [status, wanted], "left")
    reason = reduce(lambda acc, r: acc.when(r[0], r[1]), more, F.when(F.col("listed").isNull(), F.concat(F.col(status), F.lit(" to "), F.col(wanted), F.lit(" is not allowed"))))
    return j.withColumn("reason", reason).drop("listed").withColumn("after", F.when(F.col("reason").isNull(), F.col(wanted)).otherwise(F.col(status)))


def link_pairs(links: DataFrame, a: str, b: str, excluded: DataFrame, key: str) -> DataFrame:
    """Symmetric links, each once in either direction, without self links and without excluded ends."""
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(links.select(F.col(b).alias("a"), F.col(a).alias("b"))).where("a <> b").distinct()
    gone = excluded.select(F.col(key).alias("x")).distinct()
    return both.join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti")
