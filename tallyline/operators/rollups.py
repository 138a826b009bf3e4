"""Roll-ups of events, mentions and signatures by entity; each groups before it joins, and gathers no group whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import rounded, small


def tail_after_marks(rows: DataFrame, entity: str, at: str, end: str, mark: Column) -> DataFrame:
    """(entity, tail, no_mark): the time between the last end of a marked event, no later than the last event's start, and that start.

    Without a mark the tail is the whole time since 0 and no_mark is true. One aggregation; times and ends that are null don't count.
    """
    last = F.when(mark, F.coalesce(end, at))
    g = rows.groupBy(entity).agg(F.max(at).alias("_stop"), F.max(last).alias("_mark"))
    kept = F.when(F.col("_mark").isNotNull(), F.least("_mark", "_stop"))
    return g.select(entity, rounded(F.col("_stop") - F.coalesce(kept, F.lit(0.0))).alias("tail"), F.col("_mark").isNull().alias("no_mark"))


def first_known_time(rows: DataFrame, entity: str, at: str, known: Column, unknown: Column, slack: float) -> DataFrame:
    """(entity, first_t) of entities with a known event: when the first one is, or null if an unknown event lies more than slack before it."""
    g = rows.groupBy(entity).agg(F.min(F.when(known, F.col(at))).alias("_t0"), F.min(F.when(unknown, F.col(at))).alias("_u0"))
    hidden = F.coalesce(F.col("_u0") < F.col("_t0") - slack, F.lit(False))
    return g.where("_t0 IS NOT NULL").select(entity, F.when(~hidden, rounded("_t0")).alias("first_t"))


def longest_in_order(rows: DataFrame, entity: str, id_: str, length: str, at: str, k: int) -> DataFrame:
    """(entity, id, pos): the k longest of each entity, of equal ones the smallest ids, numbered from 1 by time, then id. Null lengths come last."""
    top = rows.withColumn("_r", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(length), id_))).where(F.col("_r") <= k)
    return top.select(entity, id_, F.row_number().over(Window.partitionBy(entity).orderBy(at, id_)).alias("pos"))


def extremes(rows: DataFrame, group: str, value: str, id_: str, *ties: str) -> DataFrame:
    """(group, low, low_at, high, high_at): the smallest and largest known value of each group and the row that has it, of equal ones the first by id, then ties."""
    order = [id_, *ties]
    known = F.col(value).isNotNull()
    first = F.min(F.when(known, F.struct(value, *order)))
    last = F.max(F.when(known, F.struct(F.col(value), *[(-F.col(c)).alias(c) for c in order])))
    out = rows.groupBy(group).agg(first.alias("_a"), last.alias("_b"))
    return out.select(group, F.col(f"_a.{value}").alias("low"), F.col(f"_a.{id_}").alias("low_at"), F.col(f"_b.{value}").alias("high"), (-F.col(f"_b.{id_}")).alias("high_at"))


def fixed_alignment(rows: DataFrame, group: str, positions: dict[str, Column], margin: float = 1.02) -> DataFrame:
    """(group, alignment, sd_<name>): the one of several positions that varies least; undecided if the next one is within the margin, null without positions."""
    sd = rows.groupBy(group).agg(*[F.stddev_pop(c).alias(f"_{n}") for n, c in positions.items()])
    cols = {n: F.col(f"_{n}") for n in positions}
    low, second = F.least(*cols.values()), F.sort_array(F.array(*cols.values()))[1]
    name = F.coalesce(*[F.when(c == low, F.lit(n)) for n, c in cols.items()])
    return sd.select(group, F.when(low * margin >= second, "undecided").otherwise(name).alias("alignment"), *[rounded(c).alias(f"sd_{n}") for n, c in cols.items()])


def top_words(rows: DataFrame, entity: str, pos: str, text: str, stop: list[str], k: int, shortest: int = 3, pattern: str = "[a-z]+") -> DataFrame:
    """(entity, word, n, first_<pos>, rank): the k most frequent words of each entity's texts in small letters; of equal ones the one seen first, then by name."""
    words = rows.select(entity, pos, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word")).where((F.length("word") >= shortest) & ~F.col("word").isin(*stop))
    c = words.groupBy(entity, "word").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias(f"first_{pos}"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("n"), f"first_{pos}", "word"))).where(F.col("rank") <= k)


def first_ids(rows: DataFrame, by: str, id_: str, limit: int, name: str) -> DataFrame:
    """(by, name): the smallest different ids of each group, in order; no more than `limit` of a group are gathered."""
    few = rows.where(F.col(id_).isNotNull()).select(by, id_).distinct().withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy(id_))).where(F.col("_p") <= limit)
    return few.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(id_)), lambda x: x.cast("string")), ",").alias(name))


def account_rollup(mentions: DataFrame, account: str, entity: str, verified: Column, limit: int = 20) -> DataFrame:
    """(account, n_entities, n_mentions, verified, evidence): an account is verified if any of its mentions is; evidence are its first entities, a null account is one account."""
    g = mentions.groupBy(account).agg(F.count_distinct(entity).alias("n_entities"), F.count(F.lit(1)).alias("n_mentions"), F.bool_or(verified).alias("verified"))
    proof = first_ids(mentions, account, entity, limit, "evidence").withColumnRenamed(account, "_of")
    return g.join(proof, F.col(account).eqNullSafe(F.col("_of")), "left").select(account, "n_entities", "n_mentions", "verified", F.coalesce("evidence", F.lit("")).alias("evidence"))


def with_origins(parts: dict[str, DataFrame], *keys: str, name: str = "origins") -> DataFrame:
    """(keys, name, n): rows of several origins as one row for each key, with the names of its origins, sorted, and its number of rows."""
    stacked = None
    for origin, rows in parts.items():
        one = rows.select(*keys, F.lit(origin).alias("_origin"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("_origin")), ",").alias(name), F.count(F.lit(1)).alias("n"))


def freshest(parts: list[DataFrame], key: str, value: str, at: str, order: str) -> DataFrame:
    """(key, value): of rows of several layers the newest by time; of equal times that of the earlier layer, then of the smaller order. Rows without a time give way to all others."""
    stacked = None
    for layer, rows in enumerate(parts):
        one = rows.select(key, value, at, order, F.lit(-layer).alias("_layer"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.groupBy(key).agg(F.max_by(value, F.struct(at, "_layer", (-F.col(order)).alias("_o"))).alias(value))


def signature(rows: DataFrame, key: str, id_: str, *fields: str) -> DataFrame:
    """(key, sign): a digest of each key's rows, whatever their order: two sums of 60 bits of the rows' digests and their number, so nothing is gathered.

    Equal signs of different rows are as likely as equal md5 sums by chance; a repeated row counts twice.
    """
    text = F.to_json(F.struct(id_, *fields), {"ignoreNullFields": "false"})
    bits = lambda start: F.sum(F.conv(F.substring(F.md5(text), start, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(key).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), bits(1), bits(16)).alias("sign"))


def staleness(now: DataFrame, approved: DataFrame, key: str, sign: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, state): approved if the rows that were approved are those of now, stale if they differ, never approved without any."""
    then = sign(approved).withColumnRenamed("sign", "_then")
    state = F.when(F.col("_then").isNull(), "never approved").when(F.col("_then") == F.col("sign"), "approved").otherwise("stale")
    return sign(now).join(then, key, "left").select(key, state.alias("state"))


def said_before(rows: DataFrame, entity: str, pos: str, text: str, pattern: str) -> DataFrame:
    """(entity, pos) of the rows before an entity's last one whose text holds, in small letters, the first match of a pattern in that last text."""
    last = rows.groupBy(entity).agg(F.max(F.struct(pos, text)).alias("_r")).select(F.col(entity).alias("_e"), F.col(f"_r.{pos}").alias("_last"), F.lower(F.regexp_extract(F.col(f"_r.{text}"), pattern, 0)).alias("_word"))
    return rows.join(last, F.col(entity) == F.col("_e")).where((F.col(pos) < F.col("_last")) & (F.col("_word") != "") & F.contains(F.lower(text), F.col("_word"))).select(entity, pos)


def unobserved(rows: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys were never observed; a null key was not."""
    return rows.join(observed.select(*keys).distinct(), list(keys), "left_anti")


def use_verdict(used: DataFrame, policy: DataFrame, kind: str) -> DataFrame:
    """used with present and verdict: not allowed (used where the policy has it absent), unused (not used where it is present), else ok.

    used: (entity, kind, used); policy: (kind, present). Kinds that the policy does not name are left out.
    """
    verdict = F.when(F.col("used") & ~F.col("present"), "not allowed").when(~F.col("used") & F.col("present"), "unused").otherwise("ok")
    return used.join(small(policy.select(kind, "present")), kind).withColumn("verdict", verdict)
