"""Candidates of listed accounts: by an account's id, its page, or its handle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import small


def plain_handle(name: Column) -> Column:
    """Lower-case letters and digits of any script; signs, spaces and separators do not count."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def page_key(address: Column) -> Column:
    """A page's address in lower case without scheme, www., m. or mobile., query, fragment, or closing slashes."""
    bare = F.regexp_replace(F.lower(F.trim(address)), r"^(https://)?(http://)?(www\.)?(m\.)?(mobile\.)?", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^[^?#]*", 0), "/+$", "")


def excluded_accounts(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, ref, reason, other_platform): candidates that a listed account has posted, each with the first account that it matches, by ref.

    candidates: (id, platform, fields array<string>), the names, ids and addresses that a candidate has of its poster;
    listed: (ref, platform, handle, page, ids array<string>). Within an account an id goes before its page, a page before
    its handle. An id may stand anywhere in a field; a page equals a field that has a slash, a handle equals a field, each in
    their plain forms. A handle counts on another platform too, which other_platform says, where both are known.
    Null or blank fields, handles, pages and ids match nothing; a candidate without a match has no row.

    All three are one join by (reason, key): a field lists its stretches of the lengths that listed ids have, so an id is found by
    equality; an id, page or handle of several accounts is first cut to the first of them. Listed keys are broadcast if they are few (by count).
    """
    own = F.struct("ref", F.col("platform").alias("on"))
    row = lambda reason, key: F.struct(F.lit(reason).alias("reason"), key.alias("key"))
    text = lambda c: F.nullif(c, F.lit(""))
    ids = listed.select(own.alias("own"), F.explode("ids").alias("key")).where("key <> ''").select("own", F.lit("id").alias("reason"), "key")
    named = listed.select(own.alias("own"), F.explode(F.array(row("page", page_key(F.col("page"))), row("handle", plain_handle(F.col("handle"))))).alias("k")).select("own", "k.reason", "k.key").where("key <> ''")
    known = ids.unionByName(named).groupBy("reason", "key").agg(F.min("own").alias("own"))
    lengths = known.where("reason = 'id'").agg(F.collect_set(F.length("key")).alias("lengths"))
    field = candidates.select("id", "platform", F.explode("fields").alias("f")).where("f <> ''").crossJoin(F.broadcast(lengths))
    # substr takes no step past the end of a short field
    stretches = F.flatten(F.transform("lengths", lambda n: F.when(F.length("f") >= n, F.transform(F.sequence(F.lit(1), F.length("f") - n + 1), lambda i: F.substr(F.col("f"), i, n))).otherwise(F.array().cast("array<string>"))))
    keys = F.concat(
        F.transform(F.array_distinct(stretches), lambda s: row("id", s)),
        F.array(row("page", F.when(F.contains("f", F.lit("/")), text(page_key(F.col("f"))))), row("handle", text(plain_handle(F.col("f"))))),
    )
    asked = field.select("id", "platform", F.explode(keys).alias("k")).select("id", "platform", "k.reason", "k.key").where("key IS NOT NULL")
    order = F.when(F.col("reason") == "id", 0).when(F.col("reason") == "page", 1).otherwise(2)
    elsewhere = (F.col("reason") == "handle") & F.coalesce(text(F.col("platform")) != text(F.col("own.on")), F.lit(False))
    hit = asked.join(small(known), ["reason", "key"]).select("id", F.struct("own.ref", order.alias("p"), "reason", elsewhere.alias("other_platform")).alias("r"))
    return hit.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.ref", "r.reason", "r.other_platform")
