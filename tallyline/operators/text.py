"""Credits, mentions and accounts in free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_handle

#: Kinds of credits and how they are written; the first group is the account or address.
ADDRESS = r"https?://[^\s)\]>\"']+"
HANDLE = r"@?\w[\w.\-]{1,40}"
SEPARATOR = r"(?:\s*[:：=\-]\s*|\s+(?=@|https?://))"
CREDITS = [
    ("출처", rf"출처{SEPARATOR}({ADDRESS}|{HANDLE})"),
    ("credit", rf"(?i)\b(?:credits?|cr|source){SEPARATOR}(?:to\s+)?({ADDRESS}|{HANDLE})"),
    ("credit", rf"(?i)\b(?:video|filmed|shot|recorded|original(?:ly)?(?: posted)?) by\s+({ADDRESS}|{HANDLE})"),
    ("via", rf"(?i)\bvia\s+({ADDRESS}|{HANDLE})"),
]
MENTION = r"(?<![\w@])@([A-Za-z0-9_][A-Za-z0-9_.]{1,29})"


def extract_credits(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, kind, value, is_url, pos) of credits; of equal ones (case aside) the first stays, and a mention gives way to a credit of the same account."""
    def hits(pattern: str, kind: str, at: int):
        """The pattern's groups in the text, each with its kind and its place among all patterns'."""
        tidy = lambda v: F.regexp_replace(v, r"[.,;:!)]+$", "") if kind != "mention" else F.concat(F.lit("@"), F.regexp_replace(v, r"\.+$", ""))
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v, i: F.struct(F.lit(kind).alias("kind"), tidy(v).alias("value"), (F.lit(at).cast("long") + i).alias("pos")))

    found = [hits(rx, kind, n << 40) for n, (kind, rx) in enumerate(CREDITS)]
    mention = hits(MENTION, "mention", len(CREDITS) << 40)
    all_ = rows.select(id_, F.explode(F.concat(*found, mention)).alias("c")).select(id_, "c.*").where("value <> ''")
    first = all_.withColumn("r", F.row_number().over(Window.partitionBy(id_, "kind", F.lower("value")).orderBy("pos"))).where("r = 1").drop("r")
    first = first.withColumn("is_url", F.col("value").startswith("http")).withColumn("norm", normal_handle(F.col("value")))
    named = F.max(F.when((F.col("kind") != "mention") & ~F.col("is_url"), 1)).over(Window.partitionBy(id_, "norm"))
    return first.withColumn("named", named).where("kind <> 'mention' OR named IS NULL").select(id_, "kind", "value", "is_url", "pos")


def authorship(items: DataFrame, credits: DataFrame, id_: str, uploader: str, uploader_id: str | None = None, hint: str | None = None, hint_basis: str | None = None, original_url: str | None = None) -> DataFrame:
    """(id, author, basis, original_url, reposter): the first named credit, else the hint of the metadata, else the only mention of
    someone else, else nobody if an original address is known, else the uploader.

    Someone else is neither the uploader's name nor its id. hint, hint_basis (metadata, if null), original_url: columns of items, if they have them.
    """
    c = credits.groupBy(id_).agg(
        F.min(F.when((F.col("kind") != "mention") & ~F.col("is_url"), F.struct("pos", "value"))).alias("named"),
        F.min(F.when((F.col("kind") != "mention") & F.col("is_url"), F.struct("pos", "value"))).alias("address"),
        F.collect_set(F.when(F.col("kind") == "mention", F.col("value"))).alias("mentions"),
    )
    j = items.join(c, id_, "left")
    own = [normal_handle(F.col(c)) for c in (uploader, uploader_id) if c]
    differs = lambda name: (normal_handle(name) != "") & ~F.coalesce(F.array_contains(F.array(*[F.coalesce(u, F.lit("")) for u in own]), normal_handle(name)), F.lit(False))
    none = F.lit(None).cast("string")
    hinted, link = F.nullif(F.col(hint), F.lit("")) if hint else none, F.nullif(F.col(original_url), F.lit("")) if original_url else none
    only = F.when(F.size("mentions") == 1, F.try_element_at("mentions", F.lit(1)))
    mentioned = only.isNotNull() & differs(only)
    author = F.when(F.col("named").isNotNull(), F.col("named.value")).when(hinted.isNotNull(), hinted).when(mentioned, only).when(link.isNotNull(), none).otherwise(F.col(uploader))
    because = F.coalesce(F.nullif(F.col(hint_basis), F.lit("")) if hint_basis else none, F.lit("metadata"))
    basis = F.when(F.col("named").isNotNull(), "description_credit").when(hinted.isNotNull(), because).when(mentioned, "description_mention").when(link.isNotNull(), "external_link").when(F.col(uploader).isNotNull(), "uploader").otherwise("unknown")
    out = j.withColumn("author", author).withColumn("basis", basis)
    reposter = F.when(F.col(uploader).isNotNull() & (F.col("author").isNull() | differs(F.col("author"))), F.col(uploader))
    return out.select(id_, "author", "basis", F.coalesce(link, F.col("address.value")).alias("original_url"), reposter.alias("reposter"))
