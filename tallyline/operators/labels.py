"""Human labels of sequences: tokens by aliases, the time of a reveal, and whether the two agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Purposes of a sequence's parts, other names for them, what parts them, and words for no reveal.
PURPOSES = ("hook", "context", "build", "reveal", "reaction", "outro")
ALIASES = {
    "훅": "hook", "후킹": "hook", "도입": "hook",
    "상황": "context", "배경": "context", "맥락": "context", "설명": "context",
    "전개": "build", "빌드업": "build", "고조": "build",
    "반전": "reveal", "공개": "reveal",
    "반응": "reaction", "리액션": "reaction",
    "마무리": "outro", "아웃트로": "outro", "끝": "outro",
}
SEPARATORS = r"\s*(?:>|→|->|,|/|\|)\s*"
NO_REVEAL = ("none", "no", "없음", "-")


def sequence(text: Column, names: tuple[str, ...] = PURPOSES, aliases: dict[str, str] = ALIASES, separators: str = SEPARATORS) -> Column:
    """Struct (parts, reason): the named parts in order, equal neighbours once; parts is null for no part, or, with a reason, for an unknown one."""
    known = F.create_map(*[F.lit(x) for pair in ({n: n for n in names} | aliases).items() for x in pair])
    tokens = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), separators), lambda t: t != "")
    named = F.transform(tokens, lambda t: F.try_element_at(known, F.lower(F.trim(t))))
    bad = F.element_at(F.filter(F.transform(tokens, lambda t: F.when(F.try_element_at(known, F.lower(F.trim(t))).isNull(), t)), lambda t: t.isNotNull()), 1)
    unknown = F.exists(named, lambda t: t.isNull())
    once = F.filter(F.transform(named, lambda t, i: F.when((i == 0) | (F.get(named, i - 1) != t), t)), lambda t: t.isNotNull())
    parts = F.when(~unknown & (F.size(tokens) > 0), once)
    return F.struct(parts.alias("parts"), F.when(unknown, F.concat(F.lit("unknown part: "), bad)).alias("reason"))


def reveal(text: Column) -> Column:
    """Struct (at, none, reason): seconds from 0 on, or whether the text says that there is none; all null for a blank text, a reason for another."""
    v = F.trim(F.coalesce(text, F.lit("")))
    none = F.lower(v).isin(*NO_REVEAL)
    t = F.when(~none, v.try_cast("double"))
    good = t.isNotNull() & ~F.isnan(t) & (t < float("inf")) & (t >= 0)
    return F.struct(F.when(good, t).alias("at"), F.when(v != "", none).alias("none"), F.when((v != "") & ~none & ~F.coalesce(good, F.lit(False)), F.concat(F.lit("not a time: "), v)).alias("reason"))


def disclosure(parts_text: Column, reveal_text: Column, duration: Column, part: str = "reveal") -> Column:
    """Struct (parts, at, fraction, reason): a whole label, or why it is none; all null where neither column is filled in.

    A label has parts and a time or "none", has the part named `part` just if there is a time, and its time lies within the duration.
    """
    s, r = sequence(parts_text), reveal(reveal_text)
    blank = (F.trim(F.coalesce(parts_text, F.lit(""))) == "") & (F.trim(F.coalesce(reveal_text, F.lit(""))) == "")
    has = F.array_contains(s["parts"], part)
    reason = (
        F.when(blank, F.lit(None).cast("string"))
        .when(s["reason"].isNotNull(), s["reason"])
        .when(r["reason"].isNotNull(), r["reason"])
        .when(s["parts"].isNull(), "no parts")
        .when(r["at"].isNull() & ~F.coalesce(r["none"], F.lit(False)), "no reveal time")
        .when(r["none"] & has, "a reveal part, but no reveal")
        .when(r["at"].isNotNull() & ~has, "a reveal, but no reveal part")
        .when(r["at"].isNotNull() & duration.isNull(), "duration unknown")
        .when(r["at"] > duration + 1e-6, "reveal after the end")
    )
    good = ~blank & reason.isNull()
    return F.struct(F.when(good, s["parts"]).alias("parts"), F.when(good, r["at"]).alias("at"), F.when(good, r["at"] / duration).alias("fraction"), reason.alias("reason"))
