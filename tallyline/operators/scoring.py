"""Scores: a total is given only if each of its parts is measured, with the list of those that are not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the parts of a total, scales of file quality, and the factor of a watermark.
WEIGHTS = {"recency": 0.20, "intensity": 0.25, "reversal": 0.20, "quality": 0.15, "format_fit": 0.20}
SHORT_SIDE, BITS_PER_PIXEL, SHARPNESS = 1080.0, 0.05, 150.0
WATERMARK_FACTOR = 0.7


def names_where(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order, joined by commas."""
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull()), ",")


def review_problems(watched_by: Column, notes: Column, items: dict[str, Column], watermark: Column | None = None) -> Column:
    """What makes a review unusable; empty for a valid one."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = {"watched_by": blank(watched_by), "notes": blank(notes)}
    found |= {n: ~F.coalesce(c.between(1, 5), F.lit(False)) for n, c in items.items()}
    if watermark is not None:
        found["watermark"] = watermark.isNotNull() & ~watermark.isin("present", "absent")
    return names_where(found)


def originality(answer: Column, reposter: Column, original_url: Column, url: Column) -> Column:
    """repost, confirmed_original or unconfirmed: a reviewer's answer, then a credit to someone else, then another original address."""
    return (
        F.when(answer == "no", "repost")
        .when((answer == "yes") & reposter.isNull(), "confirmed_original")
        .when(reposter.isNotNull() | (original_url.isNotNull() & (original_url != F.coalesce(url, F.lit("")))), "repost")
        .otherwise("unconfirmed")
    )


def repost_aware(label: Column, state: Column, original_label: Column) -> Column:
    """A known original's date decides; without it a repost is old or unknown, and a recent upload that nobody confirmed is unknown."""
    own = F.when((state == "repost") & (label != "old"), "unknown").when((state == "unconfirmed") & (label == "recent"), "unknown").otherwise(label)
    return F.coalesce(original_label, own)


def quality(short_side: Column, bpp: Column, sharpness: Column, watermark: Column) -> Column:
    """Mean of three capped parts, less a share for a watermark; null unless all are measured."""
    parts = [F.when(c.isNotNull(), F.least(F.lit(1.0), c / full)) for c, full in ((short_side, SHORT_SIDE), (bpp, BITS_PER_PIXEL), (sharpness, SHARPNESS))]
    return reduce(lambda a, b: a + b, parts) / 3 * F.when(watermark == "present", WATERMARK_FACTOR).otherwise(1.0)


def total(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> tuple[Column, Column]:
    """(weighted mean, names of unmeasured parts, sorted): the mean is null if a part is."""
    score = reduce(lambda a, b: a + b, [parts[n] * w for n, w in weights.items()]) / sum(weights.values())
    return score, names_where({n: parts[n].isNull() for n in sorted(parts)})
