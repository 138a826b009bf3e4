"""Features of entities from their event tables; what was not analysed stays null and never counts as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles of captions that frame a whole video, and those whose shares are features.
FRAMING = ("title", "description", "identity_mark", "unknown")
SHARED = ("situation", "dialogue", "reaction", "speaker")


def entity_features(analysed: DataFrame, shots: DataFrame, captions: DataFrame, motion: DataFrame, sounds: DataFrame, entity: str, framing: tuple[str, ...] = FRAMING, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """One row for each entity with shots, captions or motion analysed.

    analysed: (entity, duration, has_shots, has_captions, has_motion, has_sounds); shots, motion: (entity, type); captions:
    (entity, role, start, end); sounds: (entity). Rates are per ten seconds, null without a duration above 0. An analysed
    source without events gives zeros, a source that was not analysed nulls. Each source is reduced by entity before it meets
    the others.
    """
    kind = lambda c, *names: F.count(F.when(F.col(c).isin(*names), 1))
    starts = lambda text: F.count(F.when(F.col("type").startswith(text), 1))
    timed = ~F.coalesce(F.col("role"), F.lit("unknown")).isin(*framing)
    by_shot = shots.groupBy(entity).agg(*[kind("type", t).alias(f"n_{t}") for t in ("cut", "flash", "crossfade")])
    by_caption = captions.groupBy(entity).agg(
        F.count(F.when(timed, 1)).alias("n_timed"), F.avg(F.when(timed, F.col("end") - F.col("start"))).alias("mean"),
        *[F.count(F.when(timed & (F.col("role") == r), 1)).alias(f"n_{r}") for r in shared],
        kind("role", "title").alias("n_title"), kind("role", "description").alias("n_description"),
    )
    by_motion = motion.groupBy(entity).agg(starts("zoom").alias("n_zoom"), kind("type", "freeze").alias("n_freeze"), kind("type", "speed").alias("n_speed"))
    by_sound = sounds.groupBy(entity).agg(F.count(F.lit(1)).alias("n_sounds"))
    j = analysed.where("has_shots OR has_captions OR has_motion")
    for part in (by_shot, by_caption, by_motion, by_sound):
        j = j.join(part, entity, "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = lambda c: F.when(F.col("duration") > 0, F.round(10.0 * count(c) / F.col("duration"), 4))
    part = lambda c: F.coalesce(F.round(F.col(c) / F.nullif(F.col("n_timed"), F.lit(0)), 4), F.lit(0.0))
    flag = lambda c: (count(c) > 0).cast("double")

    def of(source: str, value: Column, name: str) -> Column:
        return F.when(F.col(f"has_{source}"), value).alias(name)

    return j.select(
        entity, F.when(F.col("duration") > 0, F.col("duration").cast("double")).alias("duration_s"),
        *[of("shots", rate(f"n_{t}"), f"{name}_per_10s") for t, name in (("cut", "cuts"), ("flash", "flash"), ("crossfade", "crossfade"))],
        of("captions", rate("n_timed"), "captions_per_10s"), of("captions", F.coalesce(F.round("mean", 3), F.lit(0.0)), "caption_mean_dur_s"),
        *[of("captions", part(f"n_{r}"), f"share_{r}") for r in shared],
        of("captions", flag("n_title"), "has_title"), of("captions", flag("n_description"), "has_description"),
        of("motion", rate("n_zoom"), "zoom_per_10s"), of("motion", rate("n_freeze"), "freeze_per_10s"), of("motion", count("n_speed").cast("double"), "speed_events"),
        of("sounds", rate("n_sounds"), "sfx_per_10s"),
    )
