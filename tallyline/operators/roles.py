"""The style of each role of captions in an entity: medians, modes, edges that stay put, motions, colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .colors import color_mode
from .stats import rounded, tri_state

#: Share of the duration from which a caption stays for the whole, and limits (px) of edges that count as fixed.
WHOLE, SAME_WIDTH, STILL = 0.9, 8, 4
MODES = ("align", "outline_visibility", "motion_in", "motion_out")
MEDIANS = ("size", "ink_h", "shadow", "line_spacing", "lead")
ITEM = ("id", "start", "end", "x", "y", "w", "h", "n_lines", "left", "right", "anchor_x", "outline", "box", "box_alpha", "pad_x", "pad_y", "chars", "highlight", "in_dur", "in_scale", "in_offset", "in_direction", "out_dur", "out_direction")
COLORS = ("color", "highlight", "outline_color", "shadow_color", "box_color")


def _median(value: Column) -> Column:
    return F.round(F.median(value.cast("double")), 3)


def _fixed_edge(spread: dict[str, Column], limit: Column) -> Column:
    """The name with the smallest spread, if that is within the limit and all others are at least twice as large (and 2 px); else unmeasured."""
    low = F.least(*spread.values())
    best = reduce(lambda c, n: c.when(spread[n] == low, n), list(spread)[1:], F.when(spread[next(iter(spread))] == low, next(iter(spread))))
    second = F.sort_array(F.array(*spread.values()))[1]
    return F.when((low <= limit) & (second >= 2 * F.greatest(low, F.lit(1.0))), best).otherwise("unmeasured")


def _modes(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, one column for each of MODES): the most frequent known value, of equal ones that of the item that starts first."""
    cells = F.array(*[F.struct(F.lit(m).alias("_what"), F.nullif(F.col(m), F.lit("unmeasured")).alias("_v")) for m in MODES])
    named = items.select(*by, F.struct("start", "id").alias("_at"), F.explode(cells).alias("_c")).select(*by, "_at", "_c.*").where("_v IS NOT NULL")
    counted = named.groupBy(*by, "_what", "_v").agg(F.count(F.lit(1)).alias("_k"), F.min("_at").alias("_at"))
    best = counted.groupBy(*by, "_what").agg(F.sum("_k").alias("_n"), F.min(F.struct((-F.col("_k")).alias("k"), F.col("_at").alias("at"), F.col("_v").alias("v"))).alias("_b"))
    of = lambda m, c: F.max(F.when(F.col("_what") == m, F.col(c)))
    return best.groupBy(*by).agg(*[of(m, "_b.v").alias(f"{m}_mode") for m in MODES], *[of(m, "_n").alias(f"n_{m}") for m in MODES[2:]])


def _edges(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, still, valign): which edge stays put, left to right over all items, and up and down between the items of fewest and of most lines."""
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    wide = items.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), (F.max(w) - F.min(w)).alias("_widths"), F.stddev_pop(x).alias("_left"), F.stddev_pop(x + w / 2).alias("_center"), F.stddev_pop(x + w).alias("_right"))
    across = F.when((F.col("_n") >= 2) & (F.col("_widths") >= SAME_WIDTH), _fixed_edge({e: F.col(f"_{e}") for e in ("left", "center", "right")}, F.lit(float(STILL)))).otherwise("unmeasured")
    lines = items.groupBy(*by, F.coalesce(F.nullif("n_lines", F.lit(0)), F.lit(1)).alias("_k")).agg(F.median(y).alias("_top"), F.median(y + h / 2).alias("_middle"), F.median(y + h).alias("_bottom"), F.median(h).alias("_h"))
    both = lines.groupBy(*by).agg(F.count(F.lit(1)).alias("_kinds"), *[f(F.struct("_k", "_top", "_middle", "_bottom", "_h")).alias(n) for f, n in ((F.min, "_a"), (F.max, "_b"))])
    moved = {e: F.abs(F.col(f"_a._{e}") - F.col(f"_b._{e}")) for e in ("top", "middle", "bottom")}
    upright = F.when(F.col("_kinds") >= 2, _fixed_edge(moved, F.greatest(F.lit(3.0), 0.1 * F.least("_a._h", "_b._h")))).otherwise("unmeasured")
    return wide.select(*by, across.alias("still")).join(both.select(*by, upright.alias("valign")), by)


def role_styles(items: DataFrame, frames: DataFrame, entity: str, evidence: int = 5) -> DataFrame:
    """One row for each entity and role of its captions; what no item shows is null, and no items give no row.

    items: (entity, id, role, start, end, x, y, w, h, n_lines, size, ink_h, align, left, right, anchor_x, outline, outline_visibility,
    shadow, box (present, absent or null), box_alpha, pad_x, pad_y, line_spacing, chars, highlight, motion_in, in_dur, in_scale, in_offset,
    in_direction, motion_out, out_dur, out_direction, lead); frames: (entity, duration). Items without a role are left out. align is the most frequent stated
    one, else the edge that stays put; the anchor is at that edge. Durations and directions of motions are those of the most frequent one.
    The items are grouped by (entity, role), once for the modes and edges and once with them; a buffer holds the distinct values of one role of one entity.
    """
    by = [entity, "role"]
    rows = items.where("role IS NOT NULL").select(*by, *ITEM, *MEDIANS, *MODES)
    known = rows.join(_modes(rows, by), by, "left").join(_edges(rows, by), by).withColumn("_align", F.coalesce("align_mode", "still"))
    length = F.col("end") - F.col("start")
    x = F.when(F.col("_align") == "left", F.col("left")).when(F.col("_align") == "right", F.col("right")).otherwise(F.col("anchor_x"))
    y = F.when(F.col("valign") == "top", F.col("y")).when(F.col("valign") == "bottom", F.col("y") + F.col("h")).otherwise(F.col("y") + F.col("h") / 2)
    boxed, box = F.col("box") == "present", F.when(F.col("box").isin("present", "absent"), F.col("box") == "present")
    lasting = F.coalesce(F.bool_or(length >= WHOLE * F.col("duration")), F.lit(False))

    def of(motion: str, value: str, like: str) -> Column:
        """The median over the items that move as most of them do, if that motion is like a pattern."""
        top = F.col(f"{motion}_mode")
        return _median(F.when((F.col(motion) == top) & top.like(like), F.col(value)))

    named = known.join(frames.select(entity, "duration"), entity, "left").groupBy(*by)
    out = named.agg(
        F.count(F.lit(1)).alias("n_items"), *[_median(F.col(c)).alias(c) for c in MEDIANS], F.first("_align").alias("align"), F.first("valign").alias("valign"), _median(x).alias("anchor_x"), _median(y).alias("anchor_y"),
        _median(F.when(F.col("outline_visibility").isin("visible", "none"), F.col("outline"))).alias("outline"), F.first("outline_visibility_mode").alias("outline_visibility"), tri_state(F.col("highlight").isNotNull()).alias("highlight_presence"),
        tri_state(box).alias("box"), F.round(F.avg(F.coalesce(boxed, F.lit(False)).cast("int")), 3).alias("box_share"), *[_median(F.when(boxed, F.col(c))).alias(c) for c in ("box_alpha", "pad_x", "pad_y")],
        F.max("chars").alias("max_chars"), F.max("n_lines").alias("max_lines"), F.max("w").alias("max_width"),
        F.first("motion_in_mode").alias("motion_in"), F.coalesce(F.first("n_motion_in"), F.lit(0)).alias("n_motion_in"), of("motion_in", "in_dur", "%").alias("in_dur"), of("motion_in", "in_scale", "pop").alias("in_scale"),
        of("motion_in", "in_offset", "slide%").alias("in_offset"), of("motion_in", "in_direction", "slide%").alias("in_direction"),
        F.first("motion_out_mode").alias("motion_out"), F.coalesce(F.first("n_motion_out"), F.lit(0)).alias("n_motion_out"), of("motion_out", "out_dur", "%").alias("out_dur"), of("motion_out", "out_direction", "slide%").alias("out_direction"),
        F.round(F.min(length), 3).alias("min_dur"), _median(length).alias("dur_p50"), F.when(lasting, "whole_video").otherwise("timed").alias("persist"),
    )
    first = rows.select(*by, "start", "id", F.row_number().over(Window.partitionBy(*by).orderBy("start", "id")).alias("r")).where(F.col("r") <= evidence)
    proof = first.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda s: s["id"].cast("string")), ",").alias("evidence"))
    return out.join(proof, by)


def role_colors(items: DataFrame, entity: str) -> DataFrame:
    """(entity, role, what, color, n, share): the dominant colour of each of COLORS that items have; a box's colour counts where a box is present.

    Colours join clusters in the order of start and id, those of one role of one entity in one task, which holds clusters and not items.
    """
    cell = lambda c: F.struct(F.lit(c).alias("what"), (F.when(F.col("box") == "present", F.col(c)) if c == "box_color" else F.col(c)).alias("color"))
    rows = items.where("role IS NOT NULL").select(F.col(entity), "role", "start", "id", F.explode(F.array(*[cell(c) for c in COLORS if c in items.columns])).alias("_c"))
    keyed = rows.select(F.to_json(F.struct(F.col(entity).alias("e"), F.col("role").alias("r"), F.col("_c.what").alias("w"))).alias("_key"), F.struct("start", "id").alias("_pos"), F.col("_c.color").alias("color"))
    kind = dict(items.dtypes)
    names = f"e {kind[entity]}, r {kind['role']}, w string"
    best = color_mode(keyed, "_key", "color", "_pos").withColumn("_k", F.from_json("_key", names))
    return best.select(F.col("_k.e").alias(entity), F.col("_k.r").alias("role"), F.col("_k.w").alias("what"), "color", "n", rounded("share").alias("share"))
